import itertools
import random

import numpy as np
from roundtide.llm import decontaminate as d


def brute(docs, items):
    """All diagonals of all pairs, token by token."""
    found = {}
    for i, t in docs:
        for j, s in items:
            doc, item = d.tokens(t or ""), d.tokens(s or "")
            best = 0
            for shift in range(-len(item), len(doc)):
                run = 0
                score = 0
                for k in range(len(item)):
                    if 0 <= k + shift < len(doc):
                        if doc[k + shift] == item[k]:
                            score, run = score + 1, run + 1
                        else:
                            score -= 3
                            if score < 0:
                                score = run = 0
                        best = max(best, run) if score > 0 else best
            if item and best >= d.needed(len(item)):
                found[i, j] = best
    return found


def rows_of(rng):
    vocabulary = [f"t{k}" for k in range(150)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(14, 50)))) for k in range(25)]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, len(passage) // 8 + 1)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in passage]
        docs.append((i, " ".join(words)))
    return docs, items


def test_hits_equal_brute_force(spark, make_docs):
    docs, items = rows_of(random.Random(4))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in d.contaminated(make_docs(docs), benchmark).collect()}
    expected = brute(docs, items)
    assert len(expected) > 40
    assert set(got) == set(expected)


def test_best_stretch_allows_substitutions():
    assert d.best_stretch(np.array([1, 1, 1, 1, 0, 1, 1, 1, 1], bool)) == (8, 0, 9)
    assert d.best_stretch(np.array([0, 0, 1, 1, 0, 0], bool)) == (2, 2, 4)
    assert d.best_stretch(np.array([], bool)) == (0, 0, 0)


def test_odd_rows(spark, odd_docs, empty_docs):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "short"), (4, " ".join(f"w{i}" for i in range(40))), (4, "other text")], "item_id long, text string")
    got = d.contaminated(odd_docs, benchmark).collect()
    assert {r["doc_id"] for r in got} <= {8}
    assert d.contaminated(empty_docs, benchmark).count() == 0
    assert d.contaminated(odd_docs, benchmark.limit(0)).count() == 0


def ruled(equal):
    """Most equal tokens of any stretch that is three quarters equal, all stretches tried."""
    n = len(equal)
    sums = [sum(equal[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 4 * sum(equal[a:b]) >= 3 * (b - a)]
    return max(sums, default=0)


def test_best_stretch_equals_all_stretches():
    rng = random.Random(7)
    for _ in range(300):
        share = rng.choice([0.5, 0.7, 0.75, 0.8, 0.9])
        equal = [rng.random() < share for _ in range(rng.randrange(0, 40))]
        n, a, b = d.best_stretch(np.array(equal, bool))
        assert n == ruled(equal) == sum(equal[a:b]) and 4 * n >= 3 * (b - a)
    assert d.best_stretch(np.array([1, 1, 1, 0] * 14 + [1, 1, 1], bool)) == (45, 0, 59)
    assert d.best_stretch(np.array([int(c == "E") for c in "EEEEEEMEEEMEEEME"], bool)) == (13, 0, 16)


def test_passages_with_a_quarter_replaced(spark, make_docs):
    rng = random.Random(8)
    vocabulary = [f"t{k}" for k in range(4000)]
    items, docs, expected = [], [], {}
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(16, 60))]
        items.append((k, " ".join(words)))
        # a run of nine that the masks hit, then one token in five to one in four replaced
        equal = [i < 9 or (i % 4 if k % 2 else i % 5) != 0 for i in range(len(words))]
        passage = [w if e else "changed" for w, e in zip(words, equal)]
        docs.append((k, " ".join([rng.choice(vocabulary) for _ in range(20)] + passage + ["tail"] * 20)))
        if (n := ruled(equal)) >= d.needed(len(words)):
            expected[k, k] = n
    # every fourth token replaced from the start on, and runs of 6, 3, 3 and 1
    for k, kept in ((100, "EEEM" * 14 + "EEE"), (101, "EEEEEEMEEEMEEEME")):
        words = [f"u{k}x{i}" for i in range(len(kept))]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join(w if c == "E" else "changed" for w, c in zip(words, kept))))
        expected[k, k] = kept.count("E")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in d.contaminated(make_docs(docs), benchmark).collect()}
    assert len(expected) > 50 and got == expected


def test_short_masks_hit_whatever_is_substituted():
    for n in range(3, d.SHORT_ITEM):
        for kept in itertools.product((0, 1), repeat=n):
            if ruled(kept) >= d.needed(n):
                row = "".join(map(str, kept))
                assert any(
                    all(row[i + k] == "1" for k, c in enumerate(m) if c == "1")
                    for m in d.SHORT_MASKS for i in range(n - len(m) + 1)
                ), row


def test_short_items_equal_brute_force(spark, make_docs):
    rng = random.Random(9)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 14)))) for k in range(40)]
    docs = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))]
        passage = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, len(passage) // 4 + 1)):
            passage[rng.randrange(len(passage))] = "changed"
        at = rng.randrange(len(words))
        words[at:at] = passage
        docs.append((i, " ".join(words)))
    expected = {}
    for i, t in docs:
        for j, s in items:
            doc, item = d.tokens(t), d.tokens(s)
            rows = ([0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(item)] for shift in range(-len(item), len(doc)))
            if (best := max(map(ruled, rows))) >= d.needed(len(item)):
                expected[i, j] = best
    benchmark = spark.createDataFrame([*items, (90, "one"), (91, "two words"), (None, "a b c")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in d.contaminated(make_docs(docs), benchmark).collect()}
    assert len(expected) > 100 and got == expected


def test_an_item_id_with_several_texts_is_searched_for_each(spark, make_docs):
    first, second = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    benchmark = spark.createDataFrame([(1, first), (1, second), (1, first)], "item_id long, text string")
    got = d.contaminated(make_docs([(1, first), (2, second), (3, "a0 b1")]), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched"]) for r in got) == [(1, 1, 20), (2, 1, 20)]
