import random

import numpy as np
from roundtide.llm import neardup
from roundtide.llm.graph import components


def shingles(text, width):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_equal_brute_force(make_docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(80)]
    rows = []
    for i in range(160):  # a large group of copies with growing changes, many of them stragglers
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(80)] = f"x{rng.randrange(10_000)}"
        rows.append((1000 + i, " ".join(words)))
    passage = [f"p{k}" for k in range(60)]
    for i in range(60):  # texts that share a passage and nothing else
        rows.append((3000 + i, " ".join(passage + [f"q{rng.randrange(10_000)}" for _ in range(15)])))
    for i in range(120):
        rows.append((5000 + i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30)))))
    rows += [(9000 + i, rows[i % 7][1].upper() + "\n") for i in range(40)]
    for width in (2, 5):
        got = neardup.near_duplicates(make_docs(rows), width, 80).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width, 80)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    sign = neardup.signer(neardup.BANDS, neardup.ROWS)
    for true in (0.8, 0.9, 1.0):
        errors = []
        for _ in range(40):
            n = 400
            shared = round(2 * n * true / (1 + true))
            pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.int64).astype(np.uint64)
            s, t = pool[:n], np.concatenate([pool[:shared], pool[n:]])
            a, b = sign(s)[1], sign(t)[1]
            bits = np.unpackbits((a ^ b).view(np.uint8)).sum()
            errors.append(neardup.sketch_similarity(np.array([bits]), 120)[0] - true)
        assert abs(np.mean(errors)) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    got = neardup.near_duplicates(odd_docs, 2).collect()
    assert len(got) == len(odd_rows)
    expected = brute(odd_rows, 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == expected
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(empty_docs).count() == 0
