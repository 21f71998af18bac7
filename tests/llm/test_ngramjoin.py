import random

from roundtide.llm import ngramjoin
from test_neardup import brute


def rows_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def made_rows(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    rows = []
    for i in range(140):  # near copies at, above and under the threshold
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(160)] = f"x{rng.randrange(10_000)}"
        rows.append((1000 + i, " ".join(words)))
    chain = [f"c{k}" for k in range(120)]
    for i in range(12):  # each linked with the next ones only
        rows.append((2000 + i, " ".join(chain[3 * i : 3 * i + 80])))
    passage = [f"p{k}" for k in range(60)]
    for i in range(60):  # a shared passage and nothing else
        rows.append((3000 + i, " ".join(passage + [f"q{rng.randrange(10_000)}" for _ in range(25)])))
    for i in range(120):
        rows.append((5000 + i, " ".join(f"w{rng.randrange(8)}" for _ in range(rng.randrange(1, 12)))))
    rows += [(9000 + i, rows[i % 7][1].upper() + "\n") for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_equal_brute_force(make_docs, monkeypatch):
    for name, value in (("BLOCK", 8), ("FREQUENT", 6), ("SLICE", 2)):  # few rows fill several blocks and both joins
        monkeypatch.setattr(ngramjoin, name, value)
    rows = made_rows(8)
    assert rows_of(ngramjoin.linked_documents(make_docs(rows).repartition(3), 3, 90)) == brute(rows, 3, 90)


def test_no_hub_rounds(make_docs, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HUB_ROUNDS", 0)  # the blocks alone find all links
    rows = made_rows(1)
    assert rows_of(ngramjoin.linked_documents(make_docs(rows), 2, 80)) == brute(rows, 2, 80)


def test_texts_of_one_id_join_their_links(make_docs):
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(5, a), (7, a), (7, b), (3, b + " more"), (9, "alone in the world")]
    got = ngramjoin.linked_documents(make_docs(rows), 3, 90).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (7, 3), (7, 3), (9, 9)]


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    got = ngramjoin.linked_documents(odd_docs, 3).collect()
    assert len(got) == len(odd_rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(odd_rows, 3, 90)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngramjoin.linked_documents(empty_docs).count() == 0
