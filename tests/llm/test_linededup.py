import random

import numpy as np
from roundtide.llm import linededup as ld

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_length=40, min_docs=5):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_length:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, t in rows:
        stay = []
        for line in (t or "").split("\n"):
            who = holders.get(line.strip(SPACE).translate(LOWER), set())
            known = [x for x in who if x is not None]
            if len(who) < min_docs or not known or i is not None and i == max(known):
                stay.append(line)
        out[i] = ((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(stay), "\n".join(stay))
    return out


def test_lines_equal_brute_force(make_docs):
    rng = random.Random(2)
    pool = ["Shared " + " ".join(rng.choice("abcdefgh") * 4 for _ in range(10)) for _ in range(30)]
    rows = []
    for i in range(200):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own line {rng.random()} of document {i} with enough letters" for _ in range(6)]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " "]) for x in lines]
        rows.append((i, "\n".join(lines + ["ö" * 39, "ö" * 40])))
    got = ld.dedup_lines(make_docs(rows), counts=("n", "gone")).collect()
    assert {r["doc_id"]: (r["n"], r["gone"], r["text"]) for r in got} == brute(rows)


def test_filter_passes_every_repeated_line(make_docs):
    lines = [f"line number {k} is long enough to count as a line" for k in range(3000)]
    docs = make_docs([(i, "\n".join(lines[i * 100 : i * 100 + 150])) for i in range(29)])
    bits = 1 << 22
    whole = ld.repeated_line_filter(docs, 40, bits)
    import xxhash

    def passes(line):
        at = ld.positions(np.array([xxhash.xxh3_64_intdigest(line.encode())], np.uint64), bits)[0].astype(np.int64)
        return all(whole[p >> 3] >> (p & 7) & 1 for p in at)

    twice = [x for k, x in enumerate(lines[:2900]) if k >= 100 and k % 100 < 50]
    once = [x for k, x in enumerate(lines[:2900]) if k % 100 >= 50]
    assert all(map(passes, twice)) and sum(map(passes, once)) <= len(once) // 50


def test_odd_rows(odd_docs, empty_docs, odd_rows, make_docs):
    out = ld.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert ld.dedup_lines(empty_docs, counts=("a", "b")).count() == 0
    line = "The same long line stands in every one of these documents."
    rows = [(i, line) for i in (1, 2, 3, 4, None)] + [(4, line)]
    got = ld.dedup_lines(make_docs(rows), counts=("n", "gone")).collect()
    assert sorted((str(r["doc_id"]), r["gone"]) for r in got) == [("1", 1), ("2", 1), ("3", 1), ("4", 0), ("4", 0), ("None", 1)]
