import random
import zlib
from collections import Counter

import pytest
from roundtide.llm import spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [n, len(near), form, counts[form] if form else None, None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row[4] = root
    return out


def rows_of(df):
    return {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in df.collect()}


def made_words(seed, n=500):
    rng = random.Random(seed)
    words = set()
    for _ in range(n):
        word = "".join(rng.choice("abcéÿz") for _ in range(rng.randrange(3, 8)))
        words.add(word)
        at = rng.randrange(len(word))
        words.add(word[:at] + rng.choice(["", "q", "ñb"[rng.randrange(2)] + word[at]]) + word[at + 1 :])
    return {w: rng.choice([1, 2, 2, 30, 31, 400, 5000, 60_000]) for w in sorted(words) if w}


@pytest.mark.parametrize("block", [1 << 14, 24])
def test_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)  # small blocks open the trie to its leaves and split those
    monkeypatch.setattr(spelling, "PAIRS", 64)
    counts = made_words(block)
    got = rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)))
    assert got == brute(counts)


def test_chains_ties_and_odd_words(spark):
    rows = [("balance", 2), ("balances", 25), ("balancest", 300), ("xalancest", 300), ("xxlancest", 1), (None, 4), ("lone", None)]
    rows += [("abc", 1), ("abd", 10), ("abe", 10), ("x" * 50_000, 3), ("x" * 50_001, 40), ("", 9), ("日本語", 2), ("日本", 20), ("abc", 0)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "word string, n long")))
    counts = Counter()
    for w, n in rows:
        if w and n is not None:
            counts[w] += n
    assert got == brute(dict(counts))
    assert got["balance"][2:] == ["balances", 25, "balancest"] and got["abc"][2] == "abd"
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_typed_words(odd_docs, empty_docs, odd_rows, make_docs):
    def expected(rows):
        counts = Counter()
        for i, t in rows:
            for run in spelling.RUN.findall(t or ""):
                word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % 3 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                if len(word) >= 3:
                    counts[word] += 1
        return {w: n for w, n in counts.items() if n >= 2}

    got = spelling.typed_words(odd_docs, 3, 2, 3)
    assert {r["word"]: r["n"] for r in got.collect()} == expected(odd_rows)
    rows = [(i, "Ünder ÉCOLE École école×÷a 12word34 wordword WORD") for i in range(40)]
    assert {r["word"]: r["n"] for r in spelling.typed_words(make_docs(rows), 3, 2, 3).collect()} == expected(rows)
    assert spelling.variants(spelling.typed_words(empty_docs, 3, 2, 3)).count() == 0
