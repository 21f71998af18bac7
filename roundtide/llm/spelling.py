"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

1. Code points belong to ``GROUPS`` letter groups (code point modulo the number). A word's frequency
   vector is its number of letters in each group; a trie arranges vectors level by level. One edit
   moves a vector by at most one surplus and one deficit letter.
2. The upper part of the trie is laid out by Spark: a node of more than ``BLOCK`` words is opened, the
   others are cells. Each vector is sent to the cells it can reach with a surplus and a later deficit;
   the opposite moves are found from the other word, so a pair of words meets once. A cell's words
   and the words that search it are dealt into blocks, so no task grows with the vocabulary.
3. In a block the two tries are searched depth first together, carrying what is left of the budget;
   the words in the leaves that are reached are verified letter by letter.
4. A block gives each of its words the number of near words and the best of them; sums and minima
   join the blocks. Roots follow by pointer doubling: counts grow tenfold a step, so chains are short.

Edge cases: null texts hold no words, a null id counts as an empty one in the typing hash; repeated
rows count again; null words and counts are left out and repeated words are added up; the largest
count wins, the smaller word in code-point order on a tie; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import map_columns, small_batches, stage_table

GROUPS = 13
#: Words of a cell, and searching words of a block.
BLOCK = 1 << 14
#: Levels that are always open.
FIRST_LEVEL = 2
#: Candidate pairs verified at once.
PAIRS = 1 << 18
NEAR = "word string, n_near long, best_n long, best string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def typed_words(docs: DataFrame, min_length: int, min_count: int, every: int) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, counted over all documents.

    Of a run whose crc32 with the document's id is divisible by ``every``, one letter is lost.
    """

    def make():
        long_run = re.compile(f"{RUN.pattern[:-1]}{{{min_length},}}")

        def step(ids, text):
            counts: Counter[str] = Counter()
            for i, t in zip(ids, text):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, k in Counter(long_run.findall(t)).items():
                    word = run.lower() if run.isascii() else run.translate(LOWER)
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        counts[word] += k
            return [list(counts), list(counts.values())]

        return step

    rows = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))
    counted = map_columns(rows, make, "word string, n long", chunk=2048)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def vector(word: str) -> list[int]:
    counts = [0] * GROUPS
    for c in word:
        counts[ord(c) % GROUPS] += 1
    return counts


def moves(counts: list[int]) -> list[list[int]]:
    """The counts themselves, with one surplus, and with one surplus and a deficit further on."""
    out = [counts]
    for i in range(len(counts)):
        more = [*counts]
        more[i] += 1
        out.append(more)
        for j in range(i + 1, len(counts)):
            if counts[j]:
                less = [*more]
                less[j] -= 1
                out.append(less)
    return out


def _vectors(words: DataFrame) -> DataFrame:
    def make():
        return lambda word, n: [word, n, [".".join(map(str, vector(w))) for w in word]]

    return map_columns(words, make, "word string, n long, vec string")


def _cells(sizes: DataFrame) -> DataFrame:
    """(vec, size, cell): the highest node on a vector's path with at most ``BLOCK`` words, or the leaf."""
    levels = F.explode(F.sequence(F.lit(FIRST_LEVEL), F.lit(GROUPS - 1)))
    paths = sizes.select("vec", "size", levels.alias("level"))
    paths = paths.withColumn("node", F.expr("substring_index(vec, '.', level)"))
    opened = paths.groupBy("node").agg(F.sum("size").alias("words")).where(F.col("words") > BLOCK).select("node")
    depth = paths.join(opened, "node").groupBy("vec").agg((F.max("level") + 1).alias("depth"))
    cell = F.expr(f"substring_index(vec, '.', coalesce(depth, {FIRST_LEVEL}))")
    return sizes.join(depth, "vec", "left").select("vec", "size", cell.alias("cell"))


def _reach(sizes: DataFrame, cells: DataFrame) -> DataFrame:
    """(vec, size, cell): the cells that a vector reaches within its budget."""
    level = F.size(F.split("cell", r"\."))
    depths = [r["d"] for r in cells.select(level.alias("d")).distinct().collect()]  # at most one a level

    def make():
        def step(vecs, counts):
            out = [], [], []
            for vec, size in zip(vecs, counts):
                whole = list(map(int, vec.split(".")))
                for d in depths:
                    for m in moves(whole[:d]):
                        for column, value in zip(out, (vec, size, ".".join(map(str, m)))):
                            column.append(value)
            return list(out)

        return step

    paths = map_columns(sizes.select("vec", "size"), make, "vec string, size long, cell string")
    return paths.join(cells.select("cell").distinct(), "cell")


def _trie(vectors: list[list[int]]) -> dict:
    root: dict = {}
    for k, counts in enumerate(vectors):
        node = root
        for c in counts[:-1]:
            node = node.setdefault(c, {})
        node[counts[-1]] = k
    return root


def _leaf_pairs(queries: list[list[int]], indexed: list[list[int]]) -> dict[str, list]:
    """Pairs of positions, by the move between them, from a depth-first search of both tries."""
    found: dict[str, list] = {"same": [], "insert": [], "replace": []}
    names = {(False, False): "same", (True, False): "insert", (True, True): "replace"}

    def walk(query: dict, frontier: list) -> None:
        for c, child in query.items():
            ahead = []
            for node, surplus, deficit in frontier:
                if (x := node.get(c)) is not None:
                    ahead.append((x, surplus, deficit))
                if not surplus:
                    if (x := node.get(c + 1)) is not None:
                        ahead.append((x, True, False))
                elif not deficit and (x := node.get(c - 1)) is not None:
                    ahead.append((x, True, True))
            if type(child) is dict:
                if ahead:
                    walk(child, ahead)
            else:
                for x, surplus, deficit in ahead:
                    found[names[surplus, deficit]].append((child, x))

    walk(_trie(queries), [(_trie(indexed), False, False)])
    return found


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: one letter replaced, or one letter of the wider ``b`` missing in ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    front, back = a != b[:, :n], a != b[:, 1:]
    first = np.where(front.any(axis=1), front.argmax(axis=1), n)
    last = np.where(back.any(axis=1), n - back[:, ::-1].argmax(axis=1), 0)
    return last <= first


def _expanded(pairs: list, starts_a, sizes_a, starts_b, sizes_b):
    """Positions of all word pairs of the leaf pairs, in portions of bounded size."""
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    a0, a1, b0, b1 = starts_a[pairs[:, 0]], sizes_a[pairs[:, 0]], starts_b[pairs[:, 1]], sizes_b[pairs[:, 1]]
    ends = np.cumsum(a1 * b1)
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        flat = np.arange(low, min(low + PAIRS, int(ends[-1])))
        k = np.searchsorted(ends, flat, side="right")
        at = flat - (ends[k] - a1[k] * b1[k])
        yield a0[k] + at // b1[k], b0[k] + at % b1[k]


def _letters(words: list[str], starts: np.ndarray, sizes: np.ndarray) -> tuple[dict, np.ndarray]:
    """Code points of the words by length, and each word's row there; words of a vector have one length."""
    by_length: dict[int, list[int]] = {}
    for s, k in zip(starts.tolist(), sizes.tolist()):
        by_length.setdefault(len(words[s]), []).extend(range(s, s + k))
    row, arrays = np.zeros(len(words), np.int64), {}
    for n, places in by_length.items():
        row[places] = np.arange(len(places))
        arrays[n] = np.array([words[p] for p in places], f"<U{n}").view(np.uint32).reshape(-1, n)
    return arrays, row


def _search(pdf):
    """Near words of a block: a row for each word that has any there."""
    import pandas as pd

    pdf = pdf.sort_values(["vec", "word"], kind="stable")
    sides = []
    for flag in (False, True):
        side = pdf[pdf["indexed"] == flag]
        vecs, starts, sizes = np.unique(side["vec"].to_numpy(object), return_index=True, return_counts=True)
        vectors = [list(map(int, v.split("."))) for v in vecs]
        words = side["word"].tolist()
        sides.append((vectors, starts, sizes, words, side["n"].to_numpy(np.int64), *_letters(words, starts, sizes)))
    (va, sa, ka, wa, na, la, ra), (vb, sb, kb, wb, nb, lb, rb) = sides
    left, right = [], []
    for kind, pairs in _leaf_pairs(va, vb).items():
        grouped: dict[int, list] = {}
        for x, y in pairs:
            grouped.setdefault(len(wa[sa[x]]), []).append((x, y))
        for n, group in grouped.items():
            for i, j in _expanded(group, sa, ka, sb, kb):
                good = one_edit(la[n][ra[i]], lb[n + (kind == "insert")][rb[j]])
                i, j = i[good], j[good]
                if kind == "same":  # both words search here: the smaller one counts
                    once = np.array([wa[x] < wb[y] for x, y in zip(i, j)], bool)
                    i, j = i[once], j[once]
                left.append(i)
                right.append(j)
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    word = [*(wa[x] for x in i), *(wb[y] for y in j)]
    near = pd.DataFrame({"word": word, "best_n": [*nb[j], *na[i]], "best": [*(wb[y] for y in j), *(wa[x] for x in i)]})
    near = near.sort_values(["word", "best_n", "best"], ascending=[True, False, True])
    near["n_near"] = near.groupby("word")["word"].transform("size") if len(near) else []
    near = near.drop_duplicates("word")[["word", "n_near", "best_n", "best"]]
    return near.astype({"word": object, "n_near": "int64", "best_n": "int64", "best": object})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) of a (word, n) table: near words counted, the most frequent named."""
    small_batches(words.sparkSession)
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = stage_table(_vectors(words.where("word != ''")), "words")
    sizes = words.groupBy("vec").agg(F.count("*").alias("size"))
    cells = stage_table(_cells(sizes), "cells")
    reach = stage_table(_reach(cells, cells), "reach")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias(name))
    dealt = blocks(cells, "parts").join(blocks(reach, "searches"), "cell")
    own = lambda count: F.pmod(F.xxhash64("word"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = "cell", "word", "n", "vec"
    index = words.join(cells.join(dealt, "cell").select("vec", "cell", "parts", "searches"), "vec")
    index = index.select(*columns, F.lit(True).alias("indexed"), own("parts").alias("part"), every("searches").alias("search"))
    query = words.join(reach.join(dealt, "cell").select("vec", "cell", "parts", "searches"), "vec")
    query = query.select(*columns, F.lit(False).alias("indexed"), every("parts").alias("part"), own("searches").alias("search"))
    found = index.unionByName(query).groupBy("cell", "part", "search").applyInPandas(_search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    found = found.select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best"))
    return words.select("word", "n").join(found, "word", "left").fillna(0, ["n_near"])


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root: a word's form is its most frequent near word with at least ``times`` its count."""
    rows = near_words(words)
    known = F.col("best_n") >= times * F.col("n")
    rows = rows.select("word", "n", "n_near", F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n"))
    rows = stage_table(rows, "forms")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # counts below 2^63 leave fewer than 64 steps even where they only double
    for _ in range(6):
        links = stage_table(links, "roots")
        on = links.toDF("at", "next")
        further = links.join(on, links["root"] == on["at"], "left")
        if further.where("next is not null").isEmpty():
            break
        links = further.select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
