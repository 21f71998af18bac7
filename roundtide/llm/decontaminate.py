"""Benchmark decontamination with spaced seeds.

A mask keeps some of the token positions under it and ignores the others, so a substituted token
spoils only the seeds that keep its position. Benchmark items give a table of seeds (mask, kept
tokens) -> (item, position). Documents are hashed under the same masks; a bit table of the benchmark
seeds, of bounded size, lets only likely hits leave a task, and the join with the seed table settles
them. Every hit names a diagonal (document position minus item position); the tokens along it are
compared one by one and of all stretches that are dense enough the one with most equal tokens decides.

A document holds an item when a stretch has at least ``min_match`` equal tokens (or
``short_share`` of the item's tokens, if that is less) and is at least three quarters equal.

Items of fewer than ``SHORT_ITEM`` tokens have masks of their own: three kept positions, chosen so that
whichever tokens the rule lets be substituted, one mask still hits. Documents are hashed under a mask
only if the benchmark has items that need it.

Edge cases: null or empty texts and items have no tokens and match nothing; items of one or two tokens
are words, not passages, and are not searched; an item id with several texts is searched for each; documents with a null id are not examined; repeated rows of one id are one
document; repeated items are reported each under its own id; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Collection

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import CACHE_WORDS, map_columns, stage_table, texts

TOKEN = re.compile(r"[^\W_]+")
MASKS = ("1101101", "11010011", "101100101")
#: Items below this many tokens are found by these masks, whatever the rule lets be substituted.
SHORT_ITEM = 14
SHORT_MASKS = ("111", "1101", "1011")
MIN_MATCH = 12
SHORT_SHARE = 0.7
#: The bit table of benchmark seeds has at most this many bits; more seeds only mean more hits to join.
MAX_FILTER_BITS = 1 << 24


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeder(masks: tuple[str, ...] = MASKS):
    """A function from text, and from its length to the masks wanted, to seeds: (hashes, positions, mask numbers), as arrays."""
    known: dict[str, int] = {}
    kept = [(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in masks]

    def word_hash(word: str) -> int:
        got = known.get(word)
        if got is None:
            if len(known) > CACHE_WORDS:
                known.clear()
            got = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got

    def seeds(text: str, wanted: Callable[[int], Collection[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = tokens(text)
        numbers = wanted(len(words))
        h = np.fromiter(map(word_hash, words), np.uint64, len(words))
        found, at, by = [], [], []
        for number, (span, offsets) in enumerate(kept):
            n = len(h) - span + 1
            if n <= 0 or number not in numbers:
                continue
            acc = np.full(n, number + 1, np.uint64)
            for i in offsets:
                acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
            found.append(acc)
            at.append(np.arange(n))
            by.append(np.full(n, number))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found).view(np.int64), np.concatenate(at), np.concatenate(by)

    return seeds


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, start, end) of the stretch with most equal tokens that is three quarters equal."""
    if not equal.any():
        return 0, 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # a stretch is dense enough when its sum is not negative: for each end, the earliest start whose sum is not larger
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int((count - count[starts]).argmax())
    inside = np.flatnonzero(equal[starts[end] : end]) + starts[end]
    return len(inside), int(inside[0]), int(inside[-1]) + 1


def needed(n_tokens: int, min_match: int = MIN_MATCH, short_share: float = SHORT_SHARE) -> int:
    return min(min_match, math.ceil(short_share * n_tokens))


def overlaps(doc: list[str], item: list[str], diagonals: list[int]) -> tuple[int, int, int]:
    """(equal tokens, document start, document end) of the best stretch on any of the diagonals."""
    best = (0, 0, 0)
    for d in sorted(diagonals):
        first = max(0, -d)
        last = min(len(item), len(doc) - d)
        equal = np.fromiter((doc[i + d] == item[i] for i in range(first, last)), bool, max(0, last - first))
        n, a, b = best_stretch(equal)
        if n > best[0]:
            best = (n, first + d + a, first + d + b)
    return best


def _seed_rows(masks: tuple[str, ...], short_masks: tuple[str, ...]):
    long, short = range(len(masks)), range(len(masks), len(masks) + len(short_masks))

    def make():
        seeds = seeder(masks + short_masks)

        def step(ids, text):
            out = [[], [], [], []]
            for i, t in zip(ids, text):
                h, at, by = seeds(t, lambda n: short if n < SHORT_ITEM else long)
                out[0] += h.tolist()
                out[1] += [i] * len(h)
                out[2] += at.tolist()
                out[3] += by.tolist()
            return out

        return step

    return make


def seed_filter(seeds: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit table of the benchmark seeds, gathered as at most ``MAX_FILTER_BITS`` / 64 words."""
    bits = min(MAX_FILTER_BITS, max(1 << 16, 1 << (32 * count).bit_length()))
    at = F.pmod(F.col("seed"), F.lit(bits))
    words = (
        seeds.select(F.shiftrightunsigned(at, 6).alias("word"), (at % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    )
    table = np.zeros(bits // 64, np.int64)
    for row in words.collect():
        table[row["word"]] = row["mask"]
    return table, bits


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_match: int = MIN_MATCH,
    short_share: float = SHORT_SHARE, text_col: str = "text", short_masks: tuple[str, ...] = SHORT_MASKS,
) -> DataFrame:
    """doc_id, item_id, matched, share, token_start, token_end: a row per document and item it holds."""
    rows = texts(docs, text_col=text_col).where("doc_id is not null")
    items = texts(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").where("item_id is not null")
    seeds = stage_table(map_columns(items, _seed_rows(masks, short_masks), "seed long, item_id long, item_pos int, mask int").distinct(), "seeds")
    used = {row["mask"] for row in seeds.select("mask").distinct().collect()}  # no more than there are masks
    table, bits = seed_filter(seeds, seeds.count())
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        find, marks = seeder(masks + short_masks), shared.value

        def step(ids, text):
            out = [[], [], []]
            for i, t in zip(ids, text):
                h, at, _ = find(t, lambda n: used)
                p = h & np.int64(bits - 1)
                hit = np.flatnonzero((marks[p >> 6] >> (p & 63)) & 1)
                out[0] += [i] * len(hit)
                out[1] += h[hit].tolist()
                out[2] += at[hit].tolist()
            return out

        return step

    hits = map_columns(rows, make, "doc_id long, seed long, doc_pos int")
    lines = hits.join(seeds, "seed").select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"))
    lines = lines.groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))
    lines = stage_table(lines, "seed-hits")
    searched = items.distinct().withColumnRenamed("text", "item")
    found = (
        lines.join(searched, "item_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("found"))
    )
    pairs = rows.join(found, "doc_id").select("doc_id", "text", "found")

    def verify():
        def step(ids, text, found):
            out = [[], [], [], [], [], []]
            for i, t, candidates in zip(ids, text, found):
                doc = tokens(t)
                for c in candidates:
                    item = tokens(c["item"])
                    n, a, b = overlaps(doc, item, c["diagonals"])
                    if n >= needed(len(item), min_match, short_share):
                        for column, value in zip(out, (i, c["item_id"], n, round(n / len(item), 6), a, b)):
                            column.append(value)
            return out

        return step

    schema = "doc_id long, item_id long, matched long, share double, token_start long, token_end long"
    best = F.max(F.struct("matched", "share", (-F.col("token_start")).alias("s"), "token_end")).alias("best")
    return (
        map_columns(pairs, verify, schema, chunk=64)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.matched", "best.share", (-F.col("best.s")).alias("token_start"), "best.token_end")
    )
