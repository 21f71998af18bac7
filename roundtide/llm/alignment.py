"""Alignment of two tokenizers: groups between common ends, links, and how common each link is.

1. Each text is encoded by both tokenizers; places where both have a token end cut it into groups. An
   array gives each id of the first the id of the second with the same bytes (the identity map).
2. Links whose two ids have the same bytes, nearly all from groups of one token a side, are kept as
   ids of the first alone and counted in a vector of vocabulary length a task; only links of other
   groups are kept as pairs and counted by a shuffle.
3. Identity counts, each id's highest count, and the counts of frequent pairs (those with at least
   1 / ``FREQUENT`` of all pair rows, so at most ``FREQUENT`` of them) are bounded by the vocabulary or by
   that constant and go to all tasks. Rows of rarer pairs meet their counts by a join in which no
   key holds more than that share.

Edge cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no
tokens: zeros and an empty hash; null ids and repeated rows come back once per row, and each counts as
a document; an id whose bytes the other tokenizer lacks has no identity; ties for the highest count
are all best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import map_columns, small_batches, stage_table, texts

#: At most so many pairs are sent to all tasks; a rarer one holds under 1 / FREQUENT of the pair rows.
FREQUENT = 1 << 16
#: Links of one group that are listed one by one; larger groups are multiplied out by distinct ids.
LISTED = 1 << 16
#: How the byte-level tokenizer cuts a text, and the space sign of the piece tokenizer.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_SIGN = "▁"

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<int>, same_links array<long>, pairs array<long>, pair_links array<long>"
)


def byte_level_entries(path: str) -> list[bytes]:
    """Token bytes by id of a byte-level BPE file whose ids follow its merges.

    Printable Latin-1 signs stand for their own byte, the other bytes for the signs from U+0100 on.
    """
    model = json.load(open(path, encoding="utf-8"))["model"]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own}
    byte_of |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    pieces = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    first = len(model["vocab"]) - len(pieces)
    if any(model["vocab"][p] != first + i for i, p in enumerate(pieces)):
        raise ValueError(f"{path}: ids do not follow the merges")
    entries = sorted(model["vocab"].items(), key=lambda x: x[1])
    return [bytes(byte_of[c] for c in word) for word, _ in entries]


def piece_entries(model) -> list[bytes]:
    """Token bytes by id of a sentencepiece model."""
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in pieces]


def identity_map(a: list[bytes], b: list[bytes], is_byte: Callable[[int], bool]) -> np.ndarray:
    """For each id of A the id of B with the same bytes, a piece before a lone byte, or -1."""
    of: dict[bytes, int] = {}
    for i, word in enumerate(b):
        if word not in of or is_byte(of[word]):
            of[word] = i
    return np.array([of.get(word, -1) for word in a], np.int64)


def aligner(entries_a: list[bytes], entries_b: list[bytes], same_as: np.ndarray):
    """A function from the token ids of a few documents to the columns of ``ALIGNED`` after n_b."""
    length_a, length_b = (np.array([len(w) for w in e], np.int64) for e in (entries_a, entries_b))
    printed = [[f"{i}{sign}".encode() for i in range(len(e))] for e, sign in ((entries_a, ","), (entries_a, "|"), (entries_b, ","), (entries_b, ";"))]
    starts = np.cumsum([0, *map(len, printed)])
    printed = [x for part in printed for x in part]

    def sums(keys: np.ndarray, weights: np.ndarray):
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, weights, len(keys)).astype(np.int64)

    def per_doc(n: int, keys: np.ndarray, weights: np.ndarray):
        keys, weights = sums(keys, weights)
        at = np.searchsorted(keys >> 32, np.arange(1, n))
        return np.split(keys & 0xFFFFFFFF, at), np.split(weights, at)

    def align(ids_a: list[list[int]], ids_b: list[list[int]]) -> list:
        n = len(ids_a)
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (ids_a, ids_b))
        doc_of = np.repeat(np.arange(n), [len(x) for x in ids_a])
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        at = np.searchsorted(ends_b, ends_a)
        common = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(a) else np.empty(0, bool)
        stop_a, stop_b = np.flatnonzero(common) + 1, at[common] + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        start_a, start_b, doc = stop_a - size_a, stop_b - size_b, doc_of[stop_a - 1]
        links = size_a * size_b

        # one token a side, with the bytes of the identity map
        exact = links == 1
        exact[exact] = same_as[a[start_a[exact]]] == b[start_b[exact]]
        same_keys, same_weights = [(doc[exact] << 32) | a[start_a[exact]]], [np.ones(exact.sum(), np.int64)]
        # the others, link by link, or by distinct ids where a group is large
        listed = np.flatnonzero(~exact & (links <= LISTED))
        g = np.repeat(listed, links[listed])
        within = np.arange(len(g)) - np.repeat(np.cumsum(links[listed]) - links[listed], links[listed])
        left, right = a[start_a[g] + within // size_b[g]], b[start_b[g] + within % size_b[g]]
        parts = [(doc[g], left, right, np.ones(len(g), np.int64))]
        for k in np.flatnonzero(~exact & (links > LISTED)):
            x, n_x = np.unique(a[start_a[k] : stop_a[k]], return_counts=True)
            y, n_y = np.unique(b[start_b[k] : stop_b[k]], return_counts=True)
            parts.append((np.full(len(x) * len(y), doc[k]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(n_x, n_y).ravel()))
        of, left, right, weight = (np.concatenate(x) for x in zip(*parts))
        same = same_as[left] == right
        same_keys.append((of[same] << 32) | left[same])
        same_weights.append(weight[same])
        other = ~same
        same_ids, same_links = per_doc(n, np.concatenate(same_keys), np.concatenate(same_weights))
        pairs, pair_links = per_doc(n, (of[other] << 32) | (left[other] << 16) | right[other], weight[other])

        # the digest's text: tokens of a group in order, A before B
        group_a, group_b = np.repeat(np.arange(len(links)), size_a), np.repeat(np.arange(len(links)), size_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[stop_a - 1] = last_b[stop_b - 1] = 1
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + start_b[group_a]] = starts[last_a] + a
        signs[np.arange(len(b)) + stop_a[group_b]] = starts[2 + last_b] + b
        digests, low = [], 0
        for x, y in zip(ids_a, ids_b):
            high = low + len(x) + len(y)
            text = b"".join(map(printed.__getitem__, signs[low:high].tolist()))[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if text else "")
            low = high
        groups = np.bincount(doc, minlength=n)
        total = np.zeros(n, np.int64)
        np.add.at(total, doc, links)
        return [groups, total, digests, same_ids, same_links, pairs, pair_links]

    return align


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document with its groups, identity links and other links (id of A * 65,536 + id of B)."""
    import sentencepiece

    proto = open(path_b, "rb").read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    entries_a, entries_b = byte_level_entries(path_a), piece_entries(model)
    if max(len(entries_a), len(entries_b)) > 1 << 16:
        raise ValueError("a pair of ids must fit 32 bits")
    same_as = identity_map(entries_a, entries_b, model.is_byte)
    files = docs.sparkSession.sparkContext.broadcast((entries_a, entries_b, same_as, proto))

    def make():
        import sentencepiece
        import tiktoken

        entries_a, entries_b, same_as, proto = files.value
        ranks = {w: i for i, w in enumerate(entries_a)}
        a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        align = aligner(entries_a, entries_b, same_as)

        def step(ids, text):
            ids_a = [a.encode_ordinary(" " + t) if t else [] for t in text]
            ids_b = b.encode(text, num_threads=1)
            for k, t in enumerate(text):
                whole = (" " + t).encode()
                if not t or any(b"".join(map(e.__getitem__, x[k])) != whole for e, x in ((entries_a, ids_a), (entries_b, ids_b))):
                    ids_a[k] = ids_b[k] = []
            return [ids, list(map(len, ids_a)), list(map(len, ids_b)), *align(ids_a, ids_b)]

        return step

    return map_columns(texts(docs), make, ALIGNED, chunk=128)


def _columns(batch: pa.RecordBatch, *names: str):
    """Row boundaries and flat values of list columns of one shape."""
    first = batch.column(names[0])
    ends = np.concatenate([[0], np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ends, *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names)


def same_counts(rows: DataFrame, vocabulary: int) -> DataFrame:
    """(a, n): documents that hold the identity link of id a; a vector a task, then sums by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            _, ids = _columns(batch, "same")
            counts += np.bincount(ids, minlength=vocabulary)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["a", "n"])

    return rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _settled(rows: DataFrame, vectors, schema: str) -> DataFrame:
    """Sums over the links whose counts all tasks know: identity links and frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_n, best, pair_ids, pair_n = vectors.value
        for batch in batches:
            out = [batch.column("rid")]
            sums = np.zeros((2, batch.num_rows), np.int64)
            for ids, weights in (("same", "same_links"), ("pairs", "pair_links")):
                ends, key, links = _columns(batch, ids, weights)
                if ids == "same":
                    n, a = same_n[key], key
                else:
                    at = np.minimum(np.searchsorted(pair_ids, key), len(pair_ids) - 1)
                    n = np.where(pair_ids[at] == key, pair_n[at], 0)
                    a = key >> 16
                for k, value in enumerate((links * ((n > 0) & (n == best[a])), links * n)):
                    sums[k] += np.diff(np.concatenate([[0], np.cumsum(value)])[ends])
            out += [pa.array(x) for x in sums]
            yield pa.RecordBatch.from_arrays(out, names=["rid", "n_best", "count_sum"])

    return rows.select("rid", "same", "same_links", "pairs", "pair_links").mapInArrow(run, schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = stage_table(aligned(docs, path_a, path_b).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    vocabulary = len(byte_level_entries(path_a))
    same = stage_table(same_counts(rows, vocabulary), "same-counts")
    held = rows.select("rid", F.explode(F.arrays_zip("pairs", "pair_links")).alias("x"))
    counts = stage_table(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.count("*").alias("n")), "pair-counts")
    best = same.unionByName(counts.select(F.shiftright("pair", 16).alias("a"), "n")).groupBy("a").agg(F.max("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= total
    frequent = counts.where(often)

    def dense(df: DataFrame) -> np.ndarray:
        out = np.zeros(vocabulary, np.int64)
        for a, n in df.select("a", "n").collect():  # one row an id of the vocabulary at most
            out[a] = n
        return out

    top = np.array(sorted((r["pair"], r["n"]) for r in frequent.collect()) or [(-1, 0)], np.int64)  # FREQUENT rows at most
    best_n = dense(best)
    vectors = spark.sparkContext.broadcast((dense(same), best_n, top[:, 0].copy(), top[:, 1].copy()))
    sums = "rid long, n_best long, count_sum long"
    settled = _settled(rows, vectors, sums)

    rare = held.select("rid", F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("links"))
    rare = rare.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(counts.where(~often), "pair")
    rare = rare.join(F.broadcast(best.toDF("a", "most")), F.shiftright("pair", 16) == F.col("a"))
    rare = rare.select("rid", F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    added = settled.unionByName(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    columns = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    return facts.join(added, "rid").select(*columns)
