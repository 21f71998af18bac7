"""Line dedup with two Bloom filters.

Pass 1 hashes every long line. Tasks emit the bit positions of their lines by filter segment, once
for each line and again for lines seen in two of their documents; merging the segments sets a bit of
the second filter as soon as it arrives twice. A line in two documents always passes that filter; a
unique line passes it only by chance. Pass 2 shuffles nothing but lines that pass (16-byte digests
and ids), counts their documents exactly and picks the occurrence that stays. Pass 3 drops lines.

The filter's size follows the corpus up to ``MAX_BITS``; beyond that more unique lines pass and are
counted in vain, so the result is the same at any size.

Edge cases: null or empty text is one empty line and stays as it is; documents with a null id never
hold the occurrence that stays unless all holders are null, and then nothing is dropped; rows that
repeat an id are one document; an empty table gives an empty result; all other columns pass through,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roundtide.llm.common import map_columns, small_batches, stage_table, texts

SEGMENT_BITS = 1 << 20
MIN_BITS, MAX_BITS = 1 << 22, 1 << 30
#: Filter bits for each line that could be long enough (bytes of text / shortest line).
BITS_PER_LINE = 8
PROBES = 3
#: Hashes that a task holds before it emits their positions.
FLUSH = 200_000


def line_key(line: bytes, min_length: int) -> bytes | None:
    """The line stripped of ASCII white space with A-Z lowered, or None when it is too short."""
    key = line.strip().lower()
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode("utf-8", "surrogatepass")) < min_length:
        return None
    return key


def long_keys(text: str, min_length: int) -> set[bytes]:
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return {k for k in (line_key(x, min_length) for x in lines if len(x) >= min_length) if k is not None}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter positions of every hash, one column a probe (double hashing)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def filter_bits(docs: DataFrame, min_length: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(MIN_BITS, size // (min_length + 1) * BITS_PER_LINE)
    return min(MAX_BITS, 1 << int(wanted - 1).bit_length())


def _emit(hashes: list[int], bits: int):
    """Positions by segment: of every hash, and of those that occur twice."""
    found, times = np.unique(np.array(hashes, np.uint64), return_counts=True)
    once = np.unique(positions(found, bits))
    twice = np.unique(positions(found[times > 1], bits))
    edges = np.arange(0, bits + 1, SEGMENT_BITS, dtype=np.uint64)
    a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    for s in np.flatnonzero(np.diff(a)):
        yield int(s), once[a[s] : a[s + 1]].astype(np.uint32).tobytes(), twice[b[s] : b[s + 1]].astype(np.uint32).tobytes()


SEGMENTS = T.StructType().add("segment", "integer").add("once", "binary").add("twice", "binary")


def repeated_line_filter(docs: DataFrame, min_length: int, bits: int) -> np.ndarray:
    """The twice-seen filter as bytes: every line of two documents has all its bits set."""
    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(SEGMENTS)

    def scan(batches):
        held: list[int] = []

        def flush():
            rows = list(_emit(held, bits))
            held.clear()
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i : i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(part, arrow)], schema=arrow)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.extend(map(xxhash.xxh3_64_intdigest, long_keys(text, min_length)))
                if len(held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def merge(batches):
        at, once, twice = None, None, None

        def result():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary())],
                names=["segment", "bits"],
            )

        for batch in batches:
            for s, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
                if s != at:
                    if at is not None:
                        yield result()
                    at, once, twice = s, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                here = np.frombuffer(seen, np.uint32) % SEGMENT_BITS
                twice[here[once[here]]] = True
                once[here] = True
                twice[np.frombuffer(again, np.uint32) % SEGMENT_BITS] = True
        if at is not None:
            yield result()

    marks = docs.select("text").mapInArrow(scan, SEGMENTS)
    merged = marks.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # compressed, bits / 8 bytes in all before that, at most MAX_BITS / 8
        size = SEGMENT_BITS // 8
        whole[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return whole


def repeated_lines(docs: DataFrame, min_length: int, min_docs: int) -> DataFrame:
    """(doc_id, keys): the digests of the lines that each document loses."""
    rows = texts(docs)
    bits = filter_bits(rows, min_length)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_line_filter(rows, min_length, bits))

    def make():
        table = shared.value

        def step(ids, text):
            out_ids, out_keys = [], []
            for i, t in zip(ids, text):
                keys = list(long_keys(t, min_length))
                if not keys:
                    continue
                at = positions(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits).astype(np.int64)
                passed = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                for j in np.flatnonzero(passed):
                    out_ids.append(i)
                    out_keys.append(xxhash.xxh3_128_digest(keys[j]))
            return [out_ids, out_keys]

        return step

    suspects = stage_table(map_columns(rows, make, "doc_id long, key binary").distinct(), "suspect-lines")
    repeated = (
        suspects.groupBy("key")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("key", "keeper")
    )
    repeated = stage_table(repeated.where("keeper is not null"), "repeated-lines")
    lost = suspects.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return stage_table(lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "lost-lines")


def drop_lines(text: str, keys: set[bytes], min_length: int) -> tuple[str, int, int]:
    """The text without its lines of these digests, its number of lines, and how many went."""
    lines = text.split("\n")
    if not keys:
        return text, len(lines), 0
    stay = []
    for line in lines:
        key = line_key(line.encode("utf-8", "surrogatepass"), min_length) if len(line) >= min_length else None
        if key is None or xxhash.xxh3_128_digest(key) not in keys:
            stay.append(line)
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(
    docs: DataFrame, min_length: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """All columns with repeated lines gone from the text; ``counts`` names columns for lines and dropped lines.

    A line of at least ``min_length`` code points found in ``min_docs`` documents stays in the
    document of the largest id only.
    """
    lost = repeated_lines(texts(docs, id_col, text_col), min_length, min_docs)
    spare = "lost_keys"
    while spare in docs.columns:
        spare += "_"
    # by sort-merge at every size: the lost lines grow with the corpus
    lost = lost.select(F.col("doc_id").alias(spare + "id"), F.col("keys").alias(spare)).hint("merge")
    joined = docs.join(lost, docs[id_col].cast("long").eqNullSafe(lost[spare + "id"]), "left").drop(spare + "id")
    at = docs.columns.index(text_col)
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(c, T.LongType()) for c in counts or ()])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            done = [
                drop_lines(t or "", set(k) if k else set(), min_length)
                for t, k in zip(old, batch.column(batch.num_columns - 1).to_pylist())
            ]
            columns = [c.cast(f.type) for c, f in zip(batch.columns[:-1], arrow)]
            columns[at] = pa.array([d[0] if d[2] else t for d, t in zip(done, old)], arrow[at].type)
            if counts:
                columns += [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(run, schema)


