"""Keywords against texts through bigram postings: texts meet blocks of keywords, shared bigrams are counted by block."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundtide import dims
from roundtide.functions.grams import squeezed
from roundtide.sources.tables import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

#: A block's keywords count their bigrams and KEYWORD_COST each up to this; a chunk holds about so many texts; a slice of texts has so many cells.
BLOCK_COST, KEYWORD_COST, CHUNK, CELLS = 65_536, 128, 2_048, 4_000_000


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _codes(packed: list[str]) -> np.ndarray:
    """Bigrams, two characters each and written one after another, as numbers."""
    pairs = _characters("".join(packed)).reshape(-1, 2)
    return (pairs[:, 0] << np.uint64(32)) | pairs[:, 1]


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams of a squeezed text, as ``grams.bigrams`` gives them but in order of their characters."""
    chars = _characters(text)
    codes = np.unique((chars[:-1] << np.uint64(32)) | chars[1:])
    packed = np.stack([codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [packed[i : i + 2] for i in range(0, len(packed), 2)]


def _bigram_rows(rows: DataFrame, key: str, text: Column, name: str) -> DataFrame:
    """(key, name: distinct bigrams), written; rows without a key or without bigrams go."""
    rows = rows.select(key, squeezed(text).alias(name)).where(F.col(key).isNotNull() & (F.length(name) > 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                grams = [bigrams_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.list_(pa.string()))], names=[key, name])

    return written(rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField(name, T.ArrayType(T.StringType()))])), name)


def shared_counts(wanted: list[str], held: list[str]):
    """Yield (first text, counts) of slices of texts; counts has a row per text and a column per keyword."""
    sizes = [len(w) // 2 for w in wanted]
    vocabulary, place = np.unique(_codes(wanted), return_inverse=True)
    of_keyword = np.zeros((len(vocabulary), len(wanted)), dtype=np.float32)
    of_keyword[place, np.repeat(np.arange(len(wanted)), sizes)] = 1
    step = max(1, CELLS // max(len(vocabulary), len(wanted)))
    for first in range(0, len(held), step):
        part = held[first : first + step]
        codes = _codes(part)
        at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
        known = vocabulary[at] == codes
        of_text = np.zeros((len(part), len(vocabulary)), dtype=np.float32)
        of_text[np.repeat(np.arange(len(part)), [len(h) // 2 for h in part])[known], at[known]] = 1
        yield first, of_text @ of_keyword


def texts_of_keywords(keywords: DataFrame, texts: DataFrame, limit: float = dims.MIN_KEYWORD_OVERLAP) -> DataFrame:
    """(keyword_id, text_id, overlap) for all pairs whose share of the keyword's bigrams is ``limit`` (above 0) or more.

    ``keywords`` has keyword_id and keyword, ``texts`` text_id and text; ids are unique. A text that reaches the limit
    holds one of the ``n - ceil(limit * n) + 1`` bigrams of the keyword that the fewest texts hold, so only these
    meet the postings. Keywords of like rarest bigrams form blocks of bounded size, and a text meets a block once,
    however many bigrams and keywords bring it there; its shared bigrams with all keywords of the block are then
    counted at once, exactly, for a chunk of texts at a time. Keywords and texts without bigrams (null, empty, one
    character) or without an id are in no pair. Runs jobs: bigrams and candidates go through written tables.
    """
    wanted = _bigram_rows(keywords, "keyword_id", F.col("keyword"), "wanted")
    held = _bigram_rows(texts, "text_id", F.col("text"), "held")
    each = wanted.select("keyword_id", F.size("wanted").alias("n"), F.explode("wanted").alias("gram"))
    postings = held.select("text_id", F.explode("held").alias("gram")).join(each.select("gram").distinct(), "gram", "left_semi")
    spread = postings.groupBy("gram").agg(F.count("*").alias("n_texts"))
    rarest = Window.partitionBy("keyword_id").orderBy(F.coalesce("n_texts", F.lit(0)), "gram")
    need = F.ceil(F.col("n") * limit - 1e-9)  # a product just above a whole number stays that number
    prefix = each.join(spread, "gram", "left").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("n") - need + 1)
    prefix = written(prefix.select("keyword_id", "gram", "place"), "prefix")

    cost = F.size("wanted") + KEYWORD_COST
    total = wanted.agg(F.sum(cost).alias("n")).first()["n"] or 0
    part = F.pmod(F.hash("gram"), F.lit(-(-total // BLOCK_COST) or 1))
    running = Window.partitionBy("part").orderBy("gram", "keyword_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = wanted.join(prefix.where("place = 1").select("keyword_id", "gram"), "keyword_id").withColumns({"part": part, "cost": cost})
    slot = F.floor(F.sum("cost").over(running) / BLOCK_COST)
    packed = written(packed.select("part", slot.alias("slot"), "keyword_id", F.array_join("wanted", "").alias("wanted")), "blocks")

    block = ["part", "slot"]
    doors = prefix.join(packed.select("keyword_id", *block), "keyword_id").select("gram", *block).distinct()
    met = written(postings.join(doors, "gram").select("text_id", *block).distinct(), "met")
    chunks = met.groupBy(*block).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n_chunks"))
    number = F.pmod(F.xxhash64("text_id"), F.col("n_chunks")).cast("int")
    rows = met.join(chunks, block).select("text_id", *block, number.alias("chunk")).join(held, "text_id")
    rows = rows.select(*block, "chunk", "text_id", F.array_join("held", "").alias("held"))
    dealt = packed.join(chunks, block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_chunks")

    def counted(texts: pa.Table, keywords: pa.Table) -> pa.Table:
        ids, names = texts["text_id"].combine_chunks(), keywords["keyword_id"].combine_chunks()
        packed = keywords["wanted"].to_pylist()
        sizes = np.array([len(w) // 2 for w in packed], dtype=np.float64)
        out = [pa.table([names[:0], ids[:0], pa.array([], pa.float64())], names=["keyword_id", "text_id", "overlap"])]
        for first, counts in shared_counts(packed, texts["held"].to_pylist()) if packed else ():
            overlap = counts.astype(np.float64) / sizes
            text, keyword = np.nonzero(overlap >= limit)
            out.append(pa.table([names.take(pa.array(keyword)), ids.take(pa.array(text + first)), pa.array(overlap[text, keyword])], names=["keyword_id", "text_id", "overlap"]))
        return pa.concat_tables(out)

    schema = T.StructType([wanted.schema["keyword_id"], held.schema["text_id"], T.StructField("overlap", T.DoubleType())])
    return rows.groupBy(*block, "chunk").cogroup(dealt.groupBy(*block, "chunk")).applyInArrow(counted, schema)
