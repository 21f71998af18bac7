"""Helpers shared by the operators: input columns, Arrow mapping, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to a task function at once; bounds the memory of a Python worker, not the result.
CHUNK_ROWS = 256
#: Bytes and rows of an Arrow batch between Spark and a worker, and entries of a worker's word cache.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048
CACHE_WORDS = 60_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches are held to a few megabytes, unless the session asks for less."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def workspace(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: lineage is cut by files that outlive any executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column's name can clash; null text becomes empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def map_columns(
    df: DataFrame, make: Callable[[], Callable[..., list]], schema: str | T.StructType, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """``make()`` runs once a task and gives a function from column lists to output column lists."""
    small_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                out = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, schema)
