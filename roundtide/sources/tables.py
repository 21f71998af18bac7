"""State tables as versioned parquet, and shared scratch paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Without that setting only local mode gets a temporary folder: on a cluster other machines could
    not read it, so the job stops.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="roundtide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage through a written table: it survives lost executors, unlike cached blocks.

    With ``by`` it lies in buckets of that key (rows should come dealt by it), and joins by it need no shuffle.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    writer.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
    return spark.table(table)


#: Independent writes that a step has under way at once.
SIDE_BY_SIDE = 4


def side_by_side(spark: SparkSession, writes: Iterable[Callable[[], object]]) -> list:
    """Run independent writes, some at once, and give their results in order: planning and small jobs leave most slots idle."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [w.result() for w in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]]


def all_written(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """``written`` for some independent tables."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    return dict(zip(tables, side_by_side(spark, [lambda n=n, t=t: written(t, f"{name}_{n}") for n, t in tables.items()])))


def publish(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write every table under a new version, then append the version to the pointer.

    A reader follows the pointer, so a failed write is never visible and no job overwrites the
    path it reads.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{root}/_pointer")


def current_version(spark: SparkSession, root: str) -> int:
    return spark.read.schema("version int").parquet(f"{root}/_pointer").agg(F.max("version")).first()[0]


def read_state(spark: SparkSession, root: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    v = current_version(spark, root) if version is None else version
    return {n: spark.read.parquet(f"{root}/v={v}/{n}") for n in names}
