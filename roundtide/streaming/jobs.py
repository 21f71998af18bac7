"""Micro-batch jobs: each one re-uses a batch operator inside ``foreachBatch``.

State lives in versioned tables under the cluster's shared folder. Every micro-batch writes its
own ``batch=<id>`` folder with overwrite, so a replay after a lost executor or driver rewrites
the same rows instead of adding them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundtide.operators.state import apply_batch, stale_fallbacks, with_stored_ids
from roundtide.sources.deltas import DeltaState, distinct_keys
from roundtide.sources.tables import all_written, side_by_side, written


def read_landing(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a job: drain what is there, or keep running at an interval (``every='60 minutes'``)."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


#: State larger than a heap: keyed state lives in files of the executors, changelogs in the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def append_to(rows: DataFrame, path: str, checkpoint: str, every: str | None = None, partition_by: tuple[str, ...] = ()):
    """Start a job that appends a stream's rows to a folder, each micro-batch once.

    A query takes the state store's settings when it starts; the session's own are put back.
    """
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedupe_step(path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Append only keys not seen in any earlier batch (idempotent alert and reminder logs).

    The log lies in folders by batch and key bucket; a batch reads the buckets of its own keys only.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        once = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
        once = once.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        schema = T.StructType([*once.drop("bucket").schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        touched = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # at most `buckets` numbers
        seen = spark.createDataFrame([], schema)
        if batch_id:
            seen = spark.read.schema(schema).parquet(path).where((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
        new = once.join(seen.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return step


def delta_step(
    state: DeltaState, to_batch: Callable[[DataFrame], dict[str, DataFrame]], as_of: Column, now: Column, compact_every: int = 16
) -> Callable[[DataFrame, int], None]:
    """Save each micro-batch into the state: read what the batch touches, write what it touches as the next version.

    Touched are the events of the batch, whatever event its links and rounds name, and the fallback events that it
    retires. Read are those events' rows and all events of the watches concerned, for a page may be known by its
    watch and URL, and an id may belong to another watch. The alerts of a version lie beside it.
    """
    def step(rows: DataFrame, batch_id: int) -> None:
        batch = to_batch(rows)
        asked = written(distinct_keys([t.select("event_id") for t in batch.values()]), "asked")
        known = written(state.ids(batch_id, asked), "known")
        watches = written(distinct_keys([batch["events"].select("watch_id"), known.where("watch_id is not null").select("watch_id")]), "watches")
        events = written(state.events_of(watches, batch_id), "events_read")
        batch = all_written(with_stored_ids(events, batch, known.where("live")), "moved")
        retired = stale_fallbacks(events, batch["events"])
        touched = written(distinct_keys([t.select("event_id") for t in [*batch.values(), retired]]), "touched")
        after, alerts = apply_batch({"events": events, **state.children_of(touched, batch_id)}, batch, as_of, now)
        tell = lambda name, told: told.write.mode("overwrite").parquet(f"{state.root}/{name}/v{batch_id + 1}")
        save = lambda: state.save(batch_id + 1, touched, {n: after[n] for n in ["events", *state.children]})
        side_by_side(state.spark, [save, *[lambda n=n, t=t: tell(n, t) for n, t in alerts.items()]])
        if (batch_id + 1) % compact_every == 0:
            state.compact(batch_id + 1)

    return step
