"""Identity across saves and watches: moved rounds, and events that several watches follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundtide.functions.text import round_name_key
from roundtide.operators.state import ROUND_ID, event_identity, prune_rounds


def round_moves(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Rounds whose start or sale date moved: a pruned round and a new one of one event, platform, URL and name.

    A moved date changes the round key, so a move shows up as one round lost and one found. Lost and
    found rounds of a place are put in date order (start, sale date, key; missing dates last) and paired
    by rank: each is used once, what is left over has no partner. Places hold one round a date pair, so
    the ranks are taken over small groups.
    """
    start, sale = F.coalesce("application_start_at", "lottery_start"), F.col("general_sale_date")
    place = ["event_id", "platform", "url", "name_key"]
    order = Window.partitionBy(*place).orderBy(F.col("start").asc_nulls_last(), F.col("sale").asc_nulls_last(), "round_key")

    def ranked(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.select("event_id", "platform", "url", round_name_key(F.col("name")).alias("name_key"), "round_key", start.alias("start"), sale.alias("sale"))
        rows = rows.withColumn("rank", F.row_number().over(order))
        return rows.select(*place, "rank", *[F.col(c).alias(f"{side}_{c}") for c in ("round_key", "start", "sale")])

    found = batch.join(old.select(*ROUND_ID), ROUND_ID, "left_anti")
    return ranked(prune_rounds(old, batch), "old").join(ranked(found, "new"), [*place, "rank"]).drop("rank", "name_key")


def survivors(events: DataFrame) -> DataFrame:
    """(event_id, survivor): events of one identity go into the one with the smallest id."""
    keyed = events.select("event_id", event_identity().alias("identity"))
    first = keyed.groupBy("identity").agg(F.min("event_id").alias("survivor"))
    return keyed.join(first, "identity").select("event_id", "survivor")


def merge_events(events: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Merge events of one identity across watches: (events, watched, children).

    The survivor keeps its id and takes the header of the newest copy (ties: the larger id). ``watched``
    lists (event_id, watch_id) of all copies, so no watch loses its event. Children come as a table and
    its key without event_id; they move to the survivor, and of children that meet under one key the one
    from the smallest event stays, so none is left without a parent.
    """
    into = survivors(events)
    homed = events.join(into, "event_id")
    header = [c for c in events.columns if c not in ("event_id", "watch_id", "updated_at")]
    newest = F.max(F.struct("updated_at", "event_id", *header)).alias("e")
    merged = homed.groupBy("survivor").agg(newest, F.min("watch_id").alias("watch_id"))
    merged = merged.select(F.col("survivor").alias("event_id"), "watch_id", "e.updated_at", *[f"e.{c}" for c in header])
    watched = homed.select(F.col("survivor").alias("event_id"), "watch_id").distinct()
    moved = {}
    for name, (rows, key) in children.items():
        rest = [c for c in rows.columns if c not in ("event_id", *key)]
        first = F.min(F.struct("event_id", *rest)).alias("r")
        kept = rows.join(into, "event_id").groupBy("survivor", *key).agg(first)
        moved[name] = kept.select(F.col("survivor").alias("event_id"), *key, *[f"r.{c}" for c in rest])
    return merged.select(*events.columns), watched, moved
