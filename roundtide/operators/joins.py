"""Joins on keys of which one may hold a large share of the rows, and of sides whose size is not known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least 1 / SHARES of the rows are dealt out: at most so many, and so their list is small.
SHARES = 4096


def by_shuffle(rows: DataFrame) -> DataFrame:
    """A join side of which the planner can only guess the size: it is shuffled, never collected for a broadcast.

    Texts made from a few narrow columns, exploded rows and compressed files are taken for a fraction of what they
    hold, so a table of a million pages may pass for a small one and fill the driver.
    """
    return rows.hint("merge")


#: So many rows of one key may lie in one task.
TOGETHER = 1_000_000


def fits_together(rows: DataFrame, key: str, least: int = 0, most: int = TOGETHER) -> bool:
    """Whether rows can be dealt by a key alone: no key has more than ``most`` rows; fewer than ``least`` are not worth it."""
    most_of_key, total = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return (most_of_key or 0) <= most and (total or 0) >= least


def together(rows: DataFrame, key: str, most: int = TOGETHER) -> DataFrame:
    """Rows dealt by a key while they are narrow, so that later joins and groups by it, and by more, move nothing again.

    Counts decide: where one key has more than ``most`` rows the rows stay as they lie, and each later step deals them by its own keys.
    """
    return rows.repartition(key) if fits_together(rows, key, most=most) else rows


def hot_keys(rows: DataFrame, key: str, shares: int = SHARES) -> DataFrame:
    """(key, copies): keys with a large share of the rows, and into how many parts of that share they fall."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") * shares >= total).select(key, F.ceil(F.col("n") * shares / total).alias("copies"))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, shares: int = SHARES) -> DataFrame:
    """Inner join of many rows with few facts a key, evenly dealt.

    Counts decide: rows of a hot key are dealt by their own hash over copies of the key's facts, so no
    task holds more than a share of the rows under one key. Other keys have one copy.
    """
    hot = F.broadcast(hot_keys(rows, key, shares))
    own = F.pmod(F.xxhash64(*rows.columns), F.coalesce("copies", F.lit(1)))
    dealt = rows.join(hot, key, "left").withColumn("salt", own).drop("copies")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))
    copies = facts.join(hot, key, "left").withColumn("salt", every).drop("copies")
    return dealt.join(by_shuffle(copies), [key, "salt"]).drop("salt")
