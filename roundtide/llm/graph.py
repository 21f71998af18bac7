"""Connected components of an edge table: alternating large-star and small-star steps.

Every step is a grouped minimum and a join; the edges are cut from their lineage by a written table
after each round, and only a count and a sum (did anything change) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roundtide.llm.common import stage_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _staged(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a written table, and their number and hash sum, observed while they are written."""
    seen = Observation()
    edges = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return stage_table(edges, "edges"), seen.get


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node that it reaches.

    Null ends and self-loops are left out; an empty edge table gives an empty result.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges, mark = _staged(edges.where("a is not null and b is not null and a != b").distinct())
    for _ in range(max_rounds):
        before = mark
        if not before["n"]:
            break
        edges, mark = _staged(_small_star(_large_star(edges)))
        if mark == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())
