"""Round normalisation, identity, dedupe and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.dates import dominant_year, iso_date, range_after_label
from roundtide.functions.rounds import (
    latest_day,
    membership_required,
    round_number,
    round_type,
    status_at,
)
from roundtide.functions.text import any_contains, joined_key, present, round_name_key, string_array
from roundtide.functions.urls import platform_confidence, platform_name


def staged(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    """Add computed columns through a one-row ``inline``.

    The generator is evaluated once per row and its outputs are plain attributes afterwards, so
    later filters and projections refer to the values instead of repeating the text expressions.
    """
    kept = list(keep) or [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def is_sale_round(name: Column) -> Column:
    return any_contains(name, ("一般発売", "一般前売"))


def round_key() -> Column:
    return joined_key(
        F.coalesce(present(F.col("platform")), F.col("source")),
        F.col("url"),
        round_name_key(F.col("name")),
        F.col("application_start_at").cast("string"),
        F.col("general_sale_date").cast("string"),
    )


def normalize_rounds(rounds: DataFrame, as_of: Column, parse_evidence: bool = True) -> DataFrame:
    """Fill platform, window, payment end, number, type, membership; derive status and key.

    Narrow: every step is a projection. The evidence window is only parsed for rows that
    still miss an end of their window and whose evidence holds a digit. Read paths over stored
    rounds pass ``parse_evidence=False``: the window was derived at save time, and without the
    text scan a status filter is pushed down as a small date predicate.
    """
    name, evidence = F.col("name"), F.coalesce(F.col("evidence"), F.lit(""))
    start = F.coalesce("application_start_at", "lottery_start")
    end = F.coalesce("application_end_at", "lottery_end")
    wants_evidence = (start.isNull() | end.isNull()) & evidence.rlike(r"(?U)\d") & ~is_sale_round(name)
    from_evidence = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    if parse_evidence:
        from_evidence = F.when(
            wants_evidence,
            range_after_label(evidence, string_array(dims.ADVANCE_RANGE_LABELS), dominant_year(evidence), as_of),
        )
    platform = F.coalesce(present(F.col("platform")), present(F.col("source")), platform_name(F.col("url")))
    columns = {"platform": platform, "_window": from_evidence}
    base = staged(rounds, columns) if parse_evidence else rounds.withColumns(columns)
    filled = base.withColumns(
        {
            "application_start_at": F.when(
                ~is_sale_round(name), F.coalesce(start, iso_date(F.col("_window.start")))
            ),
            "application_end_at": F.when(~is_sale_round(name), F.coalesce(end, iso_date(F.col("_window.end")))),
            "payment_end_at": F.coalesce("payment_end_at", "payment_deadline"),
            "round_number": F.coalesce(F.col("round_number"), round_number(name)),
            "confidence": F.coalesce(
                F.nullif(F.col("confidence"), F.lit(0)), platform_confidence(F.col("platform"))
            ),
            "round_type": F.when(F.col("round_type") != "unknown", F.col("round_type")).otherwise(round_type(name)),
            "membership_required": F.when(
                F.col("membership_required") != "unknown", F.col("membership_required")
            ).otherwise(membership_required(name, evidence)),
        }
    ).drop("_window")
    return filled.withColumns({"status": status_at(as_of), "round_key": round_key()})


DEDUPE_KEY = (
    "application_start_at", "application_end_at", "results_date", "general_sale_date",
)


def dedupe_rounds(rounds: DataFrame, scope: list[str], ordinals: list[str]) -> DataFrame:
    """First round wins per scope and 7-part key; a min over ordinals combines map-side."""
    keyed = rounds.withColumns(
        {"_platform": F.coalesce(present(F.col("platform")), F.col("source")), "_name": round_name_key(F.col("name"))}
    )
    keys = [*scope, "_platform", "url", "_name", *DEDUPE_KEY]
    rest = [c for c in keyed.columns if c not in keys and c not in ordinals]
    first = keyed.groupBy(*keys).agg(F.min(F.struct(*ordinals, *rest)).alias("_first"))
    return first.select(*keys, "_first.*").select(*rounds.columns)


def one_per_key(rounds: DataFrame, scope: list[str]) -> DataFrame:
    """One row per (scope, round_key): the one that sorts last, as a keyed save would keep it."""
    rest = [c for c in rounds.columns if c not in scope and c != "round_key"]
    order = F.struct((-latest_day()).alias("back"), "platform", "name", *[c for c in rest if c not in ("platform", "name")])
    last = rounds.groupBy(*scope, "round_key").agg(F.max(order).alias("l"))
    return last.select(*scope, "round_key", "l.*").select(*rounds.columns)


def numbered_within(df: DataFrame, keys: list[str], coarse: Column, fine: list[Column], name: str) -> DataFrame:
    """Exact 1-based positions within ``keys`` without sorting a whole group in one task.

    ``coarse`` is the leading sort value. Rows are counted per (keys, coarse) with map-side
    partials, the counts are accumulated over the few coarse values of a group, and only rows
    that share both are sorted together.
    """
    rows = df.withColumn("_coarse", coarse)
    counts = rows.groupBy(*keys, "_coarse").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_coarse", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_coarse").orderBy(*fine)
    return (
        rows.join(offsets, [*keys, "_coarse"])
        .withColumn(name, (F.col("_before") + F.row_number().over(local)).cast("bigint"))
        .drop("_coarse", "_before")
    )


def order_rounds(rounds: DataFrame, scope: list[str]) -> DataFrame:
    """Position of each round in its scope: latest date first, then platform, name, key."""
    fine = [F.coalesce(present(F.col("platform")), F.col("source"), F.lit("")), F.coalesce("name", F.lit("")), F.col("round_key")]
    return numbered_within(rounds, scope, -latest_day(), fine, "position")
