"""Event-time aggregates and repeat suppression over an unbounded log of alerts or activity.

All run in append mode: a window is written once, when the watermark (the latest time seen less
``late``) has passed its end; rows of windows that have ended come too late and are left out. State
is held for open windows and keys inside the delay only, however long the log is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_within(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Repeats of a key inside the delay are dropped; the key is forgotten after it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts_per_window(stream: DataFrame, keys: list[str], ts: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, n); with a slide shorter than the width a row counts in several windows."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, late).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(stream: DataFrame, keys: list[str], ts: str, late: str, gap: str) -> DataFrame:
    """(session_start, session_end, keys, n): activity without a pause of ``gap``; the end is a gap after the last row."""
    span = F.session_window(ts, gap)
    counted = stream.withWatermark(ts, late).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
