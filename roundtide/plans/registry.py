"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundtide.plans.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns in portable types: dates, times and lists as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            c = F.to_json(c)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name``; ``sql`` is its DuckDB twin."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Star(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
