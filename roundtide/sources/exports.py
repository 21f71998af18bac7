"""Export sinks: JSON rows and iCalendar text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundtide.operators.joins import by_shuffle


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def block_documents(blocks: dict[str, DataFrame], scope: str = "keyword") -> DataFrame:
    """One JSON document per block: header and facts as general information, the list of its rounds.

    Blocks without facts or rounds keep empty lists. A document holds its whole block, so it is as
    large as the block's own text.
    """
    facts = blocks["facts"].groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("kind", "first", "value", "label"))).alias("facts"))
    dated = ["lottery_start", "lottery_end", "results_date", "general_sale_date", "payment_deadline"]
    ticket = F.struct("name", "platform", "url", *[F.col(c).cast("string").alias(c) for c in dated], "status", "evidence")
    rounds = blocks["rounds"].groupBy(scope).agg(F.array_sort(F.collect_list(ticket)).alias("rounds"))
    joined = blocks["header"].join(by_shuffle(facts), scope, "left").join(by_shuffle(rounds), scope, "left")
    info = F.struct(*blocks["header"].columns, F.coalesce("facts", F.array()).alias("facts"))
    document = F.to_json(F.struct(info.alias("general_info"), F.coalesce("rounds", F.array()).alias("ticket_info")))
    return joined.select(scope, document.alias("document"))


def ics_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def vevents(stamp: Column) -> Column:
    """One VEVENT text per calendar entry row; a row without URL has no URL line."""
    when = F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")
    line = lambda head, c: F.concat(F.lit(head), c)
    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("uid"), F.lit("@roundtide.local")),
        line("DTSTAMP:", when),
        line("SUMMARY:", ics_escape(F.col("summary"))),
        line("DTSTART;VALUE=DATE:", F.col("dtstart")),
        line("DTEND;VALUE=DATE:", F.col("dtend")),
        line("DESCRIPTION:", ics_escape(F.col("description"))),
        F.when(F.col("url") != "", line("URL:", ics_escape(F.col("url")))),
        F.lit("END:VEVENT"),
    )


# --- fixed values: calendar frame ----------------------------------------------
CALENDAR_HEAD = (
    "BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//roundtide//ticket timeline//EN",
    "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "X-WR-CALNAME:roundtide ticket timeline",
)


def write_calendar(entries: DataFrame, stamp: Column, path: str) -> None:
    """Text part files that concatenate, in name order, to one calendar.

    A range-partitioned sort puts the head first and the end last, so no task holds the whole
    calendar.
    """
    spark = entries.sparkSession
    frame = spark.range(2).select(
        F.when(F.col("id") == 0, 0).otherwise(2).alias("part"),
        F.lit("").alias("uid"),
        F.when(F.col("id") == 0, "\r\n".join(CALENDAR_HEAD)).otherwise("END:VCALENDAR").alias("value"),
    )
    body = entries.select(F.lit(1).alias("part"), "uid", vevents(stamp).alias("value"))
    frame.unionByName(body).orderBy("part", "uid").select("value").write.mode("overwrite").option(
        "lineSep", "\r\n"
    ).text(path)
