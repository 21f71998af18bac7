"""Round facts: type, membership, number, status, dates, labels, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.dates import DATE_RE, U
from roundtide.functions.text import (
    any_contains,
    ascii_digits,
    collapse,
    first_listed,
    lookup,
    present,
    string_array,
)


def round_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(any_contains(low, dims.FAN_CLUB_WORDS), "fc")
        .when(any_contains(name, dims.GENERAL_WORDS), "general")
        .when(any_contains(name, dims.TRADE_WORDS), "trade")
        .when(any_contains(name, dims.OFFICIAL_WORDS), "official")
        .when(any_contains(low, dims.PLATFORM_WORDS), "platform")
        .when(any_contains(name, dims.ADVANCE_WORDS), "platform")
        .otherwise("unknown")
    )


def membership_required(name: Column, evidence: Column) -> Column:
    text = F.lower(F.concat(name, F.lit(" "), F.coalesce(evidence, F.lit(""))))
    return (
        F.when(any_contains(text, dims.MEMBER_WORDS), "yes")
        .when(any_contains(name, dims.GENERAL_WORDS), "no")
        .otherwise("unknown")
    )


def round_number(value: Column) -> Column:
    """``N次`` with ASCII, full-width or kanji (1-99) digits."""
    raw = ascii_digits(F.regexp_extract(value, r"(?U)([0-9０-９一二三四五六七八九十]+)\s*次", 1))

    def kanji(c: Column) -> Column:
        # Position in the digit list is the value; the tenth entry is ten itself.
        return F.when(c == "", 0).otherwise(F.position(c, F.lit(dims.KANJI_DIGITS)))

    first, second, third = (F.substring(raw, i, 1) for i in (1, 2, 3))
    n = F.length(raw)
    number = (
        F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int"))
        .when(raw == "十", 10)
        .when(raw.startswith("十") & (n == 2), 10 + kanji(second))
        .when(raw.endswith("十") & (n == 2), kanji(first) * 10)
        .when(F.contains(raw, F.lit("十")) & (n == 3), kanji(first) * 10 + kanji(third))
        .when(n == 1, F.nullif(kanji(raw), F.lit(0)))
        .cast("int")
    )
    return F.when(F.contains(value, F.lit("次")), number)  # a plain test first: most names have no number


def application_start() -> Column:
    return F.coalesce(F.col("application_start_at"), F.col("lottery_start"))


def application_end() -> Column:
    return F.coalesce(F.col("application_end_at"), F.col("lottery_end"))


def payment_end() -> Column:
    return F.coalesce(F.col("payment_end_at"), F.col("payment_deadline"))


def status_at(as_of: Column) -> Column:
    """Ordered status ladder over the DATE columns of a round."""
    start, end, pay = application_start(), application_end(), payment_end()
    results, sale = F.col("results_date"), F.col("general_sale_date")
    return (
        F.when(results == as_of, "results_today")
        .when(F.date_diff(pay, as_of).between(0, 1), "payment_due")
        .when(F.date_diff(sale, as_of).between(0, 2), "general_sale_soon")
        .when(sale < as_of, "closed")
        .when((start <= as_of) & (as_of <= end) & (F.date_diff(end, as_of) <= 2), "closing_soon")
        .when((start <= as_of) & (as_of <= end), "open")
        .when(as_of < start, "upcoming")
        .when(as_of > end, "closed")
        .otherwise("unknown")
    )


def latest_date(*columns: str) -> Column:
    names = columns or (
        "application_start_at", "application_end_at", "results_date", "general_sale_date", "payment_end_at",
    )
    return F.greatest(*[F.col(c) for c in names])


def latest_day(*columns: str) -> Column:
    """Latest date as a proleptic day number (day 1 is 0001-01-01), 0 when there is none."""
    return F.coalesce(F.date_diff(latest_date(*columns), F.lit("0001-01-01").cast("date")) + 1, F.lit(0))


def relevant_date() -> Column:
    status = F.col("status")
    start, end = F.col("application_start_at"), F.col("application_end_at")
    results, pay, sale = F.col("results_date"), F.col("payment_end_at"), F.col("general_sale_date")
    return (
        F.when(status.isin("closing_soon", "open", "upcoming"), F.coalesce(end, start))
        .when(status == "results_today", results)
        .when(status == "payment_due", pay)
        .when(status == "general_sale_soon", sale)
        .otherwise(F.coalesce(start, end, results, pay, sale))
    )


def schedule_label() -> Column:
    start, end = F.col("application_start_at").cast("string"), F.col("application_end_at").cast("string")
    window = (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("Apply "), start, F.lit(" – "), end))
        .when(start.isNotNull(), F.concat(F.lit("Apply from "), start))
        .when(end.isNotNull(), F.concat(F.lit("Apply by "), end))
    )
    return F.concat_ws(
        " · ",
        window,
        F.concat(F.lit("Results "), F.col("results_date").cast("string")),
        F.concat(F.lit("Pay by "), F.col("payment_end_at").cast("string")),
        F.concat(F.lit("Sale "), F.col("general_sale_date").cast("string")),
    )


def label(labels: dict[str, str], code: Column) -> Column:
    """Label of a code, '' for anything else."""
    return F.coalesce(lookup(labels, code), F.lit(""))


def status_label(status: Column) -> Column:
    return label(dims.STATUS_LABELS, status)


def status_rank(status: Column) -> Column:
    return F.coalesce(lookup(dims.STATUS_RANK, status), F.lit(99))


# --- places ------------------------------------------------------------------

def city_for_text(text: Column) -> Column:
    cities = {c: c for c in dims.TOUR_CITIES} | dict(dims.VENUE_CITIES)
    return F.coalesce(lookup(cities, first_listed(text, [(c,) for c in cities])), F.lit(""))


def round_location(name: Column, evidence: Column, venues: Column) -> Column:
    clean_name = collapse(F.coalesce(name, F.lit("")))
    haystack = F.concat(clean_name, F.lit(" "), collapse(F.coalesce(evidence, F.lit(""))))
    venue = F.try_element_at(F.filter(venues, lambda v: (v != "") & F.contains(haystack, v)), F.lit(1))
    return F.coalesce(
        present(city_for_text(haystack)),
        present(city_for_text(venue)),
        venue,
        F.when(F.contains(clean_name, F.lit(dims.ADDED_SHOW)), dims.ADDED_SHOW),
        F.lit(""),
    )


def event_location(venues: Column) -> Column:
    """Short parenthetical, else region prefix of the first venue that has one, else venue 1."""
    def trimmed(v: Column) -> Column:
        text = F.regexp_replace(collapse(v), "^[ ：:]+|[ ：:]+$", "")
        text = F.regexp_replace(text, r"(?iU)^(?:会\s*場|Venue)\s*", "")
        return F.regexp_replace(text, "^[ ：:]+|[ ：:]+$", "")

    def place(v: Column) -> Column:
        text = trimmed(v)
        inner = collapse(F.regexp_extract(text, r"[（(]([^）)]+)[）)]", 1))
        region = F.regexp_extract(text, r"(?U)^(" + "|".join(dims.LOCATION_REGIONS) + r")\s+", 1)
        return F.when((inner != "") & (F.length(inner) <= 24), inner).otherwise(present(region))

    found = F.try_element_at(F.array_compact(F.transform(venues, place)), F.lit(1))
    first = F.regexp_replace(collapse(F.try_element_at(venues, F.lit(1))), "^[ ：:]+|[ ：:]+$", "")
    return F.coalesce(found, first, F.lit(""))


def venue_label(venues: Column, title: Column) -> Column:
    named = F.filter(F.transform(venues, collapse), lambda v: v != "")
    touring = collapse(F.coalesce(title, F.lit(""))).rlike(r"(?iU)\bTOUR\b|ツアー|\d+\s*-?\s*CITY")
    return (
        F.when(F.size(named) > 0, F.array_join(F.slice(named, 1, 3), "; "))
        .when(touring, "Multiple cities")
        .otherwise("—")
    )


def evidence_snippet(value: Column, limit: int = 180) -> Column:
    text = collapse(F.coalesce(value, F.lit("")))
    text = F.regexp_replace(text, dims.SNIPPET_NOTICE, " ")
    text = F.regexp_replace(text, r"(?U)https?://\S+", " ")
    text = F.regexp_replace(collapse(text), "^[ ・:：。]+|[ ・:：。]+$", "")
    tail = F.regexp_extract(text, r"(?s)^.*?(" + dims.SNIPPET_LABEL + r".*)$", 1)
    text = F.when(tail != "", tail).otherwise(text)
    return (
        F.when(text == "", "none")
        .when(F.length(text) <= limit, text)
        .otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit("...")))
    )


def tour_stops(venues: Column, event_dates: Column) -> Column:
    """array<struct<city, venue, date>>: the n-th venue with the n-th date text."""
    return F.transform(
        venues,
        lambda v, i: F.struct(
            city_for_text(v).alias("city"),
            v.alias("venue"),
            F.coalesce(F.try_element_at(event_dates, i + 1), F.lit("")).alias("date"),
        ),
    )


# --- names -------------------------------------------------------------------

def looks_like_listing(evidence: Column) -> Column:
    place = evidence.rlike(U + dims.LISTING_PREFECTURE) | evidence.rlike("(?iu)" + dims.LISTING_VENUE)
    return place & ~any_contains(evidence, dims.APPLICATION_WINDOW_SIGNALS)


def round_name(context: Column) -> Column:
    """Label nearest to, and preferably before, the first date; NULL without a label."""
    lead = F.regexp_extract(context, U + f"^((?s:.)*?){dims.DATE_TOKEN}", 1)
    date_at = F.length(F.when(context.rlike(DATE_RE), lead).otherwise(context))
    named = F.transform(
        string_array(dims.ROUND_NAME_LABELS),
        lambda l: F.struct(
            (F.position(l, context) - 1).alias("s"),
            (F.position(l, context) - 1 + F.length(l)).alias("e"),
            l.alias("name"),
        ),
    )
    numbered_re = U + dims.ROUND_NUMBERED
    found = F.regexp_extract(context, numbered_re, 0)
    at = F.when(found == "", -1).otherwise(F.length(F.split(context, numbered_re, 2)[0]))
    numbered = F.array(F.struct(at.alias("s"), (at + F.length(found)).alias("e"), collapse(found).alias("name")))
    spans = F.filter(F.concat(numbered, named), lambda x: x["s"] >= 0)

    def nearest(xs: Column) -> Column:
        outer = F.filter(
            xs,
            lambda x: ~F.exists(
                xs,
                lambda o: (o["s"] <= x["s"]) & (x["e"] <= o["e"]) & ((o["s"] != x["s"]) | (o["e"] != x["e"])),
            ),
        )
        ranked = F.transform(
            outer,
            lambda x: F.struct(
                (x["s"] > date_at).cast("int").alias("after"),
                F.abs(date_at - x["s"]).alias("dist"),
                x["name"].alias("name"),
            ),
        )
        return F.array_min(ranked)["name"]

    return F.transform(F.array(spans), nearest)[0]


def application_name(context: Column) -> Column:
    return F.when(any_contains(context, dims.APPLICATION_SIGNALS), "先行受付").when(
        any_contains(context, dims.SALE_SIGNALS), "一般発売"
    )


def round_section(context: Column, name: Column) -> Column:
    """Context from ``name`` (with its opening bracket) up to the next round label."""
    start = F.position(name, context)
    bracket = F.substring(context, start - 1, 1).isin("【", "[") & (start > 1)
    left = F.when(bracket, start - 1).otherwise(start)
    ends = F.filter(
        F.transform(
            string_array(dims.ROUND_NAME_LABELS), lambda l: F.position(l, context, start + F.length(name))
        ),
        lambda p: p > 0,
    )
    right = F.coalesce(F.array_min(ends), F.length(context) + 1)
    section = F.regexp_replace(F.substring(context, left, right - left), r"[ \t\r\n【\[]+$", "")
    return F.when(start == 0, context).otherwise(section)


