"""Date tokens, ranges and label-anchored dates.

Inside extraction a date is ISO text (``2026-02-31`` is kept as text, as a page may print
it); tables hold DATE. Every year guess takes ``as_of`` instead of the wall clock.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.text import ascii_digits, bind, chunked, collapse, cut, first_n, running_starts

U = dims.UNI
DATE_RE = U + dims.DATE_TOKEN
_T = dims.DATE_TOKEN
RANGE_RE = (
    U + f"({_T})(?:(?!{_T}).){{0,60}}(?:[{dims.RANGE_MARKS}]|から)(?:(?!{_T}).){{0,60}}({_T})"
)
YMD_JP = U + r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})日"
YMD_WEST = U + r"(20\d{2})[./-](\d{1,2})[./-](\d{1,2})"
MD_JP = U + r"(\d{1,2})月\s*(\d{1,2})日"
MD_WEST = U + r"(\d{1,2})[./-](\d{1,2})"
TOKEN_PARTS = U + r"^(?:(20\d{2})(?:年\s*|[./-]))?(\d{1,2})(?:月\s*|[./-])(\d{1,2})日?$"


def as_date(day: dt.date | str) -> Column:
    return F.to_date(F.lit(str(day)))


def iso_date(c: Column) -> Column:
    """Lenient ISO prefix parse: anything unusable is NULL."""
    return _try_iso(F.substring(c, 1, 10))


def _try_iso(c: Column) -> Column:
    return F.when(c.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def dominant_year(text: Column) -> Column:
    """The page's year when it prints exactly one distinct ``20dd``."""
    years = F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(r"(?U)20\d{2}"), F.lit(0)), ascii_digits)
    )
    return F.when(F.size(years) == 1, F.try_element_at(years, F.lit(1)).cast("int"))


def infer_year(month: Column, day: Column, as_of: Column) -> Column:
    """The as-of year, or the next one when the day lies over 180 days back; NULL for no such day."""
    candidate = _try_iso(_iso(F.year(as_of), month, day))
    return F.when(candidate < F.date_sub(as_of, 180), F.year(as_of) + 1).when(
        candidate.isNotNull(), F.year(as_of)
    )


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a year of four digits and a month and a day of one or two."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(day))


def is_valid_month_day(month: Column, day: Column) -> Column:
    return month.between(1, 12) & day.between(1, 31)


def token_iso(token: Column, year_hint: Column, as_of: Column) -> Column:
    """ISO text of one date token, or NULL. Parts are bound once to keep the expression small."""
    def parts(plain: Column) -> Column:
        part = lambda g: F.regexp_extract(plain, TOKEN_PARTS, g).try_cast("int")
        return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))

    def build(p: Column) -> Column:
        year = F.coalesce(p["y"], year_hint, infer_year(p["m"], p["d"], as_of))
        return F.when(is_valid_month_day(p["m"], p["d"]) & year.between(2000, 2099), _iso(year, p["m"], p["d"]))

    return bind(bind(ascii_digits(token), parts), build)


def normalize_date(value: Column, year_hint: Column, as_of: Column) -> Column:
    """ISO text for the first date shape that occurs (four shapes, tried in order), else NULL."""
    shapes = [F.nullif(F.regexp_extract(value, p, 0), F.lit("")) for p in (YMD_JP, YMD_WEST, MD_JP, MD_WEST)]
    return token_iso(F.coalesce(*shapes), year_hint, as_of)


def all_dates(text: Column, year_hint: Column, as_of: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(DATE_RE), F.lit(0))
    return F.array_compact(F.transform(tokens, lambda t: token_iso(t, year_hint, as_of)))


def first_date_token(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DATE_RE, 0), F.lit(""))


def first_date(text: Column, year_hint: Column, as_of: Column) -> Column:
    """First token that normalises."""
    return F.try_element_at(all_dates(text, year_hint, as_of), F.lit(1))


def date_range(text: Column, year_hint: Column, as_of: Column) -> Column:
    """struct(start, end): a separated pair, else the first two dates, else one."""
    hint = F.coalesce(dominant_year(text), year_hint)
    # One-element arrays bind shared sub-results once instead of repeating their expressions.
    def build(h: Column) -> Column:
        dates = all_dates(text, h, as_of)
        paired = F.struct(
            token_iso(F.regexp_extract(text, RANGE_RE, 1), h, as_of).alias("start"),
            token_iso(F.regexp_extract(text, RANGE_RE, 2), h, as_of).alias("end"),
        )
        listed = F.transform(
            F.array(dates),
            lambda d: F.struct(
                F.try_element_at(d, F.lit(1)).alias("start"),
                F.try_element_at(d, F.lit(2)).alias("end"),
            ),
        )[0]
        return F.when(text.rlike(RANGE_RE), paired).otherwise(listed)

    return F.transform(F.array(hint), build)[0]


def occurrences(text: Column, label: Column) -> Column:
    """0-based code-point offsets of a literal label, case-insensitively, in order."""
    parts = F.split(text, F.concat(F.lit(r"(?iu)\Q"), label, F.lit(r"\E")))
    sizes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p))
    return running_starts(sizes, F.transform(sizes, lambda _: F.length(label)))


def label_windows(text: Column, labels: Column, before: int | None, after: int | None, chunks: Column | None = None) -> Column:
    """Raw windows around each label, labels in list order, then occurrences in order.

    ``before`` counts characters in front of the label; ``after`` counts characters past its
    end, ``None`` meaning the window stops where the label starts. Long texts bring their ``chunks``.
    """
    def of_label(label: Column) -> Column:
        def window(start: Column) -> Column:
            left = F.greatest(start - (before or 0), F.lit(0))
            right = start if after is None else start + F.length(label) + after
            return F.substring(text, left + 1, right - left) if chunks is None else cut(chunks, left, right)

        return F.transform(occurrences(text, label), window)

    hits = bind(F.lower(text), lambda low: F.filter(labels, lambda l: F.contains(low, F.lower(l))))
    return F.flatten(F.transform(hits, of_label))


def date_after_label(text: Column, labels: Column, year_hint: Column, as_of: Column, width: int) -> Column:
    """First label window whose first date token normalises."""
    def of_window(w: Column) -> Column:
        return token_iso(first_date_token(w), F.coalesce(dominant_year(w), year_hint), as_of)

    dates = F.transform(label_windows(text, labels, 0, width), of_window)
    return F.try_element_at(F.array_compact(dates), F.lit(1))


def date_before_label(text: Column, labels: Column, year_hint: Column, as_of: Column, width: int = 60) -> Column:
    """Last date of the first window in front of a label that holds one."""
    def of_window(w: Column) -> Column:
        hint = F.coalesce(dominant_year(w), year_hint)
        return F.try_element_at(all_dates(w, hint, as_of), F.lit(-1))

    dates = F.transform(label_windows(text, labels, width, None), of_window)
    return F.try_element_at(F.array_compact(dates), F.lit(1))


def range_after_label(text: Column, labels: Column, year_hint: Column, as_of: Column, width: int = 140) -> Column:
    """First label window that yields a start or an end; struct of NULLs otherwise."""
    ranges = F.transform(
        label_windows(text, labels, 0, width), lambda w: date_range(w, year_hint, as_of)
    )
    found = F.filter(ranges, lambda r: r["start"].isNotNull() | r["end"].isNotNull())
    none = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    return F.coalesce(F.try_element_at(found, F.lit(1)), none)


def occurring(text: Column, patterns: Iterable[str]) -> Column:
    """The distinct patterns that match the text, in list order; a word without case or operators by a substring test."""
    def hit(pattern: str) -> Column:
        plain = pattern.lower() == pattern.upper() and not re.search(r"[\\.\[\]{}()*+?^$|\s]", pattern)
        return F.contains(text, F.lit(pattern)) if plain else text.rlike(f"(?iUd){pattern}")

    return F.array_compact(F.array(*[F.when(hit(p), F.lit(p)) for p in dict.fromkeys(patterns)]))


def pattern_windows(text: Column, patterns: Column | Iterable[str], before: int, after: int) -> Column:
    """Distinct collapsed windows around regex matches: pattern order, then position order.

    Patterns given as text are tried on the page first; windows are cut for those that match.
    """
    patterns = patterns if isinstance(patterns, Column) else occurring(text, patterns)

    def of_page(chunks: Column) -> Column:
        def of_pattern(pattern: Column) -> Column:
            rx = F.concat(F.lit("(?iUd)"), pattern)
            gaps = F.transform(F.split(text, rx), lambda p: F.length(p))
            return bind(
                F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: F.length(m)),
                lambda lengths: F.zip_with(
                    running_starts(gaps, lengths), lengths, lambda at, n: collapse(cut(chunks, at - before, at + n + after))
                ),
            )

        return F.array_distinct(F.flatten(F.transform(patterns, of_pattern)))

    return bind(chunked(text), of_page)


def label_phrases(text: Column, labels: Column, before: int, after: int) -> Column:
    """Distinct collapsed label windows of a page."""
    return bind(
        chunked(text),
        lambda chunks: F.array_distinct(
            F.transform(label_windows(text, labels, before, after, chunks), lambda w: collapse(w))
        ),
    )


def nearby_phrases(text: Column, labels: Column, width: int = 90, limit: int | None = None) -> Column:
    return first_n(label_phrases(text, labels, width // 3, width), limit)
