"""Whitespace, stripping, hashing and list helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_array() -> Column:
    return F.expr("cast(array() as array<string>)")


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def quoted(value: str) -> str:
    """A Java-regex literal for ``value``."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-/])", r"\\\1", value)


def alternation(values: Iterable[str]) -> str:
    return "(?:" + "|".join(quoted(v) for v in values) + ")"


def any_contains(haystack: Column, needles: Iterable[str]) -> Column:
    """Substring test against a list: one alternation regex, so the haystack is evaluated once
    and the generated code stays small."""
    wanted = list(needles)
    if len(wanted) == 1:
        return F.contains(haystack, F.lit(wanted[0]))
    return haystack.rlike(alternation(wanted))


def first_listed(haystack: Column, groups: Iterable[tuple[str, ...]]) -> Column:
    """The fragment found for the first group (in list order) that occurs anywhere, else ''.

    One regex with an alternative per group, tried in order, so the haystack is evaluated once.
    """
    wanted = [tuple(g) for g in groups]
    lead = "|".join(f".*?(?={alternation(g)})" for g in wanted)
    every = alternation([fragment for g in wanted for fragment in g])
    return F.regexp_extract(haystack, f"(?s)^(?:{lead})({every})", 1)


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table (a folded map literal) or NULL; the key is evaluated once."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def collapse(c: Column) -> Column:
    """Unicode whitespace runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def round_name_key(c: Column) -> Column:
    return F.lower(collapse(c))


def strip_chars(c: Column, chars: str) -> Column:
    cls = "[" + re.sub(r"([\\\[\]^\-&])", r"\\\1", chars) + "]+"
    return F.regexp_replace(c, f"^{cls}|{cls}$", "")


def present(c: Column) -> Column:
    """NULL for the empty string, so coalesce behaves like ``a or b``."""
    return F.nullif(c, F.lit(""))


def stable_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def joined_key(*parts: Column) -> Column:
    """Stable key over parts joined with ``|``; NULL counts as empty."""
    return stable_key(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def comma_values(c: Column) -> Column:
    parts = F.transform(F.split(c, ","), lambda x: F.lower(collapse(x)))
    return F.filter(parts, lambda x: x != "")


def lead_days(c: Column) -> Column:
    """Distinct whole numbers of a comma text in order; ``[0]`` when there are none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    days = F.array_distinct(
        F.transform(F.filter(parts, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
    )
    return F.when(F.size(days) == 0, F.array(F.lit(0))).otherwise(days)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def first_n(items: Column, limit: int | None) -> Column:
    """The first items of an array; all of them without a limit."""
    return items if limit is None else F.slice(items, 1, limit)


CHUNK = 512


def chunked(text: Column) -> Column:
    """The text in pieces of 512 characters, so that a place in a long text is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` (0-based, at least 0) to before ``end`` of a chunked text."""
    left = F.greatest(start, F.lit(0))
    first = F.floor(left / CHUNK).cast("int")
    count = F.greatest(F.ceil(end / CHUNK).cast("int") - first, F.lit(1))
    return F.substring(F.array_join(F.slice(chunks, first + 1, count), ""), left - first * CHUNK + 1, end - left)


def running_starts(gaps: Column, lengths: Column) -> Column:
    """Start offsets of hits from the lengths of the gaps before them and their own; only numbers accumulate."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, n: F.struct(g.alias("gap"), n.alias("len")))
    return F.aggregate(
        steps,
        F.expr("named_struct('at', 0, 'starts', cast(array() as array<int>))"),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + s["gap"])).alias("starts")
        ),
        lambda acc: acc["starts"],
    )


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _numeric_entities(c: Column) -> Column:
    """Decimal and hexadecimal references as characters; an ampersand waits for the end."""
    pieces = F.split(c, "&#(?=[0-9]|[xX][0-9a-fA-F])")
    number = r"^(?:[xX]([0-9a-fA-F]{1,8})|([0-9]{1,9}));?"

    def decoded(piece: Column) -> Column:
        hexadecimal, decimal = F.regexp_extract(piece, number, 1), F.regexp_extract(piece, number, 2)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("bigint")).otherwise(decimal.cast("bigint"))
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.concat(F.when(code == 38, "&amp;").otherwise(char), F.regexp_replace(piece, number, ""))

    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")
    return F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)


def unescape_html(c: Column) -> Column:
    """Numeric references, then named entities that occur in page text and hrefs, ``&amp;`` last."""
    out = _numeric_entities(c)
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


# --- fixed values: entities decoded natively (the last one must stay last) ---
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"),
    ("&yen;", "¥"), ("&euro;", "€"), ("&times;", "×"), ("&amp;", "&"),
)
