"""Facts from page text as corpus jobs: array expressions per page, one explode, no page shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.dates import (
    DATE_RE,
    U,
    all_dates,
    date_after_label,
    date_before_label,
    date_range,
    dominant_year,
    first_date,
    iso_date,
    label_phrases,
    nearby_phrases,
    pattern_windows,
    range_after_label,
    token_iso,
)
from roundtide.functions.rounds import (
    application_name,
    looks_like_listing,
    round_name,
    round_section,
)
from roundtide.functions.text import (
    chunked,
    cut,
    first_n,
    running_starts,
    bind,
    alternation,
    any_contains,
    collapse,
    empty_array,
    present,
    string_array,
    strip_chars,
)
from roundtide.functions.urls import is_actionable_ticket_link, platform_confidence, platform_name
from roundtide.operators.rounds import is_sale_round, normalize_rounds, staged

EDGE = " ：:、。"
NOTE_EDGE = " ・:：。"
ROUND_PREFILTER = r"(?iUd)先行|プレオーダー|プレリクエスト|抽選|" + "|".join(
    [*dims.ROUND_EXTRA_PATTERNS, *dims.ROUND_CONTEXT_HINTS]
)


def no_year() -> Column:
    return F.lit(None).cast("int")


def pattern_hits(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>>: code-point offsets of matches and one group's text."""
    gaps = F.transform(F.split(text, pattern), lambda p: F.length(p))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(lengths: Column) -> Column:
        ends = F.zip_with(
            running_starts(gaps, lengths), lengths, lambda at, n: F.struct(at.alias("start"), (at + n).alias("end"))
        )
        return F.zip_with(
            ends, values, lambda e, v: F.struct(e["start"].alias("start"), e["end"].alias("end"), v.alias("value"))
        )

    return bind(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.length(w)), placed)


# --- notes, rules, prices ---------------------------------------------------------

def split_notes(text: Column) -> Column:
    parts = F.transform(F.split(collapse(text), r"(?=※)|[。\n\r]+"), lambda p: strip_chars(p, NOTE_EDGE))
    return F.filter(parts, lambda p: p != "")


def sanitize_note(value: Column) -> Column:
    out = F.regexp_replace(value, r"(?U)https?://\S+", " ")
    out = F.regexp_replace(out, r"(?U)(?<!:)//\S+", " ")
    out = F.regexp_replace(out, r"(?U)(?:^|\s)(?:同意|注意)$", " ")
    return strip_chars(collapse(out), NOTE_EDGE)


def ticket_rules(text: Column, limit: int | None = None) -> Column:
    """Hinted notes; a leading continuation joins the item before it; contained notes drop out."""
    notes = F.filter(
        F.transform(split_notes(text), sanitize_note),
        lambda n: (n != "")
        & ~n.isin(*dims.RULE_BARE)
        & ~any_contains(n, dims.RULE_SKIPS)
        & ~F.contains(F.lower(n), F.lit("cookie")),
    )

    def step(acc: Column, n: Column) -> Column:
        last = F.element_at(acc, -1)
        continues = (F.size(acc) > 0) & (
            n.startswith(dims.RULE_CONTINUATIONS[0]) | n.startswith(dims.RULE_CONTINUATIONS[1])
        )
        merged = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), n))
        )
        known = F.exists(acc, lambda e: F.contains(e, n) | F.contains(n, e))
        return (
            F.when(F.lit(False) if limit is None else F.size(acc) >= limit, acc)
            .when(continues & F.contains(F.try_element_at(acc, F.lit(-1)), n), acc)
            .when(continues, merged)
            .when(known | ~any_contains(n, dims.RULE_HINTS), acc)
            .otherwise(F.concat(acc, F.array(n)))
        )

    return F.aggregate(notes, empty_array(), step)


def ticket_prices(text: Column, limit: int | None = None) -> Column:
    """Tier sections, else loose tier prices, else notes that name an amount."""
    return bind(collapse(text), lambda flat: bind(chunked(flat), lambda chunks: _prices(flat, chunks, limit)))


def _prices(flat: Column, chunks: Column, limit: int | None) -> Column:
    yen = U + dims.PRICE_YEN

    def sections(hits: Column) -> Column:
        def section(h: Column, i: Column) -> Column:
            own = h["end"] - 1 - F.length(h["value"])
            nxt = F.get(hits, i + 1)
            stop = F.coalesce(nxt["end"] - 1 - F.length(nxt["value"]), F.length(flat))
            body = F.split(cut(chunks, own, stop), dims.PRICE_STOP, 2)[0]
            return strip_chars(body, NOTE_EDGE + "＊*")

        return F.transform(hits, section)

    tiers = F.filter(bind(pattern_hits(flat, U + dims.PRICE_TIER, 1), sections), lambda n: n.rlike(yen))
    loose = F.filter(
        F.transform(
            F.regexp_extract_all(flat, F.lit(U + dims.PRICE_LOOSE), F.lit(0)), lambda n: strip_chars(n, NOTE_EDGE)
        ),
        lambda n: n != "",
    )
    noted = F.filter(
        F.transform(
            F.filter(split_notes(flat), lambda n: n.rlike(yen)),
            lambda n: F.trim(F.regexp_replace(n, U + dims.PRICE_LEAD, "")),
        ),
        lambda n: n != "",
    )

    def choose(level: Column, below: Column) -> Column:
        return bind(level, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(below))

    return first_n(F.array_distinct(choose(tiers, choose(loose, noted))), limit)


# --- event dates and venues ---------------------------------------------------------

def event_dates(text: Column, limit: int | None = None) -> Column:
    return bind(chunked(text), lambda chunks: _event_dates(text, chunks, limit))


def _event_dates(text: Column, chunks: Column, limit: int | None) -> Column:
    labels = string_array(dims.EVENT_DATE_LABELS)

    def clean_phrase(p: Column) -> Column:
        lead = F.split(p, DATE_RE, 2)[0]
        scope = F.when(any_contains(lead, dims.EVENT_DATE_LABELS), lead).otherwise(p)
        return p.rlike(DATE_RE) & ~any_contains(scope, dims.EVENT_DATE_NOISE)

    labelled = F.filter(nearby_phrases(text, labels, 90, limit), clean_phrase)

    def periods(pattern: str, lead_width: int) -> Column:
        def lead(h: Column) -> Column:
            return F.translate(cut(chunks, h["start"] - lead_width, h["start"]), " 　", "")

        kept = F.filter(
            pattern_hits(text, U + pattern, 1), lambda h: ~any_contains(lead(h), dims.PERIOD_LEAD_NOISE)
        )
        return F.filter(
            F.transform(kept, lambda h: strip_chars(collapse(h["value"]), EDGE)), lambda p: p != ""
        )

    return F.array_distinct(
        F.concat(labelled, periods(dims.SLASH_PERIOD_PATTERN, 24), periods(dims.PERIOD_PATTERN, 12))
    )


def venue_is_noisy(venue: Column, context: Column) -> Column:
    return any_contains(collapse(context), dims.VENUE_CONTEXT_NOISE) | any_contains(
        collapse(venue), dims.VENUE_NOISE
    )


def venues(text: Column, limit: int | None = None) -> Column:
    """Ordered patterns; the loosest one only when the others found nothing."""
    return bind(chunked(text), lambda chunks: _venues(text, chunks, limit))


def _venues(text: Column, chunks: Column, limit: int | None) -> Column:
    def found(pattern: str) -> Column:
        def tidy(h: Column) -> Column:
            v = strip_chars(collapse(h["value"]), EDGE)
            v = F.trim(F.regexp_replace(v, r"(?U)^(?:のご案内|会場のご案内)\s*", ""))
            return F.struct(v.alias("v"), collapse(cut(chunks, h["start"] - 24, h["end"] + 80)).alias("ctx"))

        kept = F.filter(
            F.transform(pattern_hits(text, U + pattern, 1), tidy),
            lambda x: (x["v"] != "") & ~venue_is_noisy(x["v"], x["ctx"]),
        )
        return F.transform(kept, lambda x: x["v"])

    def fold(candidates: Column) -> Column:
        return F.aggregate(
            candidates,
            empty_array(),
            lambda acc, v: F.when(
                (F.lit(False) if limit is None else F.size(acc) >= limit)
                | F.exists(acc, lambda e: F.contains(e, v) | F.contains(v, e)),
                acc,
            ).otherwise(F.concat(acc, F.array(v))),
        )

    strict = fold(F.concat(*[found(p) for p in dims.VENUE_PATTERNS[:3]]))
    return bind(strict, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(fold(found(dims.VENUE_PATTERNS[3]))))


def clean_venues(names: Column) -> Column:
    return F.filter(names, lambda v: (collapse(v) != "") & ~venue_is_noisy(v, F.lit("")))


def tour_venue(window: Column) -> Column:
    w = collapse(window)
    suffix, prefecture = alternation(dims.VENUE_SUFFIXES), alternation(dims.PREFECTURES)
    return F.coalesce(
        present(collapse(F.regexp_extract(w, U + prefecture + r"\s*[・:：]?\s*[^\s、,，。]{0,24}?" + suffix, 0))),
        present(collapse(F.regexp_extract(w, U + r"[^\s、,，。]{1,24}?" + suffix, 0))),
        present(collapse(F.regexp_extract(w, U + dims.TITLE_PLACE, 1))),
        F.regexp_extract(w, U + prefecture, 0),
    )


# --- tour schedules -----------------------------------------------------------------

def tour_entries(text: Column, as_of: Column, last_width: int | None = None, title_width: int | None = None) -> Column:
    """array of (date, date_text, title, venue, ended): text between one date and the next.

    The last entry reaches to the end of the text and titles are whole, unless widths are given.
    """
    return bind(chunked(text), lambda chunks: _tour_entries(text, chunks, as_of, last_width, title_width))


def _tour_entries(text: Column, chunks: Column, as_of: Column, last_width: int | None, title_width: int | None) -> Column:
    def entries(hits: Column) -> Column:
        def entry(h: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(hits, i + 1)["start"], F.length(text) if last_width is None else h["end"] + last_width)
            chunk = collapse(cut(chunks, h["end"], stop))
            chunk = F.regexp_replace(chunk, r"(?U)^[\[\(（][^\]\)）]{1,12}[\]\)）]\s*", "")
            flag = r"(?U)^[\[【]?\s*終了\s*[\]】]?\s*"
            rest = F.regexp_replace(chunk, flag, "")
            return F.struct(
                h["iso"].alias("date"),
                collapse(h["value"]).alias("date_text"),
                strip_chars(rest if title_width is None else F.substring(rest, 1, title_width), " 　・-—:：").alias("title"),
                tour_venue(rest).alias("venue"),
                chunk.rlike(flag).alias("ended"),
            )

        return F.transform(hits, entry)

    def dated(year: Column) -> Column:
        with_iso = F.transform(
            pattern_hits(text, DATE_RE, 0),
            lambda h: F.struct(
                h["start"].alias("start"),
                h["end"].alias("end"),
                h["value"].alias("value"),
                token_iso(h["value"], year, as_of).alias("iso"),
            ),
        )
        return F.filter(with_iso, lambda h: h["iso"].isNotNull())

    return F.filter(bind(bind(dominant_year(text), dated), entries), lambda e: e["title"] != "")


def tour_dates(parsed: DataFrame, as_of: Column, last_width: int | None = None, title_width: int | None = None) -> DataFrame:
    """One row per show of a page; the first of equal (date, title) wins."""
    shows = parsed.where(F.col("text").rlike(DATE_RE)).select(
        "page_id", "url", F.posexplode(tour_entries(F.col("text"), as_of, last_width, title_width)).alias("pos", "e")
    )
    first = shows.groupBy("page_id", "url", F.col("e.date").alias("date"), F.col("e.title").alias("title")).agg(
        F.min(F.struct("pos", "e.date_text", "e.venue", "e.ended")).alias("f")
    )
    return first.select("page_id", "url", "date", "title", "f.pos", "f.date_text", "f.venue", "f.ended")


# --- ticket rounds ------------------------------------------------------------------

def round_contexts(text: Column) -> Column:
    """Distinct context windows around round labels and hints, in scan order.

    A hint that is among the labels has its windows from there.
    """
    named = [*dims.ROUND_LABEL_PATTERNS, *dims.ROUND_EXTRA_PATTERNS]
    return F.array_distinct(
        F.concat(
            pattern_windows(text, named, 60, 220),
            label_phrases(text, string_array(dims.ROUND_FORWARD_LABELS), 12, 180),
            pattern_windows(text, [p for p in dims.ROUND_CONTEXT_HINTS if p not in named], 60, 220),
        )
    )


MEMBER_PATTERN = (
    U + "(" + "|".join(dims.MEMBERSHIP_RANGE_LABELS) + r")[：:]\s*("
    + f"{dims.DATE_TOKEN}(?:(?!{dims.DATE_TOKEN}).){{0,60}}[{dims.RANGE_MARKS}]"
    + f"(?:(?!{dims.DATE_TOKEN}).){{0,60}}{dims.DATE_TOKEN})"
)


def membership_windows(context: Column, base_name: Column, year_hint: Column, as_of: Column) -> Column:
    """Distinct (name, start, end) per membership label that prints a range."""
    labels = F.regexp_extract_all(context, F.lit(MEMBER_PATTERN), F.lit(1))
    ranges = F.regexp_extract_all(context, F.lit(MEMBER_PATTERN), F.lit(2))
    hint = F.coalesce(dominant_year(context), year_hint)

    def child(label: Column, span: Column) -> Column:
        name = F.when(
            (base_name != "") & ~F.contains(base_name, label), F.concat(base_name, F.lit(" / "), label)
        ).otherwise(label)
        r = date_range(span, hint, as_of)
        return F.struct(name.alias("name"), r["start"].alias("start"), r["end"].alias("end"))

    return F.array_distinct(F.zip_with(labels, ranges, child))


FACTS = ("results", "sale", "deadline", "pay_start", "pay_end", "trade_start", "trade_end")


def extract_rounds(parsed: DataFrame, as_of: Column) -> DataFrame:
    """(page_id, url, text) -> raw rounds with a page ordinal; DATE columns, first wins.

    Pages without any round word or date token are dropped before the window scan. After the
    explode only the context travels, dealt out by page and window, as reading a window costs far more
    than moving it and a long page has very many; the number of tasks is given, or adaptive execution would
    join them by bytes. Every fact is its own projected column, so a window is evaluated once.
    """
    text, spark = F.col("text"), parsed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    scanned = (
        parsed.where(text.rlike(ROUND_PREFILTER) & text.rlike(DATE_RE))
        .select("page_id", "url", dominant_year(text).alias("year"), F.posexplode(round_contexts(text)).alias("ord", "context"))
        .where(F.col("context").rlike(DATE_RE))
        .repartition(tasks, "page_id", "ord")
    )
    context, section, year, name = F.col("context"), F.col("section"), F.col("year"), F.col("name")
    named = staged(
        staged(scanned, {"name": F.coalesce(round_name(context), application_name(context))}).where(name.isNotNull()),
        {"section": round_section(context, name)},
    )

    def after(source: Column, *labels: str, width: int = 100) -> Column:
        return date_after_label(source, string_array(labels), year, as_of, width)

    def before(*labels: str) -> Column:
        return date_before_label(context, string_array(labels), year, as_of)

    ranged = staged(
        named,
        {
            "own": range_after_label(section, F.array(name), year, as_of),
            "pay": range_after_label(section, string_array(dims.PAYMENT_RANGE_LABELS), year, as_of),
            "trade": range_after_label(section, string_array(dims.TRADE_RANGE_LABELS), year, as_of),
            "results": after(section, *dims.RESULT_LABELS),
            "sale": F.coalesce(
                after(context, "一般発売", "一般前売", "発売日", "発売開始"),
                before("一般発売", "一般前売", "発売開始"),
            ),
        },
    )
    ranged = staged(
        ranged,
        {
            "window": F.when(
                F.col("own.start").isNotNull() | F.col("own.end").isNotNull(), F.col("own")
            ).otherwise(range_after_label(section, string_array(dims.ADVANCE_RANGE_LABELS), year, as_of)),
            "deadline": F.coalesce(
                "pay.end",
                "pay.start",
                after(section, "入金", "支払", "払込", "決済", "支払い", "支払期限", "入金締切"),
            ),
        },
    )
    booking = any_contains(name, ("会員先行予約", "先行予約"))
    dated = staged(
        ranged,
        {
            "start": F.coalesce(
                F.when(booking, before("会員先行予約", "先行予約")),
                F.col("window.start"),
                before("会員先行予約", "先行予約", "先着先行"),
                after(context, "先行先着販売", "先着先行", width=40),
            ),
            "end": F.col("window.end"),
            "pay_start": F.col("pay.start"),
            "pay_end": F.col("pay.end"),
            "trade_start": F.col("trade.start"),
            "trade_end": F.col("trade.end"),
        },
    ).where(F.coalesce("start", "end", "results", "sale", "deadline", "trade_start", "trade_end").isNotNull())
    sale_round = is_sale_round(name)
    own = F.struct(
        name.alias("name"),
        F.when(~sale_round, F.col("start")).alias("start"),
        F.when(~sale_round, F.col("end")).alias("end"),
    )
    children = F.when(~sale_round, membership_windows(section, name, year, as_of))
    split = staged(dated, {"children": children}).select(
        "page_id", "url", "ord", *FACTS, F.col("section").alias("evidence"),
        F.posexplode(F.when(F.size("children") > 0, F.col("children")).otherwise(F.array(own))).alias("sub", "r"),
    )
    first = split.groupBy(
        "page_id", "url", F.col("r.name").alias("name"), F.col("r.start").alias("start"), F.col("r.end").alias("end")
    ).agg(F.min(F.struct("ord", "sub", *FACTS, "evidence")).alias("f"))
    return first.select("page_id", "url", "name", "start", "end", "f.*").select(
        "page_id",
        F.struct("ord", "sub").alias("round_ord"),
        platform_name(F.col("url")).alias("source"),
        "url",
        "name",
        iso_date(F.col("start")).alias("lottery_start"),
        iso_date(F.col("end")).alias("lottery_end"),
        iso_date(F.col("results")).alias("results_date"),
        iso_date(F.col("sale")).alias("general_sale_date"),
        iso_date(F.col("deadline")).alias("payment_deadline"),
        F.lit(None).cast("date").alias("application_start_at"),
        F.lit(None).cast("date").alias("application_end_at"),
        iso_date(F.col("pay_start")).alias("payment_start_at"),
        iso_date(F.col("pay_end")).alias("payment_end_at"),
        iso_date(F.col("trade_start")).alias("trade_start_at"),
        iso_date(F.col("trade_end")).alias("trade_end_at"),
        "evidence",
        F.lit(None).cast("int").alias("round_number"),
        F.lit(None).cast("string").alias("platform"),
        F.lit(50).alias("confidence"),
        F.lit("unknown").alias("round_type"),
        F.lit("unknown").alias("membership_required"),
    )


def page_rounds(parsed: DataFrame, as_of: Column) -> DataFrame:
    """Extracted rounds, normalised; rounds on a known platform carry its name and confidence."""
    source = F.col("source")
    known = source.isin(*dims.TICKET_PLATFORMS)
    adapted = extract_rounds(parsed, as_of).withColumns(
        {
            "platform": F.when(known, source),
            "confidence": F.when(known, platform_confidence(source)).otherwise(F.col("confidence")),
        }
    )
    return normalize_rounds(adapted, as_of)


def split_memberships(rounds: DataFrame, as_of: Column) -> DataFrame:
    """Membership windows in the evidence of stored rounds: all columns, ``child``, ``member_name``.

    A round named after a membership is read again from its evidence, under the name found there;
    any other must name an advance sale that is no draw.
    """
    name, evidence = F.col("name"), F.coalesce(F.col("evidence"), F.lit(""))
    member = F.contains(name, F.lit("会員"))
    eligible = (evidence != "") & (
        member | ~any_contains(name, ("/", "抽選")) & any_contains(name, ("先行", "先着"))
    )
    named = F.coalesce(round_name(evidence), F.lit("先行"))
    base = F.when(member | (name == "先行"), named).otherwise(name)
    year = F.when(~member, dominant_year(evidence))
    children = F.when(
        eligible & evidence.rlike(MEMBER_PATTERN), membership_windows(evidence, base, year, as_of)
    )
    return (
        rounds.withColumns({"children": children, "member_name": member})
        .where(F.size("children") > 0)
        .withColumn("child", F.explode("children"))
        .drop("children")
    )


# --- performance-run scrub ------------------------------------------------------------

PERIOD_TYPE = "array<struct<start:string,end:string>>"


def _full(ranges: Column) -> Column:
    return F.array_distinct(
        F.filter(ranges, lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    )


def performance_periods(dates: Column, as_of: Column) -> Column:
    """Run ranges of an event, read from the text before the first ticketing word."""
    cut_re = alternation(dims.PERIOD_CUT_LABELS)
    return _full(F.transform(dates, lambda d: date_range(F.split(d, cut_re, 2)[0], no_year(), as_of)))


def evidence_periods(evidence: Column, as_of: Column) -> Column:
    spans = F.regexp_extract_all(evidence, F.lit(U + dims.EVIDENCE_RANGE), F.lit(0))
    return _full(F.transform(spans, lambda m: date_range(m, no_year(), as_of)))


def _replaced(text: Column, pattern: str, drop) -> Column:
    """Matches for which ``drop(match)`` holds become one space."""
    pieces, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(
            pieces, hits, lambda p, h: F.concat(p, F.when(h.isNull(), "").when(drop(h), " ").otherwise(h))
        ),
        "",
    )


def _without_ranges(evidence: Column, ranges: Column, as_of: Column) -> Column:
    def listed(h: Column) -> Column:
        return bind(
            date_range(h, no_year(), as_of),
            lambda r: F.coalesce(
                F.exists(ranges, lambda x: (x["start"] == r["start"]) & (x["end"] == r["end"])), F.lit(False)
            ),
        )

    return _replaced(evidence, U + dims.EVIDENCE_RANGE, listed)


def scrub_performance_windows(rounds: DataFrame, as_of: Column, dates: str = "event_dates") -> DataFrame:
    """Null ticket dates that only echo the event's run; narrow, one row in and one out.

    ``rounds`` carries the event's date phrases in column ``dates``.
    """
    ev = F.coalesce(F.col("evidence"), F.lit(""))
    text = lambda c: F.col(c).cast("string")
    rows = staged(
        rounds,
        {
            "_all": evidence_periods(ev, as_of),
            "_periods": performance_periods(F.coalesce(F.col(dates), empty_array()), as_of),
            "_listing": looks_like_listing(ev),
        },
    )
    rows = staged(
        rows,
        {"_seen": F.when(F.col("_listing"), F.col("_all")).otherwise(F.array_intersect("_all", "_periods"))},
    )
    union = F.array_union("_periods", "_seen")
    rows = staged(
        rows,
        {
            "_union": union,
            "_days": F.flatten(F.transform(union, lambda r: F.array(r["start"], r["end"]))),
            "_window_days": F.array_compact(
                F.array(
                    text("lottery_start"), text("lottery_end"),
                    text("application_start_at"), text("application_end_at"),
                )
            ),
        },
    )

    def is_run(start: str, end: str) -> Column:
        return F.coalesce(
            F.exists("_union", lambda r: (r["start"] == text(start)) & (r["end"] == text(end))), F.lit(False)
        )

    sale = text("general_sale_date")
    outside = F.array_contains(
        all_dates(_without_ranges(ev, F.col("_seen"), as_of), no_year(), as_of), sale
    )
    rows = staged(
        rows,
        {
            "_lottery": is_run("lottery_start", "lottery_end"),
            "_application": is_run("application_start_at", "application_end_at"),
            "_isolated": (F.size("_window_days") == 1)
            & F.coalesce(F.array_contains("_days", F.get("_window_days", F.lit(0))), F.lit(False))
            & F.col("_listing"),
            "_sale": F.coalesce(
                (F.size("_seen") > 0) & F.array_contains("_days", sale) & ~outside, F.lit(False)
            ),
        },
    )
    touched = F.col("_lottery") | F.col("_application") | F.col("_isolated") | (F.size("_seen") > 0)
    rejected = F.when(
        F.col("_lottery") | F.col("_application") | F.col("_isolated"),
        F.array_intersect("_window_days", "_days"),
    ).otherwise(empty_array())
    rows = staged(
        rows,
        {
            "_touched": touched,
            "_rejected": rejected,
            "_bare": F.when(touched, collapse(_without_ranges(ev, F.col("_seen"), as_of))),
        },
    )

    def rejected_date(h: Column) -> Column:
        return F.coalesce(
            F.array_contains("_rejected", token_iso(h, no_year(), as_of)), F.lit(False)
        )

    def kept(column: str, flag: str) -> Column:
        return F.when(~(F.col(flag) | F.col("_isolated")), F.col(column))

    return staged(
        rows,
        {
            "lottery_start": kept("lottery_start", "_lottery"),
            "lottery_end": kept("lottery_end", "_lottery"),
            "application_start_at": kept("application_start_at", "_application"),
            "application_end_at": kept("application_end_at", "_application"),
            "general_sale_date": F.when(~(F.col("_touched") & F.col("_sale")), F.col("general_sale_date")),
            "evidence": F.when(~F.col("_touched"), F.col("evidence"))
            .when(F.size("_rejected") > 0, collapse(_replaced(F.col("_bare"), DATE_RE, rejected_date)))
            .otherwise(F.col("_bare")),
        },
    ).select(*rounds.columns)


# --- event facts ------------------------------------------------------------------------

def page_facts(parsed: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Per-page fact arrays next to the page columns; narrow, texts evaluated once.

    ``limits`` caps kinds of facts per page (event_dates, venues, ticket_rules, ticket_prices,
    summary); without it every fact is kept.
    """
    most = (limits or {}).get
    text = F.col("text")
    return staged(
        parsed,
        {
            "ticket_links": F.filter("links", lambda l: is_actionable_ticket_link(l["url"], l["label"])),
            "event_dates": event_dates(text, most("event_dates")),
            "venues": venues(text, most("venues")),
            "ticket_rules": ticket_rules(text, most("ticket_rules")),
            "ticket_prices": ticket_prices(text, most("ticket_prices")),
            "summary": present(
                F.array_join(nearby_phrases(text, string_array(dims.SUMMARY_LABELS), 180, most("summary")), " ")
            ),
        },
    )


def _texts(kind: str, item, label: Column) -> Column:
    return F.transform(kind, lambda x, i: item(kind, i, x, label))


def collect_facts(facts: DataFrame, owner: list[str], order: str) -> DataFrame:
    """Long form (owner, kind, value, label, first): first sighting of every distinct fact.

    One explode over all kinds, then a grouped min that combines map-side, so an owner with very
    many pages never becomes one array in one task.
    """
    def item(kind: str, pos: Column, value: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), value.alias("value"), label.alias("label"))

    no_label = F.lit(None).cast("string")
    arrays = [F.transform("ticket_links", lambda x, i: item("ticket_links", i, x["url"], x["label"]))]
    for kind in ("event_dates", "venues", "ticket_rules", "ticket_prices"):
        arrays.append(_texts(kind, item, no_label))
    rows = facts.select(*owner, F.col(order).alias("page_ord"), F.inline(F.concat(*arrays)))
    return (
        rows.groupBy(*owner, "kind", "value")
        .agg(F.min(F.struct("page_ord", "pos", "label")).alias("first"))
        .select(*owner, "kind", "value", "first.label", F.struct("first.page_ord", "first.pos").alias("first"))
    )


def first_sort_date(dates: Column, as_of: Column) -> Column:
    """First date phrase entry that holds a usable date."""
    found = F.transform(dates, lambda d: first_date(d, no_year(), as_of))
    return iso_date(F.try_element_at(F.array_compact(found), F.lit(1)))
