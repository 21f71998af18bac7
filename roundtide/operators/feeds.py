"""Read models: feeds, priority list, calendar, dashboards, health.

Children of events stay rows (event key + position) instead of nested arrays, so one event with
very many rounds is never gathered in one task. A ``limit`` is a feature of a feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions.rounds import (
    latest_day,
    label,
    relevant_date,
    schedule_label,
    status_label,
    status_rank,
    venue_label,
)
from roundtide.functions.text import collapse, present, stable_key
from roundtide.functions.urls import is_actionable_ticket_link, is_noisy_url, is_web_url
from roundtide.operators.rounds import numbered_within


def visible_watches(
    watches: DataFrame, user_watches: DataFrame | None = None, user_id: int | None = None,
    include_muted: bool = False, kind: str | None = None,
) -> DataFrame:
    """Watches in scope: not muted, of a kind, subscribed by a user."""
    out = watches
    if not include_muted:
        out = out.where(~F.col("muted"))
    if kind:
        out = out.where(F.col("kind") == kind)
    if user_id is not None:
        mine = user_watches.where(F.col("user_id") == user_id).select("watch_id")
        out = out.join(mine, "watch_id", "left_semi")
    return out


def visible_sources(
    sources: DataFrame, watches: DataFrame, watch_id: int | None = None, include_muted: bool = False,
    user_watches: DataFrame | None = None, user_id: int | None = None,
) -> DataFrame:
    """Curated sources in scope: of one watch, of a user's watches, with or without the muted ones.

    A source is muted by itself or through its watch.
    """
    scoped = visible_watches(watches, user_watches, user_id, include_muted)
    if watch_id is not None:
        scoped = scoped.where(F.col("watch_id") == watch_id)
    live = sources if include_muted else sources.where(~F.col("muted"))
    return live.join(scoped.select("watch_id"), "watch_id", "left_semi")


def shown_rounds(rounds: DataFrame) -> DataFrame:
    return rounds.where(~is_noisy_url(F.col("url")))


def shown_links(links: DataFrame) -> DataFrame:
    return links.where(is_actionable_ticket_link(F.col("url"), F.coalesce("label", F.lit(""))))


def event_headers(events: DataFrame, watches: DataFrame, limit: int | None = 50) -> DataFrame:
    """Events of visible watches, newest first; ``None`` keeps all."""
    joined = events.join(watches.select("watch_id", "keyword", F.col("kind").alias("watch_kind")), "watch_id")
    if limit is None:
        return joined
    return joined.orderBy(F.col("updated_at").desc(), "event_id").limit(limit)


def of_headers(child: DataFrame, headers: DataFrame, key: str = "event_id") -> DataFrame:
    """Child rows of the given headers; the measured size of the headers decides how they join."""
    return child.join(headers.select(key), key, "left_semi")


def feed_rounds(rounds: DataFrame) -> DataFrame:
    """Visible rounds with labels and their position in the event."""
    labelled = shown_rounds(rounds).withColumns(
        {
            "status_label": status_label(F.col("status")),
            "round_type_label": label(dims.ROUND_TYPE_LABELS, F.col("round_type")),
            "membership_label": label(dims.MEMBERSHIP_LABELS, F.col("membership_required")),
            "schedule_label": schedule_label(),
        }
    )
    fine = [F.coalesce("platform", F.lit("")), F.coalesce("name", F.lit("")), F.col("round_key")]
    return numbered_within(labelled, ["event_id"], -latest_day(), fine, "position")


def feed_links(links: DataFrame) -> DataFrame:
    """Visible links by confidence, then label."""
    # confidence has three values only: the label's first characters split the links of a large event further
    rank = F.struct((-F.col("confidence")).alias("confidence"), F.substring("label", 1, 10).alias("lead"))
    return numbered_within(shown_links(links), ["event_id"], rank, [F.col("label"), F.col("url")], "position")


def round_summary(rounds: DataFrame) -> DataFrame:
    """Per event: count, best confidence, status of the leading round, first three platforms."""
    shown = shown_rounds(rounds)
    lead = F.struct((-latest_day()).alias("d"), F.coalesce("platform", F.lit("")).alias("p"), "name", "round_key", "status")
    facts = shown.groupBy("event_id").agg(
        F.count("*").alias("n_rounds"), F.max("confidence").alias("best_confidence"), F.min(lead)["status"].alias("lead_status")
    )
    names = shown.where(F.col("platform") != "").groupBy("event_id", "platform").agg(F.lit(1).alias("one"))
    w = Window.partitionBy("event_id").orderBy("platform")
    top = (
        names.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= 3)
        .groupBy("event_id")
        .agg(F.array_sort(F.collect_list("platform")).alias("platforms"))
    )
    return facts.join(top, "event_id", "left")


def source_summary(sources: DataFrame) -> DataFrame:
    return sources.groupBy("watch_id").agg(
        F.count_if(~F.col("private_note")).alias("n_public"), F.count_if("private_note").alias("n_private")
    )


def _reasons() -> Column:
    clean = lambda c: collapse(F.coalesce(F.col(c), F.lit("")))
    dates = F.filter(F.transform("event_dates", collapse), lambda x: x != "")
    venues = F.filter(F.transform("venues", collapse), lambda x: x != "")
    keyword = clean("keyword")
    haystack = F.lower(
        F.concat_ws(" ", clean("title"), clean("summary"), F.array_join(dates, " "), F.array_join(venues, " "))
    )
    said = lambda text, value: F.concat(F.lit(text), value.cast("string"))
    public, private = F.coalesce("n_public", F.lit(0)), F.coalesce("n_private", F.lit(0))
    found = F.array_compact(
        F.array(
            F.when(keyword == "", None)
            .when(F.contains(haystack, F.lower(keyword)), said("keyword match: ", keyword))
            .otherwise(said("tracked keyword: ", keyword)),
            said("date clue: ", F.try_element_at(dates, F.lit(1))),
            said("venue clue: ", F.try_element_at(venues, F.lit(1))),
            F.when(public > 0, said("manual public source: ", public)),
            F.when(private > 0, said("private source note: ", private)),
            F.when(F.size("platforms") > 0, said("ticket platforms: ", F.array_join("platforms", ", "))),
            F.when(F.col("best_confidence") > 0, said("source confidence: ", F.col("best_confidence"))),
            said("ticket status: ", F.col("lead_status")),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("saved local event"))).otherwise(found)


def with_reasons(headers: DataFrame, rounds: DataFrame, sources: DataFrame) -> DataFrame:
    """Headers plus round counts, venue label and match reasons."""
    return (
        headers.join(round_summary(rounds), "event_id", "left")
        .join(source_summary(sources), "watch_id", "left")
        .withColumns({"match_reasons": _reasons(), "venue_label": venue_label(F.col("venues"), F.col("title"))})
        .withColumn("n_rounds", F.coalesce("n_rounds", F.lit(0)))
    )


def event_feed(
    events: DataFrame, watches: DataFrame, rounds: DataFrame, links: DataFrame, sources: DataFrame, limit: int | None = 50
) -> DataFrame:
    """Newest events of the given (already scoped) watches with counts, labels and reasons."""
    head = event_headers(events, watches, limit)
    n_links = shown_links(of_headers(links, head)).groupBy("event_id").agg(F.count("*").alias("n_links"))
    live = sources.where(~F.col("muted"))
    return (
        with_reasons(head, of_headers(rounds, head), of_headers(live, head, "watch_id"))
        .join(n_links, "event_id", "left")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    )


def event_detail(
    event_id: int, events: DataFrame, watches: DataFrame, rounds: DataFrame, links: DataFrame, sources: DataFrame
) -> DataFrame:
    """One event with the feed columns, muted or not; the id filter reaches every scan."""
    one = lambda df: df.where(F.col("event_id") == event_id)
    head = event_headers(one(events), watches, None)
    n_links = shown_links(one(links)).groupBy("event_id").agg(F.count("*").alias("n_links"))
    mine = sources.join(head.select("watch_id"), "watch_id", "left_semi")
    return with_reasons(head, one(rounds), mine).join(n_links, "event_id", "left").withColumn(
        "n_links", F.coalesce("n_links", F.lit(0))
    )


def upcoming(
    events: DataFrame, watches: DataFrame, rounds: DataFrame, limit: int = 50, pre_limit: int | None = None
) -> DataFrame:
    """Actionable rounds of event watches by urgency, date, title.

    Status filters the rounds before any join. ``pre_limit`` restricts to the newest events first
    (exact parity with a capped feed); by default all events take part.
    """
    live = shown_rounds(rounds).where(~F.col("status").isin("closed", "unknown"))
    head = event_headers(events, watches, pre_limit).where(F.col("watch_kind") == "event")
    rows = live.join(head.select("event_id", "watch_id", "keyword", "watch_kind", F.col("title").alias("event_title")), "event_id")
    return (
        rows.select(
            "event_id", "event_title", "watch_id", "watch_kind", "keyword", "platform",
            F.col("name").alias("round_name"), "status", status_label(F.col("status")).alias("status_label"),
            relevant_date().alias("relevant_date"), "url", "round_key",
        )
        .orderBy(
            status_rank(F.col("status")),
            F.coalesce("relevant_date", F.lit("9999-12-31").cast("date")),
            "event_title",
            "event_id",
            "round_key",
        )
        .limit(limit)
    )


def upcoming_with_reasons(
    top: DataFrame, events: DataFrame, watches: DataFrame, rounds: DataFrame, sources: DataFrame, limit: int = 50
) -> DataFrame:
    """Attach match reasons to a limited priority list (its events are at most ``limit``)."""
    ids = top.select("event_id").distinct()
    head = event_headers(of_headers(events, ids), watches, None)
    live = of_headers(sources.where(~F.col("muted")), head, "watch_id")
    reasons = with_reasons(head, of_headers(rounds, ids), live).select("event_id", "match_reasons")
    return top.join(reasons, "event_id")


def alert_feed(
    alert_log: DataFrame, events: DataFrame, watches: DataFrame, limit: int = 50,
    user_watches: DataFrame | None = None, user_id: int | None = None,
) -> DataFrame:
    """Newest logged alerts with event and watch context (context columns win over payload)."""
    ctx = alert_log.join(events.select("event_id", "watch_id", F.col("title").alias("event_title")), "event_id", "left").join(
        watches.select("watch_id", F.col("keyword").alias("watch_keyword"), F.col("kind").alias("watch_kind"), F.col("muted").alias("watch_muted")),
        "watch_id",
        "left",
    )
    if user_id is not None:
        ctx = ctx.join(user_watches.where(F.col("user_id") == user_id).select("watch_id"), "watch_id", "left_semi")
    return ctx.orderBy(F.col("created_at").desc(), "event_id", "alert_key").limit(limit)


def calendar_entries(events: DataFrame, watches: DataFrame, rounds: DataFrame, pre_limit: int | None = None) -> DataFrame:
    """Dated facts of event watches: the application window (exclusive end) and three single days."""
    head = event_headers(events, watches, pre_limit).where(F.col("watch_kind") == "event")
    rows = feed_rounds(rounds).join(
        head.select("event_id", "keyword", F.col("title").alias("event_title"), "official_url"), "event_id"
    )
    title = F.coalesce(present(F.col("event_title")), present(F.col("keyword")), F.lit("Tracked event"))
    name = F.coalesce(present(F.col("name")), F.lit("Ticket round"))
    platform = F.coalesce(present(F.col("platform")), F.lit("ticket"))
    caption = F.concat(title, F.lit(" - "), name)
    index = (F.col("position") - 1).cast("string")
    compact = lambda d: F.date_format(d, "yyyyMMdd")
    start, end = F.col("application_start_at"), F.col("application_end_at")

    def entry(kind: str, prefix: str, first: Column, last: Column, stamp: Column) -> Column:
        uid = stable_key(
            F.concat_ws("|", F.col("event_id").cast("string"), index, F.lit(kind), platform, name, stamp)
        )
        return F.struct(
            uid.alias("uid"),
            F.concat(F.lit(prefix + ": "), caption).alias("summary"),
            compact(first).alias("dtstart"),
            compact(F.date_add(last, 1)).alias("dtend"),
        )

    results, pay, sale = F.col("results_date"), F.col("payment_end_at"), F.col("general_sale_date")
    entries = F.array(
        entry("application", "Lottery application", start, F.coalesce(end, start), start.cast("string")),
        entry("results_date", "Lottery results", results, results, compact(results)),
        entry("payment_end_at", "Payment due", pay, pay, compact(pay)),
        entry("general_sale_date", "General sale", sale, sale, compact(sale)),
    )
    return rows.select(
        "event_id",
        F.concat(F.lit("Platform: "), platform, F.lit("\nStatus: "), F.col("status")).alias("description"),
        F.coalesce(present(F.col("url")), F.col("official_url"), F.lit("")).alias("url"),
        F.inline(F.filter(entries, lambda e: e["dtstart"].isNotNull())),
    )


def health(watches: DataFrame, events: DataFrame, sources: DataFrame, alert_log: DataFrame) -> DataFrame:
    """Workspace counts as (item, n) rows."""
    live = watches.where(~F.col("muted"))

    def n(item: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n")

    return (
        n("tracked_artists", live.where(F.col("kind") == "artist"))
        .unionByName(n("tracked_events", live.where(F.col("kind") == "event")))
        .unionByName(n("saved_events", events))
        .unionByName(n("manual_sources", visible_sources(sources, watches)))
        .unionByName(n("alerts", alert_log))
    )


def artist_events(events: DataFrame, watches: DataFrame, sort_date: Column) -> DataFrame:
    """Events of every artist: dated first, by date, then title, with their position."""
    artists = watches.where(F.col("kind") == "artist").select("watch_id", "keyword")
    rows = events.join(artists, "watch_id").withColumn("first_date", sort_date)
    last = F.lit("9999-12-31").cast("date")
    # all undated events share the last date: the title's start splits them further
    rank = F.struct(F.coalesce("first_date", last).alias("date"), F.substring("title", 1, 10).alias("lead"))
    return numbered_within(rows, ["watch_id"], rank, [F.col("title"), F.col("event_id")], "position")


def latest_events(events: DataFrame) -> DataFrame:
    """Newest event per watch; a grouped max, safe for watches with very many events."""
    best = F.max(F.struct("updated_at", (-F.col("event_id")).alias("neg"), "event_id", "title", "official_url", F.size("event_dates").alias("n_dates")))
    return events.groupBy("watch_id").agg(best.alias("b")).select("watch_id", "b.event_id", "b.title", "b.official_url", "b.updated_at", "b.n_dates")


def artist_counts(events: DataFrame, watches: DataFrame) -> DataFrame:
    artists = watches.where((F.col("kind") == "artist") & ~F.col("muted")).select("watch_id")
    return events.join(artists, "watch_id").groupBy("watch_id").agg(F.count("*").alias("n_events"))


def watch_dashboard(watches: DataFrame, events: DataFrame, rounds: DataFrame, links: DataFrame) -> DataFrame:
    """Active event watches with their newest event and its counts."""
    live = watches.where((F.col("kind") == "event") & ~F.col("muted")).select("watch_id", "keyword")
    newest = latest_events(events).join(live.select("watch_id"), "watch_id", "left_semi")
    n_rounds = shown_rounds(rounds).groupBy("event_id").agg(F.count("*").alias("n_rounds"))
    n_links = shown_links(links).groupBy("event_id").agg(F.count("*").alias("n_links"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        live.join(newest.join(n_rounds, "event_id", "left").join(n_links, "event_id", "left"), "watch_id", "left")
        .withColumns(
            {
                "has_official": F.coalesce(is_web_url(F.col("official_url")), F.lit(False)),
                "n_rounds": zero("n_rounds"), "n_links": zero("n_links"), "n_dates": zero("n_dates"),
            }
        )
    )


def display_order() -> list[Column]:
    """Watches with an event first: official page, rounds, dates, links, then keyword."""
    return [
        F.col("event_id").isNull().cast("int"), -F.col("has_official").cast("int"), -F.col("n_rounds"),
        -F.col("n_dates"), -F.col("n_links"), F.lower("keyword"), F.col("watch_id"),
    ]


def platform_groups(rounds: DataFrame, links: DataFrame) -> DataFrame:
    """Per event and platform: round count, latest day, link count; link-only platforms stay."""
    name = lambda c: F.coalesce(present(collapse(F.coalesce(c, F.lit("")))), F.lit("unknown"))
    r = shown_rounds(rounds).groupBy("event_id", name(F.coalesce(present(F.col("platform")), F.col("source"))).alias("platform")).agg(
        F.count("*").alias("n_rounds"), F.max(latest_day()).alias("latest")
    )
    k = shown_links(links).groupBy("event_id", name(F.col("platform")).alias("platform")).agg(F.count("*").alias("n_links"))
    both = r.join(k, ["event_id", "platform"], "full_outer").select(
        "event_id", "platform", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rounds", "latest", "n_links")]
    )
    return numbered_within(both, ["event_id"], -F.col("latest"), [F.col("platform")], "position")


def watch_lists(watches: DataFrame) -> DataFrame:
    """Client lists: active artists, active events, muted."""
    which = F.when(F.col("muted"), "muted").when(F.col("kind") == "artist", "active_artists").otherwise("active_events")
    return watches.select(which.alias("list"), "watch_id", "keyword")
