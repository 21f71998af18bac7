"""Feeds, joins, aggregations and ordering over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundtide.functions.rounds import latest_day
from roundtide.operators import feeds, rounds as rops
from roundtide.operators.extraction import first_sort_date
from roundtide.plans import sqltext as q
from roundtide.plans.registry import query
from roundtide.sources.exports import vevents

BASE = q.with_(q.WATCHES, q.EVENTS, q.ROUNDS, q.LINKS, q.SOURCES)
SHOWN = f"shown AS (SELECT * FROM rounds WHERE NOT {q.noisy('url')})"
SHOWN_LINKS = f"shown_links AS (SELECT *, {q.platform('url')} AS platform, {q.link_confidence('url', 'label')} AS confidence FROM event_links WHERE {q.actionable('url', 'label')})"
SUMMARY = f"""summary AS (SELECT event_id, count(*) AS n_rounds, max(confidence) AS best,
    arg_min(status, (-({q.LATEST_DAY}), platform, name, round_key)) AS lead_status,
    array_to_string(list_sort(list_distinct(list(platform)))[1:3], ', ') AS platforms FROM shown GROUP BY 1),
  srcs AS (SELECT watch_id, count(*) FILTER (WHERE NOT private_note) AS n_public, count(*) FILTER (WHERE private_note) AS n_private
    FROM watch_sources WHERE NOT muted GROUP BY 1),
  nlinks AS (SELECT event_id, count(*) AS n_links FROM shown_links GROUP BY 1)"""
REASONS = """array_to_string([x FOR x IN [
   CASE WHEN contains(lower(concat_ws(' ', title, coalesce(summary, ''), array_to_string(event_dates, ' '), array_to_string(venues, ' '))), lower(keyword)) THEN 'keyword match: ' || keyword ELSE 'tracked keyword: ' || keyword END,
   'date clue: ' || event_dates[1], 'venue clue: ' || venues[1],
   CASE WHEN n_public > 0 THEN 'manual public source: ' || n_public END, CASE WHEN n_private > 0 THEN 'private source note: ' || n_private END,
   CASE WHEN platforms <> '' THEN 'ticket platforms: ' || platforms END, CASE WHEN best > 0 THEN 'source confidence: ' || best END,
   'ticket status: ' || lead_status] IF x IS NOT NULL], '|')"""
VENUE_LABEL = "CASE WHEN len(venues) > 0 THEN array_to_string(venues[1:3], '; ') WHEN regexp_matches(title, '(?i)\\bTOUR\\b|ツアー') THEN 'Multiple cities' ELSE '—' END"
FEED = f"{BASE}, {SHOWN}, {SHOWN_LINKS}, {SUMMARY}, heads AS (SELECT e.*, w.keyword, w.kind AS watch_kind, w.muted FROM events_t e JOIN watches w USING (watch_id))"
TS = "strftime(updated_at, '%Y-%m-%d %H:%M:%S')"


@query(
    "event_feed",
    FEED
    + f""" SELECT h.event_id, h.watch_id, keyword, watch_kind, title, official_url, {TS} AS updated_at, {VENUE_LABEL} AS venue_label,
      coalesce(n_rounds, 0) AS n_rounds, coalesce(n_links, 0) AS n_links, {REASONS} AS match_reasons
      FROM (SELECT * FROM heads WHERE NOT muted ORDER BY updated_at DESC, event_id LIMIT 50) h
      LEFT JOIN summary s ON s.event_id = h.event_id LEFT JOIN srcs c ON c.watch_id = h.watch_id LEFT JOIN nlinks n ON n.event_id = h.event_id""",
)
def _(s):
    w = feeds.visible_watches(s.watches)
    feed = feeds.event_feed(s.events, w, s.rounds, s.event_links, s.watch_sources, 50)
    return feed.select(
        "event_id", "watch_id", "keyword", "watch_kind", "title", "official_url", "updated_at", "venue_label",
        "n_rounds", "n_links", "match_reasons",
    )


@query(
    "event_feed_rounds",
    FEED
    + f""" SELECT event_id, round_key, position, platform, name, status, {q.STATUS_LABEL} AS status_label FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY -({q.LATEST_DAY}), platform, name, round_key) AS position FROM shown)
      WHERE event_id IN (SELECT event_id FROM heads WHERE NOT muted ORDER BY updated_at DESC, event_id LIMIT 50)""",
)
def _(s):
    head = feeds.event_headers(s.events, feeds.visible_watches(s.watches), 50)
    rows = feeds.feed_rounds(feeds.of_headers(s.rounds, head))
    return rows.select("event_id", "round_key", "position", "platform", "name", "status", "status_label")


@query(
    "event_feed_links",
    FEED
    + """ SELECT event_id, url, label, confidence, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, label, url) AS position FROM shown_links
      WHERE event_id IN (SELECT event_id FROM heads WHERE NOT muted ORDER BY updated_at DESC, event_id LIMIT 50)""",
)
def _(s):
    from roundtide.operators.state import shape_links

    head = feeds.event_headers(s.events, feeds.visible_watches(s.watches), 50)
    rows = feeds.feed_links(shape_links(feeds.of_headers(s.event_links, head)))
    return rows.select("event_id", "url", "label", "confidence", "position")


@query(
    "match_reasons",
    FEED
    + f""" SELECT h.event_id, {REASONS} AS match_reasons FROM heads h
      LEFT JOIN summary s ON s.event_id = h.event_id LEFT JOIN srcs c ON c.watch_id = h.watch_id""",
)
def _(s):
    head = feeds.event_headers(s.events, s.watches, None)
    return feeds.with_reasons(head, s.rounds, s.watch_sources.where(~F.col("muted"))).select("event_id", "match_reasons")


@query(
    "event_detail",
    FEED
    + f""" SELECT h.event_id, h.watch_id, keyword, title, {VENUE_LABEL} AS venue_label, coalesce(n_rounds, 0) AS n_rounds, coalesce(n_links, 0) AS n_links
      FROM heads h LEFT JOIN summary s ON s.event_id = h.event_id LEFT JOIN nlinks n ON n.event_id = h.event_id WHERE h.event_id = 42""",
)
def _(s):
    one = feeds.event_detail(42, s.events, s.watches, s.rounds, s.event_links, s.watch_sources)
    return one.select("event_id", "watch_id", "keyword", "title", "venue_label", "n_rounds", "n_links")


UPCOMING = f"""top AS (SELECT r.event_id, title AS event_title, watch_id, keyword, platform, name AS round_name, status, {q.STATUS_LABEL} AS status_label,
      CAST({q.RELEVANT} AS VARCHAR) AS relevant_date, r.url, round_key
      FROM shown r JOIN heads h ON h.event_id = r.event_id WHERE NOT muted AND watch_kind = 'event' AND status NOT IN ('closed', 'unknown')
      ORDER BY {q.STATUS_RANK}, coalesce({q.RELEVANT}, DATE '9999-12-31'), title, r.event_id, round_key LIMIT 50)"""


@query(
    "upcoming",
    FEED
    + f""", {UPCOMING} SELECT t.*, reasons AS match_reasons FROM top t JOIN (SELECT h.event_id, {REASONS} AS reasons FROM heads h
      LEFT JOIN summary s ON s.event_id = h.event_id LEFT JOIN srcs c ON c.watch_id = h.watch_id) m USING (event_id)""",
)
def _(s):
    w = feeds.visible_watches(s.watches)
    top = feeds.upcoming(s.events, w, s.rounds, 50)
    full = feeds.upcoming_with_reasons(top, s.events, w, s.rounds, s.watch_sources, 50)
    return full.drop("watch_kind")


@query(
    "upcoming_user",
    FEED
    + f""", {q.USERS} SELECT r.event_id, round_key, status FROM shown r JOIN heads h ON h.event_id = r.event_id
      WHERE NOT muted AND watch_kind = 'event' AND status NOT IN ('closed', 'unknown') AND watch_id IN (SELECT watch_id FROM user_watches WHERE user_id = 7)
      ORDER BY {q.STATUS_RANK}, coalesce({q.RELEVANT}, DATE '9999-12-31'), title, r.event_id, round_key LIMIT 50""",
)
def _(s):
    w = feeds.visible_watches(s.watches, s.user_watches, 7)
    return feeds.upcoming(s.events, w, s.rounds, 50).select("event_id", "round_key", "status")


@query(
    "user_scope",
    f"{q.with_(q.WATCHES, q.USERS)} SELECT user_id, count(*) AS n_watches, count(*) FILTER (WHERE kind = 'event') AS n_event FROM user_watches JOIN watches USING (watch_id) WHERE NOT muted GROUP BY 1",
)
def _(s):
    rows = s.user_watches.join(feeds.visible_watches(s.watches), "watch_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_watches"), F.count_if(F.col("kind") == "event").alias("n_event"))


@query("active_watches", q.with_(q.WATCHES) + "SELECT watch_id, keyword, kind, tags FROM watches WHERE NOT muted")
def _(s):
    return feeds.visible_watches(s.watches).select("watch_id", "keyword", "kind", "tags").orderBy("watch_id")


@query(
    "watch_lists",
    q.with_(q.WATCHES) + "SELECT CASE WHEN muted THEN 'muted' WHEN kind = 'artist' THEN 'active_artists' ELSE 'active_events' END AS list, watch_id, keyword FROM watches",
)
def _(s):
    return feeds.watch_lists(s.watches)


@query(
    "visible_sources",
    q.with_(q.WATCHES, q.SOURCES) + "SELECT s.source_id, s.watch_id, s.url, s.label, s.platform, s.confidence, s.private_note FROM watch_sources s JOIN watches w USING (watch_id) WHERE NOT s.muted AND NOT w.muted",
)
def _(s):
    return feeds.visible_sources(s.watch_sources, s.watches).select("source_id", "watch_id", "url", "label", "platform", "confidence", "private_note")


@query(
    "user_sources",
    q.with_(q.WATCHES, q.SOURCES, q.USERS) + "SELECT source_id, watch_id, url, muted FROM watch_sources WHERE watch_id IN (SELECT watch_id FROM user_watches WHERE user_id = 7)",
)
def _(s):
    mine = feeds.visible_sources(s.watch_sources, s.watches, include_muted=True, user_watches=s.user_watches, user_id=7)
    return mine.select("source_id", "watch_id", "url", "muted")


@query(
    "watch_source_list",
    q.with_(q.WATCHES, q.SOURCES) + "SELECT source_id, url, label FROM watch_sources WHERE watch_id = 12",
)
def _(s):
    return feeds.visible_sources(s.watch_sources, s.watches, watch_id=12, include_muted=True).select("source_id", "url", "label")


@query("label_sources", q.with_(q.SOURCES) + "SELECT source_id, label, platform, confidence FROM watch_sources")
def _(s):
    return s.watch_sources.select("source_id", "label", "platform", "confidence")


@query(
    "round_order",
    q.with_(q.ROUNDS) + f"SELECT event_id, round_key, row_number() OVER (PARTITION BY event_id ORDER BY -({q.LATEST_DAY}), platform, name, round_key) AS position FROM rounds",
)
def _(s):
    return rops.order_rounds(s.rounds, ["event_id"]).select("event_id", "round_key", "position")


DUPES = """dupes AS (SELECT event_id, line, 1 AS ord, platform, url, name, application_start_at, application_end_at, results_date, general_sale_date FROM rounds
  UNION ALL SELECT event_id, line, 0, platform, url, upper(name) || '  ', application_start_at, application_end_at, results_date, general_sale_date FROM rounds WHERE (event_id + line) % 3 = 0)"""


@query(
    "round_dedupe",
    q.with_(q.ROUNDS, DUPES)
    + f"""SELECT event_id, line, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY event_id, platform, url, lower({q.clean('name')}), application_start_at, application_end_at, results_date, general_sale_date
      ORDER BY ord) AS rn FROM dupes) WHERE rn = 1""",
)
def _(s):
    base = s.rounds.withColumn("ord", F.lit(1))
    copies = s.rounds.where((F.col("event_id") + F.col("line")) % 3 == 0).withColumns(
        {"ord": F.lit(0), "name": F.concat(F.upper("name"), F.lit("  "))}
    )
    got = rops.dedupe_rounds(base.unionByName(copies), ["event_id"], ["ord"])
    return got.select("event_id", "line", "ord", "name")


@query(
    "event_status",
    BASE
    + f""", {SHOWN_LINKS} SELECT e.event_id, CASE WHEN r.is_open THEN 'lottery_open' WHEN r.is_open IS NOT NULL THEN 'lottery_found' WHEN l.event_id IS NOT NULL THEN 'ticket_links_found'
      WHEN NOT starts_with(official_url, 'keyword:') THEN 'official_found' ELSE 'watching' END AS status
      FROM events_t e LEFT JOIN (SELECT event_id, bool_or(status IN ('open', 'closing_soon')) AS is_open FROM rounds GROUP BY 1) r USING (event_id)
      LEFT JOIN (SELECT DISTINCT event_id FROM shown_links) l USING (event_id)""",
)
def _(s):
    from roundtide.operators.state import event_status

    return event_status(s.events, s.rounds, s.event_links)


CAL = f"""cal AS (SELECT event_id, line, platform, name, status, application_start_at, application_end_at, results_date, payment_end_at, general_sale_date, url, title, idx
   FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY -({q.LATEST_DAY}), platform, name, round_key) - 1 AS idx FROM shown) JOIN (SELECT event_id, title FROM heads WHERE NOT muted AND watch_kind = 'event') USING (event_id)),
 entries AS (
   SELECT event_id, substr(sha256(event_id || '|' || idx || '|application|' || platform || '|' || name || '|' || application_start_at), 1, 24) AS uid, 'Lottery application: ' || title || ' - ' || name AS summary,
     strftime(application_start_at, '%Y%m%d') AS dtstart, strftime(coalesce(application_end_at, application_start_at) + 1, '%Y%m%d') AS dtend, platform, status, url FROM cal WHERE application_start_at IS NOT NULL
   UNION ALL SELECT event_id, substr(sha256(event_id || '|' || idx || '|' || f || '|' || platform || '|' || name || '|' || strftime(d, '%Y%m%d')), 1, 24), p || ': ' || title || ' - ' || name, strftime(d, '%Y%m%d'), strftime(d + 1, '%Y%m%d'), platform, status, url
   FROM (SELECT *, 'results_date' AS f, 'Lottery results' AS p, results_date AS d FROM cal UNION ALL SELECT *, 'payment_end_at', 'Payment due', payment_end_at FROM cal
         UNION ALL SELECT *, 'general_sale_date', 'General sale', general_sale_date FROM cal) WHERE d IS NOT NULL)"""


@query("calendar_entries", f"{FEED}, {CAL} SELECT event_id, uid, summary, dtstart, dtend, 'Platform: ' || platform || chr(10) || 'Status: ' || status AS description, url FROM entries")
def _(s):
    return feeds.calendar_entries(s.events, feeds.visible_watches(s.watches), s.rounds)


@query(
    "calendar_vevents",
    f"""{FEED}, {CAL} SELECT concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || uid || '@roundtide.local', 'DTSTAMP:20260802T000000Z', 'SUMMARY:' || replace(replace(summary, ';', '\\;'), ',', '\\,'),
      'DTSTART;VALUE=DATE:' || dtstart, 'DTEND;VALUE=DATE:' || dtend, 'DESCRIPTION:Platform: ' || platform || '\\nStatus: ' || status, 'URL:' || url, 'END:VEVENT') AS vevent FROM entries""",
)
def _(s):
    entries = feeds.calendar_entries(s.events, feeds.visible_watches(s.watches), s.rounds)
    return entries.select(vevents(F.to_timestamp(F.lit("2026-08-02 00:00:00"))).alias("vevent"))


HEALTH = """health AS (SELECT 'tracked_artists' AS item, count(*) AS n FROM watches WHERE NOT muted AND kind = 'artist' UNION ALL
  SELECT 'tracked_events', count(*) FROM watches WHERE NOT muted AND kind = 'event' UNION ALL SELECT 'saved_events', count(*) FROM events_t UNION ALL
  SELECT 'manual_sources', count(*) FROM watch_sources s JOIN watches w USING (watch_id) WHERE NOT s.muted AND NOT w.muted UNION ALL
  SELECT 'alerts', count(*) FROM alert_log)"""


def sql_alerts(as_of: str, relation: str = "rounds") -> str:
    """Lifecycle alerts of a rounds relation at a day."""
    arms = (
        ("lottery_opened", "lottery_start", "coalesce(application_start_at, lottery_start)", 0),
        ("lottery_closing_soon", "lottery_end", "coalesce(application_end_at, lottery_end)", 2),
        ("results_today", "results_date", "results_date", 0),
        ("payment_due_soon", "payment_deadline", "coalesce(payment_end_at, payment_deadline)", 1),
        ("general_sale_soon", "general_sale_date", "general_sale_date", 2),
    )
    return " UNION ALL ".join(
        f"SELECT event_id, round_key, name AS round, source, url, '{t}' AS type, '{f}' AS field, {d} AS date, {d} - {as_of} AS days_until,"
        f" substr(sha256('{t}|' || round_key || '|{f}|' || ({d})), 1, 24) AS alert_key FROM {relation} WHERE {d} - {as_of} BETWEEN 0 AND {n}"
        for t, f, d, n in arms
    )


ALERT_LOG = (
    "alert_log AS (SELECT event_id, alert_key, any_value(type) AS alert_type, min(created_at) AS created_at FROM ("
    + f"SELECT *, CAST({q.AS_OF} - 2 AS TIMESTAMP) AS created_at FROM ({sql_alerts('(' + q.AS_OF + ' - 2)')}) UNION ALL "
    + f"SELECT *, CAST({q.AS_OF} - 1 AS TIMESTAMP) FROM ({sql_alerts('(' + q.AS_OF + ' - 1)')})) GROUP BY 1, 2)"
)


@query("health", f"{BASE}, {ALERT_LOG}, {HEALTH} SELECT * FROM health")
def _(s):
    return feeds.health(s.watches, s.events, s.watch_sources, s.alert_log)


@query(
    "alert_feed",
    f"""{BASE}, {ALERT_LOG} SELECT event_id, alert_key, alert_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, title AS event_title, watch_id, keyword AS watch_keyword, muted AS watch_muted
      FROM alert_log LEFT JOIN events_t USING (event_id) LEFT JOIN watches USING (watch_id) ORDER BY alert_log.created_at DESC, event_id, alert_key LIMIT 50""",
)
def _(s):
    feed = feeds.alert_feed(s.alert_log, s.events, s.watches, 50)
    return feed.select("event_id", "alert_key", "alert_type", "created_at", "event_title", "watch_id", "watch_keyword", "watch_muted")


MINE = f"{q.USERS}, mine AS (SELECT watch_id FROM user_watches WHERE user_id = 7)"


@query(
    "event_feed_user",
    FEED
    + f""", {MINE} SELECT event_id, keyword, title, {TS} AS updated_at FROM heads WHERE NOT muted AND watch_id IN (SELECT watch_id FROM mine)
      ORDER BY updated_at DESC, event_id LIMIT 50""",
)
def _(s):
    w = feeds.visible_watches(s.watches, s.user_watches, 7)
    feed = feeds.event_feed(s.events, w, s.rounds, s.event_links, s.watch_sources, 50)
    return feed.select("event_id", "keyword", "title", "updated_at")


@query(
    "alert_feed_user",
    f"""{BASE}, {ALERT_LOG}, {MINE} SELECT event_id, alert_key, watch_id FROM alert_log JOIN events_t USING (event_id) WHERE watch_id IN (SELECT watch_id FROM mine)
      ORDER BY alert_log.created_at DESC, event_id, alert_key LIMIT 50""",
)
def _(s):
    return feeds.alert_feed(s.alert_log, s.events, s.watches, 50, s.user_watches, 7).select("event_id", "alert_key", "watch_id")


@query(
    "artist_events",
    q.with_(q.WATCHES, q.EVENTS)
    + """SELECT watch_id, event_id, event_dates[1] AS first_date, row_number() OVER (PARTITION BY watch_id ORDER BY coalesce(event_dates[1], '9999-12-31'), title, event_id) AS position
      FROM events_t JOIN watches USING (watch_id) WHERE kind = 'artist'""",
)
def _(s):
    got = feeds.artist_events(s.events, s.watches, first_sort_date(F.col("event_dates"), s.as_of))
    return got.select("watch_id", "event_id", "first_date", "position")


@query(
    "artist_counts",
    q.with_(q.WATCHES, q.EVENTS) + "SELECT watch_id, count(*) AS n_events FROM events_t JOIN watches USING (watch_id) WHERE kind = 'artist' AND NOT muted GROUP BY 1",
)
def _(s):
    return feeds.artist_counts(s.events, s.watches)


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY updated_at DESC, event_id) AS rn FROM events_t) WHERE rn = 1)"


@query("latest_event", f"{q.with_(q.EVENTS, LATEST)} SELECT watch_id, event_id, title, {TS} AS updated_at FROM latest")
def _(s):
    return feeds.latest_events(s.events).select("watch_id", "event_id", "title", "updated_at")


DASH = """dash AS (SELECT w.watch_id, w.keyword, l.event_id, coalesce(regexp_matches(official_url, '^https?://[^/?#]+'), false) AS has_official,
  coalesce(n_rounds, 0) AS n_rounds, coalesce(n_links, 0) AS n_links, coalesce(len(event_dates), 0) AS n_dates
  FROM watches w LEFT JOIN latest l USING (watch_id) LEFT JOIN summary s ON s.event_id = l.event_id LEFT JOIN nlinks n ON n.event_id = l.event_id WHERE w.kind = 'event' AND NOT w.muted)"""


@query("watch_dashboard", f"{FEED}, {LATEST}, {DASH} SELECT * FROM dash")
def _(s):
    got = feeds.watch_dashboard(s.watches, s.events, s.rounds, s.event_links)
    return got.select("watch_id", "keyword", "event_id", "has_official", "n_rounds", "n_links", "n_dates")


@query(
    "watch_display_order",
    f"""{FEED}, {LATEST}, {DASH} SELECT watch_id, has_official, n_rounds FROM dash ORDER BY event_id IS NULL, has_official DESC, n_rounds DESC, n_dates DESC, n_links DESC, lower(keyword), watch_id""",
)
def _(s):
    got = feeds.watch_dashboard(s.watches, s.events, s.rounds, s.event_links)
    return got.orderBy(*feeds.display_order()).select("watch_id", "has_official", "n_rounds")


@query(
    "platform_groups",
    f"""{FEED}, g AS (SELECT coalesce(r.event_id, k.event_id) AS event_id, coalesce(r.platform, k.platform) AS platform, coalesce(n_rounds, 0) AS n_rounds, coalesce(latest, 0) AS latest, coalesce(n_links, 0) AS n_links
      FROM (SELECT event_id, platform, count(*) AS n_rounds, max({q.LATEST_DAY}) AS latest FROM shown GROUP BY 1, 2) r
      FULL JOIN (SELECT event_id, platform, count(*) AS n_links FROM shown_links GROUP BY 1, 2) k ON r.event_id = k.event_id AND r.platform = k.platform)
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY latest DESC, platform) AS position FROM g""",
)
def _(s):
    from roundtide.operators.state import shape_links

    got = feeds.platform_groups(s.rounds, shape_links(s.event_links))
    return got.select("event_id", "platform", "n_rounds", "latest", "n_links", "position")


@query("export_watches", q.with_(q.WATCHES) + "SELECT watch_id, keyword, kind, tags, muted FROM watches")
def _(s):
    from roundtide.sources.exports import export_json
    from roundtide.sources.tables import scratch_dir

    out = scratch_dir(s.spark, "export_watches")
    export_json(s.watches, out)
    return s.spark.read.schema(s.watches.schema).json(out).select("watch_id", "keyword", "kind", "tags", "muted")


def _exported(s, rows, name):
    from roundtide.sources.exports import export_json
    from roundtide.sources.tables import scratch_dir

    out = scratch_dir(s.spark, name)
    export_json(rows, out)
    return s.spark.read.schema(rows.schema).json(out)


@query("export_sources", q.with_(q.SOURCES) + "SELECT source_id, watch_id, url, label, platform, confidence, private_note, muted FROM watch_sources")
def _(s):
    columns = ("source_id", "watch_id", "url", "label", "platform", "confidence", "private_note", "muted")
    return _exported(s, s.watch_sources.select(*columns), "export_sources")


@query(
    "export_subscriptions",
    f"{q.with_(q.WATCHES, q.EVENTS, q.ROUNDS)}, {q.SUBSCRIPTIONS} SELECT subscription_id, watch_id, scope, location, round_key, channels, lead_days, enabled FROM subscriptions",
)
def _(s):
    return _exported(s, s.subscriptions, "export_subscriptions")


@query(
    "curated_first",
    f"""{BASE}, heads AS (SELECT watch_id, official_url AS url FROM events_t WHERE regexp_matches(official_url, '^https?://')),
      pub AS (SELECT watch_id, url FROM watch_sources WHERE NOT private_note AND NOT muted)
      SELECT watch_id, url, true AS curated FROM pub UNION ALL SELECT watch_id, url, false FROM heads WHERE watch_id NOT IN (SELECT watch_id FROM pub)""",
)
def _(s):
    from roundtide.operators.discovery import curated_first
    from roundtide.functions.urls import is_web_url

    found = s.events.where(is_web_url(F.col("official_url"))).select("watch_id", F.col("official_url").alias("url"))
    return curated_first(s.watch_sources, found)


@query(
    "merge_links",
    f"""{BASE}, mine AS (SELECT watch_id, l.url FROM event_links l JOIN events_t e USING (event_id)),
      manual AS (SELECT watch_id, url FROM watch_sources WHERE NOT muted UNION ALL SELECT watch_id, min(url) FROM mine GROUP BY 1)
      SELECT watch_id, url, 'found' AS origin FROM (SELECT DISTINCT * FROM mine) UNION ALL
      SELECT watch_id, url, 'manual' FROM (SELECT DISTINCT * FROM manual m WHERE NOT EXISTS (SELECT 1 FROM mine x WHERE x.watch_id = m.watch_id AND x.url = m.url))""",
)
def _(s):
    from roundtide.operators.discovery import merge_links

    mine = s.event_links.join(s.events.select("event_id", "watch_id"), "event_id").select("watch_id", "url").distinct()
    manual = s.watch_sources.where(~F.col("muted")).select("watch_id", "url").unionByName(
        mine.groupBy("watch_id").agg(F.min("url").alias("url"))
    )
    return merge_links(mine, manual)


@query(
    "artist_fallback",
    q.with_(q.WATCHES, q.EVENTS)
    + """SELECT watch_id, keyword || ' ticket search' AS title, 'https://t.pia.jp/pia/search_all.do?kw=' || replace(keyword, '#', '%23') AS official_url FROM watches
      WHERE kind = 'artist' AND NOT muted AND watch_id NOT IN (SELECT watch_id FROM events_t WHERE starts_with(official_url, 'https://stage'))""",
)
def _(s):
    from roundtide.operators.discovery import artist_fallback

    artists = feeds.visible_watches(s.watches, kind="artist")
    shows = s.events.where(F.col("official_url").startswith("https://stage"))
    return artist_fallback(artists, shows).select("watch_id", "title", "official_url")


@query(
    "rounds_union",
    q.with_(q.ROUNDS)
    + """, u AS (SELECT *, 0 AS origin FROM rounds WHERE line <= 3 UNION ALL SELECT *, 1 FROM rounds WHERE line BETWEEN 2 AND 5 UNION ALL SELECT *, 2 FROM rounds WHERE line >= 4)
      SELECT event_id, line, min(origin) AS origin FROM u GROUP BY event_id, line, round_key""",
)
def _(s):
    line = F.col("line")
    rounds = s.rounds.select("event_id", "line", "platform", "source", "url", "name", *rops.DEDUPE_KEY)  # what the result and its key need
    lanes = [rounds.where(line <= 3), rounds.where(line.between(2, 5)), rounds.where(line >= 4)]
    rows = lanes[0].withColumn("origin", F.lit(0))
    for i, lane in enumerate(lanes[1:], 1):
        rows = rows.unionByName(lane.withColumn("origin", F.lit(i)))
    return rops.dedupe_rounds(rows, ["event_id"], ["origin"]).select("event_id", "line", "origin")


@query(
    "link_follow",
    f"""WITH l AS (SELECT page_id AS from_id, page_id + 1 AS to_id, page_id FROM pages UNION ALL SELECT page_id, page_id // 2, page_id FROM pages)
      SELECT DISTINCT l.from_id, p.page_id AS to_id FROM l JOIN pages p ON p.page_id = l.to_id WHERE p.page_id <> l.from_id""",
)
def _(s):
    from roundtide.operators.discovery import follow_links

    p = s.table("pages").select("page_id", "url")
    ahead = p.select((F.col("page_id") - 1).alias("from_id"), "url")
    back = p.select(F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 2 + 1)).alias("from_id"), "url")
    known = p.select(F.col("page_id").alias("from_id"))
    wanted = ahead.unionByName(back).join(known, "from_id", "left_semi")
    dead = p.select(F.col("page_id").alias("from_id"), F.concat("url", F.lit("/gone")).alias("url"))
    portal = p.select(F.col("page_id").alias("from_id"), F.lit("https://t.pia.jp/pia/search_all.do?kw=x").alias("url"))
    hits = follow_links(wanted.unionByName(dead).unionByName(portal), p)
    return hits.where(F.col("page_id") != F.col("from_id")).select("from_id", F.col("page_id").alias("to_id"))


@query(
    "schedule_pages",
    """WITH l AS (SELECT a.page_id AS from_id, k AS pos, p.page_id AS to_id, p.url AS url, CASE WHEN k % 2 = 0 THEN 'Live ' || k ELSE 'about' END AS label
        FROM pages a, (SELECT unnest(range(1, 11)) AS k) t JOIN pages p ON p.page_id = (a.page_id * 7 + k * k) % (SELECT count(*) FROM pages)),
      f AS (SELECT from_id, to_id, min(pos) AS pos FROM l WHERE from_id <> to_id AND regexp_matches(lower(label || ' ' || url), 'live|tour|schedule|concert|event|公演|ライブ|ツアー|スケジュール|コンサート') GROUP BY 1, 2)
      SELECT from_id, to_id FROM f""",
)
def _(s):
    from roundtide.operators.discovery import schedule_pages

    p = s.table("pages").select("page_id", "url")
    n = p.agg(F.count("*")).scalar()
    k = F.explode(F.sequence(F.lit(1), F.lit(10)))
    picks = p.select(F.col("page_id").alias("from_id"), F.col("url").alias("page_url"), k.alias("pos")).withColumn(
        "to_id", (F.col("from_id") * 7 + F.col("pos") * F.col("pos")) % n
    )
    label = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Live "), F.col("pos").cast("string"))).otherwise("about")
    links = picks.join(p.select(F.col("page_id").alias("to_id"), "url"), "to_id").select(
        F.col("from_id").alias("page_id"), "page_url", "pos", label.alias("label"), "url"
    )
    return schedule_pages(links, p).select(F.col("page_id").alias("from_id"), F.col("to_page_id").alias("to_id"))
