"""State maintenance, alerts and reminders over yesterday's tables and today's batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundtide import dims
from roundtide.operators import alerts as al
from roundtide.operators import reminders as rm
from roundtide.operators import state as st
from roundtide.plans import sqltext as q
from roundtide.plans.reads import ALERT_LOG, BASE, SHOWN, SHOWN_LINKS, sql_alerts
from roundtide.plans.registry import query
from roundtide.plans.scalar import sql_commas
from roundtide.sources.tables import written

NOW = "2026-08-02 09:00:00"
H = "(event_id + line)"
PREV = f"""prev_rounds AS (SELECT * REPLACE (CASE WHEN {H} % 7 = 0 THEN lottery_end + 2 ELSE lottery_end END AS lottery_end,
    CASE WHEN {H} % 7 = 0 THEN application_end_at + 2 ELSE application_end_at END AS application_end_at,
    CASE WHEN {H} % 13 <> 0 THEN results_date END AS results_date) FROM rounds WHERE {H} % 11 <> 0),
  batch_rounds AS (SELECT * FROM rounds WHERE {H} % 17 <> 0 AND NOT (event_id % 10 = 3 AND platform = 'pia')),
  prev_events AS (SELECT * REPLACE (CASE WHEN event_id % 6 = 0 THEN 'Old ' || title ELSE title END AS title) FROM events_t WHERE event_id % 11 <> 0),
  batch_events AS (SELECT * FROM events_t WHERE event_id % 17 <> 0),
  prev_links AS (SELECT * FROM shown_links WHERE event_id % 9 <> 0),
  batch_links AS (SELECT * FROM shown_links WHERE event_id % 17 <> 0)"""
STATE = f"{BASE}, {SHOWN_LINKS}, {PREV}"


def now():
    return F.to_timestamp(F.lit(NOW))


def sql_changes(old: str = "prev_rounds", new: str = "batch_rounds") -> str:
    fields = (
        ("lottery_start", "coalesce({x}.application_start_at, {x}.lottery_start)"),
        ("lottery_end", "coalesce({x}.application_end_at, {x}.lottery_end)"),
        ("results_date", "{x}.results_date"),
        ("general_sale_date", "{x}.general_sale_date"),
        ("payment_deadline", "coalesce({x}.payment_end_at, {x}.payment_deadline)"),
    )
    arms = [
        f"SELECT n.event_id, n.round_key, 'new_lottery_round' AS type, n.name AS round, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS old, CAST(NULL AS VARCHAR) AS new, n.url FROM {new} n"
        f" WHERE NOT EXISTS (SELECT 1 FROM {old} o WHERE o.event_id = n.event_id AND o.round_key = n.round_key)"
    ]
    for name, expr in fields:
        a, b = expr.format(x="o"), expr.format(x="n")
        arms.append(
            f"SELECT n.event_id, n.round_key, 'ticket_field_changed', n.name, '{name}', coalesce(CAST({a} AS VARCHAR), ''), coalesce(CAST({b} AS VARCHAR), ''), n.url"
            f" FROM {new} n JOIN {old} o ON o.event_id = n.event_id AND o.round_key = n.round_key WHERE {a} IS DISTINCT FROM {b}"
        )
    return " UNION ALL ".join(arms)


@query("round_changes", f"{STATE} {sql_changes()}")
def _(s):
    return st.round_changes(s.prev_rounds, s.batch_rounds)


PRUNED = """pruned AS (SELECT p.event_id, p.round_key FROM prev_rounds p
  WHERE EXISTS (SELECT 1 FROM batch_rounds b WHERE b.event_id = p.event_id AND b.platform = p.platform)
    AND NOT EXISTS (SELECT 1 FROM batch_rounds b WHERE b.event_id = p.event_id AND b.round_key = p.round_key))"""


@query("prune_rounds", f"{STATE}, {PRUNED} SELECT * FROM pruned")
def _(s):
    return st.prune_rounds(s.prev_rounds, s.batch_rounds).select("event_id", "round_key")


@query(
    "upsert_rounds",
    f"""{STATE}, {PRUNED} SELECT event_id, round_key, CAST(application_end_at AS VARCHAR) AS application_end_at, is_new FROM (
      SELECT event_id, round_key, application_end_at, round_key NOT IN (SELECT round_key FROM prev_rounds) AS is_new FROM batch_rounds UNION ALL
      SELECT p.event_id, p.round_key, p.application_end_at, false FROM prev_rounds p
      WHERE NOT EXISTS (SELECT 1 FROM batch_rounds b WHERE b.event_id = p.event_id AND b.round_key = p.round_key)
        AND NOT EXISTS (SELECT 1 FROM pruned x WHERE x.event_id = p.event_id AND x.round_key = p.round_key))""",
)
def _(s):
    return st.upsert_rounds(s.prev_rounds, s.batch_rounds).select("event_id", "round_key", "application_end_at", "is_new")


@query(
    "upsert_events",
    f"""{STATE} SELECT coalesce(n.event_id, o.event_id) AS event_id, CASE WHEN n.event_id IS NOT NULL THEN n.title ELSE o.title END AS title, o.event_id IS NULL AS is_new
      FROM prev_events o FULL JOIN batch_events n ON o.watch_id = n.watch_id AND o.official_url = n.official_url""",
)
def _(s):
    return st.upsert_events(s.prev_events, s.batch_events).select("event_id", "title", "is_new")


@query(
    "upsert_links",
    f"""{STATE} SELECT coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.url, o.url) AS url, coalesce(n.confidence, o.confidence) AS confidence, o.event_id IS NULL AS is_new
      FROM prev_links o FULL JOIN batch_links n ON o.event_id = n.event_id AND o.url = n.url""",
)
def _(s):
    return st.upsert_links(s.prev_links, s.batch_links).select("event_id", "url", "confidence", "is_new")


FALLBACK = """gone AS (SELECT e.event_id FROM prev_events e JOIN (SELECT watch_id, bool_or(NOT contains(official_url, 'search_all.do')) AS real_page FROM batch_events
    WHERE starts_with(official_url, 'https://') GROUP BY 1) p USING (watch_id)
  WHERE (starts_with(official_url, 'keyword:') OR (contains(official_url, 'search_all.do') AND real_page))
    AND NOT EXISTS (SELECT 1 FROM batch_events b WHERE b.watch_id = e.watch_id AND b.official_url = e.official_url))"""


@query("stale_fallbacks", f"{STATE}, {FALLBACK} SELECT * FROM gone")
def _(s):
    return st.stale_fallbacks(s.prev_events, s.batch_events).select("event_id")


@query(
    "orphans",
    f"""{STATE} SELECT 'rounds' AS child, count(*) AS n FROM rounds WHERE event_id NOT IN (SELECT event_id FROM prev_events)
      UNION ALL SELECT 'links', count(*) FROM event_links WHERE event_id NOT IN (SELECT event_id FROM prev_events)""",
)
def _(s):
    n = lambda name, df: st.orphans(df, s.prev_events, "event_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
    return n("rounds", s.rounds).unionByName(n("links", s.event_links))


@query(
    "snapshots_new",
    f"""{STATE}, r AS (SELECT event_id, list_sort(list(concat_ws('~', round_key, name, application_start_at, application_end_at, results_date, payment_end_at, evidence, confidence))) AS c FROM rounds GROUP BY 1),
      p AS (SELECT event_id, list_sort(list(concat_ws('~', round_key, name, application_start_at, application_end_at, coalesce(CAST(results_date AS VARCHAR), 'none'), payment_end_at, evidence, confidence))) AS c FROM prev_rounds GROUP BY 1),
      r2 AS (SELECT event_id, list_sort(list(concat_ws('~', round_key, name, application_start_at, application_end_at, coalesce(CAST(results_date AS VARCHAR), 'none'), payment_end_at, evidence, confidence))) AS c FROM rounds GROUP BY 1)
      SELECT e.event_id FROM events_t e LEFT JOIN prev_events o USING (event_id) LEFT JOIN r2 ON r2.event_id = e.event_id LEFT JOIN p ON p.event_id = e.event_id
      WHERE o.event_id IS NULL OR o.title <> e.title OR r2.c IS DISTINCT FROM p.c""",
)
def _(s):
    stored = st.snapshots(s.prev_events, s.prev_rounds)
    return st.new_snapshots(st.snapshots(s.events, s.rounds), stored).select("event_id")


# --- alerts -----------------------------------------------------------------------

TODAY = f"today AS ({sql_alerts(q.AS_OF)})"


@query("lifecycle_alerts", f"{BASE}, {TODAY} SELECT event_id, type, round, source, field, CAST(date AS VARCHAR) AS date, days_until, url, alert_key FROM today")
def _(s):
    return s.alerts_at(s.as_of).select("event_id", "type", "round", "source", "field", "date", "days_until", "url", "alert_key")


@query(
    "alerts_new",
    f"{BASE}, {TODAY}, {ALERT_LOG} SELECT event_id, alert_key, type FROM today t WHERE NOT EXISTS (SELECT 1 FROM alert_log l WHERE l.event_id = t.event_id AND l.alert_key = t.alert_key)",
)
def _(s):
    return al.new_alerts(s.alerts_at(s.as_of), s.alert_log).select("event_id", "alert_key", "type")


CHANGES = f"""changes AS (SELECT event_id, type, round, field, old, new, url FROM ({sql_changes()}) UNION ALL
  SELECT n.event_id, 'new_official_page', NULL, NULL, NULL, NULL, official_url FROM batch_events n WHERE NOT starts_with(official_url, 'keyword:')
    AND NOT EXISTS (SELECT 1 FROM prev_events o WHERE o.event_id = n.event_id) UNION ALL
  SELECT n.event_id, 'new_ticket_link', NULL, NULL, NULL, NULL, url FROM batch_links n WHERE NOT EXISTS (SELECT 1 FROM prev_links o WHERE o.event_id = n.event_id AND o.url = n.url))"""


def _changes(s):
    merged = st.upsert_events(s.prev_events, s.batch_events)
    links = st.upsert_links(s.prev_links, s.batch_links)
    titles = s.events.select("event_id", "watch_id", F.col("title").alias("event"))
    return al.change_alerts(merged, links, st.round_changes(s.prev_rounds, s.batch_rounds), titles)


@query("change_alerts", f"{STATE}, {CHANGES} SELECT c.*, watch_id, title AS event FROM changes c JOIN events_t USING (event_id)")
def _(s):
    return _changes(s)


MATCH = f"""judged AS (SELECT event_id, watch_id, keyword, {sql_commas("CASE WHEN alert_preferences = '' THEN " + q.lit(",".join(dims.ALERT_TYPES)) + " ELSE alert_preferences END")} AS allowed,
   {sql_commas('preferred_regions')} AS r, {sql_commas('preferred_venues')} AS v,
   lower(concat_ws(' ', array_to_string(event_dates, ' '), array_to_string(venues, ' '), summary)) AS hay FROM events_t JOIN watches USING (watch_id)),
 verdict AS (SELECT *, (len(list_concat(r, v)) = 0 OR len(list_filter(list_concat(r, v), lambda p: contains(hay, p))) > 0) AS match FROM judged)"""


@query(
    "alerts_filtered",
    f"""{STATE}, {CHANGES}, {MATCH} SELECT event_id, watch_id, 'watch_filtered' AS type, 'preferred region/venue did not match' AS detail FROM verdict WHERE NOT match
      UNION ALL SELECT c.event_id, watch_id, type, concat_ws('|', round, field, url) FROM changes c JOIN verdict v USING (event_id) WHERE match AND list_contains(allowed, lower(type))""",
)
def _(s):
    return al.filter_for_watches(_changes(s), s.events, s.watches)


@query("pref_match", f"{q.with_(q.WATCHES, q.EVENTS, MATCH)} SELECT event_id, match FROM verdict")
def _(s):
    rows = s.events.join(s.watches, "watch_id")
    match = al.preference_match(F.col("preferred_regions"), F.col("preferred_venues"), F.col("event_dates"), F.col("venues"), F.col("summary"))
    return rows.select("event_id", match.alias("match"))


@query(
    "run_summary",
    f"""{BASE}, {SHOWN_LINKS}, {PREV}, {TODAY}, {ALERT_LOG}, {CHANGES} SELECT type, count(*) AS n FROM (SELECT type FROM changes UNION ALL
      SELECT type FROM today t WHERE NOT EXISTS (SELECT 1 FROM alert_log l WHERE l.event_id = t.event_id AND l.alert_key = t.alert_key)) GROUP BY 1""",
)
def _(s):
    both = _changes(s).select("type").unionByName(al.new_alerts(s.alerts_at(s.as_of), s.alert_log).select("type"))
    return both.groupBy("type").agg(F.count("*").alias("n"))


@query(
    "watch_failures",
    "SELECT 'watch_failed' AS type, c_custkey AS watch_id, c_name AS keyword, 'unparsable date' AS error, count(*) AS n_errors FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 = 2 GROUP BY ALL",
)
def _(s):
    from roundtide.functions.dates import iso_date

    raw = F.when(F.col("event_id") % 4 == 2, "2026-13-45").otherwise(F.date_format("updated_at", "yyyy-MM-dd"))
    bad = s.events.withColumn("raw_date", raw).where(F.col("raw_date").isNotNull() & iso_date(F.col("raw_date")).isNull())
    return al.watch_failures(s.watches, bad.select("watch_id", F.lit("unparsable date").alias("error")))


# --- watches, sources, subscriptions ------------------------------------------------

@query(
    "upsert_watches",
    q.with_(q.WATCHES)
    + """, reqs AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'Fresh ' || s_name ELSE (SELECT min(c_name) FROM customer WHERE c_custkey = s_suppkey * 2) END AS keyword, s_suppkey % 2 = 0 AS explicit, 'tag' || s_suppkey AS tags FROM supplier)
      SELECT coalesce(r.keyword, w.keyword) AS keyword, CASE WHEN r.explicit THEN 'artist' ELSE coalesce(w.kind, 'event') END AS kind,
        CASE WHEN r.explicit THEN r.tags ELSE coalesce(w.tags, '') END AS tags, CASE WHEN r.explicit THEN false ELSE coalesce(w.muted, false) END AS muted, w.keyword IS NULL AS is_new
      FROM watches w FULL JOIN reqs r ON r.keyword = w.keyword""",
)
def _(s):
    k = F.col("s_suppkey")
    names = s.watches.select((F.col("watch_id") / 2).cast("bigint").alias("s_suppkey"), F.col("keyword").alias("known"), "watch_id").where(F.col("watch_id") % 2 == 0)
    reqs = s.table("supplier").join(names, "s_suppkey", "left").select(
        k.alias("ord"),
        F.when(k % 3 == 0, F.concat(F.lit("Fresh "), F.col("s_name"))).otherwise(F.col("known")).alias("keyword"),
        (k % 2 == 0).alias("explicit"), F.lit("artist").alias("kind"), F.concat(F.lit("tag"), k.cast("string")).alias("tags"),
        F.lit("").alias("preferred_regions"), F.lit("").alias("preferred_venues"), F.lit("").alias("alert_preferences"),
    )
    stamped = s.watches.withColumns({"created_at": now(), "updated_at": now()})
    return st.upsert_watches(stamped, reqs, now()).select("keyword", "kind", "tags", "muted", "is_new")


IDENT = "idents AS (SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey * 3 AS VARCHAR) WHEN 1 THEN 'Customer#' || lpad(CAST(s_suppkey * 5 AS VARCHAR), 9, '0') ELSE 'nobody ' || s_suppkey END AS identifier, s_suppkey % 2 = 0 AS muted FROM supplier)"


def _identifiers(s):
    k = F.col("s_suppkey")
    ident = (
        F.when(k % 3 == 0, (k * 3).cast("string"))
        .when(k % 3 == 1, F.concat(F.lit("Customer#"), F.lpad((k * 5).cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("nobody "), k.cast("string")))
    )
    return s.table("supplier").select(k.alias("ord"), ident.alias("identifier"), (k % 2 == 0).alias("muted"), F.lit(True).alias("only_if_changed"))


@query(
    "resolve_watch",
    q.with_(q.WATCHES, IDENT)
    + "SELECT ord, identifier, watch_id FROM idents JOIN watches ON CASE WHEN regexp_full_match(identifier, '[0-9]+') THEN watch_id = TRY_CAST(identifier AS BIGINT) ELSE keyword = identifier END",
)
def _(s):
    return st.resolve_watch(_identifiers(s), s.watches).select("ord", "identifier", "watch_id")


@query(
    "mute_apply",
    q.with_(q.WATCHES, IDENT)
    + """, want AS (SELECT watch_id, arg_max(i.muted, ord) AS want FROM idents i JOIN watches w ON CASE WHEN regexp_full_match(identifier, '[0-9]+') THEN watch_id = TRY_CAST(identifier AS BIGINT) ELSE keyword = identifier END GROUP BY 1)
      SELECT watch_id, coalesce(want, muted) AS muted, coalesce(want <> muted, false) AS changed FROM watches LEFT JOIN want USING (watch_id)""",
)
def _(s):
    stamped = s.watches.withColumn("updated_at", now())
    return st.apply_mutes(stamped, _identifiers(s), now()).select("watch_id", "muted", "changed")


@query(
    "mute_sources",
    q.with_(q.SOURCES)
    + """, want AS (SELECT source_id, source_id % 2 = 0 AS want FROM watch_sources WHERE source_id % 3 = 0)
      SELECT source_id, coalesce(want, muted) AS muted, coalesce(want <> muted, false) AS changed FROM watch_sources LEFT JOIN want USING (source_id)""",
)
def _(s):
    k = F.col("source_id")
    reqs = s.watch_sources.where(k % 3 == 0).select(
        F.when(k % 2 == 0, k.cast("string")).otherwise(F.col("url")).alias("identifier"), (k % 2 == 0).alias("muted")
    )
    return st.mute_sources(s.watch_sources, reqs, only_if_changed=True).select("source_id", "muted", "changed")


@query(
    "mark_checked",
    q.with_(q.WATCHES, q.EVENTS) + f"SELECT watch_id, CASE WHEN watch_id IN (SELECT watch_id FROM events_t WHERE event_id % 5 = 0) THEN '{NOW}' END AS last_checked_at FROM watches",
)
def _(s):
    w = s.watches.withColumn("last_checked_at", F.lit(None).cast("timestamp"))
    checked = s.events.where(F.col("event_id") % 5 == 0)
    return st.mark_checked(w, checked, now()).select("watch_id", "last_checked_at")


@query(
    "upsert_sources",
    q.with_(q.SOURCES)
    + f""", reqs AS (SELECT watch_id, trim(url) AS url, CASE WHEN source_id % 4 = 1 THEN '' ELSE 'New label' END AS label, source_id % 5 = 0 AS private_note FROM raw_sources WHERE source_id % 2 = 1
        UNION ALL SELECT watch_id, 'https://eplus.jp/x/' || source_id, '', false FROM raw_sources),
      shaped AS (SELECT watch_id, url, coalesce(nullif(label, ''), url) AS label, CASE WHEN private_note THEN 'manual' ELSE {q.platform('url')} END AS platform, private_note FROM reqs)
      SELECT coalesce(n.watch_id, o.watch_id) AS watch_id, coalesce(n.url, o.url) AS url, coalesce(n.label, o.label) AS label, coalesce(n.platform, o.platform) AS platform,
        CASE WHEN n.url IS NULL THEN o.confidence WHEN n.private_note THEN 40 ELSE {q.confidence('n.platform')} END AS confidence, CASE WHEN n.url IS NULL THEN o.muted ELSE false END AS muted, o.url IS NULL AS is_new
      FROM watch_sources o FULL JOIN shaped n ON n.watch_id = o.watch_id AND n.url = o.url""",
)
def _(s):
    k = F.col("source_id")
    again = s.raw_watch_sources.where(k % 2 == 1).select(
        k.alias("ord"), "watch_id", F.concat(F.lit(" "), F.col("url"), F.lit("  ")).alias("url"),
        F.when(k % 4 == 1, "").otherwise("New label").alias("label"), (k % 5 == 0).alias("private_note"),
    )
    extra = s.raw_watch_sources.select(
        k.alias("ord"), "watch_id", F.concat(F.lit("https://eplus.jp/x/"), k.cast("string")).alias("url"),
        F.lit("").alias("label"), F.lit(False).alias("private_note"),
    )
    got = st.upsert_sources(s.watch_sources, again.unionByName(extra))
    return got.select("watch_id", "url", "label", "platform", "confidence", "muted", "is_new")


SUBS = f"{q.with_(q.WATCHES, q.EVENTS, q.ROUNDS)}, {q.SUBSCRIPTIONS}"


@query(
    "upsert_subscriptions",
    f"""{SUBS}, reqs AS (SELECT watch_id, CASE WHEN watch_id % 4 = 1 THEN 'event_all' ELSE 'artist_all' END AS scope, '' AS location, '' AS round_key, '5' AS lead_days FROM watches WHERE watch_id % 2 = 1)
      SELECT coalesce(n.watch_id, o.watch_id) AS watch_id, coalesce(n.scope, o.scope) AS scope, coalesce(n.location, o.location) AS location, coalesce(n.round_key, o.round_key) AS round_key,
        coalesce(n.lead_days, o.lead_days) AS lead_days, CASE WHEN n.watch_id IS NULL THEN o.enabled ELSE true END AS enabled, o.watch_id IS NULL AS is_new
      FROM subscriptions o FULL JOIN reqs n ON n.watch_id = o.watch_id AND n.scope = o.scope AND n.location = o.location AND n.round_key = o.round_key""",
)
def _(s):
    k = F.col("watch_id")
    reqs = s.watches.where(k % 2 == 1).select(
        k.alias("ord"), k.alias("subscription_id"), "watch_id", F.when(k % 4 == 1, "event_all").otherwise("artist_all").alias("scope"),
        F.lit("").alias("location"), F.lit("").alias("round_key"), F.lit("feed").alias("channels"), F.lit("5").alias("lead_days"),
    )
    bad = reqs.withColumn("scope", F.lit("galaxy"))
    got = st.upsert_subscriptions(s.subscriptions, reqs.unionByName(bad))
    return got.select("watch_id", "scope", "location", "round_key", "lead_days", "enabled", "is_new")


@query("subscription_list", f"{SUBS} SELECT subscription_id, watch_id, scope, lead_days FROM subscriptions WHERE enabled ORDER BY subscription_id")
def _(s):
    return st.list_subscriptions(s.subscriptions, include_disabled=False).select("subscription_id", "watch_id", "scope", "lead_days")


@query(
    "subscription_switch",
    f"{SUBS} SELECT subscription_id, CASE WHEN subscription_id % 5 = 0 THEN false WHEN subscription_id % 5 = 1 THEN true ELSE enabled END AS enabled FROM subscriptions",
)
def _(s):
    """Every fifth is switched on, then off; the next ones on: the last request counts."""
    k = F.col("subscription_id")
    on = s.subscriptions.where(k % 5 < 2).select(k, F.lit(1).alias("ord"), F.lit(True).alias("enabled"))
    off = s.subscriptions.where(k % 5 == 0).select(k, F.lit(2).alias("ord"), F.lit(False).alias("enabled"))
    return st.enable_subscriptions(s.subscriptions, on.unionByName(off)).select("subscription_id", "enabled")


@query("subscription_remove", f"{SUBS} SELECT subscription_id, scope FROM subscriptions WHERE subscription_id % 6 <> 2")
def _(s):
    gone = s.subscriptions.where(F.col("subscription_id") % 6 == 2)
    return st.remove_subscriptions(s.subscriptions, gone).select("subscription_id", "scope")


@query(
    "subscribe_users",
    q.with_(q.WATCHES, q.USERS) + "SELECT user_id, watch_id FROM user_watches UNION SELECT 7, watch_id FROM watches WHERE kind = 'artist'",
)
def _(s):
    asked = s.watches.where(F.col("kind") == "artist").select(F.lit(7).cast("bigint").alias("user_id"), "watch_id")
    return st.subscribe_users(s.user_watches, asked.unionByName(asked))


# --- reminders ------------------------------------------------------------------------

OCC = f"""occ0 AS (SELECT event_id, round_key, name, url, evidence, field, label, date FROM (
    SELECT event_id, round_key, name, url, evidence, unnest(['application_start_at','application_end_at','results_date','payment_end_at','general_sale_date']) AS field,
      unnest([{', '.join(q.lit(l) for _, l in dims.REMINDER_FIELDS)}]) AS label,
      unnest([application_start_at, application_end_at, results_date, payment_end_at, general_sale_date]) AS date FROM shown) WHERE date IS NOT NULL),
 located AS (SELECT o.*, e.watch_id, e.title AS event_title, {q.city("(" + q.clean('o.name') + " || ' ' || o.evidence)")} AS direct,
     list_filter(e.venues, lambda v: contains({q.clean('o.name')} || ' ' || o.evidence, v))[1] AS venue FROM occ0 o JOIN events_t e USING (event_id)),
 every AS (SELECT watch_id, event_id, event_title, coalesce(nullif(direct, ''), nullif({q.city("venue")}, ''), venue, '{dims.ALL_PERFORMANCES}') AS location, label, field, date, name AS subject, url, round_key FROM located
   UNION ALL SELECT watch_id, event_id, title, CASE WHEN {q.city('v')} <> '' THEN {q.city('v')} ELSE v END, 'Performance date', 'show', CAST(d AS DATE), v, official_url, NULL
     FROM (SELECT *, unnest(venues) AS v, unnest(event_dates[1:len(venues)]) AS d FROM events_t WHERE len(venues) > 0) WHERE d IS NOT NULL AND v IS NOT NULL
   UNION ALL SELECT watch_id, event_id, title, '', 'Performance date', 'show', CAST(d AS DATE), title, official_url, NULL FROM (SELECT *, unnest(event_dates) AS d FROM events_t WHERE len(venues) = 0)),
 scoped AS (SELECT e.*, s.subscription_id, s.channels, s.lead_days, s.enabled FROM every e JOIN subscriptions s USING (watch_id) WHERE CASE WHEN s.scope = 'round' THEN coalesce(e.round_key = s.round_key, false)
     WHEN s.scope = 'event_location' AND s.location <> '' THEN e.location = s.location ELSE true END)"""
REM = f"{q.with_(q.WATCHES, q.EVENTS, q.ROUNDS)}, {q.SUBSCRIPTIONS}, {SHOWN}, {OCC}"


def sql_due(as_of: str) -> str:
    return (
        f"SELECT *, date - {as_of} AS lead, substr(sha256(concat_ws('|', subscription_id, event_id, field, subject, location, date, date - {as_of})), 1, 24) AS notification_key FROM scoped"
        f" WHERE enabled AND list_contains(CASE lead_days WHEN '7, 1,0,x,1' THEN [7, 1, 0] WHEN '3' THEN [3] ELSE [0] END, date - {as_of})"
    )


@query(
    "occasions",
    f"{REM} SELECT subscription_id, event_id, field, subject, location, CAST(date AS VARCHAR) AS date, url FROM scoped",
)
def _(s):
    got = rm.occasions(s.subscriptions, s.events_dealt, s.rounds, s.as_of)
    return got.select("subscription_id", "event_id", "field", "subject", "location", "date", "url")


@query("reminders_due", f"{REM} SELECT notification_key, subscription_id, event_id, field, subject, location, CAST(date AS VARCHAR) AS date, lead FROM ({sql_due(q.AS_OF)})")
def _(s):
    got = rm.due_reminders(s.subscriptions, s.events, s.rounds, s.as_of)
    return got.select("notification_key", "subscription_id", "event_id", "field", "subject", "location", "date", "lead")


def _log(s):
    """Reminders of the day that were already sent: those of even subscriptions."""
    due = rm.due_reminders(s.subscriptions, s.events, s.rounds, s.as_of)
    return rm.log_rows(due.where(F.col("subscription_id") % 2 == 0), now())


@query(
    "reminders_new",
    f"{REM} SELECT DISTINCT notification_key, subscription_id FROM ({sql_due(q.AS_OF)}) WHERE subscription_id % 2 = 1",
)
def _(s):
    due = rm.due_reminders(s.subscriptions, s.events, s.rounds, s.as_of)
    return rm.new_reminders(due, _log(s)).select("notification_key", "subscription_id")


HEADLINE = f"""label || CASE lead WHEN 0 THEN ' today' WHEN 1 THEN ' in 1 day' ELSE ' in ' || lead || ' days' END AS headline,
  subject || CASE WHEN location <> '' AND location <> '{dims.ALL_PERFORMANCES}' THEN ' (' || location || ')' ELSE '' END || ' — ' || date || ' · ' || event_title AS body"""


@query("reminder_headline", f"{REM} SELECT notification_key, {HEADLINE} FROM ({sql_due(q.AS_OF)})")
def _(s):
    due = rm.due_reminders(s.subscriptions, s.events, s.rounds, s.as_of)
    return due.select("notification_key", rm.headline_title().alias("headline"), rm.headline_body().alias("body"))


@query(
    "reminder_feed",
    f"{REM} SELECT DISTINCT notification_key, channels AS channel, headline FROM (SELECT *, {HEADLINE} FROM ({sql_due(q.AS_OF)}) WHERE subscription_id % 2 = 0) ORDER BY notification_key LIMIT 100",
)
def _(s):
    feed = rm.reminder_feed(_log(s).dropDuplicates(["notification_key"]), 100)
    return feed.select("notification_key", "channel", F.get_json_object("payload", "$.title").alias("headline"))


# --- cleanup and one batch --------------------------------------------------------------

DIRTY = f"""d_links AS (SELECT CASE WHEN event_id % 23 = 0 THEN -event_id - 1 ELSE event_id END AS event_id, url, label FROM event_links),
 d_rounds AS (SELECT * REPLACE (CASE WHEN event_id % 23 = 0 THEN -event_id - 1 ELSE event_id END AS event_id, CASE WHEN part % 37 = 0 THEN 'Fetch failed' ELSE name END AS name,
   {q.status('(' + q.AS_OF + ' - 30)', 'coalesce(application_start_at, lottery_start)', 'coalesce(application_end_at, lottery_end)')} AS status) FROM rounds),
 official AS (SELECT watch_id, min(event_id) AS target FROM events_t WHERE regexp_matches(official_url, '^https?://') GROUP BY 1),
 stale AS (SELECT event_id, target FROM events_t JOIN official USING (watch_id) WHERE starts_with(official_url, 'keyword:')),
 live AS (SELECT *, part % 12 = 3 AND line IN (2, 4) AS splits FROM d_rounds WHERE event_id IN (SELECT event_id FROM events_t) AND event_id NOT IN (SELECT event_id FROM stale) AND name <> 'Fetch failed'),
 kept_links AS (SELECT DISTINCT coalesce(target, l.event_id) AS event_id, url FROM d_links l LEFT JOIN stale s USING (event_id) WHERE l.event_id IN (SELECT event_id FROM events_t) AND {q.actionable('url', 'label')}),
 d_sources AS (SELECT CASE WHEN source_id % 4 = 0 THEN -watch_id - 1 ELSE watch_id END AS watch_id FROM watch_sources)"""


@query(
    "cleanup_counts",
    f"""{BASE}, {ALERT_LOG}, {DIRTY}
      SELECT 'sources' AS item, (SELECT count(*) FROM d_links) - (SELECT count(*) FROM kept_links) AS n UNION ALL
      SELECT 'ticket_rounds', (SELECT count(*) FROM d_rounds) - (SELECT count(*) FROM live) UNION ALL
      SELECT 'snapshots', (SELECT count(*) FROM events_t WHERE event_id IN (SELECT event_id FROM stale)) UNION ALL
      SELECT 'alert_log', (SELECT count(*) FROM alert_log WHERE event_id IN (SELECT event_id FROM stale)) UNION ALL
      SELECT 'watch_sources', (SELECT count(*) FROM d_sources WHERE watch_id NOT IN (SELECT watch_id FROM watches)) UNION ALL
      SELECT 'keyword_fallback_events', (SELECT count(*) FROM stale) UNION ALL
      SELECT 'event_venues', (SELECT count(*) FROM events_t WHERE event_id NOT IN (SELECT event_id FROM stale) AND event_id % 5 = 3) UNION ALL
      SELECT 'ticket_round_dates', (SELECT count(*) FROM live l JOIN rounds r ON r.event_id = l.event_id AND r.round_key = l.round_key WHERE r.status <> l.status AND NOT splits) UNION ALL
      SELECT 'ticket_round_memberships', (SELECT sum(CASE line WHEN 2 THEN 3 ELSE 2 END) FROM live WHERE splits)""",
)
def _(s):
    return st.cleanup(dirty_state(s), s.as_of)[1]


#: Evidence of some rounds on lines 2 (named after a membership) and 4 (an advance sale).
MEMBER_EVIDENCE = "プレミアム会員：2026/07/01～2026/07/10 非会員：2026/07/28～2026/08/05"
MEMBERS = "(VALUES ('プレミアム会員', DATE '2026-07-01', DATE '2026-07-10'), ('非会員', DATE '2026-07-28', DATE '2026-08-05')) m(member, a, b)"


@query(
    "cleanup_rounds",
    f"""{BASE}, {DIRTY}, kids AS (SELECT event_id, platform, url, CASE line WHEN 2 THEN '先行 / ' ELSE name || ' / ' END || member AS name, a, b, results_date, general_sale_date, payment_end_at
        FROM live, {MEMBERS} WHERE splits)
      SELECT l.event_id, l.round_key, l.name, CAST(l.application_start_at AS VARCHAR) AS application_start_at, CAST(l.application_end_at AS VARCHAR) AS application_end_at, r.status
        FROM live l JOIN rounds r ON r.event_id = l.event_id AND r.round_key = l.round_key WHERE NOT splits UNION ALL
      SELECT event_id, {q.key24('platform', 'url', 'lower(name)', 'CAST(a AS VARCHAR)', 'CAST(general_sale_date AS VARCHAR)')}, name, CAST(a AS VARCHAR), CAST(b AS VARCHAR), {q.status(q.AS_OF, 'a', 'b')} FROM kids""",
)
def _(s):
    cleaned = st.cleanup(dirty_state(s), s.as_of)[0]["rounds"]
    return cleaned.select("event_id", "round_key", "name", "application_start_at", "application_end_at", "status")


def dirty_state(s):
    """Stored tables with orphans, placeholders, stale fallbacks and rounds that print memberships."""
    from roundtide.functions.rounds import status_at
    from roundtide.operators.rounds import normalize_rounds

    e = F.col("event_id")
    moved = F.when(e % 23 == 0, -e - 1).otherwise(e)
    home = F.when(F.col("l_orderkey") % 23 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    lines = s.order_lines.withColumn("home", home)
    rounds = normalize_rounds(s.rounds_of(lines.repartition("home") if s.whole_orders else lines), s.as_of, parse_evidence=False)
    # stored tables, read by many steps
    named = rounds.columns
    rounds = written(rounds.select(F.col("home").alias("event_id"), F.col("event_id").alias("of_event"), *[c for c in named if c not in ("home", "event_id")]), "rounds", by="event_id" if s.whole_orders else None)
    unmoved = rounds.withColumn("event_id", F.col("of_event")).drop("of_event")
    rounds = rounds.drop("of_event")
    return {
        "watches": s.watches,
        "events": s.events,
        "links": written(s.event_links.withColumn("event_id", moved), "links"),
        "rounds": rounds.withColumn("status", status_at(F.date_sub(s.as_of, 30))).withColumns(
            {
                "name": F.when(F.col("part") % 37 == 0, "Fetch failed").otherwise(F.col("name")),
                "evidence": F.when((F.col("part") % 12 == 3) & (F.col("line") == 2), MEMBER_EVIDENCE)
                .when((F.col("part") % 12 == 3) & (F.col("line") == 4), F.concat("name", F.lit(" " + MEMBER_EVIDENCE)))
                .otherwise(F.col("evidence")),
            }
        ),
        "snapshots": written(st.snapshots(s.events, unmoved), "snapshots"),
        "alert_log": written(s.alert_log, "alert_log"),
        "watch_sources": s.watch_sources.withColumn(
            "watch_id", F.when(F.col("source_id") % 4 == 0, -F.col("watch_id") - 1).otherwise(F.col("watch_id"))
        ),
    }


def batch_state(s):
    extra = {"status": F.lit("watching"), "event_key": F.lit("")}
    by = "event_id" if s.whole_orders else None
    state = {
        "watches": s.watches,
        "events": s.prev_events.withColumns(extra),
        "links": written(s.prev_links, "prev_links", by=by),  # yesterday's tables are stored ones, read by many steps
        "rounds": written(s.prev_rounds, "prev_rounds", by=by),
        "alert_log": written(s.alert_log, "alert_log"),
    }
    state["snapshots"] = st.snapshots(s.prev_events, state["rounds"]).withColumn("created_at", now())
    batch = {"events": s.batch_events, "links": s.batch_links, "rounds": s.batch_rounds}
    return state, batch


@query(
    "apply_batch",
    f"""{STATE}, {PRUNED}, {FALLBACK}, {ALERT_LOG}, br AS (SELECT * FROM batch_rounds WHERE event_id % 17 <> 0 OR true), old_rounds AS (SELECT * FROM prev_rounds WHERE event_id NOT IN (SELECT event_id FROM gone)),
      life AS (SELECT * FROM ({sql_alerts(q.AS_OF, 'batch_rounds')}) t WHERE event_id IN (SELECT event_id FROM prev_events UNION SELECT event_id FROM batch_events)
        AND NOT EXISTS (SELECT 1 FROM alert_log l WHERE l.event_id = t.event_id AND l.alert_key = t.alert_key AND l.event_id NOT IN (SELECT event_id FROM gone)))
      SELECT 'events' AS item, (SELECT count(*) FROM (SELECT event_id FROM prev_events UNION SELECT event_id FROM batch_events) WHERE event_id NOT IN (SELECT event_id FROM gone)) AS n UNION ALL
      SELECT 'rounds', (SELECT count(*) FROM (SELECT event_id, round_key FROM old_rounds EXCEPT SELECT * FROM pruned UNION SELECT event_id, round_key FROM batch_rounds)) UNION ALL
      SELECT 'links', (SELECT count(*) FROM (SELECT event_id, url FROM prev_links WHERE event_id NOT IN (SELECT event_id FROM gone) UNION SELECT event_id, url FROM batch_links)) UNION ALL
      SELECT 'lifecycle', (SELECT count(*) FROM life) UNION ALL
      SELECT type, count(*) FROM ({sql_changes('old_rounds')}) WHERE event_id IN (SELECT event_id FROM prev_events UNION SELECT event_id FROM batch_events) GROUP BY 1 UNION ALL
      SELECT 'new_official_page', (SELECT count(*) FROM batch_events n WHERE NOT starts_with(official_url, 'keyword:') AND NOT EXISTS (SELECT 1 FROM prev_events o WHERE o.event_id = n.event_id)) UNION ALL
      SELECT 'new_ticket_link', (SELECT count(*) FROM batch_links n WHERE event_id IN (SELECT event_id FROM prev_events UNION SELECT event_id FROM batch_events)
        AND NOT EXISTS (SELECT 1 FROM prev_links o WHERE o.event_id = n.event_id AND o.url = n.url AND o.event_id NOT IN (SELECT event_id FROM gone)))""",
)
def _(s):
    state, batch = batch_state(s)
    nxt, out = st.apply_batch(state, batch, s.as_of, now())
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return (
        n("events", nxt["events"])
        .unionByName(n("rounds", nxt["rounds"]))
        .unionByName(n("links", nxt["links"]))
        .unionByName(n("lifecycle", out["lifecycle"]))
        .unionByName(out["changes"].groupBy(F.col("type").alias("item")).agg(F.count("*").alias("n")))
    )


# --- observations -------------------------------------------------------------------------

@query(
    "field_history",
    """SELECT event_id, user_id, event_type, prev, value AS new_value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events)
      WHERE prev IS NOT NULL AND prev <> value""",
)
def _(s):
    from roundtide.operators.history import field_history

    return field_history(s.table("events"), ["user_id", "event_type"], "value", ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", F.col("old").alias("prev"), F.col("new").alias("new_value")
    )
