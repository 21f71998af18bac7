"""Moved rounds, events merged across watches, and the SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions import sql
from roundtide.operators.identity import merge_events, round_moves
from roundtide.operators import state as st
from roundtide.operators.rounds import normalize_rounds, round_key
from roundtide.plans import scalar
from roundtide.plans import sqltext as q
from roundtide.plans.reads import BASE
from roundtide.plans.registry import query
from roundtide.plans.star import AS_OF
from roundtide.plans.state_q import STATE

COPY = 1_000_000_000
SQL_KEY = q.key24("platform", "url", f"lower({q.clean('name')})", "CAST(application_start_at AS VARCHAR)", "CAST(general_sale_date AS VARCHAR)")
#: One page an event and host, so that rounds of a name lie in one place; starts were three days earlier for a fifth.
SQL_MOVES = f"""{BASE}, placed AS (SELECT event_id, line, platform, regexp_extract(url, '^(https://[^/]+)/', 1) || '/e/' || event_id AS url,
    CASE WHEN line % 3 = 0 THEN '一般発売' ELSE 'FC会員先行' END AS name, lottery_start AS application_start_at, general_sale_date FROM rounds),
  was AS (SELECT DISTINCT *, {SQL_KEY} AS round_key FROM (SELECT event_id, platform, url, name,
    CASE WHEN (event_id + line) % 5 = 0 THEN application_start_at - 3 ELSE application_start_at END AS application_start_at, general_sale_date FROM placed WHERE (event_id + line) % 11 <> 0)),
  now_ AS (SELECT DISTINCT *, {SQL_KEY} AS round_key FROM (SELECT * EXCLUDE (line) FROM placed WHERE (event_id + line) % 17 <> 0)),
  lost AS (SELECT *, row_number() OVER (PARTITION BY event_id, platform, url, name ORDER BY application_start_at NULLS LAST, general_sale_date NULLS LAST, round_key) AS r FROM was
    WHERE (event_id, platform) IN (SELECT (event_id, platform) FROM now_) AND (event_id, round_key) NOT IN (SELECT (event_id, round_key) FROM now_)),
  found AS (SELECT *, row_number() OVER (PARTITION BY event_id, platform, url, name ORDER BY application_start_at NULLS LAST, general_sale_date NULLS LAST, round_key) AS r FROM now_
    WHERE (event_id, round_key) NOT IN (SELECT (event_id, round_key) FROM was))
  SELECT event_id, platform, url, l.round_key AS old_round_key, CAST(l.application_start_at AS VARCHAR) AS old_start, CAST(l.general_sale_date AS VARCHAR) AS old_sale,
    f.round_key AS new_round_key, CAST(f.application_start_at AS VARCHAR) AS new_start, CAST(f.general_sale_date AS VARCHAR) AS new_sale
  FROM lost l JOIN found f USING (event_id, platform, url, name, r)"""


@query("round_moves", SQL_MOVES)
def _(s):
    h = F.col("event_id") + F.col("line")
    none = F.lit(None).cast("date")
    placed = s.rounds.select(
        "event_id", "line", "platform", F.concat(F.regexp_extract("url", "^(https://[^/]+)/", 1), F.lit("/e/"), F.col("event_id").cast("string")).alias("url"),
        F.when(F.col("line") % 3 == 0, "一般発売").otherwise("FC会員先行").alias("name"), F.col("lottery_start").alias("application_start_at"), "general_sale_date",
    )
    earlier = F.when(h % 5 == 0, F.date_sub("application_start_at", 3)).otherwise(F.col("application_start_at"))
    keyed = lambda df: df.drop("line").distinct().withColumns({"source": F.col("platform"), "lottery_start": none}).withColumn("round_key", round_key())
    was = keyed(placed.where(h % 11 != 0).withColumn("application_start_at", earlier))
    return round_moves(was, keyed(placed.where(h % 17 != 0)))


@query(
    "event_merge",
    f"""{BASE}, homes AS (SELECT event_id, watch_id FROM events_t UNION ALL SELECT event_id, watch_id + 7 FROM events_t WHERE event_id % 4 = 0)
      SELECT event_id, title, CAST(n_watches AS BIGINT) AS n_watches, coalesce(n_rounds, 0) AS n_rounds, coalesce(n_links, 0) AS n_links FROM events_t
      JOIN (SELECT event_id, count(DISTINCT watch_id) AS n_watches FROM homes GROUP BY 1) USING (event_id)
      LEFT JOIN (SELECT event_id, count(DISTINCT round_key) AS n_rounds FROM rounds GROUP BY 1) USING (event_id)
      LEFT JOIN (SELECT event_id, count(DISTINCT url) AS n_links FROM event_links GROUP BY 1) USING (event_id)""",
)
def _(s):
    """Every fourth event has a copy under another watch; its rounds lie with either, its links with both."""
    double, k = F.col("event_id") % 4 == 0, F.col("event_id")
    events = s.events.unionByName(s.events.where(double).withColumns({"event_id": k + COPY, "watch_id": F.col("watch_id") + 7}))
    rounds = s.rounds.select("event_id", "line", "round_key").withColumn("event_id", F.when(double & (F.col("line") % 2 == 0), k + COPY).otherwise(k))
    links = s.event_links.unionByName(s.event_links.where(double).withColumn("event_id", k + COPY))
    merged, watched, moved = merge_events(events, {"rounds": (rounds, ["round_key"]), "links": (links, ["url"])})
    count = lambda df, name: df.groupBy("event_id").agg(F.count("*").alias(name))
    out = merged.select("event_id", "title").join(count(watched, "n_watches"), "event_id")
    out = out.join(count(moved["rounds"], "n_rounds"), "event_id", "left").join(count(moved["links"], "n_links"), "event_id", "left")
    return out.fillna(0, ["n_rounds", "n_links"])


@query(
    "round_evidence",
    q.with_(q.ROUNDS)
    + """SELECT event_id, line, CAST(application_start_at AS VARCHAR) AS application_start_at, CAST(application_end_at AS VARCHAR) AS application_end_at, status, round_key FROM rounds""",
)
def _(s):
    """Rounds whose window stands in the evidence only: both ends, or the start with the end stored."""
    raw = s.raw_rounds
    printed = F.col("lottery_start").isNotNull() & F.col("lottery_end").isNotNull() & (F.col("name") != "一般発売")
    day = lambda c: F.date_format(c, "yyyy年M月d日")
    text = F.concat(F.lit("会員向け " + dims.ADVANCE_RANGE_LABELS[0] + " "), day("lottery_start"), F.lit("〜"), day("lottery_end"), F.lit(" まで受付"))
    none = F.lit(None).cast("date")
    raw = raw.withColumns(
        {
            "evidence": F.when(printed, text).otherwise(F.col("evidence")),
            "lottery_start": F.when(~printed, F.col("lottery_start")).otherwise(none),
            "lottery_end": F.when(printed & (F.col("line") % 2 == 0), none).otherwise(F.col("lottery_end")),
        }
    )
    columns = "event_id", "line", "application_start_at", "application_end_at", "status", "round_key"
    return normalize_rounds(raw, s.as_of, parse_evidence=True).select(*columns)


@query(
    "snapshot_parts",
    f"""{STATE}, r AS (SELECT event_id, list_sort(list(concat_ws('~', round_key, coalesce(CAST(results_date AS VARCHAR), 'none'), application_end_at))) AS c FROM rounds GROUP BY 1),
      p AS (SELECT event_id, list_sort(list(concat_ws('~', round_key, coalesce(CAST(results_date AS VARCHAR), 'none'), application_end_at))) AS c FROM prev_rounds GROUP BY 1),
      fresh AS (SELECT e.event_id FROM events_t e LEFT JOIN prev_events o USING (event_id) LEFT JOIN r ON r.event_id = e.event_id LEFT JOIN p ON p.event_id = e.event_id
        WHERE o.event_id IS NULL OR o.title <> e.title OR r.c IS DISTINCT FROM p.c)
      SELECT event_id, 'round' AS part, round_key AS name, CAST(application_end_at AS VARCHAR) AS ends FROM rounds JOIN fresh USING (event_id)
      UNION ALL SELECT event_id, 'link', url, NULL FROM event_links JOIN fresh USING (event_id)""",
)
def _(s):
    """Rounds and links of the snapshots that are new, as they are stored with them."""
    new = st.new_snapshots(st.snapshots(s.events_dealt, s.rounds), st.snapshots(s.prev_events, s.prev_rounds))
    parts = st.snapshot_parts(new, s.rounds, s.event_links)
    return parts.select("event_id", "part", "name", F.get_json_object("content", "$.application_end_at").alias("ends"))


# --- SQL only ---------------------------------------------------------------------

@query("sql_url_platform", f"SELECT page_id, {q.platform('url')} AS platform FROM pages")
def _(s):
    sql.register(s.spark)
    return s.spark.sql("SELECT page_id, url_platform(url) AS platform FROM {pages}", pages=s.table("pages"))


@query("sql_round_status", q.with_(q.ROUNDS) + "SELECT event_id, line, status FROM rounds")
def _(s):
    sql.register(s.spark)
    return s.spark.sql(
        f"""SELECT event_id, line, round_status(coalesce(application_start_at, lottery_start), coalesce(application_end_at, lottery_end),
            results_date, general_sale_date, coalesce(payment_end_at, payment_deadline), DATE '{AS_OF}') AS status FROM {{rounds}}""",
        rounds=s.rounds,
    )


@query("sql_keyword_overlap", f"WITH {scalar.CANDIDATES} SELECT doc_id, round({scalar.sql_overlap('keyword', 'text')}, 9) AS overlap FROM cand")
def _(s):
    sql.register(s.spark)
    return s.spark.sql("SELECT doc_id, round(keyword_overlap(keyword, text), 9) AS overlap FROM {cand}", cand=scalar.candidates(s))


SQL_TOKEN = dims.DATE_TOKEN.replace("\\s", "[\\s\\x{3000}\\x{00A0}]").replace("'", "''")


@query("sql_date_tokens", f"SELECT doc_id, unnest(range(1, len(t) + 1))::INT AS place, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{SQL_TOKEN}') AS t FROM documents)")
def _(s):
    sql.register(s.spark)
    return s.spark.sql("SELECT doc_id, place, token FROM {docs}, LATERAL date_tokens(text)", docs=s.table("documents"))
