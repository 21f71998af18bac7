"""Scalar functions over whole tables: pages, URLs, texts, rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions import dates, grams, rounds, text, urls
from roundtide.plans import sqltext as q
from roundtide.plans.registry import query
from roundtide.plans.star import Star, pick
from roundtide.sources import pages

# --- fixed values: URL shapes that exercise every classification rule --------
URL_SHAPES = {
    0: "https://t.pia.jp/pia/event/", 1: "https://www.eplus.jp/sf/search/", 2: "https://L-Tike.com/search/",
    3: "https://www.shiki.jp/stage_schedule/?aj=", 4: "https://shiki.jp/tickets_guide/p", 5: "https://www.twitter.com/official/",
    6: "https://box.com/a?b=", 7: "keyword:kw-", 8: "https://marv.jp/show#ticket", 9: "https://news.example.co.jp:8080/live/",
    10: "https://eplus.jp/insurance/", 11: "http://user@tickebo.jp/公演/",
}


def url_table(s: Star) -> DataFrame:
    """(url, label): shaped part URLs, page URLs and event links."""
    shaped = s.table("part").select(
        F.when(F.col("p_partkey") % 24 == 3, "https://www.shiki.jp/stage_schedule/")
        .otherwise(F.concat(pick(F.col("p_partkey") % 12, URL_SHAPES, ""), F.col("p_partkey").cast("string")))
        .alias("url"),
        F.col("p_name").alias("label"),
    )
    paged = s.table("pages").select("url", F.lit("Page").alias("label"))
    return shaped.unionByName(paged).unionByName(s.event_links.select("url", "label"))


URLS = (
    "urls AS (SELECT CASE WHEN p_partkey % 24 = 3 THEN 'https://www.shiki.jp/stage_schedule/' ELSE "
    + q.case_of("p_partkey % 12", URL_SHAPES, "''")
    + " || p_partkey END AS url, p_name AS label FROM part UNION ALL SELECT url, 'Page' FROM pages UNION ALL SELECT url, label FROM event_links)"
)
WITH_URLS = q.with_(q.LINKS, URLS)
TAG = "<[a-zA-Z/!?][^>]*>"


def sql_unescape(c: str) -> str:
    for entity, char in text.HTML_ENTITIES:
        c = f"replace({c}, {q.lit(entity)}, {q.lit(char)})"
    return c


def sql_visible(c: str) -> str:
    return q.clean(sql_unescape(f"regexp_replace({c}, {q.lit(TAG)}, ' ', 'g')"))


# The pages of the tables close what they open; query page_markup has the other cases.
SQL_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
SQL_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
SQL_MARKUP = f"regexp_replace(html, {q.lit(SQL_HIDDEN)}, ' ', 'g')"
SQL_TEXT = sql_visible(SQL_MARKUP)
SQL_TITLE = sql_visible(f"regexp_extract(html, {q.lit(pages.TITLE)}, 1)")


@query("pages_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def _(s):
    return pages.read_pages(s.spark, f"{s.dir}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("page_title", f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def _(s):
    return pages.parse_pages(s.spread("pages")).select("page_id", "title")


@query("page_text", f"SELECT page_id, {SQL_TEXT} AS text FROM pages")
def _(s):
    return pages.parse_pages(s.spread("pages")).select("page_id", "text")


BROKEN = '<p title="a>b">quoted &#233; &#x3042; &#38;lt; <a href="/u1">one <a href="/u2">two<script>var leak = 1;'


@query("page_markup", f"SELECT page_id, {SQL_TEXT} || ' quoted é あ &lt; one two' AS text FROM pages")
def _(s):
    broken = s.table("pages").withColumn("html", F.concat("html", F.lit(BROKEN)))
    return broken.select("page_id", pages.page_text(F.col("html")).alias("text"))


SQL_LINKS = f"""page_links AS (
  SELECT page_id, page_url, pos, label, url FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM (
      SELECT page_id, page_url, pos, coalesce(nullif(label, ''), url) AS label, url FROM (
        SELECT page_id, url AS page_url, i AS pos, {sql_visible('labels[i]')} AS label,
          CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
               WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || h
               WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h
               ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/?#]*.*/)', 1) || h END AS url
        FROM (SELECT page_id, url, labels, i, {sql_unescape("regexp_extract(attrs[i], 'href=\"([^\"]*)\"', 1)")} AS h FROM (
          SELECT *, unnest(range(1, len(attrs) + 1)) AS i FROM (
            SELECT page_id, url, regexp_extract_all({SQL_MARKUP}, {q.lit(SQL_ANCHOR)}, 1) AS attrs,
              regexp_extract_all({SQL_MARKUP}, {q.lit(SQL_ANCHOR)}, 2) AS labels FROM pages)))
        WHERE h <> ''))
    WHERE NOT regexp_matches(url, '^(mailto|tel|javascript):'))
  WHERE rn = 1)"""


@query("page_links", f"WITH {SQL_LINKS} SELECT page_id, label, url FROM page_links")
def _(s):
    return pages.exploded_links(pages.parse_pages(s.spread("pages"))).select("page_id", "label", "url")


@query(
    "ticket_links",
    f"WITH {SQL_LINKS}, {q.LINKS}, m AS (SELECT page_id, url FROM page_links UNION ALL SELECT event_id, url FROM event_links) "
    f"SELECT page_id, url FROM m WHERE {q.actionable('url', chr(39) * 2)} GROUP BY 1, 2",
)
def _(s):
    found = pages.exploded_links(pages.parse_pages(s.spread("pages"))).select("page_id", "url")
    both = found.unionByName(s.event_links.select(F.col("event_id").alias("page_id"), "url"))
    return both.where(urls.is_actionable_ticket_link(F.col("url"), F.lit(""))).distinct()


HREFS = {
    0: "b/c.html", 1: "./d", 2: "../up", 3: "/root?x=1", 4: "//cdn.example.com/z", 5: "?page=3", 6: "#top",
    7: "https://other.example.com/q", 8: "mailto:a@b.c", 9: "../../far/./x",
}


@query(
    "link_resolve",
    f"""SELECT page_id, href, CASE page_id % 10
      WHEN 0 THEN dir || 'b/c.html' WHEN 1 THEN dir || 'd'
      WHEN 2 THEN regexp_replace(dir, '[^/]*/$', '') || 'up'
      WHEN 3 THEN origin || '/root?x=1' WHEN 4 THEN scheme || '//cdn.example.com/z'
      WHEN 5 THEN regexp_replace(url, '[?#].*$', '') || '?page=3' WHEN 6 THEN regexp_replace(url, '#.*$', '') || '#top'
      WHEN 9 THEN origin || '/far/x' ELSE href END AS resolved
    FROM (SELECT page_id, url, {q.case_of('page_id % 10', HREFS, "''")} AS href, regexp_extract(url, '^([a-z]+:)', 1) AS scheme,
      regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
      regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/?#]*/(?:[^/]*/)?)', 1) AS dir0,
      regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/?#]*.*/)', 1) AS dir FROM pages)""",
)
def _(s):
    href = pick(F.col("page_id") % 10, HREFS, "")
    return s.table("pages").select("page_id", href.alias("href"), urls.resolve_link(F.col("url"), href).alias("resolved"))


@query("page_quality", f"SELECT page_id, length(text) AS n_chars, (length(text) < 400 OR {q.any_in('lower(text)', dims.EMPTY_PAGE_MARKERS)} OR contains(replace(lower(text), ' ', ''), 'comingsoon')) AS needs_render FROM (SELECT page_id, {SQL_TEXT} AS text FROM pages)")
def _(s):
    parsed = pages.parse_pages(s.spread("pages"))
    return parsed.select("page_id", F.length("text").cast("bigint").alias("n_chars"), pages.needs_render(F.col("text")).alias("needs_render"))


@query("url_host", f"{WITH_URLS} SELECT url, {q.host('url')} AS host, count(*) AS n FROM urls GROUP BY 1, 2")
def _(s):
    return url_table(s).groupBy("url").agg(F.count("*").alias("n")).withColumn("host", urls.url_host(F.col("url")))


@query("url_is_web", f"{WITH_URLS} SELECT url, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS is_web FROM urls")
def _(s):
    return url_table(s).select("url", urls.is_web_url(F.col("url")).alias("is_web"))


@query(
    "url_class",
    f"""{WITH_URLS} SELECT url, {q.noisy('url')} AS noisy, {q.ticket('url')} AS ticket, {q.portal('url')} AS portal,
      ({q.host('url')} = 'shiki.jp' AND {q.path('url')} = '/stage_schedule/') AS stage_schedule, {q.generic('url')} AS generic FROM urls""",
)
def _(s):
    u = F.col("url")
    return url_table(s).select(
        "url",
        urls.is_noisy_url(u).alias("noisy"),
        urls.is_ticket_url(u).alias("ticket"),
        urls.is_portal_search_url(u).alias("portal"),
        urls.is_stage_schedule_url(u).alias("stage_schedule"),
        urls.is_generic_ticket_info_url(u).alias("generic"),
    )


@query("url_platform", f"{WITH_URLS} SELECT url, {q.platform('url')} AS platform FROM urls")
def _(s):
    return url_table(s).select("url", urls.platform_name(F.col("url")).alias("platform"))


@query("url_actionable", f"{WITH_URLS} SELECT url, label, {q.actionable('url', 'label')} AS actionable FROM urls")
def _(s):
    return url_table(s).select("url", "label", urls.is_actionable_ticket_link(F.col("url"), F.col("label")).alias("actionable"))


@query("url_provenance", f"{WITH_URLS} SELECT url, label, {q.provenance('url', 'label')} AS provenance FROM urls")
def _(s):
    return url_table(s).select("url", "label", urls.provenance(F.col("url"), F.col("label")).alias("provenance"))


@query("url_confidence", f"{WITH_URLS} SELECT url, {q.confidence('(' + q.platform('url') + ')')} AS confidence FROM urls")
def _(s):
    return url_table(s).select("url", urls.platform_confidence(urls.platform_name(F.col("url"))).alias("confidence"))


@query("link_confidence", f"{WITH_URLS} SELECT url, label, {q.link_confidence('url', 'label')} AS confidence FROM urls")
def _(s):
    return url_table(s).select("url", "label", urls.link_confidence(F.col("url"), F.col("label")).alias("confidence"))


@query("url_unwrap", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'https://plain.example.com/' || page_id ELSE url END AS target FROM pages")
def _(s):
    u, p = F.col("url"), F.col("page_id")
    packed = F.translate(F.regexp_replace(F.base64(F.encode(u, "utf-8")), "[=\\r\\n]", ""), "+/", "-_")
    wrapped = (
        F.when(p % 4 == 0, F.concat(F.lit("https://www.bing.com/ck/a?!&amp;p=1&amp;u=a1"), packed, F.lit("&amp;ntb=1")))
        .when(p % 4 == 1, F.concat(F.lit("https://www.bing.com/ck/a?u=a1"), packed))
        .when(p % 4 == 2, F.concat(F.lit("//duckduckgo.com/l/?kh=-1&uddg="), F.url_encode(u)))
        .otherwise(F.concat(F.lit("https://plain.example.com/"), p.cast("string")))
    )
    return s.table("pages").select("page_id", urls.unwrap_redirect(wrapped).alias("target"))


@query(
    "clean_text",
    f"SELECT doc_id, {q.clean('text')} AS cleaned, lower({q.clean('text')}) AS name_key FROM documents",
)
def _(s):
    c = F.regexp_replace("text", " ", "　\t ")
    return s.table("documents").select("doc_id", text.collapse(c).alias("cleaned"), text.round_name_key(c).alias("name_key"))


@query(
    "portal_links",
    """SELECT keyword, label, url FROM (SELECT c_name AS keyword, replace(c_name, '#', '%23') || CASE WHEN c_custkey % 2 = 0 THEN '%E5%85%AC' ELSE '' END AS e,
      CASE WHEN c_custkey % 2 = 0 THEN c_name || '  公' ELSE c_name END AS k, c_custkey FROM customer),
      LATERAL (SELECT unnest(['Pia search', 'eplus search', 'Lawson Ticket search']) AS label,
        unnest(['https://t.pia.jp/pia/search_all.do?kw=' || replace(keyword, '#', '%23') || CASE WHEN c_custkey % 2 = 0 THEN '++%E5%85%AC' ELSE '' END,
                'https://eplus.jp/sf/search?block=true&keyword=' || replace(keyword, '#', '%23') || CASE WHEN c_custkey % 2 = 0 THEN '++%E5%85%AC' ELSE '' END,
                'https://l-tike.com/search/?keyword=' || replace(keyword, '#', '%23') || CASE WHEN c_custkey % 2 = 0 THEN '%20%20%E5%85%AC' ELSE '' END]) AS url)""",
)
def _(s):
    kw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit("  公"))).otherwise(F.col("c_name"))
    return s.table("customer").select(F.col("c_name").alias("keyword"), F.inline(urls.portal_search_links(kw)))


@query("stable_key", "SELECT doc_id, substr(sha256(text), 1, 24) AS key FROM documents")
def _(s):
    return s.table("documents").select("doc_id", text.stable_key(F.col("text")).alias("key"))


def sql_commas(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: lower({q.clean('x')})), lambda x: x <> '')"


@query(
    "prefs_array",
    q.with_(q.WATCHES)
    + f"SELECT watch_id, array_to_string({sql_commas('preferred_regions')}, '|') AS regions, array_to_string({sql_commas('alert_preferences')}, '|') AS prefs FROM watches",
)
def _(s):
    return s.watches.select(
        "watch_id",
        text.comma_values(F.col("preferred_regions")).alias("regions"),
        text.comma_values(F.col("alert_preferences")).alias("prefs"),
    )


@query("lead_days", "SELECT c_custkey AS watch_id, CASE c_custkey % 3 WHEN 0 THEN '7|1|0' WHEN 1 THEN '3' ELSE '0' END AS days FROM customer")
def _(s):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, "7, 1,0,x,1").when(k % 3 == 1, "3").otherwise("")
    return s.table("customer").select(k.alias("watch_id"), text.lead_days(raw).alias("days"))


@query(
    "iso_date",
    f"""SELECT o_orderkey AS event_id, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""",
)
def _(s):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    raw = (
        F.when(k % 5 == 0, day)
        .when(k % 5 == 1, F.concat(day, F.lit("T12:00:00Z")))
        .when(k % 5 == 2, F.concat(day, F.lit(" note")))
        .when(k % 5 == 3, F.concat(F.substring(day, 1, 4), F.lit("-02-30")))
        .otherwise(F.concat(F.lit("on "), day))
    )
    return s.table("orders").select(k.alias("event_id"), dates.iso_date(raw).alias("day"))


# A page states a year when its digits hold exactly one distinct 20dd.
@query(
    "dominant_year",
    """SELECT doc_id, CASE WHEN len(ys) = 1 THEN CAST(ys[1] AS INTEGER) END AS year FROM (
      SELECT doc_id, list_distinct(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN 'Tour 20' || (10 + doc_id % 20) || ' / ' || text
        WHEN doc_id % 3 = 1 THEN text || ' 2024年 2024-05 20' || (24 + doc_id % 2) ELSE text END, '20[0-9]{2}')) AS ys FROM documents)""",
)
def _(s):
    d, t = F.col("doc_id"), F.col("text")
    noted = (
        F.when(d % 3 == 0, F.concat(F.lit("Tour 20"), (10 + d % 20).cast("string"), F.lit(" / "), t))
        .when(d % 3 == 1, F.concat(t, F.lit(" 2024年 2024-05 20"), (24 + d % 2).cast("string")))
        .otherwise(t)
    )
    return s.table("documents").select("doc_id", dates.dominant_year(noted).alias("year"))


PHRASE_LABELS = ("tion", "Éen", "hand")


@query(
    "phrase_windows",
    f"""WITH l AS (SELECT unnest([{', '.join(q.lit(x) for x in PHRASE_LABELS)}]) AS label, unnest([1, 2, 3]) AS lord),
    p AS (SELECT doc_id, text, label, lord, string_split(lower(text), lower(label)) AS parts FROM documents, l WHERE contains(lower(text), lower(label))),
    m AS (SELECT doc_id, text, label, lord, i, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(label) AS st
      FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM p)),
    w AS (SELECT doc_id, lord, i, {q.clean('substr(text, CAST(greatest(st - 30, 0) AS BIGINT) + 1, CAST(st + length(label) + 90 - greatest(st - 30, 0) AS BIGINT))')} AS phrase FROM m),
    f AS (SELECT doc_id, phrase, min((lord, i)) AS o FROM w GROUP BY 1, 2)
    SELECT doc_id, array_to_string(list(phrase ORDER BY o), '|') AS phrases FROM f GROUP BY 1""",
)
def _(s):
    got = dates.nearby_phrases(F.col("text"), text.string_array(PHRASE_LABELS))
    return s.table("documents").select("doc_id", got.alias("phrases")).where(F.size("phrases") > 0)


@query(
    "note_split",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(
       replace({q.clean("'注' || replace(text, '. ', '。') || ' ※' || lang || '。'")}, '※', '。※'), '[。\\n\\r]+'),
       lambda x: regexp_replace(x, '^[ ・:：。]+|[ ・:：。]+$', '', 'g')), lambda x: x <> ''), '|') AS notes FROM documents""",
)
def _(s):
    from roundtide.operators.extraction import split_notes

    t = F.concat(F.lit("注"), F.replace(F.col("text"), F.lit(". "), F.lit("。")), F.lit(" ※"), F.col("lang"), F.lit("。"))
    return s.table("documents").select("doc_id", split_notes(t).alias("notes"))


# --- rounds -------------------------------------------------------------------

@query(
    "round_status",
    q.with_(q.ROUNDS) + "SELECT event_id, line, status FROM rounds",
)
def _(s):
    return s.rounds.select("event_id", "line", "status")


@query(
    "label_maps",
    q.with_(q.ROUNDS)
    + f"""SELECT event_id, line, {q.STATUS_LABEL} AS status_label, {q.case_of('round_type', dims.ROUND_TYPE_LABELS, "''")} AS type_label,
      {q.case_of('membership_required', dims.MEMBERSHIP_LABELS, "''")} AS member_label FROM rounds""",
)
def _(s):
    return s.rounds.select(
        "event_id",
        "line",
        rounds.status_label(F.col("status")).alias("status_label"),
        rounds.label(dims.ROUND_TYPE_LABELS, F.col("round_type")).alias("type_label"),
        rounds.label(dims.MEMBERSHIP_LABELS, F.col("membership_required")).alias("member_label"),
    )


SQL_SCHEDULE = """concat_ws(' · ', CASE WHEN application_start_at IS NOT NULL AND application_end_at IS NOT NULL THEN 'Apply ' || application_start_at || ' – ' || application_end_at
  WHEN application_start_at IS NOT NULL THEN 'Apply from ' || application_start_at WHEN application_end_at IS NOT NULL THEN 'Apply by ' || application_end_at END,
  'Results ' || results_date, 'Pay by ' || payment_end_at, 'Sale ' || general_sale_date)"""


@query("schedule_label", q.with_(q.ROUNDS) + f"SELECT event_id, line, {SQL_SCHEDULE} AS schedule FROM rounds")
def _(s):
    return s.rounds.select("event_id", "line", rounds.schedule_label().alias("schedule"))


@query("relevant_date", q.with_(q.ROUNDS) + f"SELECT event_id, line, CAST({q.RELEVANT} AS VARCHAR) AS relevant FROM rounds")
def _(s):
    return s.rounds.select("event_id", "line", rounds.relevant_date().alias("relevant"))


@query("round_latest", q.with_(q.ROUNDS) + f"SELECT event_id, line, CAST({q.LATEST_DAY} AS BIGINT) AS latest FROM rounds")
def _(s):
    return s.rounds.select("event_id", "line", rounds.latest_day().cast("bigint").alias("latest"))


@query(
    "round_key",
    q.with_(q.ROUNDS) + "SELECT event_id, line, round_key FROM rounds",
)
def _(s):
    return s.rounds.select("event_id", "line", "round_key")


@query(
    "round_normalize",
    q.with_(q.ROUNDS)
    + """SELECT event_id, line, platform, CAST(application_start_at AS VARCHAR) AS application_start_at, CAST(application_end_at AS VARCHAR) AS application_end_at,
      CAST(payment_end_at AS VARCHAR) AS payment_end_at, confidence, round_number, round_type, membership_required, status FROM rounds""",
)
def _(s):
    return s.rounds.select(
        "event_id", "line", "platform", "application_start_at", "application_end_at", "payment_end_at",
        "confidence", "round_number", "round_type", "membership_required", "status",
    )


@query(
    "round_fields",
    q.with_(q.ROUNDS)
    + """SELECT event_id, line, CAST(coalesce(application_start_at, lottery_start) AS VARCHAR) AS lottery_start, CAST(coalesce(application_end_at, lottery_end) AS VARCHAR) AS lottery_end,
      CAST(results_date AS VARCHAR) AS results_date, CAST(general_sale_date AS VARCHAR) AS general_sale_date, CAST(coalesce(payment_end_at, payment_deadline) AS VARCHAR) AS payment_deadline FROM rounds""",
)
def _(s):
    from roundtide.operators.state import change_fields

    kept = ("lottery_start", "lottery_end", "results_date", "general_sale_date", "payment_deadline")
    fields = change_fields()
    return s.rounds.select("event_id", "line", *[fields[c].alias(c) for c in kept])


@query(
    "event_key",
    q.with_(q.EVENTS)
    + f"""SELECT event_id, {q.key24(f"lower({q.clean('title')})", f"lower({q.clean(chr(97) + 'rray_to_string(venues[1:2], ' + chr(39) + ' ' + chr(39) + ')')})", "array_to_string(event_dates[1:2], ' ')", 'official_url')} AS event_key FROM events_t""",
)
def _(s):
    from roundtide.operators.state import event_identity

    return s.events.select("event_id", event_identity().alias("event_key"))


@query(
    "tour_stops",
    q.with_(q.EVENTS)
    + f"""SELECT event_id, i AS stop, {q.city('v')} AS city, v AS venue, coalesce(event_dates[i], '') AS date FROM (
      SELECT event_id, event_dates, unnest(venues) AS v, unnest(range(1, len(venues) + 1)) AS i FROM events_t)""",
)
def _(s):
    stops = rounds.tour_stops(F.col("venues"), F.col("event_dates"))
    return s.events.select("event_id", F.posexplode(stops).alias("pos", "x")).select(
        "event_id", (F.col("pos") + 1).cast("bigint").alias("stop"), "x.*"
    )


# --- relevance ------------------------------------------------------------------

def keyword_of_item():
    return F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.regexp_replace("text", r"\s", ""), F.lit("公")))


def candidates(s: Star) -> DataFrame:
    """Each document is a candidate of one keyword: a benchmark text, as words or as one non-Latin word."""
    bench = s.table("benchmark")
    n = bench.agg(F.count("*")).scalar()
    kw = keyword_of_item()
    keyed = s.spread("documents").withColumn("item_id", F.col("doc_id") % n)
    return keyed.join(bench.select("item_id", kw.alias("keyword")), "item_id").select(
        "doc_id",
        "item_id",
        "keyword",
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.concat(
            F.when(F.col("doc_id") % 7 == 0, "https://www.tohostage.com/live/")
            .when(F.col("doc_id") % 7 == 1, "https://x.com/")
            .when(F.col("doc_id") % 7 == 2, "https://eplus.jp/")
            .when(F.col("doc_id") % 7 == 3, "https://a.example.co.jp/news/")
            .otherwise("https://b.example.com/"),
            F.col("doc_id").cast("string"),
        ).alias("url"),
        "text",
    )


CANDIDATES = """cand AS (SELECT doc_id, d.doc_id % n_items AS item_id, CASE WHEN item_id % 2 = 0 THEN b.text ELSE regexp_replace(b.text, '\\s', '', 'g') || '公' END AS keyword,
  concat_ws(' ', source, lang) AS title, CASE doc_id % 7 WHEN 0 THEN 'https://www.tohostage.com/live/' WHEN 1 THEN 'https://x.com/' WHEN 2 THEN 'https://eplus.jp/'
    WHEN 3 THEN 'https://a.example.co.jp/news/' ELSE 'https://b.example.com/' END || doc_id AS url, d.text AS text
  FROM documents d, (SELECT count(*) AS n_items FROM benchmark) JOIN benchmark b ON b.item_id = d.doc_id % n_items)"""


def sql_grams(c: str) -> str:
    squeezed = f"regexp_replace(lower({c}), '[\\s\\x{{0085}}\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}〜～・！？、。「」『』【】（）()\"''’”|/\\\\-]+', '', 'g')"
    return f"list_distinct(list_concat(regexp_extract_all({squeezed}, '(?s)..'), regexp_extract_all(substr({squeezed}, 2), '(?s)..')))"


def sql_overlap(kw: str, t: str) -> str:
    return f"(CASE WHEN len({sql_grams(kw)}) = 0 THEN 0.0 ELSE len(list_intersect({sql_grams(kw)}, {sql_grams(t)})) * 1.0 / len({sql_grams(kw)}) END)"


def sql_matches(kw: str, t: str) -> str:
    k, h = f"lower({q.clean(kw)})", f"lower({q.clean(t)})"
    return (
        f"CASE WHEN {k} = '' THEN false WHEN contains({h}, {k}) THEN true"
        f" WHEN len(list_filter(string_split({k}, ' '), lambda x: length(x) >= 3 AND contains({h}, x))) > 0 THEN true"
        f" WHEN regexp_full_match({k}, '[a-z0-9 ._''-]+') THEN false ELSE {sql_overlap(kw, t)} >= 0.45 END"
    )


@query("bigrams", f"SELECT doc_id, CAST(len({sql_grams('text')}) AS BIGINT) AS n, list_min({sql_grams('text')}) AS lo, list_max({sql_grams('text')}) AS hi FROM documents")
def _(s):
    got = s.spread("documents").select("doc_id", grams.bigrams(F.col("text")).alias("g"))
    return got.select("doc_id", F.size("g").cast("bigint").alias("n"), F.array_min("g").alias("lo"), F.array_max("g").alias("hi"))


@query("keyword_overlap", f"WITH {CANDIDATES} SELECT doc_id, round({sql_overlap('keyword', 'text')}, 9) AS overlap FROM cand")
def _(s):
    return candidates(s).select("doc_id", F.round(grams.keyword_overlap(F.col("keyword"), F.col("text")), 9).alias("overlap"))


@query(
    "keyword_postings",
    f"""WITH k AS (SELECT item_id, {sql_grams("CASE WHEN item_id % 2 = 0 THEN text ELSE regexp_replace(text, '\\s', '', 'g') || '公' END")} AS wanted FROM benchmark),
      t AS (SELECT doc_id, {sql_grams('text')} AS held FROM documents), p AS (SELECT item_id, doc_id, len(list_intersect(wanted, held)) * 1.0 / len(wanted) AS overlap FROM k, t WHERE len(wanted) > 0)
      SELECT item_id, doc_id, round(overlap, 9) AS overlap FROM p WHERE overlap >= 0.45""",
)
def _(s):
    """All keywords against all whole texts."""
    from roundtide.operators.postings import texts_of_keywords

    keywords = s.table("benchmark").select(F.col("item_id").alias("keyword_id"), keyword_of_item().alias("keyword"))
    texts = s.spread("documents").select(F.col("doc_id").alias("text_id"), "text")
    return texts_of_keywords(keywords, texts).select(F.col("keyword_id").alias("item_id"), F.col("text_id").alias("doc_id"), F.round("overlap", 9).alias("overlap"))


@query("keyword_match", f"WITH {CANDIDATES} SELECT doc_id, {sql_matches('keyword', 'text')} AS matched FROM cand")
def _(s):
    return candidates(s).select("doc_id", grams.keyword_matches(F.col("keyword"), F.col("text")).alias("matched"))


@query("page_match", "WITH " + CANDIDATES + ", c2 AS (SELECT doc_id, keyword, title || ' ' || text AS intro FROM cand) SELECT doc_id, " + sql_matches("keyword", "intro") + " AS matched FROM c2")
def _(s):
    c = candidates(s)
    return c.select("doc_id", grams.page_matches(F.col("keyword"), F.col("title"), F.col("text")).alias("matched"))


def sql_score() -> str:
    t = "lower(title || ' ' || text || ' ' || url)"
    ts = "(title || ' ' || text)"
    h = q.host("url")
    tok = f"2.0 * len(list_filter(string_split(lower({q.clean('keyword')}), ' '), lambda x: length(x) >= 3 AND contains(low, x)))"
    return f"""scored AS (
  SELECT doc_id, item_id, keyword, url, CASE WHEN NOT trusted AND NOT (matched OR tok > 0) THEN CASE WHEN noisy THEN -20.0 ELSE 0.0 END
    ELSE CASE WHEN noisy THEN -20 ELSE 0 END + CASE WHEN tick THEN -5 ELSE 0 END + CASE WHEN hint THEN 10 ELSE 0 END + 30 * ov + tok
      + CASE WHEN trusted THEN 6 ELSE 0 END + CASE WHEN jp THEN 4 ELSE 0 END + CASE WHEN stage THEN 3 ELSE 0 END END AS score
  FROM (SELECT *, {tok} AS tok FROM (SELECT doc_id, item_id, keyword, url, {t} AS low, {q.any_in(h, dims.OFFICIAL_HOSTS)} AS trusted, {q.noisy('url')} AS noisy, {q.ticket('url')} AS tick,
    {q.any_in(t, dims.OFFICIAL_HINTS)} AS hint, {sql_overlap('keyword', ts)} AS ov, {sql_matches('keyword', ts)} AS matched,
    (ends_with({h}, '.co.jp') OR ends_with({h}, '.or.jp')) AS jp, (contains(url, 'news') OR contains(url, 'live') OR contains(url, 'stage')) AS stage FROM cand)))"""


@query("official_score", f"WITH {CANDIDATES}, {sql_score()} SELECT doc_id, round(score, 6) AS score FROM scored")
def _(s):
    score = grams.official_score(F.col("title"), F.col("url"), F.col("text"), F.col("keyword"))
    return candidates(s).select("doc_id", F.round(score, 6).alias("score"))


@query(
    "official_topk",
    f"""WITH {CANDIDATES}, {sql_score()} SELECT keyword, doc_id, rnk AS place, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM scored WHERE score > 0) WHERE rnk <= 3""",
)
def _(s):
    from roundtide.operators.ranking import choose_official

    results = candidates(s).select("keyword", F.col("doc_id").alias("rank"), "title", "url", F.col("text").alias("snippet"))
    return choose_official(results, 3).select(
        "keyword", F.col("rank").alias("doc_id"), F.col("place").cast("bigint").alias("place"), F.round("score", 6).alias("score")
    )
