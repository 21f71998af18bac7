"""SQL twins: text helpers and common table expressions for the oracle statements."""

from __future__ import annotations

from roundtide import dims
from roundtide.plans import star

AS_OF = f"DATE '{star.AS_OF}'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_in(haystack: str, needles) -> str:
    return "(" + " OR ".join(f"contains({haystack}, {lit(n)})" for n in needles) + ")"


def case_of(key: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {k if isinstance(k, int) else lit(k)} THEN {v if isinstance(v, int) else lit(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '#(.*)$', 1)"


def noisy(u: str) -> str:
    return any_in(host(f"coalesce({u}, '')"), dims.NOISY_HOSTS)


def ticket(u: str) -> str:
    return any_in(host(u), [h for f in dims.TICKET_PLATFORMS.values() for h in f])


def platform(u: str) -> str:
    arms = " ".join(f"WHEN {any_in(host(u), f)} THEN {lit(p)}" for p, f in dims.TICKET_PLATFORMS.items())
    return f"CASE {arms} WHEN {host(u)} = '' THEN 'unknown' ELSE {host(u)} END"


def portal(u: str) -> str:
    h, p = host(u), f"lower({path(u)})"
    return (
        f"(({h} = 't.pia.jp' AND ends_with({p}, '/search_all.do')) OR ({h} = 'eplus.jp' AND starts_with({p}, '/sf/search'))"
        f" OR ({h} = 'l-tike.com' AND starts_with({p}, '/search/')))"
    )


def generic(u: str) -> str:
    p = f"rtrim({path(u)}, '/')"
    listed = ", ".join(lit(x) for x in dims.GENERIC_INFO_PATHS)
    return f"({host(u)} = 'shiki.jp' AND ({p} IN ({listed}) OR starts_with({p}, '/tickets_guide/')))"


def actionable(u: str, label: str) -> str:
    hay = f"lower(coalesce({label}, '') || ' ' || {u})"
    official = ", ".join(lit(x) for x in dims.OFFICIAL_HOSTS)
    return (
        f"(NOT {noisy(u)} AND NOT {generic(u)} AND NOT contains({hay}, 'hoken') AND NOT contains({hay}, 'insurance')"
        f" AND NOT ({host(u)} IN ({official}) AND (lower({fragment(u)}) IN ('schedule','ticket','tickets') OR contains(lower({path(u)}), '/stage/')))"
        f" AND {ticket(u)})"
    )


def provenance(u: str, label: str) -> str:
    hay = f"lower(coalesce({label}, '') || ' ' || {u})"
    names = ", ".join(lit(p) for p in dims.TICKET_PLATFORMS)
    return (
        f"CASE WHEN ({platform(u)}) IN ({names}) THEN 'ticket_primary' WHEN {any_in(hay, dims.OFFICIAL_HINTS)} THEN 'official'"
        f" WHEN ({platform(u)}) = 'unknown' THEN 'low_confidence' ELSE 'manual_public' END"
    )


def confidence(p: str) -> str:
    names = ", ".join(lit(x) for x in dims.TICKET_PLATFORMS)
    return f"CASE WHEN {p} IN ({names}) THEN 90 WHEN {p} IN ('official','manual') THEN 70 ELSE 50 END"


def link_confidence(u: str, label: str) -> str:
    hay = f"lower({label} || ' ' || {u})"
    return f"CASE WHEN {actionable(u, label)} THEN 90 WHEN {any_in(hay, dims.TICKET_LINK_HINTS)} THEN 60 ELSE 40 END"


def clean(c: str) -> str:
    ws = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b\\x1c-\\x1f]+"
    return f"trim(regexp_replace({c}, '{ws}', ' ', 'g'))"


def key24(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce({p}, '')" for p in parts)
    return f"substr(sha256({joined}), 1, 24)"


def status(as_of: str = AS_OF, start="application_start_at", end="application_end_at", pay="payment_end_at") -> str:
    return (
        f"CASE WHEN results_date = {as_of} THEN 'results_today'"
        f" WHEN {pay} - {as_of} BETWEEN 0 AND 1 THEN 'payment_due'"
        f" WHEN general_sale_date - {as_of} BETWEEN 0 AND 2 THEN 'general_sale_soon'"
        f" WHEN general_sale_date < {as_of} THEN 'closed'"
        f" WHEN {as_of} BETWEEN {start} AND {end} THEN CASE WHEN {end} - {as_of} <= 2 THEN 'closing_soon' ELSE 'open' END"
        f" WHEN {as_of} < {start} THEN 'upcoming' WHEN {as_of} > {end} THEN 'closed' ELSE 'unknown' END"
    )


LATEST = "greatest(application_start_at, application_end_at, results_date, general_sale_date, payment_end_at)"
LATEST_DAY = f"coalesce({LATEST} - DATE '0001-01-01' + 1, 0)"
STATUS_LABEL = case_of("status", dims.STATUS_LABELS, "''")
STATUS_RANK = case_of("status", dims.STATUS_RANK, "99")
RELEVANT = (
    "CASE WHEN status IN ('closing_soon','open','upcoming') THEN coalesce(application_end_at, application_start_at)"
    " WHEN status = 'results_today' THEN results_date WHEN status = 'payment_due' THEN payment_end_at"
    " WHEN status = 'general_sale_soon' THEN general_sale_date"
    " ELSE coalesce(application_start_at, application_end_at, results_date, payment_end_at, general_sale_date) END"
)
ROUND_TYPE = (
    "CASE WHEN contains(lower(name),'fc') OR contains(name,'ファンクラブ') THEN 'fc' WHEN contains(name,'一般発売') THEN 'general'"
    " WHEN contains(name,'トレード') OR contains(name,'リセール') THEN 'trade' WHEN contains(name,'公式') OR contains(name,'オフィシャル') THEN 'official'"
    " WHEN " + any_in("lower(name)", ("pia", "ぴあ", "e+", "ローソン", "lawson")) + " THEN 'platform'"
    " WHEN " + any_in("name", ("抽選", "先行", "プレオーダー")) + " THEN 'platform' ELSE 'unknown' END"
)
MEMBERSHIP = (
    "CASE WHEN " + any_in("lower(name || ' ' || evidence)", ("fc", "ファンクラブ", "会員")) + " THEN 'yes'"
    " WHEN contains(name,'一般発売') THEN 'no' ELSE 'unknown' END"
)


def city(text: str) -> str:
    arms = " ".join(f"WHEN contains({text}, {lit(c)}) THEN {lit(c)}" for c in dims.TOUR_CITIES)
    arms += " " + " ".join(f"WHEN contains({text}, {lit(h)}) THEN {lit(c)}" for h, c in dims.VENUE_CITIES)
    return f"CASE {arms} ELSE '' END"


_SHIFT = star.SHIFT_DAYS
_PREFS = lit(star.DEFAULT_PREFERENCES)
WATCHES = f"""watches AS (
  SELECT c_custkey AS watch_id, c_name AS keyword, CASE WHEN c_custkey % 3 = 0 THEN 'artist' ELSE 'event' END AS kind,
    lower(c_mktsegment) AS tags,
    CASE WHEN c_custkey % 8 = 0 THEN lower(n_name) || ' , Tokyo' WHEN c_custkey % 4 = 0 THEN lower(n_name) ELSE '' END AS preferred_regions,
    CASE WHEN c_custkey % 6 = 0 THEN 'Hall ' || (c_custkey % 50) ELSE '' END AS preferred_venues,
    CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'Lottery_Opened, results_today ,' ELSE {_PREFS} END AS alert_preferences,
    c_custkey % 10 = 0 AS muted
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
EVENTS = f"""events_t AS (
  SELECT o_orderkey AS event_id, o_custkey AS watch_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Live Tour ' || o_orderkey ELSE 'Order ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 20 = 0 THEN 'keyword:watch-' || o_custkey || '-' || o_orderkey
         WHEN o_orderkey % 20 = 7 THEN 'https://t.pia.jp/pia/search_all.do?kw=' || o_orderkey
         ELSE 'https://stage' || (o_orderkey % 97) || '.example.com/e/' || o_orderkey END AS official_url,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority || ' at nation_' || (o_orderkey % 25) END AS summary,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST([] AS VARCHAR[]) WHEN o_orderkey % 4 = 1 THEN [CAST(CAST(o_orderdate AS DATE) + {_SHIFT + 30} AS VARCHAR)]
         ELSE [CAST(CAST(o_orderdate AS DATE) + {_SHIFT + 30} AS VARCHAR), CAST(CAST(o_orderdate AS DATE) + {_SHIFT + 60} AS VARCHAR)] END AS event_dates,
    CASE o_orderkey % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['御園座 ' || (o_orderkey % 13)]
         WHEN 2 THEN ['梅田 hall ' || (o_orderkey % 50), 'hall ' || (o_orderkey % 50)]
         WHEN 3 THEN ['チケット受付 hall ' || (o_orderkey % 50), 'hall ' || (o_orderkey % 50)]
         ELSE ['hall ' || (o_orderkey % 50), '博多座', 'EXシアター有明', 'annex hall ' || (o_orderkey % 50)] END AS venues,
    CAST(CAST(o_orderdate AS DATE) + {_SHIFT} AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS updated_at
  FROM orders)"""
RAW_ROUNDS = f"""picked AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS q, CAST(l_shipdate AS DATE) AS day,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), CAST(l_shipdate AS DATE)) AS copy FROM lineitem),
raw_rounds AS (
  SELECT l_orderkey AS event_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
    'https://' || CASE WHEN l_suppkey % 29 = 0 THEN 'x.com' ELSE {case_of('l_suppkey % 8', star.ROUND_HOSTS, "''")} END || '/e/' || concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, q, day, copy) AS url,
    {case_of('l_linenumber', star.ROUND_NAMES, "'Stage  pass'")} AS name,
    CASE WHEN l_partkey % 7 <> 0 THEN ship END AS lottery_start,
    CASE WHEN l_partkey % 11 <> 0 THEN ship + q END AS lottery_end,
    CASE WHEN l_partkey % 5 <> 0 THEN ship + q + 3 END AS results_date,
    CASE WHEN l_partkey % 2 <> 0 THEN ship + q + 10 END AS general_sale_date,
    CASE WHEN l_partkey % 3 <> 0 THEN ship + q + 6 END AS payment_deadline,
    {case_of('l_partkey % 6', star.EVIDENCES, "''")} AS evidence,
    CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 50 END AS confidence
  FROM (SELECT *, day + {_SHIFT} AS ship FROM picked))"""


def rounds_from(raw: str, name: str = "rounds", as_of: str = AS_OF) -> str:
    """Normalised rounds over a raw relation."""
    return f"""{name}_p AS (SELECT *, {platform('url')} AS platform FROM {raw}),
{name}_n AS (
  SELECT * EXCLUDE (confidence), platform AS source,
    CASE WHEN name <> '一般発売' THEN lottery_start END AS application_start_at,
    CASE WHEN name <> '一般発売' THEN lottery_end END AS application_end_at,
    payment_deadline AS payment_end_at,
    CASE WHEN confidence = 0 THEN {confidence('platform')} ELSE confidence END AS confidence,
    CASE WHEN name = '第1次抽選先行' THEN 1 END AS round_number,
    {ROUND_TYPE} AS round_type, {MEMBERSHIP} AS membership_required
  FROM {name}_p),
{name} AS (
  SELECT *, {status(as_of, "coalesce(application_start_at, lottery_start)", "coalesce(application_end_at, lottery_end)")} AS status,
    {key24('platform', 'url', f"lower({clean('name')})", 'CAST(application_start_at AS VARCHAR)', 'CAST(general_sale_date AS VARCHAR)')} AS round_key
  FROM {name}_n)"""


ROUNDS = RAW_ROUNDS + ",\n" + rounds_from("raw_rounds")
LINKS = f"""event_links AS (
  SELECT event_id, url, min(label) AS label FROM (
    SELECT l_orderkey AS event_id, 'Ticket ' || l_suppkey AS label,
      CASE l_suppkey % 4 WHEN 1 THEN 'https://eplus.jp/hoken/' || l_orderkey || '/' || l_suppkey
        WHEN 2 THEN 'https://www.shiki.jp/tickets/' WHEN 3 THEN 'https://stage.co.jp/stage/' || l_orderkey || '/' || l_suppkey
        ELSE 'https://' || {case_of('(l_suppkey // 4) % 8', star.ROUND_HOSTS, "''")} || '/t/' || l_orderkey || '/' || l_suppkey END AS url
    FROM lineitem) GROUP BY 1, 2)"""
SOURCES = f"""raw_sources AS (
  SELECT page_id AS source_id, page_id AS watch_id, url, CASE WHEN page_id % 5 <> 0 THEN 'Source ' || page_id END AS label,
    CASE WHEN page_id % 4 = 0 THEN '' ELSE 'manual' END AS platform, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 60 END AS confidence,
    page_id % 6 = 0 AS private_note, page_id % 9 = 0 AS muted FROM pages),
watch_sources AS (
  SELECT source_id, watch_id, url, coalesce(nullif(label, ''), url) AS label,
    coalesce(nullif(platform, ''), {platform('url')}) AS platform,
    CASE WHEN confidence = 0 THEN 70 ELSE confidence END AS confidence, private_note, muted FROM raw_sources)"""
USERS = "user_watches AS (SELECT DISTINCT user_id, event_id * 15 // 100 AS watch_id FROM events)"
SUBSCRIPTIONS = """chosen AS (SELECT watch_id, min(round_key) AS chosen_key FROM rounds JOIN events_t USING (event_id) GROUP BY 1),
subscriptions AS (
  SELECT w.watch_id AS subscription_id, w.watch_id,
    CASE w.watch_id % 4 WHEN 0 THEN 'artist_all' WHEN 1 THEN 'event_all' WHEN 2 THEN 'event_location' ELSE 'round' END AS scope,
    CASE w.watch_id % 8 WHEN 2 THEN '大阪' WHEN 6 THEN '東京' ELSE '' END AS location,
    CASE WHEN w.watch_id % 4 = 3 THEN coalesce(chosen_key, '') ELSE '' END AS round_key,
    CASE WHEN w.watch_id % 2 = 0 THEN 'feed' ELSE 'feed,push' END AS channels,
    CASE w.watch_id % 3 WHEN 0 THEN '7, 1,0,x,1' WHEN 1 THEN '3' ELSE '' END AS lead_days,
    w.watch_id % 11 <> 0 AS enabled
  FROM watches w LEFT JOIN chosen c USING (watch_id))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
