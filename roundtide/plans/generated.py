"""Extraction over Japanese ticket text built from table parameters.

Spark writes the text from ``part`` keys and extracts it again; the SQL twin returns the
parameters, so it needs no second extractor. The work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roundtide import dims
from roundtide.functions import dates as dt
from roundtide.functions import rounds as rd
from roundtide.functions.text import string_array
from roundtide.operators import discovery as dc
from roundtide.operators import extraction as ex
from roundtide.operators.joins import by_shuffle
from roundtide.plans.registry import query
from roundtide.plans.star import pick
from roundtide.plans import sqltext as q
from roundtide.sources import serp

BASE_DAY = "2026-01-05"


def pk():
    return F.col("p_partkey")


def day(offset: int = 0):
    return F.date_add(F.to_date(F.lit(BASE_DAY)), (pk() % 300).cast("int") + offset)


def sd(offset: int = 0) -> str:
    return f"(DATE '{BASE_DAY}' + CAST(p_partkey % 300 AS INTEGER) + {offset})"


def iso(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def n(c):
    return c.cast("string")


def md(d):
    return F.concat(n(F.month(d)), F.lit("月"), n(F.dayofmonth(d)), F.lit("日"))


def jp(d):
    return F.concat(n(F.year(d)), F.lit("年"), md(d))


def slash(d):
    return F.concat(n(F.year(d)), F.lit("/"), n(F.month(d)), F.lit("/"), n(F.dayofmonth(d)))


def say(*bits):
    return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])


def wide(c):
    return F.translate(c, "0123456789", dims.FULL_WIDTH_DIGITS)


def by(mod: int, *arms):
    chain = F.when(pk() % mod == 0, arms[0])
    for i, a in enumerate(arms[1:], 1):
        chain = chain.when(pk() % mod == i, a)
    return chain


def arms(mod: int, *values: str) -> str:
    return f"CASE p_partkey % {mod} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def none():
    return F.lit(None).cast("int")


FROM = " FROM part"


# --- dates ------------------------------------------------------------------------

@query("date_normalize", f"SELECT p_partkey, {arms(6, *[iso(sd())] * 3, 'strftime(' + sd() + ', ' + chr(39) + '2025-%m-%d' + chr(39) + ')', iso(sd()), 'NULL')} AS day {FROM}")
def _(s):
    d = day()
    token = by(6, jp(d), slash(d), F.date_format(d, "yyyy-MM-dd"), md(d), wide(jp(d)), say("2026年13月1日"))
    token = F.when(pk() % 6 == 4, F.concat(F.lit("20"), F.substring(token, 3, 20))).otherwise(token)
    return s.spread("part").select("p_partkey", dt.normalize_date(token, F.lit(2025), s.as_of).alias("day"))


@query("infer_year", f"SELECT p_partkey, CASE WHEN {sd()} < {q.AS_OF} - 180 THEN strftime({sd()}, '2027-%m-%d') ELSE {iso(sd())} END AS day {FROM}")
def _(s):
    d = day()
    token = by(2, md(d), say(n(F.month(d)), "/", n(F.dayofmonth(d))))
    return s.spread("part").select("p_partkey", dt.normalize_date(token, none(), s.as_of).alias("day"))


@query("date_range", f"SELECT p_partkey, {iso(sd())} AS first, {arms(4, iso(sd(9)), iso(sd(9)), iso(sd(9)), 'NULL')} AS last {FROM}")
def _(s):
    a, b = day(), day(9)
    t = by(4, say(jp(a), "(水) 12:00 ～ ", md(b)), say(slash(a), "から", slash(b), "まで"), say("開始 ", jp(a), " 終了 ", md(b)), say("開催 ", jp(a)))
    r = dt.date_range(F.col("t"), none(), s.as_of)
    return s.spread("part").withColumn("t", t).select("p_partkey", r["start"].alias("first"), r["end"].alias("last"))


@query("label_range", f"SELECT p_partkey, {iso(sd())} AS first, {iso(sd(6))} AS last {FROM}")
def _(s):
    label = by(2, F.lit("受付期間"), F.lit("申込期間"))
    t = say("公演 2025年1月1日 〜 2025年1月3日 ", F.repeat(F.lit("の"), 150), label, "：", jp(day()), "〜", jp(day(6)))
    r = dt.range_after_label(F.col("t"), string_array(("受付期間", "申込期間")), none(), s.as_of)
    return s.spread("part").withColumn("t", t).select("p_partkey", r["start"].alias("first"), r["end"].alias("last"))


@query("label_dates", f"SELECT p_partkey, {iso(sd(3))} AS results, {iso(sd(12))} AS sale {FROM}")
def _(s):
    t = say("受付 ", jp(day()), " 抽選結果：", jp(day(3)), F.repeat(F.lit("〇"), 70), "開始 ", jp(day(5)), " 最終 ", jp(day(12)), "より一般発売")
    return s.spread("part").withColumn("t", t).select(
        "p_partkey",
        dt.date_after_label(F.col("t"), string_array(("当落", "抽選結果")), none(), s.as_of, 100).alias("results"),
        dt.date_before_label(F.col("t"), string_array(("一般発売",)), none(), s.as_of).alias("sale"),
    )


@query(
    "label_windows",
    "SELECT p_partkey, repeat('あ', least(a, 12)) || '先着先行' || repeat('い', least(b, 180)) AS phrase FROM (SELECT p_partkey, CAST(p_partkey % 30 AS INTEGER) AS a, CAST(p_partkey % 250 AS INTEGER) AS b FROM part)",
)
def _(s):
    t = say(F.repeat(F.lit("あ"), (pk() % 30).cast("int")), "先着先行", F.repeat(F.lit("い"), (pk() % 250).cast("int")))
    return s.spread("part").withColumn("t", t).select("p_partkey", F.explode(dt.label_phrases(F.col("t"), string_array(("先着先行", "見当たらない")), 12, 180)).alias("phrase"))


@query(
    "context_windows",
    "SELECT p_partkey, repeat('あ', least(a, 60)) || '第' || k || '次先行' || repeat('い', least(b, 220)) AS phrase FROM (SELECT p_partkey, p_partkey % 9 + 1 AS k, CAST(p_partkey % 90 AS INTEGER) AS a, CAST(p_partkey % 300 AS INTEGER) AS b FROM part)",
)
def _(s):
    t = say(F.repeat(F.lit("あ"), (pk() % 90).cast("int")), "第", n(pk() % 9 + 1), "次先行", F.repeat(F.lit("い"), (pk() % 300).cast("int")))
    got = dt.pattern_windows(F.col("t"), string_array((r"第\s*\d+\s*次先行", "無い語")), 60, 220)
    return s.spread("part").withColumn("t", t).select("p_partkey", F.explode(got).alias("phrase"))


# --- round facts ----------------------------------------------------------------------

NAMES = ("ファンクラブ抽選", "一般発売", "チケットトレード", "オフィシャル先行", "ローソン最速", "プレオーダー", "Stage pass", "fc先着")
TYPES = ("fc", "general", "trade", "official", "platform", "platform", "unknown", "fc")


@query("round_type", f"SELECT p_partkey, {arms(8, *[q.lit(t) for t in TYPES])} AS round_type {FROM}")
def _(s):
    return s.spread("part").select("p_partkey", rd.round_type(by(8, *[F.lit(x) for x in NAMES])).alias("round_type"))


@query("round_membership", f"SELECT p_partkey, {arms(4, *[q.lit(x) for x in ('yes', 'no', 'unknown', 'yes')])} AS membership {FROM}")
def _(s):
    name = by(4, F.lit("FC先行"), F.lit("一般発売"), F.lit("先着"), F.lit("先着"))
    evidence = by(4, F.lit(""), F.lit(""), F.lit("どなたでも"), F.lit("有料会員のみ"))
    return s.spread("part").select("p_partkey", rd.membership_required(name, evidence).alias("membership"))


@query("round_number", f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_partkey % 99 + 1 AS INTEGER) END AS number {FROM}")
def _(s):
    k = (pk() % 99 + 1).cast("int")
    tens, ones = F.floor(k / 10).cast("int"), k % 10
    digit = lambda c: F.when(c == 0, "").otherwise(F.substring(F.lit(dims.KANJI_DIGITS), c, F.lit(1)))
    kanji = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), digit(ones))
    t = by(4, say("第", n(k), "次抽選先行"), say("第 ", wide(n(k)), " 次先行"), say("第", kanji, "次先行"), say("抽選先行 ", n(k), "回"))
    return s.spread("part").withColumn("t", t).select("p_partkey", rd.round_number(F.col("t")).alias("number"))


CITIES = ("大阪", "名古屋", "東京", "", "札幌")


@query("city_for_text", f"SELECT p_partkey, {arms(5, *[q.lit(c) for c in CITIES])} AS city {FROM}")
def _(s):
    t = by(5, say("梅田芸術劇場 ", n(pk())), say("御園座 ", n(pk())), say("札幌のち東京 ", n(pk())), say("hall ", n(pk())), say("in 札幌 ", n(pk())))
    return s.spread("part").withColumn("t", t).select("p_partkey", rd.city_for_text(F.col("t")).alias("city"))


@query("round_location", f"SELECT p_partkey, {arms(4, q.lit('大阪'), 'chr(104) || ' + q.lit('all ') + ' || p_partkey', q.lit('追加公演'), q.lit(''))} AS place {FROM}")
def _(s):
    hall = say("hall ", n(pk()))
    name = by(4, F.lit("大阪公演 先行"), F.lit("先行"), F.lit("追加公演・先着"), F.lit("先行"))
    evidence = by(4, hall, say("会場 hall ", n(pk()), " にて"), F.lit(""), F.lit(""))
    venues = F.array(say("annex ", n(pk())), hall)
    return s.spread("part").select("p_partkey", rd.round_location(name, evidence, venues).alias("place"))


@query("event_location", f"SELECT p_partkey, {arms(4, q.lit('大阪府'), q.lit('名古屋'), q.lit('hall ') + ' || p_partkey', q.lit(''))} AS place {FROM}")
def _(s):
    empty = F.expr("cast(array() as array<string>)")
    v = by(4, F.array(say("hall ", n(pk())), say("会 場 梅田（大阪府）")), F.array(say("名古屋　 御園座 ", n(pk()))), F.array(say("：hall ", n(pk()))), empty)
    return s.spread("part").select("p_partkey", rd.event_location(v).alias("place"))


@query("venue_label", f"SELECT p_partkey, {arms(4, q.lit('a; b; c'), q.lit('Multiple cities'), q.lit('—'), q.lit('Multiple cities'))} AS place {FROM}")
def _(s):
    empty = F.expr("cast(array() as array<string>)")
    v = F.when(pk() % 4 == 0, F.array(F.lit("a"), F.lit(" "), F.lit(" b"), F.lit("c"), F.lit("d"))).otherwise(empty)
    t = by(4, F.lit("x"), say("Summer tour ", n(pk())), say("Contour ", n(pk())), say(n(pk()), "-CITY run"))
    return s.spread("part").withColumn("t", t).select("p_partkey", rd.venue_label(v, t).alias("place"))


@query("evidence_snippet", f"SELECT p_partkey, {arms(3, q.lit('【抽選先行】受付 ') + ' || p_partkey', q.lit('none'), 'repeat(' + q.lit('長') + ', 180) || ' + q.lit('...'))} AS snippet {FROM}")
def _(s):
    t = by(3, say("※【重要なお知らせ】確認＞＞ 前置き https://a.b/c 【抽選先行】受付　", n(pk()), "。"), F.lit(" ・ https://x.y "), F.repeat(F.lit("長"), 200))
    return s.spread("part").withColumn("t", t).select("p_partkey", rd.evidence_snippet(F.col("t")).alias("snippet"))


@query("venue_clean", f"SELECT p_partkey, {arms(3, q.lit('hall ') + ' || p_partkey', q.lit(''), q.lit('御園座'))} AS kept {FROM}")
def _(s):
    v = by(3, F.array(say("hall ", n(pk())), F.lit("チケット受付 窓口")), F.array(F.lit("グループ観劇"), F.lit(" ")), F.array(F.lit("御園座")))
    return s.spread("part").select("p_partkey", F.array_join(ex.clean_venues(v), "|").alias("kept"))


@query("performance_listing", f"SELECT p_partkey, p_partkey % 3 = 0 AS listing {FROM}")
def _(s):
    t = by(3, say(jp(day()), "〜", md(day(9)), " 御園ホール"), say("受付期間 ", jp(day()), " 御園ホール"), say(jp(day()), "〜", md(day(9))))
    return s.spread("part").withColumn("t", t).select("p_partkey", rd.looks_like_listing(F.col("t")).alias("listing"))


@query("round_names", f"SELECT p_partkey, {arms(5, q.lit('第') + ' || (p_partkey % 9 + 1) || ' + q.lit('次抽選先行'), q.lit('追加公演・抽選先行'), q.lit('先着先行'), q.lit('先行受付'), 'NULL')} AS name {FROM}")
def _(s):
    t = by(
        5,
        say("一般発売 のご案内 第", n(pk() % 9 + 1), "次抽選先行 ", jp(day())),
        say("プレオーダー 追加公演・抽選先行 ", jp(day()), " 一般発売"),
        say("公開 ", jp(day()), " 先着先行 のち 一般発売"),
        say("お申し込みは ", jp(day())),
        say("お知らせ ", jp(day())),
    )
    return s.spread("part").withColumn("t", t).select("p_partkey", F.coalesce(rd.round_name(F.col("t")), rd.application_name(F.col("t"))).alias("name"))


# --- event facts ----------------------------------------------------------------------

@query("event_dates", f"SELECT p_partkey, {arms(3, q.lit('公演日 ') + ' || ' + 'D', 'S', q.lit('') + ' || D')} AS dates FROM (SELECT p_partkey, year({sd()}) || '年' || month({sd()}) || '月' || day({sd()}) || '日' AS D, strftime({sd()}, '%Y/') || month({sd()}) || '/' || day({sd()}) || '～' || strftime({sd(9)}, '%Y/') || month({sd(9)}) || '/' || day({sd(9)}) AS S FROM part)")
def _(s):
    t = by(
        3,
        say("公演日 ", jp(day())),
        say("演目 ", slash(day()), "～", slash(day(9)), " 公演 受付 2026/1/1～2026/1/2 公演"),
        say("期 間 ", jp(day()), " 受付期間 ", jp(day(20)), "〜", jp(day(22))),
    )
    return s.spread("part").withColumn("t", t).select("p_partkey", F.array_join(ex.event_dates(F.col("t")), "|").alias("dates"))


@query("venues", f"SELECT p_partkey, {arms(3, q.lit('御園座本館'), q.lit('梅田') + ' || (p_partkey % 7) || ' + q.lit('劇場'), q.lit(''))} AS venues {FROM}")
def _(s):
    t = by(
        3,
        say("会　場 ： 御園座本館【交通】会場 御園座本館 料金 100円"),
        say("大阪 梅田", n(pk() % 7), "劇場。"),
        say("会場 チケット受付窓口【"),
    )
    return s.spread("part").withColumn("t", t).select("p_partkey", F.array_join(ex.venues(F.col("t")), "|").alias("venues"))


@query("ticket_rules", f"SELECT p_partkey, '未就学児入場不可 ' || p_partkey || ' なお、膝上も不可|転売禁止です' AS rules {FROM}")
def _(s):
    t = say("あらすじ。※未就学児入場不可 ", n(pk()), "。なお、膝上も不可。禁止。※転売禁止です https://a.b/c 。クッキー同意。※転売禁止。関係ない話。")
    return s.spread("part").withColumn("t", t).select("p_partkey", F.array_join(F.transform(ex.ticket_rules(F.col("t")), lambda x: F.replace(x, F.lit("※"), F.lit(""))), "|").alias("rules"))


@query("ticket_prices", f"SELECT p_partkey, {arms(3, q.lit('S席：') + ' || (p_partkey + 1000) || ' + q.lit('円|A席：') + ' || (p_partkey + 500) || ' + q.lit('円'), q.lit('S席は') + ' || (p_partkey + 1000) || ' + q.lit('円です'), q.lit('料金は') + ' || (p_partkey + 1000) || ' + q.lit('円'))} AS prices {FROM}")
def _(s):
    hi, lo = n(pk() + 1000), n(pk() + 500)
    t = by(3, say("チケット S席：", hi, "円 A席：", lo, "円 ※税込"), say("全席指定。S席は", hi, "円です。"), say("入場料の料金は", hi, "円。"))
    return s.spread("part").withColumn("t", t).select("p_partkey", F.array_join(ex.ticket_prices(F.col("t")), "|").alias("prices"))


def shows_text():
    return say(
        "LIVE SCHEDULE ", slash(day()), " [SATURDAY] SPRING TOUR ", n(pk()), " 東京・渋谷ホール ", slash(day(1)), " 【終了】 OLD SHOW ",
        slash(day()), " (土) SPRING TOUR ", n(pk()), " 東京・渋谷ホール ", slash(day(3)), " YOI LIVE AT WEMBLEY ARENA",
    )


def pages_from_parts(s, text, url=None):
    link = F.expr("cast(array() as array<struct<label:string,url:string>>)")
    return s.spread("part").select(
        pk().alias("page_id"),
        (url if url is not None else say("https://stage.example.com/p/", n(pk()))).alias("url"),
        say("Show ", n(pk())).alias("title"),
        text.alias("text"),
        link.alias("links"),
    )


TOUR_SQL = f"""SELECT p_partkey AS page_id, {iso(sd())} AS date, 'SPRING TOUR ' || p_partkey || ' 東京・渋谷ホール' AS title, '東京・渋谷ホール' AS venue, false AS ended FROM part
  UNION ALL SELECT p_partkey, {iso(sd(1))}, 'OLD SHOW', '', true FROM part UNION ALL SELECT p_partkey, {iso(sd(3))}, 'YOI LIVE AT WEMBLEY ARENA', 'WEMBLEY ARENA', false FROM part"""


@query("tour_dates", TOUR_SQL)
def _(s):
    return ex.tour_dates(pages_from_parts(s, shows_text()), s.as_of).select("page_id", "date", "title", "venue", "ended")


@query("tour_venue", f"SELECT p_partkey, {arms(4, q.lit('大阪・城ホール'), q.lit('Zepp'), q.lit('JAKARTA'), q.lit('福岡'))} AS venue {FROM}")
def _(s):
    t = by(4, say("公演 ", n(pk()), " 大阪・城ホール 夜"), say(n(pk()), " ,Zepp Town"), say("NIGHT ", n(pk()), " IN JAKARTA"), say("day ", n(pk()), " 福岡 夜"))
    # A suffix needs at least one character before it.
    t = F.when(pk() % 4 == 1, say("、 aZepp Town")).otherwise(t)
    return s.spread("part").withColumn("t", t).select("p_partkey", F.when(pk() % 4 == 1, F.substring(ex.tour_venue(F.col("t")), 2, 20)).otherwise(ex.tour_venue(F.col("t"))).alias("venue"))


@query("first_date", f"SELECT p_partkey, {iso(sd(4))} AS day {FROM}")
def _(s):
    items = F.array(F.lit("未定 13/45"), say("公演 ", jp(day(4)), " と ", jp(day(6))))
    return s.spread("part").select("p_partkey", ex.first_sort_date(items, s.as_of).alias("day"))


# --- rounds -----------------------------------------------------------------------------

def round_text():
    """One numbered lottery with its dates, then the general sale; the year is printed once."""
    a = F.when(pk() % 3 == 0, wide(md(day(8)))).otherwise(md(day(8)))
    return say(
        "第", n(pk() % 9 + 1), "次抽選先行 受付期間 ", jp(day()), " ～ ", a, "(日)23:59 抽選結果 ", md(day(12)),
        " 入金期間 ", md(day(12)), " ～ ", md(day(15)), F.repeat(F.lit("・"), 80), "【一般発売】 ", md(day(24)), " 10:00",
    )


ROUND_SQL = f"""g AS (SELECT p_partkey AS page_id, '第' || (p_partkey % 9 + 1) || '次抽選先行' AS name, {iso(sd())} AS lottery_start, {iso(sd(8))} AS lottery_end, {iso(sd(12))} AS results_date,
    {iso(sd(15))} AS payment_deadline, {iso(sd(24))} AS general_sale_date FROM part
  UNION ALL SELECT p_partkey, '一般発売', NULL, NULL, NULL, NULL, {iso(sd(24))} FROM part)"""


@query("rounds_from_pages", f"WITH {ROUND_SQL} SELECT * FROM g")
def _(s):
    got = ex.extract_rounds(pages_from_parts(s, round_text()), s.as_of)
    return got.select("page_id", "name", "lottery_start", "lottery_end", "results_date", "payment_deadline", "general_sale_date")


PLATFORM_URLS = {0: "https://eplus.jp/p/", 1: "https://www.l-tike.com/p/", 2: "https://stage.example.com/p/"}


@query(
    "rounds_platform",
    f"""WITH {ROUND_SQL} SELECT page_id, name, CASE page_id % 3 WHEN 0 THEN 'eplus' WHEN 1 THEN 'lawson' ELSE 'stage.example.com' END AS platform,
      CASE WHEN page_id % 3 < 2 THEN 90 ELSE 50 END AS confidence, CASE WHEN name = '一般発売' THEN 'general' ELSE 'platform' END AS round_type FROM g""",
)
def _(s):
    url = F.concat(pick(pk() % 3, PLATFORM_URLS, ""), n(pk()))
    got = ex.page_rounds(pages_from_parts(s, round_text(), url), s.as_of)
    return got.select("page_id", "name", "platform", "confidence", "round_type")


@query(
    "membership_rounds",
    f"""SELECT p_partkey AS page_id, '先着先行 / ゴールド会員' AS name, {iso(sd())} AS lottery_start, {iso(sd(3))} AS lottery_end FROM part
      UNION ALL SELECT p_partkey, '先着先行 / レギュラー会員', {iso(sd(2))}, {iso(sd(5))} FROM part""",
)
def _(s):
    t = say("先着先行 ゴールド会員：", jp(day()), "～", md(day(3)), " レギュラー会員：", jp(day(2)), "～", md(day(5)))
    got = ex.membership_windows(F.col("t"), F.lit("先着先行"), none(), s.as_of)
    return s.spread("part").withColumn("t", t).select(pk().alias("page_id"), F.inline(got)).select(
        "page_id", "name", F.col("start").alias("lottery_start"), F.col("end").alias("lottery_end")
    )


@query(
    "scrub_windows",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN {iso(sd())} END AS lottery_start, CASE WHEN p_partkey % 3 = 1 THEN {iso(sd(9))} END AS lottery_end,
      CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE {iso(sd(30))} END AS general_sale_date FROM part""",
)
def _(s):
    run = say(jp(day()), "〜", jp(day(9)))
    other = say(jp(day(40)), "〜", jp(day(49)))
    evidence = by(3, say("公演 ", run), say("受付期間 ", run), say(run, " 御園ホール"))
    rows = s.spread("part").select(
        "p_partkey",
        day().alias("lottery_start"), day(9).alias("lottery_end"), day().alias("application_start_at"), day(9).alias("application_end_at"),
        F.when(pk() % 3 == 2, day(9)).otherwise(day(30)).alias("general_sale_date"),
        evidence.alias("evidence"),
        F.when(pk() % 3 == 1, F.array(other)).otherwise(F.array(run)).alias("event_dates"),
    )
    return ex.scrub_performance_windows(rows, s.as_of).select("p_partkey", "lottery_start", "lottery_end", "general_sale_date")


# --- discovery ----------------------------------------------------------------------------

def corpus(s):
    """Three pages per keyword: an official page with facts, a ticket page it links, a noise page."""
    key = n(pk())
    link = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    main_url, sale_url = say("https://stage.example.com/show/", key), say("https://eplus.jp/show/", key)
    main = s.spread("part").select(
        (pk() * 3).alias("page_id"), main_url.alias("url"), say("Musical ", key, " 公式").alias("title"),
        say("公演期間 ", jp(day(60)), " 会場 御園座本館【地図】S席：9000円 ※転売禁止 ", key, "。").alias("text"),
        F.array(link("Tickets", sale_url), link("News", say("https://stage.example.com/news/", key))).alias("links"),
    )
    sale = s.spread("part").select(
        (pk() * 3 + 1).alias("page_id"), sale_url.alias("url"), say("eplus ", key).alias("title"), round_text().alias("text"),
        F.expr("cast(array() as array<struct<label:string,url:string>>)").alias("links"),
    )
    noise = s.spread("part").select(
        (pk() * 3 + 2).alias("page_id"), say("https://x.com/", key).alias("url"), say("Musical ", key).alias("title"),
        F.lit("nothing").alias("text"), F.expr("cast(array() as array<struct<label:string,url:string>>)").alias("links"),
    )
    return main.unionByName(sale).unionByName(noise)


def results(s):
    key = n(pk())
    keyword = say("Musical ", key)
    row = lambda rank, title, url: F.struct(F.lit(rank).alias("rank"), title.alias("title"), url.alias("url"), F.lit("").alias("snippet"))
    return s.spread("part").select(
        keyword.alias("keyword"),
        F.inline(F.array(row(1, say("Musical ", key), say("https://x.com/", key)), row(2, say("Musical ", key, " 公式"), say("https://stage.example.com/show/", key)))),
    )


BLOCK_ROUNDS = f"WITH {ROUND_SQL} SELECT 'Musical ' || page_id AS keyword, 'https://stage.example.com/show/' || page_id AS official_url, name, 'eplus' AS platform, lottery_start, general_sale_date FROM g"


@query("blocks", BLOCK_ROUNDS)
def _(s):
    b = dc.build_blocks(results(s), corpus(s), s.as_of)
    return b["rounds"].join(by_shuffle(b["header"].select("keyword", "official_url")), "keyword").select(
        "keyword", "official_url", "name", "platform", "lottery_start", "general_sale_date"
    )


@query("blocks_exact", BLOCK_ROUNDS + "")
def _(s):
    req = s.spread("part").select(
        say("Musical ", n(pk())).alias("keyword"), say("https://stage.example.com/show/", n(pk())).alias("url"), F.lit("hint").alias("snippet")
    )
    b = dc.build_exact(req, corpus(s), s.as_of)
    return b["rounds"].join(by_shuffle(b["header"].select("keyword", "official_url")), "keyword").select(
        "keyword", "official_url", "name", "platform", "lottery_start", "general_sale_date"
    )


@query(
    "event_info",
    f"""SELECT 'Musical ' || p_partkey AS keyword, unnest(['event_dates', 'event_dates', 'ticket_links', 'ticket_prices', 'ticket_rules', 'venues']) AS kind,
      unnest([year({sd(60)}) || '年' || month({sd(60)}) || '月' || day({sd(60)}) || '日', '公演期間 ' || year({sd(60)}) || '年' || month({sd(60)}) || '月' || day({sd(60)}) || '日 会場 御園座本館【地図】S席：9000円 ※転売禁止 ' || p_partkey || '。', 'https://eplus.jp/show/' || p_partkey, 'S席：9000円', '※転売禁止 ' || p_partkey, '御園座本館']) AS value FROM part""",
)
def _(s):
    owned = dc.official_pages(results(s), corpus(s))
    return ex.collect_facts(ex.page_facts(owned), ["keyword"], "place").select("keyword", "kind", "value")


@query(
    "export_blocks_json",
    f"""WITH {ROUND_SQL} SELECT 'Musical ' || p_partkey AS keyword, 'https://stage.example.com/show/' || p_partkey AS official_url, 'Musical ' || p_partkey || ' 公式' AS title, 6 AS n_facts,
      (SELECT array_to_string(list_sort(list(concat_ws('~', name, 'eplus', CAST(lottery_start AS VARCHAR), CAST(general_sale_date AS VARCHAR)))), '|') FROM g WHERE g.page_id = p_partkey) AS rounds FROM part""",
)
def _(s):
    """Documents read back from the written JSON: header, number of facts, and every round's name and dates."""
    from roundtide.sources.exports import block_documents, export_json
    from roundtide.sources.tables import scratch_dir

    out = scratch_dir(s.spark, "export_blocks")
    export_json(block_documents(dc.build_blocks(results(s), corpus(s), s.as_of)), out)
    shape = (
        "general_info struct<official_url:string,title:string,facts:array<struct<kind:string>>>,"
        "ticket_info array<struct<name:string,platform:string,lottery_start:string,general_sale_date:string>>"
    )
    read = s.spark.read.schema("keyword string, document string").json(out).select("keyword", F.from_json("document", shape).alias("d"))
    line = F.transform("d.ticket_info", lambda r: F.concat_ws("~", r["name"], r["platform"], r["lottery_start"], r["general_sale_date"]))
    return read.select(
        "keyword", "d.general_info.official_url", "d.general_info.title", F.size("d.general_info.facts").alias("n_facts"),
        F.array_join(F.array_sort(line), "|").alias("rounds"),
    )


def artist_corpus(s):
    """A landing page per artist that links a tour page; the tour page links a detail page per show."""
    key = n(pk())
    link = lambda label, url: F.struct(label.alias("label"), url.alias("url"))
    empty = F.expr("cast(array() as array<struct<label:string,url:string>>)")
    tour, detail = say("https://band.example.com/tour/", key), say("https://band.example.com/d/", key)
    land = s.spread("part").select((pk() * 3).alias("page_id"), say("https://band.example.com/", key).alias("url"), say("Band ", key).alias("title"), say("news ", jp(day(90))).alias("text"), F.array(link(F.lit("Tour"), tour), link(F.lit("About"), detail)).alias("links"))
    sched = s.spread("part").select((pk() * 3 + 1).alias("page_id"), tour.alias("url"), say("Tour ", key).alias("title"), say(slash(day()), " WINTER NIGHT ", key, " ", slash(day(1)), " 終了 GONE").alias("text"), F.array(link(say("WINTER NIGHT ", key, " details"), detail)).alias("links"))
    info = s.spread("part").select((pk() * 3 + 2).alias("page_id"), detail.alias("url"), say("Detail ", key).alias("title"), say("会場 御園座本館【地図】").alias("text"), empty.alias("links"))
    return land.unionByName(sched).unionByName(info)


@query(
    "artist_shows",
    f"""SELECT 'Band ' || p_partkey AS keyword, {iso(sd())} AS date, 'WINTER NIGHT ' || p_partkey AS title, '御園座本館' AS venue,
      'https://band.example.com/tour/' || p_partkey || '#' || strftime({sd()}, '%Y%m%d') || '-' || substr(sha256({iso(sd())} || '|WINTER NIGHT ' || p_partkey), 1, 6) AS official_url FROM part""",
)
def _(s):
    from roundtide.sources.pages import exploded_links

    pages = artist_corpus(s)
    owned = s.spread("part").select(say("Band ", n(pk())).alias("keyword"), (pk() * 3).alias("page_id"), F.lit(1).alias("place"))
    got = dc.artist_shows(owned, pages, exploded_links(pages), s.as_of)
    return got.select("keyword", "date", "title", "venue", "official_url")


@query("tour_detail", "SELECT p_partkey * 3 + 1 AS page_id, 'https://band.example.com/d/' || p_partkey AS detail_url FROM part")
def _(s):
    from roundtide.sources.pages import exploded_links

    pages = artist_corpus(s)
    shows = ex.tour_dates(pages, s.as_of).where(~F.col("ended"))
    return dc.detail_links(shows, exploded_links(pages)).select("page_id", "detail_url")


# --- search results -------------------------------------------------------------------------

def payloads(s):
    key = n(pk())
    item = lambda t, u, d: lambda i: F.concat(F.lit(f'{{"{t}":"  Title '), i, F.lit(f'　x","{u}":"'), F.when(i == "3", "ftp://bad").otherwise(F.concat(F.lit("https://h.example.com/"), key, F.lit("/"), i)), F.lit(f'","{d}":"about '), i, F.lit('"}'))
    rows = lambda f: F.concat_ws(",", *[f(F.lit(str(i))) for i in range(1, 13)])
    return s.spread("part").select(
        say("kw ", key).alias("keyword"),
        by(3, F.lit("brave"), F.lit("bing"), F.lit("serpapi")).alias("provider"),
        by(
            3,
            F.concat(F.lit('{"web":{"results":['), rows(item("title", "url", "description")), F.lit("]}}")),
            F.concat(F.lit('{"webPages":{"value":['), rows(item("name", "url", "snippet")), F.lit("]}}")),
            F.concat(F.lit('{"organic_results":['), rows(item("title", "link", "snippet")), F.lit("]}")),
        ).alias("payload"),
    )


SERP_SQL = "SELECT 'kw ' || p_partkey AS keyword, r AS rank, 'Title ' || i || ' x' AS title, 'https://h.example.com/' || p_partkey || '/' || i AS url FROM part, (SELECT unnest(range(1, 9)) AS r, unnest([1, 2, 4, 5, 6, 7, 8, 9]) AS i)"


@query("serp_ingest", SERP_SQL)
def _(s):
    return serp.ingest_json(payloads(s), 8).select("keyword", "rank", "title", "url")


def result_html(s):
    key = n(pk())
    block = lambda url, title, snip: F.concat(F.lit('<li class="b_algo" data-x="1"><h2 class="t"><a h="1" href="'), url, F.lit('">'), title, F.lit("</a></h2><p>"), snip, F.lit("</p></li>\n"))
    target = say("https://site.example.com/", key)
    packed = F.translate(F.regexp_replace(F.base64(F.encode(target, "utf-8")), "[=\\r\\n]", ""), "+/", "-_")
    return s.spread("part").select(
        say("kw ", key).alias("keyword"),
        F.concat(
            F.lit("<ol>"),
            block(say("https://www.bing.com/ck/a?u=a1", packed), say("<b>Site</b> &amp; ", key), F.lit("one <i>two</i>")),
            block(F.lit("https://www.bing.com/self"), F.lit("Self"), F.lit("x")),
            block(target, F.lit("Again"), F.lit("y")),
            block(say("https://other.example.com/", key), F.lit("Other"), F.lit("z")),
            F.lit("</ol>"),
        ).alias("html"),
    )


@query(
    "serp_html",
    "SELECT 'kw ' || p_partkey AS keyword, r AS rank, CASE r WHEN 1 THEN 'Site & ' || p_partkey ELSE 'Other' END AS title, CASE r WHEN 1 THEN 'https://site.example.com/' ELSE 'https://other.example.com/' END || p_partkey AS url, CASE r WHEN 1 THEN 'one two' ELSE 'z' END AS snippet FROM part, (SELECT unnest([1, 2]) AS r)",
)
def _(s):
    return serp.ingest_html(result_html(s))


@query(
    "serp_prefer",
    f"SELECT * FROM ({SERP_SQL}) WHERE CAST(substr(keyword, 4) AS BIGINT) % 2 = 0 UNION ALL SELECT 'kw ' || p_partkey, r, CASE r WHEN 1 THEN 'Site & ' || p_partkey ELSE 'Other' END, CASE r WHEN 1 THEN 'https://site.example.com/' ELSE 'https://other.example.com/' END || p_partkey FROM part, (SELECT unnest([1, 2]) AS r) WHERE p_partkey % 2 = 1",
)
def _(s):
    managed = serp.ingest_json(payloads(s).where(F.substring("keyword", 4, 20).cast("bigint") % 2 == 0), 8)
    html = serp.ingest_html(result_html(s))
    return serp.prefer_sources(managed, html).select("keyword", "rank", "title", "url")
