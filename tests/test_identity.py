"""Moved rounds, merged events, SQL functions."""

import datetime as dt

from pyspark.sql import functions as F

from roundtide.functions import grams, sql, urls
from roundtide.functions.dates import as_date
from roundtide.functions.rounds import status_at
from roundtide.operators import identity, state
from roundtide.operators.rounds import round_key

D = dt.date
ROUNDS = "event_id bigint, platform string, url string, name string, application_start_at date, general_sale_date date"


def rounds(spark, rows):
    none = F.lit(None).cast("date")
    return spark.createDataFrame(rows, ROUNDS).withColumns({"source": F.col("platform"), "lottery_start": none}).withColumn("round_key", round_key())


def test_moves_pair_in_date_order_and_use_each_round_once(spark):
    row = lambda start, sale=None, name="FC 先行", platform="pia", event=1: (event, platform, "https://t.pia.jp/1", name, start, sale)
    old = rounds(spark, [row(D(2026, 6, 1)), row(D(2026, 6, 9)), row(D(2026, 7, 1)), row(None, D(2026, 8, 1), "一般発売"), row(D(2026, 6, 1), platform="eplus")])
    new = rounds(spark, [row(D(2026, 6, 3)), row(D(2026, 6, 12), name="fc  先行"), row(None, D(2026, 8, 5), "一般発売"), row(D(2026, 6, 2), event=2)])
    got = {(r.old_start, r.old_sale, r.new_start, r.new_sale) for r in identity.round_moves(old, new).collect()}
    assert got == {
        (D(2026, 6, 1), None, D(2026, 6, 3), None), (D(2026, 6, 9), None, D(2026, 6, 12), None), (None, D(2026, 8, 1), None, D(2026, 8, 5)),
    }
    assert identity.round_moves(old, old).count() == 0
    assert identity.round_moves(old, old.limit(0)).count() == 0  # a platform that yields nothing keeps its rounds


def test_merge_keeps_watches_and_leaves_no_orphan(spark):
    schema = "event_id bigint, watch_id bigint, title string, official_url string, event_dates array<string>, venues array<string>, updated_at timestamp"
    t = lambda d: dt.datetime(2026, 5, d)
    events = spark.createDataFrame(
        [
            (5, 1, "Show", "https://a/1", ["2026-06-01", "2026-06-02", "x"], ["Hall"], t(2)), (3, 2, "SHOW", "https://a/1", ["2026-06-01", "2026-06-02"], ["hall"], t(1)),
            (7, 3, "Show", "https://a/2", ["2026-06-01"], [], t(3)), (8, 3, None, None, None, None, None), (9, 4, None, None, None, None, None),
        ],
        schema,
    )
    links = spark.createDataFrame([(5, "u1", "new"), (3, "u1", "old"), (5, "u2", "b"), (9, "u3", "c")], "event_id bigint, url string, label string")
    merged, watched, moved = identity.merge_events(events, {"links": (links, ["url"])})
    assert {(r.event_id, r.watch_id, r.title) for r in merged.collect()} == {(3, 1, "Show"), (7, 3, "Show"), (8, 3, None)}
    assert {tuple(r) for r in watched.collect()} == {(3, 1), (3, 2), (7, 3), (8, 3), (8, 4)}
    assert {tuple(r) for r in moved["links"].collect()} == {(3, "u1", "old"), (3, "u2", "b"), (8, "u3", "c")}
    assert state.orphans(moved["links"], merged, "event_id").count() == 0
    empty, _, _ = identity.merge_events(events.limit(0), {"links": (links, ["url"])})
    assert empty.count() == 0 and empty.columns == events.columns


def test_sql_functions_equal_the_column_forms(spark):
    sql.register(spark)
    given = ["https://WWW.eplus.jp/x", "http://t.pia.jp", "https://www.www.example.com/a?b", "//l-tike.com/s", "ftp:x", "", None, "no url", "HTTPS://x.com#a"]
    df = spark.createDataFrame([(u,) for u in given], "url string")
    got = spark.sql("SELECT url_platform(url) AS a, {df}.url FROM {df}", df=df).withColumn("b", urls.platform_name(F.col("url")))
    assert all(r.a == r.b for r in got.collect())
    days = [None, D(2026, 7, 30), D(2026, 8, 1), D(2026, 8, 2), D(2026, 8, 3), D(2026, 8, 4), D(2026, 8, 9)]
    cells = [(a, b, c, d, e) for a in days[::2] for b in days for c in days[::3] for d in days[1::2] + [None] for e in days[::3]]
    names = ["application_start_at", "application_end_at", "results_date", "general_sale_date", "payment_end_at"]
    table = spark.createDataFrame(cells, ", ".join(f"{n} date" for n in names)).withColumns({n: F.lit(None).cast("date") for n in ("lottery_start", "lottery_end", "payment_deadline")})
    by_sql = spark.sql(f"SELECT *, round_status({', '.join(names)}, DATE '2026-08-02') AS a FROM {{t}}", t=table)
    assert by_sql.withColumn("b", status_at(as_date("2026-08-02"))).where("a <> b").count() == 0
    pairs = spark.createDataFrame([("推しの子 舞台", "舞台「推しの子」公演"), ("", "a"), ("ab", ""), ("a'b\\c|d", "x a'b c")], "k string, t string")
    both = spark.sql("SELECT keyword_overlap(k, t) AS a, p.* FROM {p} p", p=pairs).withColumn("b", grams.keyword_overlap(F.col("k"), F.col("t")))
    assert all(r.a == r.b for r in both.collect())


def test_date_tokens_of_texts(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(1, "6/1 から 2026年7月 3日、2026-08-09"), (2, ""), (3, None), (4, "1.5 " * 3000)], "id int, text string")
    got = spark.sql("SELECT id, place, token FROM {docs}, LATERAL date_tokens(text)", docs=docs)
    assert [(r.place, r.token) for r in got.where("id = 1").orderBy("place").collect()] == [(1, "6/1"), (2, "2026年7月 3日"), (3, "2026-08-09")]
    assert {r.id: r["count"] for r in got.groupBy("id").count().collect()} == {1: 3, 4: 3000}
