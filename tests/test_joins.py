"""Joins with a hot key, parts of snapshots, and tour texts without cuts."""

import datetime as dt

from pyspark.sql import functions as F

from roundtide.functions.dates import as_date
from roundtide.operators import discovery, extraction, joins, state


def test_salted_join_equals_the_join_and_deals_the_hot_key(spark):
    rows = spark.range(6000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("url"))
    rows = rows.unionByName(spark.createDataFrame([(7, None), (8, "dead"), (0, "hot")], "n long, url string"))
    facts = spark.range(900).select(F.concat(F.lit("k"), F.col("id")).alias("url"), F.col("id").alias("v"))
    facts = facts.unionByName(spark.createDataFrame([("hot", 1), ("hot", 2), ("unused", 3), (None, 4)], "url string, v long"))
    got = joins.salted_join(rows, facts, "url", shares=16)
    want = rows.join(facts, "url").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    hot = joins.hot_keys(rows, "url", 16).collect()
    assert [(r.url, r.copies) for r in hot] == [("hot", 6)]  # a third of the rows: six parts of a sixteenth
    salts = rows.where("url = 'hot'").groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(6)).alias("s")).count().collect()
    assert max(r["count"] for r in salts) < 2 * sorted(r["count"] for r in salts)[3]
    assert joins.salted_join(rows.limit(0), facts, "url").count() == 0


def test_followed_links_keep_their_rows(spark):
    links = spark.createDataFrame([(1, "https://a/x"), (1, "https://a/x"), (2, "https://a/x"), (3, "https://gone/"), (4, "https://t.pia.jp/pia/search_all.do?kw=a"), (5, None)], "page_id long, url string")
    pages = spark.createDataFrame([("https://a/x", "text"), ("https://t.pia.jp/pia/search_all.do?kw=a", "list")], "url string, text string")
    assert sorted(tuple(r) for r in discovery.follow_links(links, pages).select("page_id", "url", "text").collect()) == [(1, "https://a/x", "text"), (2, "https://a/x", "text")]


def test_snapshot_parts_stay_rows(spark):
    none = F.lit(None).cast("string")
    rounds = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r3"), (3, "r4")], "event_id long, round_key string")
    rounds = rounds.withColumns({c: none for c in state.SNAPSHOT_ROUND_FIELDS if c != "round_key"})
    links = spark.createDataFrame([(1, "u", "Tickets"), (4, "v", None)], "event_id long, url string, label string")
    marks = spark.createDataFrame([(1, "h1", "{}"), (3, "h3", "{}"), (5, "h5", "{}")], "event_id long, snapshot_hash string, payload string")
    got = state.snapshot_parts(marks, rounds, links).collect()
    assert sorted((r.event_id, r.snapshot_hash, r.part, r.name) for r in got) == [(1, "h1", "link", "u"), (1, "h1", "round", "r1"), (1, "h1", "round", "r2"), (3, "h3", "round", "r4")]
    assert {r.content for r in got if r.part == "link"} == {'{"url":"u","label":"Tickets"}'}


def test_tour_entries_are_whole_unless_widths_are_given(spark):
    title = "長い題" * 40
    df = spark.createDataFrame([(1, f"2026年6月1日 {title} 2026年7月2日 {title}")], "page_id long, text string").withColumn("url", F.lit("u"))
    as_of = as_date(dt.date(2026, 5, 1))
    assert {(r.date, r.title) for r in extraction.tour_dates(df, as_of).collect()} == {("2026-06-01", title), ("2026-07-02", title)}
    cut = {r.date: r.title for r in extraction.tour_dates(df, as_of, last_width=30, title_width=60).collect()}
    assert len(cut["2026-06-01"]) == 60 and len(cut["2026-07-02"]) <= 30
