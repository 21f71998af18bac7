"""Keys of stored tables: ids, repeated batch rows, conflicting requests, cleanup of printed memberships."""

from pyspark.sql import functions as F

from roundtide.operators import feeds
from roundtide.operators import state as st
from roundtide.sources import pages as pg

EVENTS = "event_id bigint, watch_id bigint, title string, official_url string"


def test_batch_rows_follow_the_stored_event(spark):
    stored = spark.createDataFrame([(5, 1, "old", "https://a/1"), (6, 1, "x", "https://a/2")], EVENTS)
    batch = {
        "events": spark.createDataFrame([(9, 1, "new", "https://a/1"), (8, 1, "newer", "https://a/1"), (5, 2, "other", "https://b/1"), (7, 3, "free", "https://c/1")], EVENTS),
        "links": spark.createDataFrame([(9, "l1"), (8, "l2"), (5, "l3"), (7, "l4")], "event_id bigint, url string"),
    }
    out = st.with_stored_ids(stored, batch)
    events = {r["official_url"]: r for r in out["events"].collect()}
    links = {r["url"]: r["event_id"] for r in out["links"].collect()}
    assert events["https://a/1"]["event_id"] == 5 and events["https://c/1"]["event_id"] == 7
    fresh = events["https://b/1"]["event_id"]
    assert fresh not in (5, 6, 7, 8, 9) and fresh > 0
    assert links == {"l1": 5, "l2": 5, "l3": fresh, "l4": 7}
    assert len(events) == 3


def test_a_repeated_batch_key_is_one_row(spark):
    old = spark.createDataFrame([(1, "u", "old")], "event_id bigint, url string, label string")
    new = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (2, "v", "c")], "event_id bigint, url string, label string")
    got = sorted(map(tuple, st.upsert(old, new, ["event_id", "url"]).collect()))
    assert got == [(1, "u", "b", False, True), (2, "v", "c", True, True)]


def test_new_watches_and_sources_have_ids(spark):
    columns = "watch_id bigint, keyword string, kind string, tags string, preferred_regions string, preferred_venues string, alert_preferences string, muted boolean, updated_at timestamp, created_at timestamp, last_checked_at timestamp"
    now = F.to_timestamp(F.lit("2026-06-13 00:00:00"))
    watches = spark.createDataFrame([(1, "known", "event", "", "", "", "", False, None, None, None)], columns).withColumn("last_checked_at", now)
    asked = "ord bigint, keyword string, explicit boolean, kind string, tags string, preferred_regions string, preferred_venues string, alert_preferences string"
    requests = spark.createDataFrame([(1, "fresh", False, None, None, None, None, None), (2, "known", False, None, None, None, None, None)], asked)
    got = {r["keyword"]: r for r in st.upsert_watches(watches, requests, now).collect()}
    assert got["known"]["watch_id"] == 1 and got["known"]["last_checked_at"] is not None
    assert got["fresh"]["watch_id"] > 0 and got["fresh"]["is_new"]
    again = {r["keyword"]: r["watch_id"] for r in st.upsert_watches(watches, requests, now).collect()}
    assert again["fresh"] == got["fresh"]["watch_id"]
    sources = spark.createDataFrame([], "source_id bigint, watch_id bigint, url string, label string, platform string, confidence int, private_note boolean, muted boolean")
    new = spark.createDataFrame([(1, 1, "https://a/ ", "", False)], "ord bigint, watch_id bigint, url string, label string, private_note boolean")
    assert st.upsert_sources(sources, new).first()["source_id"] > 0


def test_the_last_of_conflicting_requests_counts(spark):
    sources = spark.createDataFrame([(1, "u1", False), (2, "u2", False)], "source_id bigint, url string, muted boolean")
    requests = spark.createDataFrame([(1, "1", True), (2, "u1", False), (1, "u2", False), (2, "2", True)], "ord bigint, identifier string, muted boolean")
    assert {r["source_id"]: r["muted"] for r in st.mute_sources(sources, requests).collect()} == {1: False, 2: True}
    subs = spark.createDataFrame([(1, True), (2, True)], "subscription_id bigint, enabled boolean")
    asked = spark.createDataFrame([(1, 1, True), (1, 2, False)], "subscription_id bigint, ord bigint, enabled boolean")
    assert {r["subscription_id"]: r["enabled"] for r in st.enable_subscriptions(subs, asked).collect()} == {1: False, 2: True}


def test_cleanup_splits_memberships_once(spark, sf_dir):
    from roundtide.plans.star import Star
    from roundtide.plans.state_q import dirty_state
    from roundtide.sources.tables import written

    s = Star(spark, sf_dir)
    once, counts = st.cleanup(dirty_state(s), s.as_of)
    assert {r["item"]: r["n"] for r in counts.collect()}["ticket_round_memberships"] > 0
    kept = {k: written(v, f"cleaned_{k}") for k, v in once.items()}
    rounds = kept["rounds"]
    assert rounds.groupBy("event_id", "round_key").count().where("count > 1").count() == 0
    assert rounds.where(F.col("name").contains("/ 非会員")).count() > 0
    assert st.cleanup(kept, s.as_of)[1].where("n <> 0").count() == 0


def test_broken_markup(spark):
    html = '<p title="a>b">one &#12354;&#x3044; &#38;lt;</p><a href="/1">first<a href=\'/2\' title=">">second<script>leak()'
    row = pg.parse_pages(spark.createDataFrame([(1, "https://s.example.com/", html)], "page_id bigint, url string, html string")).first()
    assert row["text"] == "one あい &lt; first second"
    assert [(x["label"], x["url"]) for x in row["links"]] == [("first", "https://s.example.com/1"), ("second", "https://s.example.com/2")]


def test_positions_in_a_hot_event(spark):
    n = 3000
    links = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("event_id"), F.concat(F.lit("https://eplus.jp/t/"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit("Ticket "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("label"), (F.col("id") % 3 * 30 + 30).cast("int").alias("confidence"),
    )
    hot = feeds.feed_links(links).where("event_id = 1").orderBy("position").collect()
    assert [r["position"] for r in hot] == list(range(1, len(hot) + 1))
    assert [(-r["confidence"], r["label"]) for r in hot] == sorted((-r["confidence"], r["label"]) for r in hot)
