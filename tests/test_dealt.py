"""Rows dealt once by event: later joins and groups move nothing again, and one key may not fill a task."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from roundtide.functions.dates import as_date
from roundtide.operators import joins, reminders, state
from roundtide.plans import state_q
from roundtide.plans.catalog import QUERIES
from roundtide.plans.star import Star
from roundtide.sources import tables


def shuffles(df) -> list[str]:
    """The keys of each shuffle of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]


@pytest.fixture()
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_rows_are_dealt_by_a_key_unless_one_has_too_many(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    assert shuffles(joins.together(rows, "k")) == ["k"]
    assert shuffles(joins.together(rows, "k", most=9)) == []
    assert shuffles(joins.together(rows.limit(0), "k")) == ["k"]
    hot = joins.together(rows.unionByName(spark.createDataFrame([(None, 1)], "k long, id long")), "k", most=10)
    assert hot.count() == 101


@pytest.mark.parametrize("name", ["upsert_rounds", "round_moves", "calendar_vevents"])
def test_rounds_are_shuffled_once(spark, sf_dir, no_broadcast, name):
    keys = shuffles(QUERIES[name](spark, sf_dir))
    assert "l_orderkey" in keys and not [k for k in keys if "event_id, " in k or "round_key" in k]


def test_written_tables_keep_their_dealing_and_free_shuffles(spark, sf_dir, no_broadcast):
    assert Star(spark, sf_dir).whole_orders and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "event_id long, round_key string")
    stored = tables.written(rows.repartition("event_id"), "by_event", by="event_id")
    both = stored.join(stored.withColumn("n", F.lit(1)), ["event_id", "round_key"])
    assert not shuffles(both)
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    assert sorted(r.round_key for r in stored.collect()) == ["a", "b", "c", "d"]


def test_cleanup_and_apply_leave_rounds_in_place(spark, sf_dir, no_broadcast, monkeypatch):
    s = Star(spark, sf_dir)
    cleaned = state.cleanup(state_q.dirty_state(s), s.as_of)[0]["rounds"]
    assert not [k for k in shuffles(cleaned) if "round_key" in k]
    monkeypatch.setattr(state, "WORTH", 0)
    kept, batch = state_q.batch_state(s)
    after, told = state.apply_batch(kept, batch, s.as_of, state_q.now())
    assert not [k for k in shuffles(after["rounds"]) + shuffles(told["changes"]) if "round_key" in k]
    monkeypatch.setattr(state, "WORTH", 10**9)
    kept, batch = state_q.batch_state(s)
    plain, _ = state.apply_batch(kept, batch, s.as_of, state_q.now())
    assert after["rounds"].exceptAll(plain["rounds"]).isEmpty() and plain["rounds"].exceptAll(after["rounds"]).isEmpty()


def test_snapshot_parts_make_texts_after_the_join(spark, sf_dir, no_broadcast):
    s = Star(spark, sf_dir)
    parts = state.snapshot_parts(state.snapshots(s.events_dealt, s.rounds), s.rounds, s.event_links)
    assert {k for k in shuffles(parts)} <= {"l_orderkey", "o_orderkey", "event_id"}
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in "".join(line for line in plan.split("\n") if "Exchange" in line)


def test_occasions_are_not_dealt_by_watch(spark, no_broadcast):
    events = spark.createDataFrame(
        [(1, 7, "a", "https://a/", ["2026-09-01"], ["Hall 大阪"]), (2, 7, "b", "https://b/", [], []), (3, 8, "c", "https://c/", ["2026-10-01"], [])],
        "event_id long, watch_id long, title string, official_url string, event_dates array<string>, venues array<string>",
    )
    day = dt.date(2026, 8, 10)
    fields = ["application_start_at", "application_end_at", "results_date", "payment_start_at", "payment_end_at", "general_sale_date", "trade_start_at", "trade_end_at", "payment_deadline", "lottery_start", "lottery_end"]
    rounds = spark.createDataFrame([(1, "k1"), (1, "k2"), (2, "k3"), (9, "k4")], "event_id long, round_key string").withColumns(
        {"name": F.lit("抽選"), "url": F.lit("https://t.pia.jp/x"), "evidence": F.lit(""), "platform": F.lit("pia"), **{c: F.lit(None).cast("date") for c in fields}, "results_date": F.lit(day)}
    )
    subs = spark.createDataFrame(
        [(70, 7, "", "", "artist_all", "", ""), (71, 7, "", "", "round", "", "k2"), (72, 7, "", "", "event_location", "東京", ""), (73, None, "", "", "artist_all", "", ""), (80, 8, "", "", "event_all", "", "")],
        "subscription_id long, watch_id long, channels string, lead_days string, scope string, location string, round_key string",
    )
    got = reminders.occasions(subs, events, rounds, as_date("2026-08-02"))
    assert shuffles(got).count("watch_id") == 6  # ids of events and subscriptions for rounds and for shows, shows without an id
    assert sum("subject" in x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x) <= 1
    rows = sorted((r.subscription_id, r.event_id, r.field, r.round_key or "") for r in got.collect())
    assert rows == [(70, 1, "results_date", "k1"), (70, 1, "results_date", "k2"), (70, 1, "show", ""), (70, 2, "results_date", "k3"), (71, 1, "results_date", "k2"), (80, 3, "show", "")]
    # an event that comes twice gives its rows twice, and a show needs no event id
    odd = events.unionByName(events.where("event_id = 1")).unionByName(events.where("event_id = 3").withColumn("event_id", F.lit(None).cast("long")))
    again = reminders.occasions(subs, odd, rounds, as_date("2026-08-02")).groupBy("subscription_id", "event_id").count().collect()
    assert sorted((r[0], r[1] or 0, r[2]) for r in again) == [(70, 1, 6), (70, 2, 1), (71, 1, 2), (80, 0, 1), (80, 3, 1)]
    assert set(got.columns) >= {"watch_id", "subscription_id", "channels", "lead_days", "kind"}
