"""Alerts, changes and keyed state: what is compared and called, not how much lies beside it."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundtide.operators import alerts as al
from roundtide.operators import state as st
from roundtide.streaming.keyed import DAY_MS, LastSeen

DAY = dt.date(2026, 8, 2)
DATES = ["application_start_at", "application_end_at", "lottery_start", "lottery_end", "results_date", "general_sale_date", "payment_end_at", "payment_deadline", "payment_start_at", "trade_start_at", "trade_end_at"]


def rounds_of(spark, rows):
    """Rounds (event_id, round_key, results_date); the other dates are missing."""
    df = spark.createDataFrame(rows, "event_id long, round_key string, results_date date")
    none = F.lit(None).cast("date")
    return df.withColumns({"name": F.lit("n"), "url": F.lit("u"), "source": F.lit("s"), **{c: none for c in DATES if c != "results_date"}})


def test_rounds_without_a_near_date_leave_before_the_titles_join(spark):
    rounds = rounds_of(spark, [(1, "a", DAY), (1, "b", DAY - dt.timedelta(9)), (2, "c", None)])
    titles = spark.createDataFrame([(1, "x"), (2, "y")], "event_id long, event string")
    got = al.lifecycle_alerts(rounds.join(titles, "event_id"), F.lit(DAY))
    assert [(r["event_id"], r["round_key"], r["type"]) for r in got.collect()] == [(1, "a", "results_today")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "date_diff" in plan[plan.index("Join Inner"):] or "datediff" in plan[plan.index("Join Inner"):]


def test_days_are_compared_as_days_and_told_as_text(spark):
    old = rounds_of(spark, [(1, "a", DAY), (1, "b", DAY), (1, "c", None)])
    new = rounds_of(spark, [(1, "a", DAY), (1, "b", None), (1, "c", DAY), (2, "a", DAY)])
    told = st.round_changes(old, new)
    want = [(1, "b", "results_date", "2026-08-02", ""), (1, "c", "results_date", "", "2026-08-02"), (2, "a", None, None, None)]
    key = ["event_id", "round_key", "field", "old", "new"]
    assert sorted(told.select(*key).collect(), key=lambda r: r[:2]) == want
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan[plan.index("Join LeftOuter"):]
    as_text = old.withColumn("results_date", F.col("results_date").cast("string"))
    assert sorted(st.round_changes(as_text, new).select(*key).collect(), key=lambda r: r[:2]) == want


class Handle:
    """A key's state and timers, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_key_makes_two_calls_and_its_one_timer_looks_at_the_last_observation():
    handle = Handle()
    seen = LastSeen(["k"], ["ts", "id"], ["v"], T.StructType(), keep_days=10)
    seen.init(handle)
    rows = lambda *r: iter([pd.DataFrame(r, columns=["ts", "id", "v"])])
    first = list(seen.handleInputRows(("a",), rows((2 * 86_400_000_000, 2, 1.0), (86_400_000_000, 1, 3.0)), None))
    assert [f.values.tolist() for f in first] == [[["a", "change", 2 * 86_400_000_000, 2, "v", "3.0", "1.0"]]]
    before = handle.calls
    more = list(seen.handleInputRows(("a",), rows((4 * 86_400_000_000, 3, float("nan")), (86_400_000_000, 9, 5.0)), None))
    assert [f.values.tolist() for f in more] == [[["a", "late", 86_400_000_000, 9, None, None, None]]]
    assert handle.calls - before == 2 and handle.value == (4 * 86_400_000_000, 3, 1.0)
    assert handle.timers == [12 * DAY_MS]
    list(seen.handleExpiredTimer(("a",), Mark(13 * DAY_MS), None))
    assert handle.value is not None and handle.timers[-1] == 14 * DAY_MS
    list(seen.handleExpiredTimer(("a",), Mark(14 * DAY_MS), None))
    assert handle.value is None
