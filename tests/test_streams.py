"""Keyed stream state, watermarks and windows over small deliveries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roundtide.streaming import jobs, windows
from roundtide.streaming.keyed import field_changes

DAY = dt.datetime(2026, 5, 1)
SCHEMA = "k string, ts timestamp, seq long, a string, b double"


@pytest.fixture
def deliver(spark, tmp_path):
    """Write each delivery to the landing folder and start the job anew on it."""

    def run(deliveries, schema, job):
        for rows in deliveries:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
            stream = jobs.read_landing(spark, f"{tmp_path}/landing", spark.createDataFrame([], schema).schema)
            jobs.append_to(job(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    return run


def at(days, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


def test_changes_of_several_fields_late_rows_and_gaps(spark, deliver):
    deliveries = [
        [("x", at(1), 1, "open", 1.0), ("x", at(0), 2, "upcoming", 1.0), ("y", at(0), 3, None, None), (None, at(0), 4, "open", 1.0)],
        [("x", at(3), 5, None, 2.0), ("x", at(0, 5), 6, "closed", 9.0), ("y", at(2), 7, "open", 5.0)],
        [("x", at(4), 8, "closed", 2.0), ("x", at(4), 8, "closed", 2.0), ("y", at(3), 9, "open", None), ("y", at(4), 10, "open", 6.0)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = deliver(deliveries, SCHEMA, lambda s: field_changes(s, ["k"], ["ts", "seq"], ["a", "b"]))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert {(r.k, r.kind, r.seq, r.field, r.old, r.new) for r in got.collect()} == {
        ("x", "change", 1, "a", "upcoming", "open"), ("x", "change", 5, "b", "1.0", "2.0"), ("x", "late", 6, None, None, None),
        ("x", "change", 8, "a", "open", "closed"), ("y", "change", 10, "b", "5.0", "6.0"),
    }
    assert {r.ts for r in got.where("seq = 5").select(F.col("ts")).collect()} == {at(3)}


def test_a_timer_forgets_keys(deliver):
    row = lambda k, day, seq, a: (k, at(day), seq, a, 1.0)
    deliveries = [[row("x", 0, 1, "open"), row("y", 0, 2, "open")], [row("y", 30, 3, "closed")], [row("y", 31, 4, "open")], [row("x", 31, 5, "closed")]]
    got = deliver(deliveries, SCHEMA, lambda s: field_changes(s, ["k"], ["ts", "seq"], ["a", "b"], keep_days=10))
    # x was forgotten when the watermark passed day 10, so its next observation is its first
    assert sorted((r.k, r.seq, r.old, r.new) for r in got.collect()) == [("y", 3, "open", "closed"), ("y", 4, "closed", "open")]


def test_windows_sessions_and_repeats(deliver, spark, tmp_path):
    schema = "u string, ts timestamp"
    deliveries = [[("x", at(0, 1)), ("x", at(0, 2)), ("y", at(0, 1))], [("x", at(0, 5)), ("x", at(9))], [("y", at(0, 3)), ("x", at(20))]]
    got = deliver(deliveries, schema, lambda s: windows.sessions(s, ["u"], "ts", "2 days", "2 hours"))
    # the last row of y comes after its window has ended
    assert sorted((r.u, r.session_start, r.session_end, r.n) for r in got.collect()) == [
        ("x", at(0, 1), at(0, 4), 2), ("x", at(0, 5), at(0, 7), 1), ("x", at(9), at(9, 2), 1), ("y", at(0, 1), at(0, 3), 1),
    ]


def test_sliding_windows_hold_a_row_twice(deliver):
    got = deliver([[("x", at(0, 1)), ("x", at(1, 1))], [("x", at(10))]], "u string, ts timestamp", lambda s: windows.counts_per_window(s, ["u"], "ts", "1 day", "2 days", "1 day"))
    assert sorted((r.window_start, r.n) for r in got.collect()) == [(at(-1), 1), (at(0), 2), (at(1), 1)]


def test_repeats_inside_the_delay_are_dropped(deliver):
    deliveries = [[("x", at(0)), ("x", at(0))], [("x", at(1)), ("y", at(8))], [("z", at(9))], [("x", at(9))]]
    got = deliver(deliveries, "u string, ts timestamp", lambda s: windows.once_within(s, ["u"], "ts", "3 days"))
    assert sorted((r.u, r.ts) for r in got.collect()) == [("x", at(0)), ("x", at(9)), ("y", at(8)), ("z", at(9))]
