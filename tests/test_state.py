"""State machine, alerts and reminders on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from roundtide.functions.dates import as_date
from roundtide.operators import alerts, history, rounds, state
from roundtide.sources import pages as pg
from roundtide.sources import tables

def as_of():
    return as_date("2026-06-03")
D = dt.date


def round_table(spark, rows):
    schema = "event_id bigint, url string, name string, lottery_start date, lottery_end date, results_date date, general_sale_date date, payment_deadline date"
    extra = {c: F.lit(None).cast("date") for c in ("application_start_at", "application_end_at", "payment_start_at", "payment_end_at", "trade_start_at", "trade_end_at")}
    df = spark.createDataFrame(rows, schema).withColumns(
        {**extra, "source": F.lit(None).cast("string"), "platform": F.lit(None).cast("string"), "round_number": F.lit(None).cast("int"),
         "round_type": F.lit("unknown"), "membership_required": F.lit("unknown"), "confidence": F.lit(50), "evidence": F.lit("")}
    )
    return rounds.normalize_rounds(df, as_of())


def test_status_closing_soon(spark):
    got = round_table(spark, [(1, "https://eplus.jp/a", "先行", D(2026, 6, 1), D(2026, 6, 4), None, None, None)]).first()
    assert (got.status, got.platform) == ("closing_soon", "eplus")


def test_one_field_change(spark):
    a = round_table(spark, [(1, "https://eplus.jp/a", "先行", D(2026, 6, 10), D(2026, 6, 18), None, None, None)])
    b = round_table(spark, [(1, "https://eplus.jp/a", "先行", D(2026, 6, 10), D(2026, 6, 20), None, None, None)])
    got = state.round_changes(a, b).select("type", "field", "old", "new").collect()
    assert [tuple(x) for x in got] == [("ticket_field_changed", "lottery_end", "2026-06-18", "2026-06-20")]


def test_prune_is_scoped_to_seen_platforms(spark):
    row = lambda url: (1, url, "先行", D(2026, 6, 10), None, None, None, None)
    old = round_table(spark, [row("https://eplus.jp/a"), row("https://eplus.jp/b"), row("https://t.pia.jp/c")])
    new = round_table(spark, [row("https://eplus.jp/a")])
    assert [x.url for x in state.prune_rounds(old, new).collect()] == ["https://eplus.jp/b"]
    assert state.upsert_rounds(old, new).count() == 2


def test_five_lifecycle_alerts_once(spark):
    day = D(2026, 6, 3)
    r = round_table(spark, [(1, "https://eplus.jp/a", "先行", day, day, day, day, day)]).withColumn("event", F.lit("E"))
    got = alerts.lifecycle_alerts(r, as_of())
    assert {x.type for x in got.collect()} == {"lottery_opened", "lottery_closing_soon", "results_today", "payment_due_soon", "general_sale_soon"}
    assert alerts.new_alerts(got, got).count() == 0


def test_positions_match_a_plain_window(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 13).alias("c"), F.col("id").alias("v"))
    got = rounds.numbered_within(df, ["k"], F.col("c"), [F.col("v")], "pos")
    want = {}
    for row in sorted(df.collect()):
        want.setdefault(row.k, []).append((row.c, row.v))
    ranks = {(k, v): i for k, xs in want.items() for i, (_, v) in enumerate(sorted(xs), 1)}
    assert {(x.k, x.v): x.pos for x in got.collect()} == ranks


def test_history_crosses_buckets(spark):
    rows = [("a", dt.datetime(2024, m, 1), i, v) for i, (m, v) in enumerate([(1, 1.0), (1, 1.0), (2, 2.0), (4, 2.0), (5, 3.0)])]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v double")
    got = history.field_history(df, ["k"], "v", ["ts", "id"])
    assert sorted((x.id, x.old, x.new) for x in got.collect()) == [(2, 1.0, 2.0), (4, 2.0, 3.0)]


def test_cleanup_is_idempotent(spark, sf_dir):
    from roundtide.plans.star import Star

    s = Star(spark, sf_dir)
    e = F.col("event_id")
    t = {
        "watches": s.watches, "events": s.events, "links": s.event_links.withColumn("event_id", F.when(e % 23 == 0, -e - 1).otherwise(e)),
        "rounds": s.rounds, "snapshots": state.snapshots(s.events, s.rounds), "alert_log": s.alert_log, "watch_sources": s.watch_sources,
    }
    once, first = state.cleanup(t, s.as_of)
    assert first.where("n > 0").count() > 0
    kept = {k: tables.written(v, f"clean_{k}") for k, v in once.items()}
    assert state.cleanup(kept, s.as_of)[1].where("n <> 0").count() == 0


def test_versions_are_published_atomically(spark, tmp_path):
    root = str(tmp_path)
    tables.publish({"t": spark.range(3)}, root, 0)
    tables.publish({"t": spark.range(5)}, root, 1)
    assert tables.read_state(spark, root, ["t"])["t"].count() == 5
    assert tables.read_state(spark, root, ["t"], version=0)["t"].count() == 3


def test_page_parse(spark):
    html = (
        '<html><head><title>Plain</title><meta property="og:title" content="Main &amp; Title"><script>var x="公";</script></head><body>'
        '<a href="/t?a=1&amp;b=2">Tick<b>ets</b></a><a href="mailto:x@y">m</a><a href="/t?a=1&amp;b=2">again</a><noscript>no</noscript></body></html>'
    )
    df = spark.createDataFrame([(1, "https://a.example.com/x/y", html)], "page_id bigint, url string, html string")
    x = pg.parse_pages(df).first()
    assert (x.title, x.text) == ("Main & Title", "Plain Tick ets m again")
    assert [(l.label, l.url) for l in x.links] == [("Tick ets", "https://a.example.com/t?a=1&b=2")]


def test_calendar_file_is_one_calendar(spark, tmp_path):
    import glob

    from roundtide.sources.exports import write_calendar

    rows = spark.createDataFrame([("u1", "a;b", "20260603", "20260606", "d\nx", "")], "uid string, summary string, dtstart string, dtend string, description string, url string")
    write_calendar(rows, F.to_timestamp(F.lit("2026-06-03 00:00:00")), str(tmp_path / "cal"))
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(str(tmp_path / "cal" / "part*"))))
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n")
    assert "SUMMARY:a\\;b\r\n" in text and "DESCRIPTION:d\\nx\r\n" in text and "URL:" not in text
