"""Deltas: one look at the ids serves all child tables, and independent writes run side by side."""

import pytest

from roundtide.sources.deltas import IDS, DeltaState
from roundtide.sources.tables import side_by_side, written


def test_children_of_touched_events_are_read_by_one_look_at_the_ids(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(i, i % 3) for i in range(12)], "event_id bigint, watch_id bigint")
    names = ("links", "rounds", "log")
    child = spark.createDataFrame([(i % 13, f"u{i}") for i in range(40)], "event_id bigint, url string")
    state = DeltaState.create(str(tmp_path), {"events": events, **{n: child for n in names}}, buckets=2)
    state.save(1, events.where("event_id in (3, 4)").select("event_id"), {"events": events.where("event_id <> 4"), **{n: child.where("url < 'u2'") for n in names}})
    touched = written(spark.createDataFrame([(3,), (4,), (5,), (12,), (99,)], "event_id bigint"), "touched")
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = {n: plain(state.rows(n, 1, touched)) for n in names}
    looks, stored = [], DeltaState._stored
    monkeypatch.setattr(DeltaState, "_stored", lambda self, name, version: looks.append(name) or stored(self, name, version))
    got = state.children_of(touched, 1)
    assert sorted(looks) == sorted([IDS, *names])
    assert {n: plain(t) for n, t in got.items()} == want and want["links"]


def test_writes_side_by_side_keep_their_order_and_their_errors(spark):
    assert side_by_side(spark, [lambda k=k: spark.range(k).count() for k in range(6)]) == list(range(6))
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])
