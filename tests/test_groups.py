"""Handlers of live streams take a group of keys at a time: few calls of the state, however many keys there are."""

import pandas as pd
import pytest

from sightline.streaming import live, replay
from sightline.streaming import metrics as live_metrics
from sightline.streaming import segments as live_segments


class Handle:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, [], {}

    def getListState(self, name, schema):
        return State(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _call(self):
        self.handle.calls += 1
        return self.handle.kept

    def exists(self):
        return bool(self._call().get(self.name))

    def get(self):
        return self._call()[self.name]

    def put(self, rows):
        self._call()[self.name] = rows

    update = put

    def appendList(self, rows):
        kept = self._call()
        kept[self.name] = [*kept.get(self.name, []), *rows]

    def clear(self):
        self._call().pop(self.name, None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def sightings(n, at, camera="x"):
    return pd.DataFrame([(f"p{i}", camera, at + i, at + i, i, at, at, 1) for i in range(n)], columns=["payload", "source_id", "at", "arrival_seq", "frame", "first_seen", "first_decode", "decode_count"])


def actions(processor, rows):
    return [tuple(r) for f in processor.handleInputRows((0,), iter([rows]), None) for r in f[["payload", "action"]].itertuples(index=False)]


@pytest.fixture
def cross():
    return started(live.LiveCrossCamera(5_000))


def test_cross_camera_of_many_payloads(cross):
    p, h = cross
    assert {a for _, a in actions(p, sightings(400, 1_000_000))} == {"emit"}
    assert {a for _, a in actions(p, sightings(400, 1_001_000, "y"))} == {"merge"}
    assert h.calls < 20 and len(h.kept["passes"]) == 400


def test_seeds_of_many_payloads(cross):
    p, h = cross
    p.handleInitialState((0,), pd.DataFrame({"payload": [f"p{i}" for i in range(400)], "anchor": 1_000_000}), None)
    assert {a for _, a in actions(p, sightings(400, 1_001_000))} == {"restart_repeat"}
    assert h.calls < 20


def test_passes_left_behind_go_with_one_timer(cross):
    p, h = cross
    actions(p, sightings(300, 1_000_000))
    actions(p, sightings(100, 9_000_000))
    assert h.timers == [1_000]
    list(p.handleExpiredTimer((0,), Clock(5_000), Clock(1_000)))
    h.timers.remove(1_000)  # as Spark does
    assert len(h.kept["passes"]) == 100 and h.timers == [9_000] and h.calls < 30


def test_markers_of_many_payloads(cross):
    p, h = cross
    actions(p, sightings(400, 1_000_000))
    marks = sightings(390, 1_000_000).assign(source_id=None, arrival_seq=0, frame=None)
    assert [a for _, a in actions(p, marks)] == ["evict"] * 390
    assert len(h.kept["passes"]) == 10 and h.calls < 20


def metric_rows(n):
    return pd.DataFrame([(str(k), day * 86_400_000_000 + k, "pass", k, 1.0 * k) for k in range(n) for day in range(20)], columns=["source", "at", "kind", "seq", "value"])


def test_rates_of_many_sources():
    p, h = started(live_metrics.LiveMetrics(5, 512))
    (told,) = p.handleInputRows((0,), iter([metric_rows(300)]), None)
    assert len(told) == 300 and set(told["p24"]) == {2} and set(told["p1"]) == {1} and h.calls < 20
    assert len(h.kept["minutes"]) <= 600  # what is behind the windows never comes in


def test_fps_of_many_sources():
    p, h = started(live_metrics.LiveMetrics(86_400, 512))
    (told,) = p.handleInputRows((0,), iter([metric_rows(300)]), None)
    assert len(told) == 300 and set(told["in_window"]) == {1} and h.calls < 20 and len(h.kept["seconds"]) == 300


def test_misses_of_many_sources():
    p, h = started(live_segments.LiveMisses(1, 2))
    rows = [(f"s{i}", kind, at, seq, payload) for i in range(300) for kind, at, seq, payload in
            [("open", 0, 1, None), ("close", 5, 1, None), ("decode", 6, None, "X"), ("open", 7, 2, None), ("decode", 8, None, "Y"), ("decode", 9, None, "Y"), ("close", 10, 2, None)]]
    list(p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["source_id", "kind", "at", "seq", "payload"])]), None))
    (told,) = p.handleExpiredTimer((0,), Clock(2_000), Clock(1_000))
    assert list(map(tuple, told.itertuples(index=False))) == [(f"s{i}", 1, 6, 1) for i in sorted(range(300), key=lambda i: f"s{i}")]
    assert h.calls < 30 and not h.kept.get("spans")


def test_landing_deals_in_one_pass(spark):
    """Micro-batches and folders from one staged copy, an unknown folder's rows left out."""
    base = replay.fresh(spark, "landing")
    rows = spark.range(900).selectExpr("id as at", "concat('c', id % 3) as camera")
    replay.land(rows, "at", 3, {"c0": f"{base}/a", "c1": f"{base}/b"}, "camera", [299, 599])
    for name, k in (("a", 0), ("b", 1)):
        read = spark.read.parquet(f"{base}/{name}").selectExpr("at", "_metadata.file_modification_time as t", "_metadata.file_path as p").collect()
        files = sorted({(r.t, r.p) for r in read})
        assert [sorted(r.at for r in read if r.p == p) for _, p in files] == [list(range(lo + k, lo + 300, 3)) for lo in (0, 300, 600)]
