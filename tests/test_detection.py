"""Golden cases and random equivalence of segmentation, dedup and tracking."""

import random

from pyspark.sql import functions as F

from sightline.operators import dedup, segment, tracking


def gate(active, open_frames, quiet_frames):
    """The state machine, frame by frame."""
    out, streak, quiet, opened, began, last = [], 0, 0, False, None, None
    for i, on in enumerate(active):
        if on:
            streak, quiet, last = streak + 1, 0, i
            began = i if streak == 1 else began
            if not opened and streak >= open_frames:
                opened = True
                out.append([began, None])
        else:
            streak, quiet = 0, quiet + 1
            if opened and quiet >= quiet_frames:
                opened = False
                out[-1][1] = last
    if opened:
        out[-1][1] = last
    return [tuple(x) for x in out]


def test_segments_equal_the_state_machine(spark):
    r = random.Random(3)
    cases = {f"s{k}": [r.random() < r.choice([0.3, 0.5, 0.8]) for _ in range(r.randint(0, 60))] for k in range(40)}
    rows = [(k, i, on) for k, v in cases.items() for i, on in enumerate(v)]
    found = segment.segments(spark.createDataFrame(rows, "source string, i long, on boolean"), ["source"], "i", "on", 2, 3).collect()
    got = {k: sorted((x.first_frame, x.last_frame) for x in found if x.source == k) for k in cases}
    assert got == {k: gate(v, 2, 3) for k, v in cases.items()}


def test_reservoir_keeps_at_most_its_size(spark):
    rows = [(str(n), i) for n in (0, 1, 5, 8, 9, 33) for i in range(n)]
    kept = segment.reservoir(spark.createDataFrame(rows, "k string, i long"), ["k"], "i", 8).collect()
    got = {n: sorted(x.i for x in kept if x.k == str(n)) for n in (1, 5, 8, 9, 33)}
    assert got[8] == list(range(8)) and got[9] == [0, 2, 4, 6, 8] and got[33] == [0, 8, 16, 24, 32] and got[1] == [0]


def test_tracker_dedup_does_not_refresh(spark):
    rows = [("A", t) for t in (0, 10, 20, 25, 100)]
    got = dedup.tracker_dedup(spark.createDataFrame(rows, "p string, t long"), ["p"], "t", 12).collect()
    assert sorted(x.t for x in got) == [0, 20, 100]


def merge(spark, events, window=12_000_000, seeds=()):
    """events: (camera, seconds) in arrival order, one payload."""
    us = lambda t: int(t * 1_000_000)
    rows = [("P", c, us(t), i, i, us(t), us(t), 1) for i, (c, t) in enumerate(events)]
    s = spark.createDataFrame(rows, "payload string, source_id string, at long, arrival_seq long, frame long, first_seen long, first_decode long, decode_count long")
    seeded = spark.createDataFrame([("P", us(t)) for t in seeds], "payload string, anchor long") if seeds else None
    return [(x.action, x.anchor / 1e6, x.n_cameras) for x in sorted(dedup.cross_camera(s, window, seeded).collect(), key=lambda x: x.arrival_seq)]


def test_cross_camera_golden_cases(spark):
    assert [a for a, *_ in merge(spark, [("A", 43), ("A", 105), ("B", 33.5)])] == ["emit", "emit", "merge"]
    assert merge(spark, [("A", 0.5), ("A", 13.5), ("B", 6.0), ("B", 14.0)]) == [("emit", 0.5, 1), ("emit", 13.5, 1), ("merge", 0.5, 2), ("merge", 13.5, 2)]
    assert merge(spark, [("A", 0), ("A", 13), ("B", 6), ("C", 10)]) == [("emit", 0, 1), ("emit", 13, 1), ("merge", 0, 2), ("merge", 13, 2)]
    assert [a for a, *_ in merge(spark, [("B", 5), ("B", 8)], seeds=[-5])] == ["restart_repeat", "emit"]
    assert [a for a, *_ in merge(spark, [("B", 5)])] == ["emit"]
    assert [a for a, *_ in merge(spark, [("A", 8), ("B", 6)], seeds=[-5])] == ["emit", "merge"]


def brute(events, window, seeds=()):
    passes, out = [[t, None] for t in seeds], []
    for camera, t in events:
        near = min(passes, key=lambda p: (abs(t - p[0]), p[0]), default=None)
        if near is None or abs(t - near[0]) > window:
            passes.append([t, {camera}])
            out.append("emit")
        elif near[1] is None:
            out.append("restart_repeat")
        elif camera in near[1]:
            out.append("repeat")
        else:
            near[1].add(camera)
            out.append("merge")
    return out


def test_cross_camera_random():
    r = random.Random(5)
    for _ in range(300):
        events = [(r.choice("ABC"), r.randint(0, 60)) for _ in range(r.randint(0, 30))]
        seeds = [-3] if r.random() < 0.3 else []
        fold = dedup.CrossCamera(7, tuple(seeds))
        assert [fold.absorb(t, c, t, t, 1, 0)[0] for c, t in events] == brute(events, 7, seeds)


def test_tracks_follow_two_objects_and_close_the_merged_one():
    t = tracking.Tracker(tracking.Rules(open_frames=2, quiet_frames=2, merge_frames=2))
    blob = lambda x, w=40: ((x, 0, w, 40), (x + w / 2, 20.0), w * 40)
    events = []
    for i in range(3):
        events += t.frame(i, [blob(i * 5), blob(400 - i * 5, 60)])[0]
    assert [e[0] for e in events] == ["open", "open"] and {e[2] for e in events} == {0}
    more, primary = t.frame(3, [blob(15), blob(385, 60)])
    assert more == [] and primary == 2
    quiet = [e for i in (4, 5) for e in t.frame(i, [blob(385, 60)])[0]]
    assert quiet == [("close", 1, 3)]
    assert t.end() == [("close", 2, 5)] and t.end() == []


def test_tracking_over_sources(spark):
    rows = [(s, i, False, 10 + i, 0, 30, 30, 900) for s in ("a", "b") for i in range(6)] + [("a", i, i == 8, None, None, None, None, None) for i in range(6, 10)]
    blobs = spark.createDataFrame(rows, "source_id string, frame_index long, discontinuity boolean, x int, y int, w int, h int, area int")
    got = sorted((x.source_id, x.kind, x.segment, x.frame_index) for x in tracking.track_objects(blobs, tracking.Rules(open_frames=2, quiet_frames=3)).collect())
    assert got == [("a", "close", 1, 5), ("a", "open", 1, 0), ("b", "close", 1, 5), ("b", "open", 1, 0)]


def test_ema_ignores_outliers(spark):
    rows = [("k", t, v) for t, v in ((0, 10.0), (1, 12.0), (2, 100.0), (3, 11.0), (50, 5.0))]
    out = sorted(segment.ema_fold(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 0.5, 4.0, 10).collect(), key=lambda x: x.run)
    assert [(x.ema, x.n_used) for x in out] == [(11.0, 3), (5.0, 1)]


def test_verdicts(spark):
    found = spark.createDataFrame([("a", 1, 0, 2), ("a", 2, 10, 20), ("a", 3, 60, 70)], "k string, seq long, first_frame long, last_frame long")
    decodes = spark.createDataFrame([("a", 45)], "k string, i long")
    got = segment.verdicts(found, ["k"], decodes, "i").select("seq", "verdict").collect()
    assert {tuple(x) for x in got} == {(1, "rejected"), (2, "decoded"), (3, "missed")}


def test_restart_seeds(spark):
    at = 1_700_000_000_000_000
    iso = F.date_format(F.timestamp_micros("wall_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = spark.createDataFrame([("A", at - 10_000_000, "x"), ("A", at - 4_000_000, "x"), ("B", at - 6_000_000, "y"), ("C", at - 500_000_000, "x"), ("D", at + 30_000_000, "x")], "payload string, wall_us long, camera string")
    stored = rows.select("payload", "wall_us", iso.alias("wall_iso"), F.create_map("camera", F.lit(1)).alias("cameras"))
    got = {x.payload: x.anchor for x in dedup.restart_seeds(stored, at, 12_000_000).collect()}
    assert got == {"A": -4_000_000, "B": -6_000_000}
    assert {x.payload for x in dedup.restart_seeds(stored, at, 12_000_000, camera="y").collect()} == {"B"}


def test_forced_eviction():
    fold = dedup.CrossCamera(1)
    for t in (0, 10, 20, 30):
        fold.absorb(t, "A", t, t, 1, 0)
    assert fold.evict(4) == 0 and fold.evict(2) == 2 and fold.anchors == [20, 30]
    assert fold.absorb(10, "B", 10, 10, 1, 0)[0] == "emit" and fold.forget(25) == 2


def test_merged_tracks_close_the_smaller_and_hand_over_its_blob():
    t = tracking.Tracker(tracking.Rules(open_frames=1, quiet_frames=5, merge_frames=2, centre_fraction=0.1))
    box = lambda x, w, h=40: ((x, 0, w, h), (x + w / 2, h / 2), w * h)
    assert [e[:2] for e in t.frame(0, [box(0, 80), box(90, 40)])[0]] == [("open", 1), ("open", 2)]
    # one blob remains, at the smaller one's place: that holds it once, then the larger has it
    assert t.frame(1, [box(90, 44)]) == ([], 2)
    assert t.frame(2, [box(90, 44)]) == ([("close", 2, 1)], 1)
    assert t.frame(3, [box(90, 44)]) == ([], 1)


def test_runs_between_quiet_frames_equal_one_pass(spark):
    """Dealing a source's runs to tasks gives the events of one tracker over all its frames."""
    r = random.Random(11)
    rules = tracking.Rules(open_frames=2, quiet_frames=3, merge_frames=2)
    rows, want = [], []
    for s in ("a", "b", "c"):
        whole, index = tracking.Tracker(rules), 0
        for _ in range(150):
            index += r.choice([1, 1, 1, 5])
            boxes = sorted({(r.randint(0, 6) * 40, r.randint(0, 2) * 40, r.choice([30, 50]), 30) for _ in range(r.choice([0, 0, 0, 1, 2, 3]))})
            gap = r.random() < 0.05
            rows += [(s, index, gap, *b, b[2] * b[3]) for b in boxes] or [(s, index, gap, None, None, None, None, None)]
            want += [(s, *e) for e in (whole.end() if gap else [])]
            want += [(s, *e) for e in whole.frame(index, [(b, (b[0] + b[2] / 2, b[1] + b[3] / 2), b[2] * b[3]) for b in boxes])[0]]
        want += [(s, *e) for e in whole.end()]
    blobs = spark.createDataFrame(rows, "source_id string, frame_index long, discontinuity boolean, x int, y int, w int, h int, area int")
    assert tracking.quiet_runs(blobs, 3).select("source_id", "run").distinct().count() > 30
    got = [(x.source_id, x.kind, x.segment, x.frame_index) for x in tracking.track_objects(blobs, rules).collect()]
    assert sorted(got) == sorted(want)


def test_one_key_without_a_pause(spark):
    """A payload that stays in view: many sightings, one run; state doesn't grow with it."""
    rows = spark.range(300_000).selectExpr("'k' AS k", "id AS t", "cast(id % 7 + 1 AS double) AS v")
    got = [r.t for r in dedup.tracker_dedup(rows, ["k"], "t", 999).orderBy("t").collect()]
    assert got == list(range(0, 300_000, 1000))
    one = segment.ema_fold(rows, ["k"], "t", "v", 0.5, 4.0, 10).collect()
    assert len(one) == 1 and one[0].run == 1
    seeds = spark.createDataFrame([("k", -1)], "k string, anchor long")
    assert dedup.tracker_dedup(rows, ["k"], "t", 999, seeds).agg(F.min("t")).first()[0] == 999


def test_rows_in_spans(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randint(0, 300)) for _ in range(200)]
    spans = [(r.choice("ab"), i, a, a + r.choice([0, 3, 150])) for i in range(20) for a in [r.randint(0, 300)]]
    got = segment.in_spans(spark.createDataFrame(rows, "k string, t long"), "t", spark.createDataFrame(spans, "k string, i int, a long, b long"), ["k"], "a", "b", 16)
    assert sorted((x.k, x.t, x.i) for x in got.collect()) == sorted((k, t, i) for k, t in rows for q, i, a, b in spans if k == q and a <= t <= b)
