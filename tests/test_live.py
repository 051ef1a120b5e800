"""Live streams against batch forms and brute force."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sightline.operators import dedup, tracking
from sightline.plans import streams
from sightline.sources import testdata as td
from sightline.streaming import joins, live, replay
from sightline.streaming import metrics as live_metrics
from sightline.streaming import operators as so
from sightline.streaming import segments as live_segments
from sightline.streaming.upsert import Upserts

SF = "/root/testdata/sf0.001"
T = 1_700_000_000_000_000
SIGHT = "payload string, source_id string, at long, arrival_seq long, frame long, first_seen long, first_decode long, decode_count long"


class SlowTracker:
    """The tracking rules over lists, one track and blob after another."""

    def __init__(self, rules):
        self.rules, self.tracks, self.n = rules, [], 0

    def close(self, t):
        self.tracks.remove(t)
        return [("close", t["id"], t["last"])] if t["id"] else []

    def end(self):
        return [e for t in list(self.tracks) for e in self.close(t)]

    def open(self, t):
        if t["id"] or t["streak"] < self.rules.open_frames:
            return []
        self.n += 1
        t["id"] = self.n
        return [("open", self.n, t["began"])]

    def frame(self, index, blobs):
        r, pairs = self.rules, []
        for i, t in enumerate(self.tracks):
            for j, (x, y, w, h, _) in enumerate(blobs):
                u, v, a, b, _ = t["blob"]
                shared = max(0, min(x + w, u + a) - max(x, u)) * max(0, min(y + h, v + b) - max(y, v))
                iou = shared / (w * h + a * b - shared) if shared else 0.0
                apart = ((x + w / 2 - u - a / 2) ** 2 + (y + h / 2 - v - b / 2) ** 2) ** 0.5
                if iou >= r.iou_gate or apart <= r.centre_fraction * r.diagonal:
                    pairs.append((iou, -apart, i, j))
        pairs.sort(reverse=True)
        of_track, of_blob, focus = {}, {}, {}
        for _, _, i, j in pairs:
            if i not in of_track and j not in of_blob:
                of_track[i], of_blob[j] = j, i
        focus = dict(of_track)
        for _, _, i, j in pairs:
            focus.setdefault(i, j)
        order, live, events, gone, contending = list(focus), list(self.tracks), [], set(), set()
        for j in dict.fromkeys(focus.values()):
            rivals = sorted((i for i in order if focus[i] == j), key=lambda i: -live[i]["blob"][4])
            for i in rivals[1:]:
                contending.add(i)
                live[i]["merging"] += 1
                if live[i]["merging"] >= r.merge_frames:
                    if of_track.pop(i, None) == j:
                        of_track[rivals[0]], of_blob[j] = j, rivals[0]
                    events += self.close(live[i])
                    gone.add(i)
        fresh = []
        for i, t in enumerate(live):
            if i in gone:
                continue
            if i not in contending:
                t["merging"] = 0
            if i in of_track:
                t["blob"], t["quiet"], t["streak"], t["last"] = blobs[of_track[i]], 0, t["streak"] + 1, index
                t["began"] = index if t["streak"] == 1 else t["began"]
                fresh.append(t)
            else:
                t["streak"], t["quiet"] = 0, t["quiet"] + 1
                if t["quiet"] >= r.quiet_frames:
                    events += self.close(t)
        for j, b in enumerate(blobs):
            if j not in of_blob:
                self.tracks.append({"id": 0, "blob": b, "streak": 1, "quiet": 0, "merging": 0, "began": index, "last": index})
                fresh.append(self.tracks[-1])
        for t in fresh:
            events += self.open(t)
        seen = [t for t in self.tracks if t["id"] and not t["quiet"]]
        return events, max(seen, key=lambda t: t["blob"][4])["id"] if seen else None


def slow_tracks(blobs, rules):
    events, primary, by = [], [], {}
    for b in blobs:
        by.setdefault(b.source_id, {}).setdefault(b.frame_index, []).append(b)
    merges = 0
    for source, frames in by.items():
        t = SlowTracker(rules)
        for index in sorted(frames):
            gap = any(b.discontinuity for b in frames[index])
            found = t.end() if gap else []
            now, first = t.frame(index, sorted((b.x, b.y, b.w, b.h, b.area) for b in frames[index] if b.w is not None))
            merges += sum(e[0] == "close" and e[2] >= index - 1 for e in now)
            events += [(source, *e) for e in found + now]
            primary.append((source, index, first))
        events += [(source, *e) for e in t.end()]
    return sorted(events), sorted(primary, key=repr), merges


def test_objects_that_meet_merge_and_split(spark):
    blobs = streams.moving_blobs(spark, SF).collect()
    want, primary, merges = slow_tracks(blobs, streams.RULES)
    assert merges > 5 and len(want) > 100
    batch = [(r.source_id, r.kind, r.segment, r.frame_index) for r in streams.crossing_tracks(spark, SF).collect()]
    assert sorted(batch) == want
    got = streams.stream_crossing_tracks(spark, SF).collect()
    assert sorted((r.source_id, r.kind, r.segment, r.at_frame) for r in got if r.kind != "primary") == want
    assert sorted(((r.source_id, r.frame_index, r.segment) for r in got if r.kind == "primary"), key=repr) == primary


def test_random_tracks_over_micro_batches(spark):
    r = random.Random(4)
    rules = tracking.Rules(open_frames=2, quiet_frames=3, merge_frames=2)
    rows = []
    for s in ("a", "b"):
        for index in range(120):
            boxes = sorted({(r.randint(0, 6) * 40, r.randint(0, 2) * 40, r.choice([30, 50]), 30) for _ in range(r.choice([0, 1, 2, 3]))})
            gap = r.random() < 0.03
            rows += [(s, index, gap, *b, b[2] * b[3]) for b in boxes] or [(s, index, gap, None, None, None, None, None)]
    blobs = spark.createDataFrame(rows, "source_id string, frame_index long, discontinuity boolean, x int, y int, w int, h int, area int")
    want, primary, _ = slow_tracks(blobs.collect(), rules)
    got = streams._tracked(spark, blobs, "random", rules).collect()
    assert sorted((x.source_id, x.kind, x.segment, x.at_frame) for x in got if x.kind != "primary") == want
    assert sorted(((x.source_id, x.frame_index, x.segment) for x in got if x.kind == "primary"), key=repr) == primary


def folded(rows, window, cameras, most, ends):
    """The cap by brute force: batch by batch, with what the slowest camera has left behind gone."""
    state, marks, actions = {}, {}, []
    for k, end in enumerate([*ends, None]):
        part = [r for r in rows if (k == 0 or r[3] > ends[k - 1]) and (end is None or r[3] <= end)]
        for r in sorted(part, key=lambda r: (r[3], r[4])):
            fold = state.setdefault(r[0], dedup.CrossCamera(window))
            actions.append((r[0], r[3], fold.absorb(r[2], r[1], r[5], r[6], r[7], r[4])[0]))
            marks[r[1]] = max(r[2], marks.get(r[1], r[2]))
        if len(marks) == len(cameras):
            cut = min(marks.values()) // 1000 - window // 1000
            for fold in state.values():
                fold.forget(next((a for a in fold.anchors if a // 1000 >= cut), 1 << 62))
        held = sorted((a, p) for p, fold in state.items() for a in fold.anchors)
        for a, p in held[: max(0, len(held) - most)]:
            state[p].anchors.remove(a)
            del state[p].passes[a]
            actions.append((p, None, "evict"))
    return actions, {(p, a) for p, fold in state.items() for a in fold.anchors}


def test_cap_over_the_whole_state(spark):
    r = random.Random(6)
    window, cameras = 5_000_000, ["x", "y"]
    rows = []
    for i in range(240):
        at = T + i * 400_000 + r.randint(0, 300_000)
        camera = r.choice(cameras)
        rows.append((f"p{r.randint(0, 25)}", camera, at, at + (3_000_000 if camera == "y" else 0), i, at, at, 1 + i % 3))
    df = spark.createDataFrame(rows, SIGHT)
    want, held = folded(rows, window, cameras, 6, replay.cuts(df, "arrival_seq", 3))
    actions, left = live.run_capped(spark, df, window, cameras, 6, 3)
    got = [(x.payload, x.arrival_seq if x.action != "evict" else None, x.action) for x in actions.collect()]
    assert sum(a == "evict" for _, _, a in want) > 3 and sorted(got, key=repr) == sorted(want, key=repr)
    assert {(x.payload, x.anchor) for x in left.collect()} == held and len(held) <= 6


def test_the_capped_query(spark):
    stored = streams._lagged(spark, SF).select(*[c.split()[0] for c in SIGHT.split(", ")])
    want, _ = folded([tuple(r) for r in stored.collect()], td.WINDOW, td.CAMERAS, 4, replay.cuts(stored, "arrival_seq", 3))
    got = {r.payload: (r.passes_emitted, r.cross_camera_merges, r.forced_evictions) for r in streams.stream_capped_dedup(spark, SF).collect()}
    assert got == {p: tuple(sum(x[0] == p and x[2] == a for x in want) for a in ("emit", "merge", "evict")) for p in {x[0] for x in want}}
    assert sum(v[2] for v in got.values()) > 2


def test_a_silent_camera_holds_the_state(spark):
    """Nothing is forgotten until each camera has spoken; then all that it has passed goes, of payloads never seen again, too."""
    rows = [("a", "x", T, T, 1, 0, 0, 1), ("b", "x", T + 90_000_000, T + 90_000_000, 2, 0, 0, 1), ("c", "y", T + 95_000_000, T + 95_000_000, 3, 0, 0, 1)]
    df = spark.createDataFrame(rows, SIGHT)
    one = live.live_passes(spark, live.replay_cross_camera(spark, df.where("source_id = 'x'"), 1_000_000, ["x", "y"], 1)[1])
    assert {r.payload for r in one.collect()} == {"a", "b"}
    both = live.live_passes(spark, live.replay_cross_camera(spark, df, 1_000_000, ["x", "y"], 1)[1])
    assert {r.payload for r in both.collect()} == {"b", "c"}


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), replay.settings(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_files_keep_step(spark):
    """Each folder gets a file per micro-batch, even where it has no row."""
    base = replay.fresh(spark, "step")
    rows = td.sightings(spark, SF).select("source_id", "arrival_seq")
    replay.land(rows, "arrival_seq", 3, {c: f"{base}/{i}" for i, c in enumerate([*td.CAMERAS, "none"])}, "source_id")
    for i, c in enumerate([*td.CAMERAS, "none"]):
        read = spark.read.schema(rows.schema).parquet(f"{base}/{i}")
        assert len(read.inputFiles()) == 3 and read.count() == rows.where(F.col("source_id") == c).count()


def run(spark, rows, at, build, tag, batches=3):
    return streams._replayed(spark, rows, at, build, tag, batches)


def test_spans_without_rows_are_told_and_state_ends(spark):
    """Spans far apart: what is over leaves the state of the join, whichever side it is on."""
    hour = 3_600_000_000
    rows = spark.createDataFrame([("k", T + i * hour, i) for i in range(200)], "k string, t long, i int")
    spans = spark.createDataFrame([("k", n, T + n * hour + 1, T + n * hour + (5 * hour if n % 20 else hour // 2)) for n in range(0, 190, 10)], "k string, n int, a long, b long")
    met, checkpoint = streams._joined(spark, rows, "t", spans, "b", lambda r, s: joins.rows_in_spans(r, "t", s, "a", "b", ["k"], 6 * hour, outer=True), "spans", 4)
    got = [(r.n, r.i) for r in met.collect()]
    want = [(n, i) for n in range(0, 190, 10) for i in range(n + 1, n + 6) if n % 20]
    assert sorted(x for x in got if x[1] is not None) == want
    assert sorted(n for n, i in got if i is None) == list(range(0, 180, 20))  # that of 180 is where its own side's clock stands
    left = spark.read.format("statestore").option("path", checkpoint).option("joinSide", "left").load().count()
    right = spark.read.format("statestore").option("path", checkpoint).option("joinSide", "right").load().count()
    assert left <= 2 and right <= 30


def test_a_source_alone_closes_by_the_wall_clock(spark):
    frames = spark.createDataFrame([("a", i, T + i, True, False) for i in range(4)], "source_id string, frame_index long, at long, active boolean, discontinuity boolean")
    base = replay.fresh(spark, "wall")
    frames.coalesce(1).write.parquet(f"{base}/in")
    with replay.settings(spark, 2):
        stream = live_segments.segment_events(replay.source(spark, f"{base}/in", frames.schema), 2, 3, 2_000_000, wall=True)
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="1 second").start()
        try:
            for _ in range(60):
                time.sleep(1)
                got = [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{base}/out").collect()] if os.path.exists(f"{base}/out".removeprefix("file://")) or os.path.exists(f"{base}/out".removeprefix("file:")) else []
                if len(got) == 2:
                    break
        finally:
            query.stop()
    assert sorted(got) == [("a", 1, "close", 3), ("a", 1, "open", 0)]


def test_silence_and_gaps(spark):
    second = 1_000_000
    rows = [("a", i, T + i * second, i in (1, 2, 3, 60, 61), False) for i in (1, 2, 3, 60, 61)] + [("b", i, T + i * second, True, i == 30) for i in range(0, 62, 5)]
    frames = spark.createDataFrame(rows, "source_id string, frame_index long, at long, active boolean, discontinuity boolean")
    got = sorted(map(tuple, run(spark, frames, "at", lambda s: live_segments.segment_events(s, 2, 3, 20 * second), "silence", 4)[0].collect()))
    assert got == [("a", 1, "close", 3), ("a", 1, "open", 1), ("a", 2, "open", 60), ("b", 1, "close", 25), ("b", 1, "open", 0), ("b", 2, "open", 30)]


def test_misses_are_told_in_order_and_at_once_at_a_gap(spark):
    second = 1_000_000
    rows = [("a", "open", 0, 1, None), ("a", "open", 1, 2, None), ("a", "close", 5, 2, None), ("a", "close", 6, 1, None), ("a", "decode", 8, None, "X"), ("a", "decode", 30, None, "X"),
            ("a", "open", 50, 3, None), ("a", "decode", 51, None, "X"), ("a", "decode", 52, None, "X"), ("a", "close", 53, 3, None),
            ("a", "open", 60, 4, None), ("a", "close", 61, 4, None), ("a", "gap", 62, None, None), ("a", "open", 63, 5, None), ("a", "close", 64, 5, None), ("b", "gap", 100, None, None), ("b", "gap", 200, None, None)]
    df = spark.createDataFrame([(s, k, T + t * second, n, p) for s, k, t, n, p in rows], "source_id string, kind string, at long, seq long, payload string")
    got = run(spark, df, "at", lambda s: live_segments.misses(s, 10 * second, 2), "misses", 3)[0]
    assert sorted((r.place, r.seq, (r.settled - T) // second) for r in got.collect()) == [(1, 2, 15), (2, 1, 16), (3, 4, 71), (4, 5, 74)]


def test_metrics_with_late_rows_and_bounded_state(spark):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        at = T + r.randint(0, 60 * 3600) * 1_000_000 + r.randint(0, 999_999)
        rows.append((r.choice("ab"), at, r.choice(["pass", "miss", "frame"]), i, r.choice([None, r.random()]), at + r.choice([0, 0, 40 * 3600 * 1_000_000])))
    df = spark.createDataFrame(rows, "k string, at long, kind string, seq long, value double, arrival long")
    told, checkpoint = run(spark, df, "arrival", lambda s: live_metrics.live_metrics(s, "k", window=3600, most=50), "live-metrics", 4)
    last = {x.k: x for x in told.collect() if x.n_rows == sum(y[0] == x.k for y in rows)}
    for k in "ab":
        own = [x for x in rows if x[0] == k]
        end = max(x[1] for x in own)
        n = lambda kind, span: sum(x[2] == kind and x[1] >= end - span * 1_000_000 for x in own)
        assert (last[k].p1, last[k].m1, last[k].p24, last[k].m24) == (n("pass", 3600), n("miss", 3600), n("pass", 86400), n("miss", 86400))
        assert last[k].in_window == sum(end // 1_000_000 - 3600 < x[1] // 1_000_000 for x in own)
        values = sorted(v for _, v in sorted((x[3], x[4]) for x in own if x[4] is not None)[-50:])
        assert last[k].samples == len(values) == 50 and last[k].p50_ms == values[round(0.5 * 49)] and last[k].p95_ms == values[round(0.95 * 49)]
    assert replay.state(spark, checkpoint, "minutes").count() <= 2 * 1442 and replay.state(spark, checkpoint, "seconds").count() <= 2 * 3600
    assert replay.state(spark, checkpoint, "samples").count() <= 100


def test_seeded_tracker_state_ends(spark):
    rows = spark.createDataFrame([("a", T + 5), ("b", T + 10_000_000_000), ("b", T + 20_000_000_000)], "k string, t long")
    seeds = spark.createDataFrame([("a", T), ("c", T)], "k string, anchor long")
    got, checkpoint = run(spark, rows, "t", lambda s: so.tracker_dedup(s, ["k"], "t", 1_000_000, seeds, "0 seconds"), "seeds", 3)
    assert sorted(map(tuple, got.collect())) == [("b", T + 10_000_000_000), ("b", T + 20_000_000_000)]
    assert [x.k for x in replay.state(spark, checkpoint, "last").select("key.k").collect()] == ["b"]


def test_upserts_stay_small_and_replay_safely(spark):
    path = replay.fresh(spark, "store")
    r = random.Random(3)
    rows = [(f"e{r.randint(0, 30)}", r.randint(0, 4), i, f"v{i}") for i in range(400)]
    store = Upserts(spark, path, "id string, rev int, seq long, v string", "id", "rev", "seq", buckets=4, every=3)
    best = {}
    for b in range(10):
        part = rows[40 * b : 40 * b + 40]
        df = spark.createDataFrame(part, "id string, rev int, seq long, v string").coalesce(1)
        store.sink(df, b)
        if b in (2, 5, 7):  # the same batch again, of the base and of the log
            store.sink(df, b)
            store.sink(spark.createDataFrame(rows[:40], "id string, rev int, seq long, v string").coalesce(1), 0)
        for x in part:
            held = best.setdefault(x[0], (x, x[2]))
            best[x[0]] = (max(held[0], x, key=lambda y: (y[1], y[2])), held[1])
        assert store.files() <= 4 + 3
    assert {(x.id, x.rev, x.seq, x.v, x.first_arrival) for x in store.view().collect()} == {(*x, first) for x, first in best.values()}
    assert store.committed()["upto"] == 8 and len(store._names("state")) <= 2 * 2


def test_upserts_after_a_failed_fold(spark):
    path = replay.fresh(spark, "failed")
    store = Upserts(spark, path, "id string, rev int, seq long", "id", "rev", "seq", buckets=2, every=100)
    store.sink(spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "id string, rev int, seq long"), 0)
    spark.createDataFrame([("a", 9, 9, 9, "0")], "id string, rev int, seq long, first_arrival long, bucket string").write.partitionBy("bucket").parquet(f"{path}/base/version=1")  # never committed
    assert {x.id: x.rev for x in store.view().collect()} == {"a": 0, "b": 0}
    store.fold()
    store.sink(spark.createDataFrame([("a", 1, 3)], "id string, rev int, seq long"), 1)
    assert {(x.id, x.rev, x.first_arrival) for x in store.view().collect()} == {("a", 1, 1), ("b", 0, 2)}
    assert store.fold()["upto"] == 1 and store.fold()["upto"] == 1 and {x.rev for x in store.view().collect()} == {0, 1}
