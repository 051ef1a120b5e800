"""Golden cases of storage, reconciliation, reports and analytics."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.functions import expressions as ex
from sightline.functions.stats import exclusive_p95, nearest_rank, ratio
from sightline.operators import analytics, metrics, reconcile, reports, store
from sightline.plans import reporting
from sightline.sources import files


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_current_view(spark):
    log = spark.createDataFrame([("a", 1, 0, "x"), ("a", 0, 1, "stale"), ("a", 1, 2, "same again"), ("b", 0, 3, "y")], "id string, revision int, seq long, v string")
    assert rows(store.current_view(log, "id", "revision", "seq"), "id", "v", "first_arrival") == [("a", "same again", 0), ("b", "y", 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 11, 31, 51, 100])
def test_nearest_rank_is_half_to_even(spark, n):
    df = spark.createDataFrame([("k", float(i)) for i in range(n)], "k string, v double")
    got = nearest_rank(df, ["k"], "v", {"a": 0.5, "b": 0.95}).first()
    assert (got.a, got.b) == (float(round(0.5 * (n - 1))), float(round(0.95 * (n - 1))))


def test_ab_report(spark):
    detail = lambda n: {c: (0.0, 0.5, 1.0, k) for c, k in n.items()}
    passes = [({"B": 4, **({"A": 2} if i < 8 else {})},) for i in range(10)]
    df = spark.createDataFrame([(p[0], detail(p[0])) for p in passes], "cameras map<string,int>, camera_detail map<string,struct<first_seen_ts:double,first_decode_ts:double,last_seen_ts:double,decode_count:int>>")
    report = reports.ab_report(reports.camera_entries(df), spark.createDataFrame([("A",), ("A",), (None,)], "source_id string"))
    got = {r.source_id: r for r in report.collect()}
    a, b = got["A"], got["B"]
    assert (a.passes_seen, a.passes_decoded, a.read_rate, a.misses, a.decodes_per_pass) == (10, 8, 0.8, 2, 2.0)
    assert (b.passes_seen, b.passes_decoded, b.read_rate, b.misses) == (10, 10, 1.0, 0)
    assert reports.best_camera(report).first().source_id == "B"
    text = reports.whole(reports.ab_markdown(report, 10, 2))
    assert "| read rate | 80.0% | 100.0% |" in text and "**B**" in text
    assert text.splitlines()[5:7] == ["| metric | A | B |", "| --- | --- | --- |"]
    assert reports.whole(reports.ab_csv(report), "\r\n").splitlines()[1] == "A,10,8,0.800000,0.500000,0.500000,2.0000,2"
    assert "No pass data" in reports.whole(reports.ab_markdown(report.limit(0), 0, 0))


def test_legacy_rows_have_no_times(spark):
    df = spark.createDataFrame([({"A": 4}, None), ({"A": 1}, {})], "cameras map<string,int>, camera_detail map<string,struct<first_seen_ts:double,first_decode_ts:double,last_seen_ts:double,decode_count:int>>")
    assert rows(reports.camera_entries(df).withColumn("none", F.col("ttfd").isNull()), "source_id", "decode_count", "none") == [("A", 1, True), ("A", 4, True)]


def test_time_windows(spark):
    stamps = ["2026-01-01T08:00:00Z", "2026-01-01T10:30:00Z", "2026-01-01T12:30:00+02:00", "2026-01-01T13:00:00Z", "junk", None]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").withColumn("at", ex.stamp(F.col("s")))
    lo, hi = (F.lit(t).cast("timestamp") for t in ("2026-01-01 10:00:00", "2026-01-01 11:00:00"))
    assert df.where(ex.in_window(F.col("at"), lo, hi)).count() == 4  # two inside, two unknown
    assert df.where(ex.in_window(F.col("at"), lo, F.lit(None).cast("timestamp"))).count() == 5


def test_manifest(spark, tmp_path):
    cases = {"Pallet_ID\r\nPLT-1\r\nPLT-2\r\n\r\nPLT-1\r\nPLT-3\r\n": ["PLT-1", "PLT-2", "PLT-3"], "code\nid\n": ["id"], "﻿payload\nA,x\n\"B, c\",y\n": ["A", "B, c"]}
    for i, (text, want) in enumerate(cases.items()):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(text.encode())
        assert [r.payload for r in files.read_manifest(spark, str(path)).orderBy("pos").collect()] == want


def test_manifest_reconciliation(spark):
    manifest = spark.createDataFrame([("P1", 0), ("P2", 1), ("P3", 2), ("P4", 3)], "payload string, pos long")
    scanned = spark.createDataFrame([("P2", 0), ("P4", 1), ("P9", 2), ("P9", 3), (None, 4)], "payload string, pos long")
    status = reconcile.manifest_status(manifest, scanned)
    assert rows(status, "payload", "status") == [("P1", "missing"), ("P2", "matched"), ("P3", "missing"), ("P4", "matched"), ("P9", "unexpected")]
    counts = reconcile.manifest_counts(status).first()
    assert (counts.expected, counts.true_read_rate) == (4, 0.5)
    assert reconcile.manifest_counts(reconcile.manifest_status(manifest.limit(0), scanned)).first().true_read_rate is None
    assert reports.whole(reports.reconciliation_csv(status), "\r\n").splitlines()[1:] == ["P2,matched", "P4,matched", "P1,missing", "P3,missing", "P9,unexpected"]


def test_truth(spark):
    truth = spark.createDataFrame([(1, "A", 0, 10), (2, "B", 100, 110), (3, "C", 300, 310)], "pass_id int, payload string, t0 long, t1 long")
    passes = spark.createDataFrame([("A",)], "payload string")
    misses = spark.createDataFrame([(112, 120)], "start long, end long")
    out = reconcile.truth_outcome(truth, passes, misses, 2, 50)
    assert rows(out, "pass_id", "outcome") == [(1, "decoded"), (2, "missed"), (3, "unaccounted")]
    assert reconcile.truth_counts(truth.limit(0).withColumn("outcome", F.lit(""))).first().read_rate == 1.0


def test_rates_decay_while_idle(spark):
    events = spark.createDataFrame([("k", "pass", 10), ("k", "pass", 20), ("k", "miss", 30)], "k string, kind string, t long")
    got = []
    for end in (40, 7200, 90000):
        frames = spark.createDataFrame([("k", 0), ("k", end)], "k string, t long")
        r = metrics.rates(events, frames, ["k"], "t").first()
        got.append((r.read_rate_1h, r.read_rate_24h))
    assert got == [(2 / 3, 2 / 3), (None, 2 / 3), (None, None)]
    steady = spark.createDataFrame([("k", "miss" if i % 4 == 3 else "pass", i * 15) for i in range(40)], "k string, kind string, t long")
    r = metrics.rates(steady, spark.createDataFrame([("k", 0), ("k", 600)], "k string, t long"), ["k"], "t").first()
    assert r.read_rate_1h == 0.75 and r.passes_per_hour == 180.0


def test_snapshot_counts_all_samples_of_a_hot_key(spark, tmp_path):
    n = (1 << 20) + 5
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1000).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert [r.samples for r in reporting.snapshot(spark, str(tmp_path)).collect()] == [n]


def memory(spark, samples):
    return spark.createDataFrame([("k", float(t), float(mb)) for t, mb in samples], "k string, t double, mb double")


def test_memory_verdicts(spark):
    v = lambda s: analytics.rss_verdict(memory(spark, s), ["k"], "t", "mb", 1.0).first()
    assert v([(t, 100 + 0.2 * (-1) ** t) for t in range(0, 120, 2)]).ok
    leak = v([(t, 100 + 0.5 * t) for t in range(0, 120, 2)])
    assert not leak.ok and abs(leak.slope_mb_min - 30) < 1e-6
    assert not v([(0, 100), (2, 100), (4, 100)]).ok
    knee = lambda s: analytics.warmup(memory(spark, s), ["k"], "t", "mb").first().warmup_s
    assert 95 <= knee([(t, 100 + min(t, 100)) for t in range(0, 361, 2)]) <= 130
    assert knee([(t, 100 + 0.5 * t) for t in range(0, 359, 2)]) == 179.0
    assert 45 <= knee([(t, 100 + 0.3 * (-1) ** (t // 2)) for t in range(0, 361, 2)]) <= 50


def test_cpu_and_series(spark):
    df = spark.createDataFrame([("c", float(i)) for i in range(1, 101)], "k string, v double")
    r = analytics.cpu_summary(df, ["k"], "v").first()
    assert (r.avg, r.p95, r.max) == (50.5, 96.0, 100.0)
    s = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 10), ("b", 1, 20)], "name string, i long, v long")
    assert rows(analytics.aligned_sum(s, "name", "i", "v"), "i", "total") == [(0, 11), (1, 22)]
    assert ratio(F.lit(1), F.lit(0)) is not None
    assert exclusive_p95(df, ["k"], "v").first().p95 == 95.95


def test_blur_gate(spark):
    make = lambda rates, blur: spark.createDataFrame([(float(e), blur, i < n) for e, n in enumerate(rates) for i in range(100)], "e double, b double, d boolean")
    gate = lambda df: analytics.blur_gate(df, "e", "b", "d", [0, 1, 2, 4], 2, 50).first().passed
    assert gate(make([90, 80, 82], 3.0)) and not gate(make([80, 90, 70], 3.0)) and not gate(make([90, 80], 0.5))


def test_outbox(spark):
    box = spark.createDataFrame([(i, "x" * 10, 1000.0 + i) for i in range(10)], "seq long, body string, enqueued_utc double")
    assert rows(store.prune_outbox(box, 1010.0, 1.0, 35, in_flight=2), "seq") == [(2,), (8,), (9,)]
    assert store.prune_outbox(box, 1010.0 + 86400, 1.0, 1000).count() == 0
    assert store.prune_outbox(box.limit(0), 0.0, 1.0, 10).count() == 0
    assert store.outbox_stats(box, 1011.0).first() == (10, 100, 0, 11.0)
    assert store.clamp_limit(0) == 1 and store.clamp_limit(10_000) == 500


def test_events_round_trip(spark, tmp_path):
    from sightline.sources import schemas

    e = {"kind": "pass", "payload": "P", "first_seen_ts": 1.0, "last_seen_ts": 2.0, "decode_count": 3, "cameras": {"A": 3}, "best_frame": ["A", 7], "candidate_ids": ["A-1"], "event_id": "e1", "revision": 1}
    (tmp_path / "e.jsonl").write_text(json.dumps(e) + "\n{broken\n")
    df = files.read_events(spark, str(tmp_path / "e.jsonl")).cache()
    assert df.where("_corrupt_record is null").first().best_frame == ("A", 7) and df.count() == 2
    files.append_events(df.where("_corrupt_record is null"), str(tmp_path / "out"))
    assert files.read_events(spark, str(tmp_path / "out")).first().cameras == {"A": 3}
    with pytest.raises(ValueError):
        files.upgrade(df, schemas.VERSION + 1)
    assert files.upgrade(df.drop("revision"), 1).first().revision == 0


def test_truth_round_trip(spark, tmp_path):
    line = {"pass_id": 1, "payload": "P", "symbology": "qr", "first_frame": 3, "last_frame": 9, "speed_mph": 4.5, "direction": "left", "truncated": True}
    (tmp_path / "t.jsonl").write_text(json.dumps(line) + "\n")
    df = files.read_truth(spark, str(tmp_path / "t.jsonl"))
    assert df.first().params == {"speed_mph": "4.5", "direction": "left", "truncated": "true"}
    files.write_truth(df, str(tmp_path / "again"))
    assert json.loads(spark.read.text(str(tmp_path / "again")).first().value) == line


def test_bursts(spark, tmp_path):
    for name, meta, frames in (("a", {"candidate_id": "a", "outcome": "pass", "payloads": ["P"], "roi": [1, 2, 3, 4]}, 2), ("b", {"candidate_id": "b", "roi": [1]}, 1), ("c", {"candidate_id": "c"}, 0), ("d", None, 1)):
        d = tmp_path / "day" / name
        d.mkdir(parents=True)
        (d / "meta.json").write_text(json.dumps(meta) if meta else "{nope")
        for i in range(frames):
            (d / f"frame_{i:06d}.jpg").write_bytes(b"x")
    got = files.find_bursts(spark, str(tmp_path)).collect()
    assert [(r.candidate_id, r.outcome, r.roi) for r in got] == [("a", "pass", [1, 2, 3, 4]), ("b", "miss", None)]
    assert [r.frame_index for r in files.burst_frames(spark, str(tmp_path / "day" / "a")).collect()] == [0, 1]


def test_payload_bytes(spark):
    df = spark.createDataFrame([(b"PLT-\xc3\xa9",), (b"PLT-\xe9",)], "b binary").select(ex.payload_text(F.col("b")).alias("p"))
    assert [r.p for r in df.collect()] == ["PLT-é", "PLT-é"]


def test_sessions(spark):
    sessions = spark.createDataFrame([(1, 0, 100, 2), (2, 200, 300, 3)], "id long, started long, ended long, expected long")
    events = spark.createDataFrame([("pass", 50), ("miss", 100), ("pass", 150), ("pass", 210)], "kind string, at long")
    counts = reports.session_counts(sessions, events, 40)
    assert rows(counts, "id", "decoded", "missed", "shortfall") == [(1, 1, 1, 0), (2, 1, 0, 2)]
    notes = spark.createDataFrame([(2, "  ")], "id long, note string")
    assert rows(reports.may_close(counts, notes), "id", "may_close") == [(1, True), (2, False)]
    session = spark.createDataFrame([(1, "open", 1)], "id long, status string, decoded long")
    cameras = spark.createDataFrame([("b", 2, 1, 1), ("a,1", 3, 3, 0)], "source_id string, passes_seen long, passes_decoded long, misses long")
    assert reports.whole(reports.session_csv(session, cameras.limit(0)), "\r\n").startswith("field,value\r\nid,1\r\nstatus,open\r\nstarted_utc,\r\n")
    status = spark.createDataFrame([("P", "missing", 1), ("Q", "matched", 2)], "payload string, status string, pos long")
    text = reports.whole(reports.session_csv(session, cameras, status), "\r\n")
    assert text.endswith('\r\n\r\ncamera,passes_seen,passes_decoded,misses\r\n"a,1",3,3,0\r\nb,2,1,1\r\n\r\npayload,status\r\nQ,matched\r\nP,missing\r\n')


def test_modes(spark):
    df = spark.createDataFrame([("d", 1, 30.0, 29.0, 100, "MJPG"), ("d", 2, 30.0, 28.5, 100, "YUY2"), ("d", 3, 60.0, 20.0, 900, "YUY2")], "d string, mode int, requested_fps double, achieved_fps double, area int, fourcc string")
    assert analytics.choose_mode(df, ["d"], ["YUY2"]).first().mode == 2


@pytest.mark.parametrize("seed", range(3))
def test_pruning_by_size_equals_brute_force(spark, seed, monkeypatch):
    """With ranges so small that the cut is searched for in several steps; an early outlier, ties and protected rows."""
    import random

    monkeypatch.setattr(store, "CELLS", 4)
    monkeypatch.setattr(store, "CUT_ROWS", 5)
    r = random.Random(seed)
    found = [(f"d{i:03d}", float(r.choice([r.randint(900, 1000), 950])) if i else 1.0, r.randint(0, 9), r.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(found, "dir string, mtime double, size long, held boolean")
    for cap in (0, 50, 400, 100_000):
        total, want = 0, set()
        safe = sum(s for *_, s, h in found if h)
        for d, _, s, h in sorted(found, key=lambda x: (-x[1], [-ord(c) for c in x[0]])):
            total += s
            safe -= s * h
            if h or total + safe <= cap:
                want.add(d)
        assert {x.dir for x in store._kept_by_size(df, "mtime", "dir", "size", cap, F.col("held")).collect()} == want
    assert store._kept_by_size(df.limit(0), "mtime", "dir", "size", 5, F.col("held")).count() == 0


def test_nearest_anchor_keeps_repeated_rows(spark):
    seen = spark.createDataFrame([("a", 10), ("a", 10), ("a", 100), (None, 5)], "k string, t long")
    anchors = spark.createDataFrame([("a", 8), ("a", 12)], "k string, anchor long")
    got = reconcile.nearest_anchor(seen, anchors, "k", "t", 20).collect()
    assert sorted(((r.k, r.t, r.anchor) for r in got), key=repr) == [("a", 10, 8), ("a", 10, 8), ("a", 100, None), (None, 5, None)]


def test_rates_without_keys(spark):
    frames = spark.createDataFrame([(0,), (7200,)], "t long")
    events = spark.createDataFrame([("pass", 7000), ("miss", 7100), ("pass", 10)], "kind string, t long")
    got = metrics.rates(events, frames, [], "t").first()
    assert (got.p1, got.m1, got.p24, got.m24, got.read_rate_1h) == (1, 1, 2, 1, 0.5)
    assert metrics.rates(events.limit(0), frames, [], "t").first().read_rate_24h is None


def test_run_text(spark):
    counts = spark.createDataFrame([(100, 3, 7, 2, 4)], "frames long, dropped long, passes long, merged long, misses long")
    outcome = spark.createDataFrame([(1, "A", "decoded"), (2, "B", "unaccounted"), (3, "C", "missed"), (7, "D", "unaccounted")], "pass_id long, payload string, outcome string")
    lines = [r.line for r in reports.run_text(counts, outcome).orderBy("section", "place").collect()]
    assert lines == ["run summary", "frames 100, dropped 3", "passes 7, merged into others 2", "misses 4", "truth 4: decoded 1 (25.0%), missed 1, unaccounted 2", "unaccounted: pass 2, B", "unaccounted: pass 7, D"]
    none = [r.line for r in reports.run_text(counts, outcome.where("false")).orderBy("place").collect()]
    assert none[-1] == "truth 0: decoded 0 (100.0%), missed 0, unaccounted 0"


def test_variant_text(spark):
    rows = [("v", "a", "miss", ["P"], "P", "d1"), ("v", "b", "pass", ["P"], None, None), ("v", "c", "pass", ["P", "Q"], "Q", "d2"), ("v", "d", "pass", ["P"], "X", "d1"), ("w", "a", "miss", [], None, None)]
    df = spark.createDataFrame(rows, "variant string, candidate_id string, outcome string, truth array<string>, decoded string, decoder string")
    got = [(r.variant, r.line) for r in reports.variant_text(df).orderBy("variant", "section", "line").collect()]
    assert got == [("v", "| v | 3/4 | 75.0% | 1 | 2 |"), ("v", "read by d1=2, d2=1"), ("v", "reads the miss a as P by d1"), ("v", "loses the pass b of P to nothing"), ("v", "loses the pass d of P to X"), ("w", "| w | 0/1 | 0.0% | 0 | 0 |")]
