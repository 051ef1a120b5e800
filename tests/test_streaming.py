"""Streams give the rows of their batch forms; sinks fail alone and replay safely."""

import datetime

from pyspark.sql import functions as F

from sightline.operators import dedup, segment
from sightline.sources import testdata as td
from sightline.sources.synthetic import SyntheticPasses, open_source, plan_pass
from sightline.streaming import operators as so
from sightline.streaming import sinks

SF = "/root/testdata/sf0.001"


def streamed(spark, df, build, tmp_path, parts=3):
    """build(stream of df), run to its end, as a table."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(parts).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(source)
    q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_tracker_dedup(spark, tmp_path):
    s = td.sightings(spark, SF)
    got = streamed(spark, s, lambda d: so.tracker_dedup(d, ["source_id", "payload"], "ts_us", td.WINDOW), tmp_path)
    want = dedup.tracker_dedup(s, ["source_id", "payload"], "ts_us", td.WINDOW)
    assert sorted(map(tuple, got.select("source_id", "payload", "ts_us").collect())) == sorted(map(tuple, want.collect()))


def test_cross_camera(spark, tmp_path):
    rows = td.sightings(spark, SF).select("payload", "source_id", F.col("ts_us").alias("at"), "arrival_seq", F.col("event_id").alias("frame"), F.col("first_seen_us").alias("first_seen"), F.col("ts_us").alias("first_decode"), "decode_count")
    got = streamed(spark, rows, lambda d: so.cross_camera(d, td.WINDOW), tmp_path)
    pick = lambda d: sorted(map(tuple, d.select("payload", "arrival_seq", "source_id", "action", "anchor", "revision", "n_cameras", "decode_count", "best_camera").collect()), key=repr)
    assert pick(got) == pick(dedup.cross_camera(rows, td.WINDOW))


def test_segments(spark, tmp_path):
    f = td.frames(spark, SF).select(F.col("payload").alias("source_id"), "frame_index", "active", "discontinuity")
    got = streamed(spark, f, lambda d: so.segment_events(d, 2, 3), tmp_path)
    want = segment.segments(f, ["source_id"], "frame_index", "active", 2, 3, gap="discontinuity")
    opened = sorted((r.source_id, r.frame_index) for r in got.where("kind = 'open'").collect())
    closed = sorted((r.source_id, r.frame_index) for r in got.where("kind = 'close'").collect())
    assert opened == sorted((r.source_id, r.first_frame) for r in want.collect())
    last = {(r.source_id, r.last_frame) for r in want.collect()}
    assert set(closed) <= last and len(closed) >= len(last) - want.select("source_id").distinct().count()


def test_misses_come_after_the_deadline(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    first = [("m", "open", None, at(0)), ("m", "close", None, at(5)), ("p", "open", None, at(0)), ("p", "decode", "X", at(1)), ("p", "decode", "X", at(2)), ("p", "close", None, at(5))]
    schema = "candidate_id string, kind string, payload string, at timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source + "/1")
    spark.createDataFrame([("z", "open", None, at(500))], schema).coalesce(1).write.parquet(source + "/2")
    spark.createDataFrame([("y", "open", None, at(501))], schema).coalesce(1).write.parquet(source + "/3")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    q = so.misses(stream, 2000, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.candidate_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["m"]


def test_sinks_fail_alone_and_replay(spark, tmp_path):
    batch = spark.createDataFrame([("e1", 0), ("e2", 1)], "event_id string, revision int")

    def broken(df, i):
        raise OSError("down")

    counts = {}
    write = sinks.fan_out({"broken": broken, "log": sinks.log_sink(str(tmp_path / "log")), "outbox": sinks.outbox_sink(str(tmp_path / "box"))}, counts)
    write(batch, 0)
    write(batch, 0)  # the same batch again
    assert counts == {"broken": {"ok": 0, "failed": 2}, "log": {"ok": 2, "failed": 0}, "outbox": {"ok": 2, "failed": 0}}
    assert sinks.read_log(spark, str(tmp_path / "log")).count() == 2 and spark.read.parquet(str(tmp_path / "box")).count() == 2


def test_losses_are_a_table(spark, tmp_path):
    batch = spark.createDataFrame([("e1", 0), ("e2", 1)], "event_id string, revision int")
    down = [True]

    def sink(df, i):
        if down[0]:
            raise OSError("down")

    path = str(tmp_path / "losses")
    write = sinks.fan_out({"a": sink, "b": lambda df, i: None}, losses=path)
    write(batch, 0)
    write(batch, 0)  # the same batch again counts once
    write(batch, 1)
    assert sorted((r.batch_id, r.sink, r.rows, r.error) for r in sinks.read_losses(spark, path).collect()) == [(0, "a", 2, "OSError('down')"), (1, "a", 2, "OSError('down')")]
    down[0] = False
    sinks.fan_out({"a": sink}, losses=path)(batch, 1)  # a later run that succeeds takes its batch's loss back
    assert [r.batch_id for r in sinks.read_losses(spark, path).collect()] == [0]


def test_delivery_keeps_order(spark):
    box = spark.createDataFrame([(i, f"e{i}", "bad" if i == 2 else "ok") for i in range(5)], "seq long, event_id string, body string").coalesce(1)
    got = sinks.deliver(box, lambda body: body == "ok", tries=2, wait=lambda _: 0.0).orderBy("seq").collect()
    assert [r.delivered for r in got][:3] == [True, True, False]
    assert sinks.backoff(0, jitter=lambda: 0.5) == 1.0 and sinks.backoff(20, jitter=lambda: 0.5) == 60.0


def test_synthetic_source(spark, tmp_path):
    a = sorted(map(tuple, open_source(spark, "synthetic", passes=40, seed=7, partitions=3).collect()))
    assert a == sorted(map(tuple, open_source(spark, "synthetic", passes=40, seed=7, partitions=9).collect())) and a[3] == plan_pass(3, 7)
    spark.dataSource.register(SyntheticPasses)
    stream = spark.readStream.format("synthetic-passes").option("passes", 20).option("batch", 10).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "o")).count() >= 10


def test_windowed_rates(spark):
    rows = [(datetime.datetime(2026, 1, 1, 0, m), "A", k) for m, k in ((1, "pass"), (2, "miss"), (30, "pass"))]
    got = so.windowed_rates(spark.createDataFrame(rows, "at timestamp, source_id string, kind string"), "at", "1 hour", "1 hour").first()
    assert (got.passes, got.misses) == (2, 1)


def test_nothing_is_lost_while_the_endpoint_is_down(spark, tmp_path):
    """Through the fan-out: bodies wait in the outbox and go out later, once each, in their order."""
    import os

    answers, heard = str(tmp_path / "up"), str(tmp_path / "heard")

    def send(url, body):  # the endpoint is up when its file is there
        if not os.path.exists(answers):
            return False
        with open(heard, "a") as f:
            f.write(body + "\n")
        return True

    box, counts, lost = str(tmp_path / "box"), {}, {}

    def broken(df, i):
        raise OSError("disk full")

    write = sinks.fan_out({"http": sinks.http_sink(box, "http://h", send, tries=1, wait=lambda _: 0.0), "broken": broken}, counts, lost)
    batch = lambda k: spark.createDataFrame([(f"e{k}", 0), (f"e{k}", 1)], "event_id string, revision int")
    write(batch(0), 0)
    write(batch(1), 1)
    assert counts["http"] == {"ok": 2, "failed": 0} and lost == {"broken": 4} and sinks.pending(spark, box).count() == 4 and not os.path.exists(heard)
    open(answers, "w").close()
    write(batch(2), 2)
    lines = open(heard).read().splitlines()
    assert [x.split('"')[3] + x[-2] for x in lines] == ["e00", "e01", "e10", "e11", "e20", "e21"]
    assert sinks.pending(spark, box).count() == 0 and not [x for x in os.listdir(box) if x.startswith("batch_id=")]
    assert sinks.drain(spark, box, lambda body: send("", body)) == (6, 0) and len(open(heard).read().splitlines()) == 6


def test_lanes_keep_the_order_of_an_event(spark, tmp_path):
    box = spark.createDataFrame([(i, f"e{i % 5}", f"{i}") for i in range(40)], "seq long, event_id string, body string")
    got = sinks.deliver(box, lambda body: body != "7", tries=1, wait=lambda _: 0.0, lanes=4).collect()
    held = {r.seq for r in got if not r.delivered}
    assert len(got) == 40 and {i for i in range(40) if i % 5 == 2 and i >= 7} <= held and 0 not in held


def test_collector_counts_what_it_leaves_out(spark):
    kept = []
    write = sinks.collector_sink(kept, cap=5)
    for k in range(3):
        write(spark.range(3), k)
    assert len(kept[0]) == 5 and kept[1] == 4


def test_a_frame_without_activity_ends_its_source(spark, tmp_path):
    rows = [("a", i, True, False) for i in range(5)] + [("a", 5, None, False), ("a", 6, True, False), ("a", 7, True, False), ("b", 0, True, False), ("b", 1, True, False)]
    df = spark.createDataFrame(rows, "source_id string, frame_index long, active boolean, discontinuity boolean")
    got = sorted(map(tuple, streamed(spark, df, lambda d: so.segment_events(d, 2, 3), tmp_path, 1).collect()))
    assert got == [("a", 1, "close", 4), ("a", 1, "open", 0), ("a", 2, "open", 6), ("b", 1, "open", 0)]


def sighted(spark, rows):
    return spark.createDataFrame([("P", c, t, k, k, t, t, 1) for k, (c, t) in enumerate(rows)], "payload string, source_id string, at long, arrival_seq long, frame long, first_seen long, first_decode long, decode_count long")


def test_late_rows_are_never_dropped(spark, tmp_path):
    df = sighted(spark, [("A", 0), ("A", 1000), ("B", 5), ("B", 500)])  # the last two long after the rest
    got = streamed(spark, df, lambda d: so.cross_camera(d, 10), tmp_path, 1)
    assert [(r.action, r.anchor) for r in got.orderBy("arrival_seq").collect()] == [("emit", 0), ("emit", 1000), ("merge", 0), ("emit", 500)]


def test_the_slowest_camera_and_the_cap_forget(spark, tmp_path):
    df = sighted(spark, [("A", 0), ("A", 100), ("B", 4), ("A", 200), ("B", 102), ("B", 150), ("A", 300), ("A", 400), ("A", 500)])
    got = streamed(spark, df, lambda d: so.cross_camera(d, 10, cameras=["A", "B"], most=3), tmp_path, 1)
    want = dedup.cross_camera(df, 10, cameras=["A", "B"], most=3)
    rows = [(r.action, r.anchor, r.decode_count) for r in want.orderBy("arrival_seq", F.col("action").desc()).collect()]
    assert sorted((r.action, r.anchor, r.decode_count) for r in got.collect() if r.anchor is not None) == sorted(r for r in rows if r[1] is not None)
    assert [r[0] for r in rows] == ["emit", "emit", "merge", "emit", "merge", "emit", "emit", "evict", "emit", "evict", "emit"]
    assert [r[2] for r in rows if r[0] == "evict"] == [1, 1] and got.where("action = 'evict'").count() == 2
    fold = dedup.CrossCamera(10)
    for c, t in (("A", 0), ("A", 100), ("B", 4)):
        fold.absorb(t, c, t, t, 1, 0)
    assert fold.settle(["A", "B"]) == 0 and fold.settle(["A", "B", "C"]) == 0
    fold.absorb(50, "B", 50, 50, 1, 0)
    assert fold.settle(["A", "B"]) == 1 and fold.anchors == [50, 100]
