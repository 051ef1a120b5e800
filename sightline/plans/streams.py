"""Queries that run streams: stored rows land in arrival order, and what the stream has written is returned."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics, segment, tracking
from ..sources import testdata as td
from ..streaming import joins, live, replay, tracks
from ..streaming import metrics as live_metrics
from ..streaming import operators as so
from ..streaming import segments as live_segments
from ..streaming.upsert import Upserts
from .detection import CROSS, EVIDENCE, FLUSHED, LANES, PASS_OR_MISS, SEEDED, _blobs, passes_or_misses, timed_segments
from .registry import query
from .reporting import FPS, LATENCY, RATE_COUNTS
from .station import DEADLINES
from .storage import VIEW, _log

#: How much later than it happens each camera tells of a sighting, in hours; more than the window for the slowest.
LAGS = {"click": 0, "purchase": 1, "signup": 3, "view": 13}
LAGGED = CROSS.replace("ORDER BY arrival_seq, event_id", "ORDER BY ts_us + lag_us, event_id").replace("FROM sightings", "FROM lagged")
LAGGED = "--cte lagged AS (SELECT *, CASE source_id " + " ".join(f"WHEN '{c}' THEN {h * td.HOUR}" for c, h in LAGS.items()) + " END AS lag_us FROM sightings)," + LAGGED.removeprefix("--cte")
CUTOFF = "cut AS (SELECT min(h) // 1000 - $WINDOW // 1000 AS ms FROM (SELECT max(ts_us) AS h FROM sightings GROUP BY source_id))"


def _lagged(spark, sf_dir):
    """Each camera's sightings in its clock's order, some cameras late."""
    lag = F.coalesce(*[F.when(F.col("source_id") == c, F.lit(h * td.HOUR)) for c, h in LAGS.items()])
    return td.sightings(spark, sf_dir).select(
        "payload", "source_id", F.col("ts_us").alias("at"), (F.col("ts_us") + lag).alias("arrival_seq"), F.col("event_id").alias("frame"), F.col("first_seen_us").alias("first_seen"), F.col("ts_us").alias("first_decode"), "decode_count")


def _counts(actions):
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.groupBy("payload").agg(n("emit").alias("passes_emitted"), n("merge").alias("cross_camera_merges"), n("repeat").alias("repeats_suppressed"))


@query(LAGGED + " SELECT payload, z.em AS passes_emitted, z.mg AS cross_camera_merges, z.sp AS repeats_suppressed FROM r")
def stream_cross_camera(spark, sf_dir):
    """Cross-camera dedup in a stream that forgets what the slowest camera has left behind, against the fold that keeps all."""
    return _counts(live.replay_cross_camera(spark, _lagged(spark, sf_dir), td.WINDOW, td.CAMERAS)[0])


@query(LAGGED + f", {CUTOFF}, e AS (SELECT payload, unnest(z.a).t AS anchor FROM r) SELECT payload, anchor FROM e, cut WHERE anchor // 1000 >= ms")
def stream_cross_camera_state(spark, sf_dir):
    """What that stream still holds in the end: passes that the slowest camera can still reach, and no others."""
    return live.live_passes(spark, live.replay_cross_camera(spark, _lagged(spark, sf_dir), td.WINDOW, td.CAMERAS)[1]).select("payload", "anchor")


@query()
def stream_capped_dedup(spark, sf_dir):
    """The stream with at most four passes over all payloads after each micro-batch; evictions are actions. A brute-force fold is the test."""
    actions = live.run_capped(spark, _lagged(spark, sf_dir), td.WINDOW, td.CAMERAS, 4, 3)[0]
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.groupBy("payload").agg(n("emit").alias("passes_emitted"), n("merge").alias("cross_camera_merges"), n("evict").alias("forced_evictions"))


SEEDS = "seeds AS (SELECT payload, min(ts_us) - 3600000000 AS seed FROM sightings WHERE user_id % 2 = 0 GROUP BY 1)"


def _seeds(rows):
    """Passes of an earlier run, for every other user."""
    return rows.where("user_id % 2 = 0").groupBy("payload").agg((F.min("ts_us") - 3_600_000_000).alias("anchor"))


@query(LAGGED.replace("FROM o)", "FROM (SELECT o.payload, xs, seed FROM o LEFT JOIN seeds USING (payload)))").replace("lagged AS", f"{SEEDS}, lagged AS").replace(
    "{'a': []::STRUCT(t BIGINT, c VARCHAR[])[], ", "{'a': CASE WHEN seed IS NULL THEN []::STRUCT(t BIGINT, c VARCHAR[])[] ELSE [{'t': seed, 'c': ['click', 'purchase', 'signup', 'view']}] END, ")
    + " SELECT payload, z.em AS passes_emitted, z.mg AS cross_camera_merges, z.sp AS repeats_suppressed FROM r")
def stream_cross_camera_seeded(spark, sf_dir):
    """The stream started with passes of an earlier run: what is near a seed is suppressed, whichever camera it is of."""
    actions = live.replay_cross_camera(spark, _lagged(spark, sf_dir), td.WINDOW, td.CAMERAS, seeds=_seeds(td.sightings(spark, sf_dir)))[0]
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.groupBy("payload").agg(n("emit").alias("passes_emitted"), n("merge").alias("cross_camera_merges"), n("repeat", "restart_repeat").alias("repeats_suppressed"))


def _replayed(spark, rows, arrival, build, tag, batches=3):
    """rows run through build(stream) in order of arrival: what it has written, and its checkpoint."""
    base = replay.fresh(spark, tag)
    replay.land(rows, arrival, batches, {"": f"{base}/in"})
    with replay.settings(spark):
        return replay.finished(lambda: build(replay.source(spark, f"{base}/in", rows.schema)), f"{base}/out", f"{base}/checkpoint"), f"{base}/checkpoint"


@query(SEEDED)
def stream_tracker_dedup_seeded(spark, sf_dir):
    """Tracker dedup as a stream in time order, started with passes of an earlier run; a payload's state ends with its window."""
    rows = td.sightings(spark, sf_dir)
    build = lambda s: so.tracker_dedup(s.select("payload", "ts_us"), ["payload"], "ts_us", td.WINDOW, _seeds(rows), "0 seconds")
    return _replayed(spark, rows.select("payload", "ts_us"), "ts_us", build, "tracker")[0]


@query("--cte g AS (SELECT payload, list_sort(list(ts_us)) AS ts FROM sightings GROUP BY 1), p AS (SELECT payload, list_reduce(ts, lambda acc, x: CASE WHEN x - acc > $WINDOW THEN x ELSE acc END) AS last FROM g), cut AS (SELECT max(ts_us) // 1000 AS ms FROM sightings) SELECT payload, last FROM p, cut WHERE (last + $WINDOW) // 1000 >= ms")
def stream_tracker_state(spark, sf_dir):
    """What tracker dedup still holds when the stream is at its end: payloads whose window is open."""
    rows = td.sightings(spark, sf_dir).select("payload", "ts_us")
    checkpoint = _replayed(spark, rows, "ts_us", lambda s: so.tracker_dedup(s, ["payload"], "ts_us", td.WINDOW, lateness="0 seconds"), "tracker-state")[1]
    return replay.state(spark, checkpoint, "last").select("key.payload", "value.last")


def _with_ends(blobs):
    """Blobs with a last frame for each source, which ends it."""
    last = blobs.groupBy("source_id").agg((F.max("frame_index") + 1).alias("frame_index"))
    return blobs.unionByName(last, allowMissingColumns=True)


def _tracked(spark, blobs, tag, rules=None):
    return _replayed(spark, _with_ends(blobs), "frame_index", lambda s: tracks.object_tracks(s, rules), tag)[0]


@query(LANES, views=False)
def stream_object_tracks(spark, sf_dir):
    """Tracking as a stream, in lanes that never meet."""
    events = _tracked(spark, _blobs(spark, sf_dir), "lanes").where("kind <> 'primary'")
    return events.select("source_id", "kind", "segment", F.col("at_frame").alias("frame_index"))


def moving_blobs(spark, sf_dir):
    """Six objects a source that cross each other in two lanes, some frames unseen; those that touch are one blob, as a motion
    mask would have it: so they meet, merge and split."""
    line, frame = td.table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") % 997).cast("long")
    k = F.col("l_partkey") % 6
    seen = line.select(F.format_string("cam%d", F.col("l_linenumber") % 4).alias("source_id"), frame.alias("frame_index"), k.alias("k")).distinct()
    x = F.when(F.col("k") % 2 == 0, F.col("frame_index") * (2 + F.col("k")) % 900).otherwise(900 - F.col("frame_index") * (1 + F.col("k")) % 900)
    boxes = seen.select("source_id", "frame_index", (F.col("k").cast("int") % 3 % 2 * 300).alias("y"), x.cast("int").alias("x"), (60 + 8 * F.col("k")).cast("int").alias("w"))
    w = Window.partitionBy("source_id", "frame_index", "y").orderBy("x", "w")
    reach = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = boxes.withColumn("part", F.sum((F.col("x") > F.coalesce(reach, F.lit(-1))).cast("int")).over(w))
    blobs = parts.groupBy("source_id", "frame_index", "y", "part").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("_to"), F.sum(F.col("w") * 50).cast("int").alias("area"))
    return blobs.select("source_id", "frame_index", (F.col("frame_index") % 331 == 0).alias("discontinuity"), "x", "y", (F.col("_to") - F.col("x")).alias("w"), F.lit(50).alias("h"), "area")


RULES = tracking.Rules(diagonal=600.0)


@query()
def stream_crossing_tracks(spark, sf_dir):
    """Opens, closes and the primary track of each frame where objects meet, merge and split; a brute-force tracker is the test."""
    return _tracked(spark, moving_blobs(spark, sf_dir), "crossing", RULES)


@query()
def crossing_tracks(spark, sf_dir):
    """The batch form over the same blobs."""
    return tracking.track_objects(moving_blobs(spark, sf_dir), RULES)


def _last_metrics(spark, rows, key, tag, **options):
    """The row that each source's metrics end with."""
    told = _replayed(spark, rows, "arrival", lambda s: live_metrics.live_metrics(s, key, **options), tag)[0]
    return told.groupBy(key).agg(F.max_by(F.struct(*[c for c in told.columns if c != key]), "n_rows").alias("m")).select(key, "m.*")


def _metric_rows(spark, sf_dir, key):
    t = td.timed(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "miss").otherwise("pass")
    return t.select(F.col(key), F.col("ts_us").alias("at"), kind.alias("kind"), F.col("event_id").alias("seq"), "value", F.col("ts_us").alias("arrival"))


@query(RATE_COUNTS)
def stream_rates(spark, sf_dir):
    """Rolling counts and rates of the last hour and day, live, up to a frame half an hour after the last event."""
    rows = _metric_rows(spark, sf_dir, "user_id")
    idle = rows.groupBy("user_id").agg((F.max("at") + td.HOUR // 2).alias("at")).withColumn("arrival", F.col("at"))
    last = _last_metrics(spark, rows.unionByName(idle, allowMissingColumns=True), "user_id", "rates")
    out = last.select("user_id", *metrics.rate_columns(1_000_000))
    return out.withColumns({c: F.round(c, 6) for c in ("passes_per_hour", "read_rate_1h", "read_rate_24h")})


@query(FPS)
def stream_fps(spark, sf_dir):
    """Frames per second of the last day, live."""
    last = _last_metrics(spark, _metric_rows(spark, sf_dir, "user_id"), "user_id", "fps", window=86_400)
    now = F.col("last_ts") / 1e6 + 0.25
    coverage = F.lit(86_399) + now - F.floor(now)
    return last.select("user_id", F.round(F.col("in_window") / F.greatest(F.least(now - F.col("first_ts") / 1e6, coverage), F.lit(1e-9)), 9).alias("fps"))


@query(LATENCY, views=False)
def stream_latency_pct(spark, sf_dir):
    """Percentiles of each source's last samples, live."""
    rows = _metric_rows(spark, sf_dir, "event_type").withColumn("arrival", F.col("seq"))
    last = _last_metrics(spark, rows, "event_type", "latency", most=512)
    return last.select(F.col("event_type").alias("source_id"), "samples", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


def _joined(spark, rows, at, spans, end, build, tag, batches=3):
    """Two streams, landed up to the same instants, through build(rows, spans); the table, its checkpoint and what it is made of."""
    base = replay.fresh(spark, tag)
    ends = replay.cuts(rows.select(F.col(at).alias("_t")), "_t", batches)
    for k, (lo, hi) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
        for name, side, column in (("rows", rows, at), ("spans", spans, end)):
            part = side if lo is None else side.where(F.col(column) > lo)
            replay.land(part if hi is None else part.where(F.col(column) <= hi), column, 1, {"": f"{base}/{name}"}, ends=[])
    with replay.settings(spark):
        build_now = lambda: build(replay.source(spark, f"{base}/rows", rows.schema), replay.source(spark, f"{base}/spans", spans.schema))
        return replay.finished(build_now, f"{base}/out", f"{base}/checkpoint"), f"{base}/checkpoint"


@query(PASS_OR_MISS)
def stream_pass_or_miss(spark, sf_dir):
    """Decodes joined to the segments they fall in, both as streams; a segment none falls in is told when its time is over."""
    t = td.timed(spark, sf_dir)
    spans = t.groupBy(F.col("payload").alias("candidate")).agg(F.min("ts_us").alias("start"), F.max("ts_us").alias("end"))
    decodes = td.sightings(spark, sf_dir).select(F.col("payload").alias("candidate"), F.col("source_id").alias("payload"), "ts_us", "event_id")
    # Both sides go on for a day, so that the last spans' time is over too.
    spans = spans.unionByName(spans.agg(F.lit("station").alias("candidate"), *[(F.max("end") + td.DAY).alias(c) for c in ("start", "end")]))
    decodes = decodes.unionByName(spans.where("candidate = 'station'").select(F.lit("heartbeat").alias("candidate"), F.col("end").alias("ts_us")), allowMissingColumns=True)
    met = _joined(spark, decodes, "ts_us", spans, "end", lambda d, s: joins.rows_in_spans(d, "ts_us", s, "start", "end", ["candidate"], 40 * td.DAY, outer=True), "decodes")[0]
    return passes_or_misses(met.where("payload is not null"), met.where("candidate <> 'station'").select("candidate").distinct())


@query(EVIDENCE)
def stream_evidence_frames(spark, sf_dir):
    """Frames joined to the segments around which they lie, both as streams; each segment's sample is taken from what has met."""
    frames = td.frames(spark, sf_dir)
    spans = timed_segments(spark, sf_dir).select("*", (F.col("start") - td.DAY // 2).alias("since"), (F.col("end") + td.DAY // 2).alias("until"))
    near = _joined(spark, frames.select("user_id", "ts_us"), "ts_us", spans, "until", lambda f, s: joins.rows_in_spans(f, "ts_us", s, "since", "until", ["user_id"], 40 * td.DAY), "frames")[0]
    return segment.sampled(near, "user_id", "ts_us", 4)


#: A source is taken for silent after so long; the station's own heartbeat goes on, so that its time passes.
SILENCE = 35 * td.DAY


def _heartbeat(rows, at, later):
    """A last row of the station itself, `later` than all others."""
    return rows.unionByName(rows.agg((F.max(at) + later).alias(at)).withColumn("source_id", F.lit("station")), allowMissingColumns=True)


@query(FLUSHED)
def stream_segments_flushed(spark, sf_dir):
    """The last segment of each source: closed by its frames, or when the source has been silent for long."""
    frames = td.frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("source_id"), "frame_index", F.col("ts_us").alias("at"), "active", F.lit(False).alias("discontinuity"))
    beat = _heartbeat(frames, "at", SILENCE + td.DAY).fillna({"frame_index": 0, "active": False, "discontinuity": False})
    told = _replayed(spark, beat, "at", lambda s: live_segments.segment_events(s, 2, 3, SILENCE), "flushed")[0].where("kind = 'close'")
    last = told.groupBy("source_id").agg(F.max_by("frame_index", "seq").alias("closed_at"), F.max("seq").alias("seq"))
    return last.select(F.col("source_id").cast("long").alias("user_id"), "seq", "closed_at")


MISSED = DEADLINES.replace("SELECT user_id, seq, e + 7200000000 AS settled FROM seg", "SELECT user_id, seq, e + 7200000000 AS settled, row_number() OVER (PARTITION BY user_id ORDER BY e, seq) AS place FROM seg")


@query(MISSED)
def stream_misses(spark, sf_dir):
    """Segments that no payload confirms until a while after their end, told one after another as their deadlines pass."""
    found = timed_segments(spark, sf_dir)
    none = F.lit(None).cast("string").alias("payload")
    source = F.col("user_id").cast("string").alias("source_id")
    rows = found.select(source, F.lit("open").alias("kind"), F.col("start").alias("at"), "seq", none).unionByName(found.select(source, F.lit("close").alias("kind"), F.col("end").alias("at"), "seq", none))
    decodes = td.frames(spark, sf_dir).where("event_type <> 'error'").select(source, F.lit("decode").alias("kind"), F.col("ts_us").alias("at"), F.lit(None).cast("long").alias("seq"), F.col("event_type").alias("payload"))
    beat = _heartbeat(rows.unionByName(decodes), "at", td.DAY).fillna({"kind": "gap"})
    told = _replayed(spark, beat, "at", lambda s: live_segments.misses(s, 2 * td.HOUR, 2), "misses")[0]
    return told.select(F.col("source_id").cast("long").alias("user_id"), "seq", "settled", "place")


@query(f"WITH {VIEW} SELECT * FROM view", views=False)
def stream_current_view(spark, sf_dir):
    """The current view of a log that arrives in micro-batches and is folded into buckets every second one."""
    log, base = _log(spark, sf_dir), replay.fresh(spark, "upserts")
    replay.land(log, "ingest_seq", 5, {"": f"{base}/in"})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    view = Upserts(spark, f"{base}/store", schema, "event_id", "revision", "ingest_seq", buckets=8, every=2)
    query = replay.source(spark, f"{base}/in", log.schema).writeStream.foreachBatch(view.sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return view.view()
