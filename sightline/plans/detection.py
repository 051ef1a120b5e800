"""Segmentation, dedup and cross-camera queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as ex
from ..operators import dedup, segment, tracking
from ..sources import testdata as td
from .registry import query

SEGMENTS = """{name} AS (
    SELECT {keys}, seq, first_frame, last_frame, n_active FROM (
      SELECT {keys}, min(t0) AS first_frame, max(t1) AS last_frame, sum(len)::BIGINT AS n_active, row_number() OVER (PARTITION BY {key} ORDER BY min(t0)) AS seq FROM (
        SELECT *, min(CASE WHEN len >= 2 THEN run END) OVER (PARTITION BY {key}, part, cluster) AS opens FROM (
          SELECT *, sum(CASE WHEN n0 - prev - 1 < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY {key}, part ORDER BY run) AS cluster FROM (
            SELECT *, lag(n1) OVER (PARTITION BY {key}, part ORDER BY run) AS prev FROM (
              SELECT {key}, part, run, min(n) AS n0, max(n) AS n1, min(frame_index) AS t0, max(frame_index) AS t1, count(*) AS len FROM (
                SELECT *, n - row_number() OVER (PARTITION BY {key}, part ORDER BY n) AS run FROM (
                  SELECT *, row_number() OVER (PARTITION BY {key}, part ORDER BY frame_index) AS n FROM (
                    SELECT *, {part} AS part FROM frames)) WHERE active)
              GROUP BY {key}, part, run))))
      WHERE run >= opens GROUP BY {key}, part, cluster))"""
PLAIN = SEGMENTS.format(name="segs", keys="user_id", key="user_id", part="0")
BROKEN = SEGMENTS.format(name="segs", keys="user_id", key="user_id", part="sum(discontinuity::INT) OVER (PARTITION BY user_id ORDER BY frame_index)")


def _segments(spark, sf_dir, **options):
    return segment.segments(td.frames(spark, sf_dir), ["user_id"], "frame_index", "active", 2, 3, **options)


def timed_segments(spark, sf_dir):
    """Segments (user_id, seq) with the instants of their first and last frames."""
    inside = segment.in_spans(td.frames(spark, sf_dir).select("user_id", "frame_index", "ts_us"), "frame_index", _segments(spark, sf_dir), ["user_id"], "first_frame", "last_frame", 1024)
    return inside.groupBy("user_id", "seq").agg(F.min("ts_us").alias("start"), F.max("ts_us").alias("end"))


@query(f"--cte {PLAIN} SELECT * FROM segs")
def segments(spark, sf_dir):
    """Hysteresis segments per source."""
    return _segments(spark, sf_dir)


@query(f"--cte {BROKEN} SELECT * FROM segs")
def segments_with_gaps(spark, sf_dir):
    """The same, a discontinuity being a hard boundary."""
    return _segments(spark, sf_dir, gap="discontinuity")


@query(f"--cte {PLAIN} SELECT user_id, seq, printf('%s-%s-%06d', 'src' || user_id, 'run1', seq) AS candidate_id, last_frame - first_frame + 1 AS span, greatest(1, round_even(0.25 * 12.0, 0))::INT AS open_frames, greatest(1, round_even(0.01 * 12.0, 0))::INT AS quiet_frames FROM segs")
def segment_ids(spark, sf_dir):
    """Candidate ids, and debounce seconds as frames."""
    fps = F.lit(12.0)
    return _segments(spark, sf_dir).select(
        "user_id", "seq", segment.candidate_id(F.concat(F.lit("src"), F.col("user_id")), "run1", F.col("seq")).alias("candidate_id"), (F.col("last_frame") - F.col("first_frame") + 1).alias("span"),
        ex.frames_of(F.lit(0.25), fps, F.lit(3)).alias("open_frames"), ex.frames_of(F.lit(0.01), fps, F.lit(3)).alias("quiet_frames"))


FLUSHED = f"--cte {PLAIN}, open_segs AS (SELECT user_id, max(seq) AS seq FROM segs GROUP BY user_id) SELECT s.user_id, s.seq, s.last_frame AS closed_at FROM segs s JOIN open_segs USING (user_id, seq)"


@query(FLUSHED)
def segments_flushed(spark, sf_dir):
    """The last segment of each source, which the end of the input closes."""
    found = _segments(spark, sf_dir)
    last = found.groupBy("user_id").agg(F.max_by("last_frame", "seq").alias("closed_at"), F.max("seq").alias("seq"))
    return last.select("user_id", "seq", "closed_at")


@query(f"""--cte {PLAIN}, d AS (SELECT DISTINCT user_id, frame_index FROM frames WHERE event_type = 'purchase')
SELECT user_id, seq, first_frame, last_frame, CASE WHEN last_frame - first_frame + 1 < 5 THEN 'rejected'
  WHEN EXISTS (SELECT 1 FROM d WHERE d.user_id = segs.user_id AND d.frame_index BETWEEN first_frame AND last_frame + 1) THEN 'decoded' ELSE 'missed' END AS verdict FROM segs""")
def bench_verdicts(spark, sf_dir):
    """Short segments are rejected; decodes shortly after still count."""
    frames = td.frames(spark, sf_dir)
    return segment.verdicts(_segments(spark, sf_dir), ["user_id"], frames.where("event_type = 'purchase'"), "frame_index", 5, 1)


@query("""--cte r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM timed),
s AS (SELECT *, (2 ** greatest(0, ceil(log2(n / 24.0))))::BIGINT AS stride FROM r) SELECT user_id, event_id, stride FROM s WHERE i % stride = 0""")
def reservoir(spark, sf_dir):
    """Bounded sample of each source's frames."""
    rows = td.timed(spark, sf_dir).select("user_id", "event_id", "ts_us")
    order = F.struct("ts_us", "event_id").alias("o")
    return segment.reservoir(rows.select("user_id", "event_id", order), ["user_id"], "o", 24).select("user_id", "event_id", "stride")


EVIDENCE = f"""--cte {PLAIN}, seg AS (SELECT user_id, seq, min(f.ts_us) AS s, max(f.ts_us) AS e FROM segs JOIN frames f USING (user_id) WHERE f.frame_index BETWEEN first_frame AND last_frame GROUP BY user_id, seq),
near AS (SELECT g.user_id, seq, f.ts_us, CASE WHEN f.ts_us <= s THEN 'pre' WHEN f.ts_us <= e THEN 'inside' ELSE 'post' END AS part FROM seg g JOIN frames f USING (user_id) WHERE f.ts_us BETWEEN s - 43200000000 AND e + 43200000000),
num AS (SELECT *, row_number() OVER (PARTITION BY user_id, seq, part ORDER BY ts_us) - 1 AS i, count(*) OVER (PARTITION BY user_id, seq, part) AS n FROM near)
SELECT user_id, seq, ts_us, part FROM num WHERE part <> 'inside' OR i % (2 ** greatest(0, ceil(log2(n / 4.0))))::BIGINT = 0"""


@query(EVIDENCE)
def evidence_frames(spark, sf_dir):
    """Pre-roll, sample and post-roll of each segment, by a join on time cells."""
    frames, spans = td.frames(spark, sf_dir), timed_segments(spark, sf_dir)
    return segment.frames_around(frames.select("user_id", "ts_us"), spans, "user_id", "ts_us", td.DAY, td.DAY // 2, td.DAY // 2, 4)


PASS_OR_MISS = "--cte d AS (SELECT payload AS candidate, source_id AS payload, count(*) AS decode_count, min(ts_us) AS first_decode, arg_min(event_id, ts_us) AS best FROM sightings GROUP BY 1, 2), c AS (SELECT * FROM d WHERE decode_count >= 12), every AS (SELECT DISTINCT payload AS candidate FROM timed) SELECT candidate, payload, decode_count, first_decode, best AS best_event, 'pass' AS outcome FROM c UNION ALL SELECT candidate, NULL, 0, NULL, NULL, 'miss' FROM every WHERE candidate NOT IN (SELECT candidate FROM c)"


@query(PASS_OR_MISS)
def pass_or_miss(spark, sf_dir):
    """Payloads confirmed by enough decodes are passes; segments without one are misses."""
    s = td.sightings(spark, sf_dir)
    decodes = s.select(F.col("payload").alias("candidate"), F.col("source_id").alias("payload"), "ts_us", "event_id")
    return passes_or_misses(decodes, td.timed(spark, sf_dir).select(F.col("payload").alias("candidate")).distinct())


def passes_or_misses(decodes, every):
    """Of each candidate its confirmed payloads, or a miss."""
    groups = decodes.groupBy("candidate", "payload").agg(F.count(F.lit(1)).alias("decode_count"), F.min("ts_us").alias("first_decode"), F.min_by("event_id", "ts_us").alias("best_event"))
    confirmed = groups.where("decode_count >= 12").withColumn("outcome", F.lit("pass"))
    none = every.join(confirmed.select("candidate").distinct(), "candidate", "left_anti")
    none = none.select("candidate", F.lit(None).cast("string").alias("payload"), F.lit(0).cast("long").alias("decode_count"), *[F.lit(None).cast("long").alias(c) for c in ("first_decode", "best_event")], F.lit("miss").alias("outcome"))
    return confirmed.unionByName(none)


GREEDY = "list_reduce(list_sort(list({t})), lambda acc, x: CASE WHEN x - acc[-1] > $WINDOW THEN list_append(acc, x) ELSE acc END, [list_min(list({t}))])"


@query("--cte g AS (SELECT source_id, payload, list_sort(list(ts_us)) AS ts FROM sightings GROUP BY 1, 2) SELECT source_id, payload, unnest(list_reduce(ts, lambda acc, x: CASE WHEN x - acc[-1] > $WINDOW THEN list_append(acc, x) ELSE acc END, [ts[1]])) AS ts_us FROM g")
def tracker_dedup(spark, sf_dir):
    """Per source and payload: sightings beyond the window of the last emitted one."""
    return dedup.tracker_dedup(td.sightings(spark, sf_dir), ["source_id", "payload"], "ts_us", td.WINDOW)


SEEDED = "--cte g AS (SELECT payload, list_sort(list(ts_us)) AS ts FROM sightings GROUP BY 1), s AS (SELECT payload, min(ts_us) - 3600000000 AS seed FROM sightings WHERE user_id % 2 = 0 GROUP BY 1) SELECT payload, unnest(CASE WHEN seed IS NULL THEN list_reduce(ts, lambda acc, x: CASE WHEN x - acc[-1] > $WINDOW THEN list_append(acc, x) ELSE acc END, [ts[1]]) ELSE list_reduce(ts, lambda acc, x: CASE WHEN x - acc[-1] > $WINDOW THEN list_append(acc, x) ELSE acc END, [seed])[2:] END) AS ts_us FROM g LEFT JOIN s USING (payload)"


@query(SEEDED)
def tracker_dedup_seeded(spark, sf_dir):
    """The same with anchors of an earlier run for some payloads."""
    rows = td.sightings(spark, sf_dir)
    seeds = rows.where("user_id % 2 = 0").groupBy("payload").agg((F.min("ts_us") - 3_600_000_000).alias("anchor"))
    return dedup.tracker_dedup(rows, ["payload"], "ts_us", td.WINDOW, seeds)


def _actions(spark, sf_dir, seeds=None):
    rows = td.sightings(spark, sf_dir).select("payload", "source_id", F.col("ts_us").alias("at"), "arrival_seq", F.col("event_id").alias("frame"), F.col("first_seen_us").alias("first_seen"), F.col("ts_us").alias("first_decode"), "decode_count")
    return dedup.cross_camera(rows, td.WINDOW, seeds)


CROSS = """--cte o AS (SELECT payload, list({'t': ts_us, 'c': source_id} ORDER BY arrival_seq, event_id) AS xs FROM sightings GROUP BY payload),
r AS (SELECT payload, list_reduce(xs, lambda acc, x: CASE
    WHEN len(list_filter(acc.a, lambda y: abs(y.t - x.t) <= $WINDOW)) = 0 THEN {'a': list_append(acc.a, {'t': x.t, 'c': [x.c]}), 'em': acc.em + 1, 'mg': acc.mg, 'sp': acc.sp}
    WHEN list_contains(list_filter(acc.a, lambda y: y.t = list_min(list_transform(acc.a, lambda z: {'d': abs(z.t - x.t), 't': z.t})).t)[1].c, x.c) THEN {'a': acc.a, 'em': acc.em, 'mg': acc.mg, 'sp': acc.sp + 1}
    ELSE {'a': list_transform(acc.a, lambda y: CASE WHEN y.t = list_min(list_transform(acc.a, lambda z: {'d': abs(z.t - x.t), 't': z.t})).t THEN {'t': y.t, 'c': list_append(y.c, x.c)} ELSE y END), 'em': acc.em, 'mg': acc.mg + 1, 'sp': acc.sp} END,
    {'a': []::STRUCT(t BIGINT, c VARCHAR[])[], 'em': 0::BIGINT, 'mg': 0::BIGINT, 'sp': 0::BIGINT}) AS z FROM o)"""


@query(CROSS + " SELECT payload, z.em AS passes_emitted, z.mg AS cross_camera_merges, z.sp AS repeats_suppressed FROM r")
def cross_camera_merge(spark, sf_dir):
    """Per payload: passes emitted, merged and suppressed, in arrival order."""
    n = lambda a: F.count_if(F.col("action") == a)
    return _actions(spark, sf_dir).groupBy("payload").agg(n("emit").alias("passes_emitted"), n("merge").alias("cross_camera_merges"), n("repeat").alias("repeats_suppressed"))


@query(CROSS + ", e AS (SELECT payload, unnest(z.a) AS p FROM r) SELECT payload, p.t AS anchor, len(p.c)::INT AS n_cameras, (len(p.c) - 1)::INT AS revision, p.c[1] AS first_camera FROM e")
def business_passes(spark, sf_dir):
    """The merged passes at their last revision."""
    actions = _actions(spark, sf_dir).where("action in ('emit', 'merge')")
    last = actions.groupBy("payload", "anchor").agg(F.max_by(F.struct("n_cameras", "revision"), "revision").alias("p"), F.min_by("source_id", "revision").alias("first_camera"))
    return last.select("payload", "anchor", "p.n_cameras", "p.revision", "first_camera")


@query(CROSS + " SELECT sum(z.em)::BIGINT AS passes_emitted, sum(z.mg)::BIGINT AS cross_camera_merges, sum(z.sp)::BIGINT AS repeats_suppressed, 0::BIGINT AS restart_repeats_suppressed, sum(z.mg)::BIGINT AS reemits FROM r")
def dedup_counters(spark, sf_dir):
    return dedup.counters(_actions(spark, sf_dir))


@query(CROSS + ", cut AS (SELECT min(h) - $WINDOW AS c FROM (SELECT max(ts_us) AS h FROM sightings GROUP BY source_id)), e AS (SELECT payload, unnest(z.a).t AS anchor FROM r) SELECT payload, anchor, anchor >= c AS alive FROM e, cut")
def reachable_passes(spark, sf_dir):
    """Which passes the slowest camera can still merge with."""
    rows = td.sightings(spark, sf_dir).select("source_id", F.col("ts_us").alias("at"))
    return dedup.reachable(_actions(spark, sf_dir), rows, td.WINDOW)


@query("--cte w AS (SELECT payload, ts_us, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, source_id FROM sightings) SELECT payload, max(least(ts_us - 1705276800000000, 0)) AS anchor FROM w WHERE iso >= '2024-01-13T23:59:00.000000+00:00' AND source_id = 'view' AND ts_us - 1705276800000000 <= 500000 GROUP BY payload")
def restart_seeds(spark, sf_dir):
    """Anchors from stored passes before a restart on 2024-01-15, of one camera."""
    at = F.col("ts_us")
    day = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ts_us / 1000000.0)"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = td.sightings(spark, sf_dir).select("payload", at.alias("wall_us"), day.alias("wall_iso"), F.create_map("source_id", F.col("decode_count").cast("int")).alias("cameras"))
    return dedup.restart_seeds(rows, 1_705_276_800_000_000, 86_400_000_000, 60_000_000, camera="view")


@query("--cte d AS (SELECT user_id, event_id, ts_us, source_id, decode_count, lag(decode_count) OVER (PARTITION BY user_id, source_id ORDER BY ts_us) AS before FROM sightings) SELECT user_id, source_id, median(abs(decode_count - before)) AS median_step, count(before) AS steps FROM d GROUP BY 1, 2")
def step_medians(spark, sf_dir):
    """Median of frame-to-frame differences per track."""
    w = Window.partitionBy("user_id", "source_id").orderBy("ts_us")
    rows = td.sightings(spark, sf_dir).withColumn("before", F.lag("decode_count").over(w))
    return rows.groupBy("user_id", "source_id").agg(F.median(F.abs(F.col("decode_count") - F.col("before"))).alias("median_step"), F.count("before").alias("steps"))


@query("""--cte r AS (SELECT payload, ts_us, value, ts_us - lag(ts_us) OVER (PARTITION BY payload ORDER BY ts_us) AS gap FROM sightings),
u AS (SELECT *, sum(CASE WHEN gap <= $WINDOW THEN 0 ELSE 1 END) OVER (PARTITION BY payload ORDER BY ts_us) AS run FROM r),
l AS (SELECT payload, run, list(value ORDER BY ts_us) AS v FROM u GROUP BY 1, 2)
SELECT payload, run::BIGINT AS run, round(z.e, 9) AS ema, z.n AS n_used FROM (SELECT payload, run, list_reduce(list_transform(v[2:], lambda q: {'e': q, 'n': 1::BIGINT}), lambda acc, x: CASE WHEN abs(x.e) > 4 * abs(acc.e) THEN acc ELSE {'e': acc.e + 0.3 * (x.e - acc.e), 'n': acc.n + 1} END, {'e': v[1], 'n': 1::BIGINT}) AS z FROM l)""")
def ema_speed(spark, sf_dir):
    """Smoothed values with an outlier gate, anew after a pause."""
    out = segment.ema_fold(td.sightings(spark, sf_dir), ["payload"], "ts_us", "value", 0.3, 4.0, td.WINDOW)
    return out.withColumn("ema", F.round("ema", 9))


def _blobs(spark, sf_dir):
    """Blobs in fifteen lanes, too far apart to meet; a gap at some frames."""
    q, frame = F.col("l_quantity"), (F.col("l_orderkey") % 997).cast("long")
    lanes = td.table(spark, sf_dir, "lineitem").groupBy(
        F.format_string("cam%d", F.col("l_linenumber") % 4).alias("source_id"), frame.alias("frame_index"), (F.col("l_partkey") % 5 * 200).cast("int").alias("x"), (F.col("l_suppkey") % 3 * 200).cast("int").alias("y"))
    sized = lanes.agg(F.max(q + 40).cast("int").alias("w"), F.max(q + 30).cast("int").alias("h"), F.max((q + 40) * (q + 30)).cast("int").alias("area"))
    return sized.withColumn("discontinuity", F.col("frame_index") % 331 == 0)


LANES = """WITH b AS (SELECT DISTINCT 'cam' || (l_linenumber % 4) AS source_id, l_orderkey % 997 AS frame_index, l_partkey % 5 * 200 AS x, l_suppkey % 3 * 200 AS y FROM lineitem),
f AS (SELECT source_id, frame_index, row_number() OVER w AS i, count(*) FILTER (frame_index % 331 = 0) OVER w AS block FROM (SELECT DISTINCT source_id, frame_index FROM b) WINDOW w AS (PARTITION BY source_id ORDER BY frame_index)),
p AS (SELECT *, lag(i) OVER w AS before, coalesce(lag(block) OVER w, -1) <> block AS apart FROM b JOIN f USING (source_id, frame_index) WINDOW w AS (PARTITION BY source_id, x, y ORDER BY frame_index)),
t AS (SELECT *, sum((apart OR i - before > 8)::INT) OVER w AS track, sum((apart OR i - before > 1)::INT) OVER w AS streak FROM p WINDOW w AS (PARTITION BY source_id, x, y ORDER BY frame_index)),
s AS (SELECT *, row_number() OVER w AS nth, min(frame_index) OVER w AS began FROM t WINDOW w AS (PARTITION BY source_id, x, y, streak ORDER BY frame_index)),
o AS (SELECT source_id, x, y, track, min(frame_index) AS spawned, max(frame_index) AS ended, min(frame_index) FILTER (nth >= 3) AS opened, arg_min(began, frame_index) FILTER (nth >= 3) AS began FROM s GROUP BY source_id, x, y, track),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY opened, spawned, x, y) AS segment FROM o WHERE opened IS NOT NULL)
SELECT source_id, 'open' AS kind, segment, began AS frame_index FROM n UNION ALL SELECT source_id, 'close', segment, ended FROM n"""


@query(LANES, views=False)
def multi_object_tracks(spark, sf_dir):
    """Open and close events of tracked objects. In lanes that never meet they are islands of frames, which the SQL finds; what
    happens where objects meet is tested on golden and random cases."""
    return tracking.track_objects(_blobs(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber,
  greatest(0, least(l_partkey % 700 - 50, 640))::INT AS cx, greatest(0, least(l_suppkey % 500 - 20, 360))::INT AS cy,
  (greatest(greatest(0, least(l_partkey % 700 - 50, 640)), least(l_partkey % 700 - 50 + l_quantity::INT, 640)) - greatest(0, least(l_partkey % 700 - 50, 640)))::INT AS cw,
  (greatest(greatest(0, least(l_suppkey % 500 - 20, 360)), least(l_suppkey % 500 - 20 + l_quantity::INT, 360)) - greatest(0, least(l_suppkey % 500 - 20, 360)))::INT AS ch,
  round(CASE WHEN greatest(0, least(l_partkey % 700 - 50 + l_quantity::INT, l_partkey % 700 - 40 + 30) - greatest(l_partkey % 700 - 50, l_partkey % 700 - 40)) > 0 THEN
    greatest(0, least(l_partkey % 700 - 50 + l_quantity::INT, l_partkey % 700 - 40 + 30) - greatest(l_partkey % 700 - 50, l_partkey % 700 - 40))::DOUBLE * least(l_quantity::INT, 30)
    / (l_quantity::INT * l_quantity::INT + 900 - greatest(0, least(l_partkey % 700 - 50 + l_quantity::INT, l_partkey % 700 - 40 + 30) - greatest(l_partkey % 700 - 50, l_partkey % 700 - 40))::DOUBLE * least(l_quantity::INT, 30)) ELSE 0.0 END, 6) AS overlap,
  round(sqrt((l_quantity - 5) ** 2 + 16), 6) AS apart FROM lineitem""", views=False)
def box_geometry(spark, sf_dir):
    """Clamping, overlap and distance of boxes."""
    line = td.table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    x, y = F.col("l_partkey") % 700 - 50, F.col("l_suppkey") % 500 - 20
    rows = line.select("l_orderkey", "l_linenumber", "l_quantity", ex.box(x, y, q, q).alias("a"), ex.box(x + 10, y, F.lit(30), F.lit(30)).alias("b"))
    rows = rows.withColumn("c", ex.clamp_box(F.col("a"), F.lit(640), F.lit(360)))
    apart = ex.distance(F.col("l_quantity"), F.lit(4.0), F.lit(5.0), F.lit(0.0))
    return rows.select("l_orderkey", "l_linenumber", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"), F.round(ex.iou(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(apart, 6).alias("apart"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(sqrt(l_quantity ** 2 + 1), sqrt((l_quantity - 1) ** 2 + 1), l_quantity), 6) AS side, round(sqrt(abs(l_quantity * (l_quantity + 1) - (l_quantity - 1) + (l_quantity - 1) * l_quantity) / 2), 6) AS root_area,
  round(l_quantity * 25.0 / 400 / (3.45 / 1000), 6) AS px_per_module, round(l_extendedprice * 2.0 / 1000 / 0.5, 6) AS blur FROM (SELECT * FROM lineitem)""", views=False)
def optics(spark, sf_dir):
    """Code size from a quadrangle, pixels per module, blur."""
    line = td.table(spark, sf_dir, "lineitem")
    q, one = F.col("l_quantity"), F.lit(1.0)
    points = [(F.lit(0.0), F.lit(0.0)), (q, one), (q - 1, q + 1), (F.lit(0.0), q)]
    side, area = ex.code_size(points)
    return line.select("l_orderkey", "l_linenumber", F.round(side, 6).alias("side"), F.round(area, 6).alias("root_area"), F.round(ex.pixels_per_module(q, F.lit(400.0), F.lit(25.0), F.lit(3.45)), 6).alias("px_per_module"), F.round(ex.blur_modules(F.col("l_extendedprice"), F.lit(2.0), F.lit(0.5)), 6).alias("blur"))


@query("""SELECT p_partkey, round(p_size * 3 / sqrt(2), 6) AS vx, round(p_size * 3 / sqrt(2), 6) AS vy, greatest(2, ceil(least((960 + 80) / (p_size * 3 / sqrt(2)), (540 + 60) / (p_size * 3 / sqrt(2)))))::INT AS frames FROM part WHERE p_size > 0""", views=False)
def trajectories(spark, sf_dir):
    """Frames a patch takes to cross a picture diagonally."""
    t = ex.trajectory(1.0, 1.0, F.lit(960), F.lit(540), F.lit(80), F.lit(60), F.col("p_size") * 3)
    return td.table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.round(t["vx"], 6).alias("vx"), F.round(t["vy"], 6).alias("vy"), t["frames"].alias("frames"))


@query(r"""--cte p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN payload || chr(7) WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'AB' ELSE payload || chr(29) || 'x' END AS payload, CASE WHEN event_id % 2 = 0 THEN 'qr' ELSE 'datamatrix' END AS symbology FROM timed)
SELECT event_id, payload <> '' AND NOT regexp_matches(payload, '[\x00-\x03\x05-\x08\x0B\x0C\x0E-\x1B\x1F]') AND NOT (symbology = 'datamatrix' AND length(payload) < 4) AS accepted, regexp_matches(payload, 'PLT-\d+5') AS by_pattern FROM p""")
def payload_gate(spark, sf_dir):
    """Which payloads are accepted, by the built-in rules and by a pattern."""
    e = F.col("event_id")
    payload = F.when(e % 11 == 0, F.concat("payload", F.lit("\x07"))).when(e % 13 == 0, "").when(e % 17 == 0, "AB").otherwise(F.concat("payload", F.lit("\x1dx")))
    rows = td.timed(spark, sf_dir).select("event_id", payload.alias("payload"), F.when(e % 2 == 0, "qr").otherwise("datamatrix").alias("symbology"))
    return rows.select("event_id", ex.payload_accepted(F.col("payload"), F.col("symbology")).alias("accepted"), ex.payload_accepted(F.col("payload"), F.col("symbology"), r"PLT-\d+5").alias("by_pattern"))


@query("""--cte b AS (SELECT l_linenumber % 4 AS source, l_orderkey % 997 AS frame, l_partkey % 50 AS blob, max(l_quantity) AS area FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY source, frame ORDER BY area DESC, blob) AS place FROM b) SELECT source::INT AS source, frame, blob, area, place = 1 AS primary_blob FROM k WHERE place <= 3""")
def top_blobs(spark, sf_dir):
    """The largest blobs of each frame, and the primary one."""
    blobs = td.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("source"), (F.col("l_orderkey") % 997).alias("frame"), (F.col("l_partkey") % 50).alias("blob")).agg(F.max("l_quantity").alias("area"))
    place = F.row_number().over(Window.partitionBy("source", "frame").orderBy(F.desc("area"), "blob"))
    return blobs.withColumn("place", place).where("place <= 3").select("source", "frame", "blob", "area", (F.col("place") == 1).alias("primary_blob"))


@query("""--cte t AS (SELECT DISTINCT l_orderkey % 499 AS frame, l_partkey % 5 * 100 AS x, l_suppkey % 3 * 100 AS y FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT l_orderkey % 499 AS frame, l_partkey % 5 * 100 + 20 AS x, l_suppkey % 3 * 100 + 10 AS y FROM lineitem WHERE l_returnflag = 'A')
SELECT frame, count(*) AS pairs, min(round(sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2), 6)) AS nearest FROM t JOIN b USING (frame) WHERE sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2) <= 150 GROUP BY frame""")
def candidate_pairs(spark, sf_dir):
    """Track and blob pairs of a frame within a distance: joined by frame, then tested."""
    line = td.table(spark, sf_dir, "lineitem")
    side = lambda flag, dx, dy: line.where(F.col("l_returnflag") == flag).select((F.col("l_orderkey") % 499).alias("frame"), (F.col("l_partkey") % 5 * 100 + dx).alias("x"), (F.col("l_suppkey") % 3 * 100 + dy).alias("y")).distinct()
    t, b = side("R", 0, 0).alias("t"), side("A", 20, 10).alias("b")
    near = t.join(b, "frame").withColumn("d", ex.distance(F.col("t.x"), F.col("t.y"), F.col("b.x"), F.col("b.y"))).where("d <= 150")
    return near.groupBy("frame").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.round("d", 6)).alias("nearest"))
