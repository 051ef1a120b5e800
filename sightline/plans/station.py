"""Sessions, queues, scans, recordings, devices, pictures and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import reports, station, vision
from ..sources import evidence, files, rendering
from ..sources import testdata as td
from ..streaming import replay
from . import detection, reporting
from .registry import query


@query("SELECT event_id, event_type AS source_id FROM events WHERE event_type <> 'error'", views=False)
def camera_union(spark, sf_dir):
    """Events of each camera, united."""
    s = td.sightings(spark, sf_dir)
    return station.union_of_cameras({c: s.where(F.col("source_id") == c).select("event_id") for c in td.CAMERAS}).select("event_id", "source_id")


@query("""WITH q AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'open' ELSE 'close' END AS a, CASE event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN user_id ELSE event_id END AS s FROM events),
l AS (SELECT user_id, list({'q': event_id, 'a': a, 's': s} ORDER BY event_id) AS xs FROM q GROUP BY 1),
r AS (SELECT user_id, list_reduce(xs, lambda acc, x: CASE
    WHEN x.a = 'open' AND acc.cur IS NULL THEN {'cur': x.s, 'out': list_append(acc.out, {'q': x.q, 'ok': true, 'o': x.s})}
    WHEN x.a = 'close' AND acc.cur IS NOT NULL AND coalesce(x.s, acc.cur) = acc.cur THEN {'cur': NULL, 'out': list_append(acc.out, {'q': x.q, 'ok': true, 'o': NULL})}
    ELSE {'cur': acc.cur, 'out': list_append(acc.out, {'q': x.q, 'ok': false, 'o': acc.cur})} END,
    {'cur': NULL::BIGINT, 'out': []::STRUCT(q BIGINT, ok BOOLEAN, o BIGINT)[]}) AS z FROM l), u AS (SELECT user_id, unnest(z.out) AS e FROM r)
SELECT user_id, e.q AS event_id, e.ok AS accepted, e.o AS open_id FROM u""", views=False)
def session_guard(spark, sf_dir):
    """At most one open session a station; a close must name it or none."""
    e = td.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "open").otherwise("close")
    named = F.when(F.col("event_type") == "purchase", None).when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.col("event_id"))
    log = station.session_log(e.select("user_id", "event_id", kind.alias("action"), named.cast("long").alias("session_id")), "user_id", "event_id")
    return log.select("user_id", "event_id", "accepted", "open_id")


@query("WITH u AS (SELECT 'PLT-' || (c_custkey % 300) AS payload, c_custkey AS pos, c_custkey * 5 // 1000 AS upload FROM customer) SELECT payload, min(pos) AS pos FROM u WHERE upload = (SELECT max(upload) FROM u) GROUP BY 1", views=False)
def manifest_replace(spark, sf_dir):
    """A new manifest replaces the one before, whole."""
    c = td.table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("PLT-"), (F.col("c_custkey") % 300).cast("string")).alias("payload"), F.col("c_custkey").alias("pos"), F.floor(F.col("c_custkey") * 5 / 1000).alias("upload"))
    return station.replaced(rows, "upload", "payload", "pos")


@query("WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) SELECT event_type, count(*) FILTER (n <= 100) AS kept, count(*) FILTER (n > 100) AS left_out, max(event_id) FILTER (n <= 100) AS last_kept FROM p GROUP BY 1", views=False)
def collected(spark, sf_dir):
    """A collector of bounded size counts what it leaves out."""
    return station.first_kept(td.table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 100)


@query("SELECT user_id, ts_us // 86400000000 AS tick, least(2, count(*)) AS kept, greatest(0, count(*) - 2) AS dropped FROM timed GROUP BY 1, 2")
def back_pressure(spark, sf_dir):
    """A live queue keeps the newest frames of each tick and counts the others."""
    out = station.drop_oldest(td.timed(spark, sf_dir).select("user_id", "ts_us"), ["user_id"], "ts_us", td.DAY, 2)
    return out.groupBy("user_id", "tick").agg(F.count(F.lit(1)).alias("kept"), F.max("dropped").alias("dropped"))


@query(f"--cte {detection.PLAIN} SELECT user_id, frame_index // 10 AS period, min(frame_index) AS frame_index FROM frames f WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.user_id = f.user_id AND f.frame_index BETWEEN first_frame AND last_frame) GROUP BY 1, 2")
def idle_scan(spark, sf_dir):
    """Frames read whole while no segment is open, one a period."""
    return station.idle_scans(td.frames(spark, sf_dir).select("user_id", "frame_index"), detection.segments(spark, sf_dir), ["user_id"], "frame_index", 10, 1024)


@query("""WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'open' ELSE 'close' END AS kind FROM events WHERE event_type IN ('view', 'purchase')),
p AS (SELECT *, count(*) FILTER (kind = 'open') OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM k)
SELECT user_id, part, min(event_id) AS opened, coalesce(min(event_id) FILTER (kind = 'close'), max(event_id)) AS ended, count(*) FILTER (kind = 'close') = 0 AS cut_short FROM p WHERE part > 0 GROUP BY 1, 2""", views=False)
def duplicate_opens(spark, sf_dir):
    """A second open ends the segment before it."""
    e = td.table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    return station.split_opens(e.select("user_id", "event_id", F.when(F.col("event_type") == "view", "open").otherwise("close").alias("kind")), "user_id", "event_id")


@query("""WITH d AS (SELECT l_orderkey, l_extendedprice, CASE WHEN l_quantity < 45 THEN 'P' || (l_partkey % 3) END AS payload, CASE WHEN l_partkey % 3 = 0 THEN 'qr' ELSE 'datamatrix' END AS symbology, l_suppkey % 90 AS x FROM lineitem),
c AS (SELECT l_orderkey, payload, min(symbology) AS symbology, count(*) AS n FROM d GROUP BY 1, 2),
g AS (SELECT l_orderkey, coalesce(string_agg(DISTINCT payload, ',' ORDER BY payload) FILTER (n >= 2 AND payload IS NOT NULL), '') AS payloads, coalesce(string_agg(DISTINCT symbology, ',' ORDER BY symbology) FILTER (n >= 2 AND payload IS NOT NULL), '') AS symbologies, sum(n)::BIGINT AS decodes FROM c GROUP BY 1),
x AS (SELECT l_orderkey, arg_max(x, l_extendedprice) AS last_x FROM d GROUP BY 1)
SELECT l_orderkey, payloads, symbologies, decodes, last_x, CASE WHEN payloads = '' THEN 'miss' ELSE 'pass' END AS outcome FROM g JOIN x USING (l_orderkey)""", views=False)
def recording_records(spark, sf_dir):
    """What is written down of each recorded segment; of equal last prices the row stored first counts."""
    line = td.placed(spark, sf_dir, "lineitem")
    d = line.select("place", "l_orderkey", "l_extendedprice", F.when(F.col("l_quantity") < 45, F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string"))).alias("payload"),
                    F.when(F.col("l_partkey") % 3 == 0, "qr").otherwise("datamatrix").alias("symbology"), F.struct((F.col("l_suppkey") % 90).alias("x")).alias("roi"))
    out = station.recordings(d, "l_orderkey", "l_extendedprice", 2, "place")
    return out.select("l_orderkey", F.concat_ws(",", "payloads").alias("payloads"), F.concat_ws(",", "symbologies").alias("symbologies"), "decodes", F.col("roi.x").alias("last_x"), "outcome")


@query("""WITH a AS (SELECT l_orderkey, CASE WHEN l_quantity < 30 THEN l_partkey % 2 END AS p, l_linenumber % 3 <> 0 AS fb FROM lineitem), c AS (SELECT l_orderkey, p, count(*) AS n, count(*) FILTER (fb) AS f FROM a GROUP BY 1, 2)
SELECT l_orderkey, sum(n)::BIGINT AS frames_attempted, sum(f)::BIGINT AS fallback_runs, count(*) FILTER (n >= 2 AND p IS NOT NULL) AS confirmed FROM c GROUP BY 1""", views=False)
def decode_attempts(spark, sf_dir):
    """A segment's attempts, those with variants, and its confirmed payloads."""
    line = td.table(spark, sf_dir, "lineitem")
    return station.decode_context(line.select("l_orderkey", F.when(F.col("l_quantity") < 30, F.col("l_partkey") % 2).alias("payload"), F.when(F.col("l_linenumber") % 3 == 0, "plain").otherwise("invert").alias("variant")), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, NOT (l_partkey % 2 = 0 AND l_quantity > 25) OR l_suppkey % 5 = 0 AS due, l_suppkey >= 4 AND NOT l_quantity > 25 AS variants FROM lineitem", views=False)
def cascade_rules(spark, sf_dir):
    """Which attempts and variants are due."""
    n, sure = F.col("l_suppkey"), F.col("l_quantity") > 25
    symbology = F.when(F.col("l_partkey") % 2 == 0, "datamatrix").otherwise("qr")
    return td.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", station.attempt_due(n, sure, symbology).alias("due"), station.variants_due(n, sure).alias("variants"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 65536)::INT END AS vid, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey * 7 % 65536)::INT END AS pid FROM customer", views=False)
def device_ids(spark, sf_dir):
    """Vendor and product numbers in device paths."""
    number = lambda c: F.lpad(F.hex(c % 65536), 4, "0")
    key = F.col("c_custkey")
    path = F.concat(F.lit("\\\\?\\usb#VID_"), number(key), F.when(key % 3 > 0, F.concat(F.lit("&Pid_"), number(key * 7))).otherwise(""), F.lit("&mi_00#7&1a"))
    return td.table(spark, sf_dir, "customer").select("c_custkey", station.usb_ids(path).alias("ids")).select("c_custkey", "ids.vid", "ids.pid")


@query("SELECT 'cam' || l_suppkey AS device, l_orderkey * 10 + l_linenumber AS mode, printf('%s %4dx%-4d %-4s asked %5.1f got %5.1f fps', CASE WHEN l_linenumber = 2 THEN '*' ELSE ' ' END, (l_partkey % 20 * 100)::INT, (l_suppkey % 15 * 80)::INT, l_returnflag, l_quantity, l_quantity / 2) AS line FROM lineitem", views=False)
def probe_table(spark, sf_dir):
    """The table of probed modes as text."""
    line = td.table(spark, sf_dir, "lineitem")
    modes = line.select(F.concat(F.lit("cam"), F.col("l_suppkey").cast("string")).alias("device"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mode"), (F.col("l_partkey") % 20 * 100).cast("int").alias("width"), (F.col("l_suppkey") % 15 * 80).cast("int").alias("height"),
                        F.col("l_returnflag").alias("fourcc"), F.col("l_quantity").alias("requested_fps"), (F.col("l_quantity") / 2).alias("achieved_fps"), "l_linenumber")
    return station.probe_lines(modes, F.col("l_linenumber") == 2)


@query("SELECT l_orderkey, l_linenumber, floor(l_partkey % 97 / s)::BIGINT + l_suppkey AS x, floor(l_suppkey % 31 / s)::BIGINT + l_linenumber AS y, ceil(l_quantity / s)::BIGINT AS w, ceil(l_linenumber / s)::BIGINT AS h, CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN l_partkey % 97 END AS motion_x, l_partkey % 97 - 3 AS padded_x, l_quantity::INT + 6 AS padded_w FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 2.0 END AS s FROM lineitem)", views=False)
def region_boxes(spark, sf_dir):
    """Boxes of scaled crops in the whole frame, motion boxes between two thresholds, padded boxes."""
    line = td.table(spark, sf_dir, "lineitem").withColumn("s", F.when(F.col("l_linenumber") % 2 == 0, 0.5).otherwise(2.0))
    px = F.col("l_partkey") % 97
    x, y, w, h = station.in_frame([px, F.col("l_suppkey") % 31, F.col("l_quantity"), F.col("l_linenumber")], [F.col("l_suppkey"), F.col("l_linenumber")], F.col("s"))
    rows = line.withColumn("_pad", ex.pad_box(ex.box(px, px, F.col("l_quantity"), F.col("l_quantity")), F.lit(3)))
    return rows.select("l_orderkey", "l_linenumber", x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"), station.motion_box(px, F.col("l_discount"), 0.02, 0.08).alias("motion_x"), F.col("_pad.x").alias("padded_x"), F.col("_pad.w").alias("padded_w"))


@query("""SELECT p_brand AS bench, row_number() OVER (PARTITION BY p_brand ORDER BY p, b, s DESC) - 1 AS case_id, p AS pitch, b AS blur, s AS symbology
FROM (SELECT DISTINCT p_brand, 2.0::DOUBLE + p_size % 3 AS p FROM part) JOIN (SELECT DISTINCT p_brand, p_partkey % 2 * 0.5::DOUBLE AS b FROM part) USING (p_brand), (VALUES ('qr'), ('datamatrix')) s(s)""", views=False)
def bench_workload(spark, sf_dir):
    """The numbered cases of decoder benches: each one's pitches by its blurs by symbologies."""
    part = td.table(spark, sf_dir, "part")
    of = lambda value, name: part.select(F.col("p_brand").alias("bench"), value.cast("double").alias(name))
    return station.workloads(of(F.lit(2.0) + F.col("p_size") % 3, "pitch"), of(F.col("p_partkey") % 2 * F.lit(0.5), "blur"), "bench", ["qr", "datamatrix"])


@query("WITH a AS (SELECT l_orderkey AS k, l_partkey % 5 AS p FROM lineitem), b AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 100 = 0 THEN 9 ELSE l_partkey % 5 END AS p FROM lineitem) SELECT k, p, sum(n)::BIGINT AS surplus FROM (SELECT k, p, 1 AS n FROM a UNION ALL SELECT k, p, -1 FROM b) GROUP BY 1, 2 HAVING sum(n) <> 0", views=False)
def bench_equality(spark, sf_dir):
    """Results that only one of two runs of a workload has."""
    line = td.table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey") % 5
    return station.same_results(line.select(F.col("l_orderkey").alias("k"), p.alias("p")), line.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_orderkey") % 100 == 0, 9).otherwise(p).alias("p")))


@query("""--cte p AS (SELECT user_id, event_id AS pass_id, ts_us AS s, ts_us + 86400000000 AS e FROM timed WHERE event_type = 'signup')
SELECT user_id, pass_id, count(*) AS frames, round_even(min(ts_us) / 33333.0, 0)::BIGINT AS first_tick, round_even(max(ts_us) / 33333.0, 0)::BIGINT AS last_tick, bool_or(discontinuity) AS truncated FROM p JOIN frames f USING (user_id) WHERE f.ts_us BETWEEN s AND e GROUP BY 1, 2""")
def injected_passes(spark, sf_dir):
    """Truth of passes laid over a feed: its ticks, and whether a gap cut them short."""
    plans = td.timed(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("pass_id"), F.col("ts_us").alias("start"), (F.col("ts_us") + td.DAY).alias("end"))
    return station.injected(plans, td.frames(spark, sf_dir).select("user_id", "ts_us", "discontinuity"), ["user_id"], "ts_us", 33_333, td.DAY)


def _pictures(spark, sf_dir, paint, *more):
    """A 32 x 24 picture per event, painted from its number; `more` of its columns go along. Events lie in few files, pictures are much
    more work: they are dealt to all cores."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            images = []
            for i in batch.column("event_id").to_pylist():
                a = np.zeros((24, 32), np.uint8)
                paint(a, i)
                images.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(images, pa.binary())], names=[*batch.schema.names, "image"])

    t = td.timed(spark, sf_dir).select("event_id", "event_type", *more)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
    return t.repartition(4 * spark.sparkContext.defaultParallelism, "event_id").mapInArrow(run, f"{head}, image binary").withColumns({"h": F.lit(24), "w": F.lit(32)})


def _one_box(a, i):
    a[i % 13 : i % 13 + 5, i % 19 : i % 19 + 6] = 200


@query("""WITH p AS (SELECT event_type AS source_id, event_id AS frame_index, event_id % 19 AS x, event_id % 13 AS y, lag(event_id % 19) OVER w AS px, lag(event_id % 13) OVER w AS py FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
m AS (SELECT *, px IS NOT NULL AND (x <> px OR y <> py) AS active FROM p)
SELECT source_id, frame_index, active, CASE WHEN active THEN greatest(0, least(x, px) - 2)::INT END AS x, CASE WHEN active THEN greatest(0, least(y, py) - 2)::INT END AS y,
  CASE WHEN active THEN (least(32, greatest(x, px) + 8) - greatest(0, least(x, px) - 2))::INT END AS w, CASE WHEN active THEN (least(24, greatest(y, py) + 7) - greatest(0, least(y, py) - 2))::INT END AS h FROM m""", views=False)
def picture_motion(spark, sf_dir):
    """Motion between successive pictures of a camera: whether, and where."""
    frames = _pictures(spark, sf_dir, _one_box).select(F.col("event_type").alias("source_id"), F.col("event_id").alias("frame_index"), "image", "h", "w", F.lit(False).alias("discontinuity"))
    return vision.activity(frames, 32).drop("motion_frac")


def _quarters(a, i):
    """Dark, with bright quarters by the bits of a scrambled number."""
    a[:] = 20
    for q in range(4):
        if i * 7919 % 16 >> q & 1:
            a[:, 8 * q : 8 * q + 8] = 200


# A pixel has two values here, so its mixture is two weights, d (dark) and b (bright), and which of them leads.
@query("""WITH f AS (SELECT event_type AS source_id, event_id AS frame_index, event_id * 7919 % 16 AS bits, event_id % 499 = 0 AS gap FROM events),
r AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY source_id ORDER BY frame_index) AS run FROM f),
q AS (SELECT source_id, run, frame_index, quarter, (bits >> quarter) & 1 = 1 AS bright, row_number() OVER (PARTITION BY source_id, run, quarter ORDER BY frame_index) AS t FROM r, (SELECT unnest(range(4)) AS quarter)),
l AS (SELECT source_id, run, quarter, list({'t': t, 'i': frame_index, 'x': bright, 'a': 1.0::DOUBLE / least(2 * t, 500), 'd': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'lead': 0, 'fg': []::BIGINT[]} ORDER BY t) AS xs FROM q GROUP BY ALL),
s AS (SELECT source_id, run, quarter, list_reduce(list_prepend({'t': 0::BIGINT, 'i': 0::BIGINT, 'x': false, 'a': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'lead': 0, 'fg': []::BIGINT[]}, xs), lambda acc, z:
  list_transform(list_transform(list_transform([{'own': CASE WHEN z.x THEN acc.b ELSE acc.d END, 'oth': CASE WHEN z.x THEN acc.d ELSE acc.b END, 'leads': acc.lead = CASE WHEN z.x THEN 1 ELSE 0 END}],
    lambda p: {'has': p.own > 0, 'own': (1 - z.a) * p.own - z.a * 0.05, 'oth': CASE WHEN p.oth > 0 AND (1 - z.a) * p.oth - z.a * 0.05 >= z.a * 0.05 THEN (1 - z.a) * p.oth - z.a * 0.05 ELSE 0.0 END, 'leads': p.leads}),
    lambda p: {'fg': NOT (p.has AND (p.leads OR p.oth < 0.9)), 'leads': p.leads,
      'own': CASE WHEN p.has THEN (p.own + z.a) / (p.own + z.a + p.oth) WHEN p.oth > 0 THEN z.a ELSE 1.0 END,
      'oth': CASE WHEN p.has THEN p.oth / (p.own + z.a + p.oth) WHEN p.oth > 0 THEN 1.0 - z.a ELSE 0.0 END, 'has': p.has}),
    lambda p: {'t': z.t, 'i': z.i, 'x': z.x, 'a': z.a, 'd': CASE WHEN z.x THEN p.oth ELSE p.own END, 'b': CASE WHEN z.x THEN p.own ELSE p.oth END,
      'lead': CASE WHEN p.own > p.oth OR p.own = p.oth AND p.has AND p.leads THEN CASE WHEN z.x THEN 1 ELSE 0 END ELSE CASE WHEN z.x THEN 0 ELSE 1 END END,
      'fg': CASE WHEN p.fg AND z.t > 1 THEN list_append(acc.fg, z.i) ELSE acc.fg END})[1]) AS z FROM l),
g AS (SELECT source_id, quarter, unnest(z.fg) AS frame_index FROM s)
SELECT f.source_id, f.frame_index, count(quarter) > 0 AS active, round(count(quarter) / 4.0, 6)::DOUBLE AS motion_frac, (min(quarter) * 8)::INT AS x, ((max(quarter) - min(quarter) + 1) * 8)::INT AS w
FROM f LEFT JOIN g ON g.source_id = f.source_id AND g.frame_index = f.frame_index GROUP BY f.source_id, f.frame_index""", views=False)
def picture_background(spark, sf_dir):
    """What stands out of a learnt background: a mixture per pixel, anew after gaps."""
    frames = _pictures(spark, sf_dir, _quarters).select(F.col("event_type").alias("source_id"), F.col("event_id").alias("frame_index"), "image", "h", "w", (F.col("event_id") % 499 == 0).alias("discontinuity"))
    out = vision.activity(frames, 32, mixture={}, grow=0)
    return out.select("source_id", "frame_index", "active", F.round("motion_frac", 6).alias("motion_frac"), "x", "w")


def _plain(a, i):
    a[:] = i % 251


@query("""--cte k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM timed)
SELECT 'u-' || user_id AS candidate_id, count(*) AS pictures, sum(768 * (event_id % 251))::BIGINT AS light, min(event_id) AS first_picture, any_value(n)::INT AS told FROM k JOIN (SELECT user_id, count(*) FILTER (i % 4 = 0) AS n FROM k GROUP BY 1) USING (user_id) WHERE i % 4 = 0 GROUP BY user_id""")
def evidence_files(spark, sf_dir):
    """Every fourth picture of each candidate, written as files with their meta body, and read back."""
    from pyspark.sql import types as T

    spark.dataSource.register(evidence.EvidenceFiles)
    t = _pictures(spark, sf_dir, _plain, "user_id")
    none = F.lit(None).cast(T.LongType())
    frames = t.select(F.concat(F.lit("u-"), "user_id").alias("candidate_id"), F.col("event_type").alias("source_id"), F.col("event_id").alias("frame_index"), F.lit(0.0).alias("ts"), "image", "h", "w", none.alias("first_frame"), none.alias("last_frame"), F.lit("miss").alias("reason"))
    path = replay.fresh(spark, "evidence")
    evidence.clustered(frames).write.format("evidence").option("path", path).option("day", "2026-06-10").option("stride", "4").mode("append").save()
    read = vision.focus_rows(evidence.read_pictures(spark, path), ["candidate_id", "frame_index"])
    seen = read.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("pictures"), F.sum(F.round(F.col("mean") * 768)).cast("long").alias("light"), F.min("frame_index").alias("first_picture"))
    return seen.join(evidence.read_meta(spark, path).select("candidate_id", F.col("frame_count").alias("told")), "candidate_id")


@query("""WITH p AS (SELECT event_id, (event_id % 251)::INT AS v FROM events),
m AS (SELECT event_id, unnest([1, 2, 3, 4, 5]) AS place, unnest([v, 255, round_even(255.0 / 12 * (1 + least(11, v // 23 + 1)), 0)::INT, v, v]) AS v FROM p)
SELECT event_id, place::INT AS place, v::DOUBLE AS mean, v AS least, v AS most FROM m""", views=False)
def picture_variants(spark, sf_dir):
    """The preprocessing variants of plain pictures: all but thresholds and equalised histograms leave them as they are."""
    return vision.variant_rows(_pictures(spark, sf_dir, _plain), ["event_id"])


def _two_boxes(a, i):
    a[1:4, 1 : 3 + i % 7] = 255  # 3 rows of 2 to 8
    a[10 : 12 + i % 11, 14:18] = 180  # 2 to 12 rows of 4
    a[23, 31] = 255  # too small


@query("""WITH b AS (SELECT event_id, 1 AS x, 1 AS y, (2 + event_id % 7)::INT AS w, 3 AS h, (3 * (2 + event_id % 7))::INT AS area FROM events UNION ALL SELECT event_id, 14, 10, 4, (2 + event_id % 11)::INT, (4 * (2 + event_id % 11))::INT FROM events)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY area DESC, x, y)::INT AS place, x, y, w, h, area FROM b""", views=False)
def picture_blobs(spark, sf_dir):
    """Connected bright parts of pictures, largest first."""
    return vision.blob_rows(_pictures(spark, sf_dir, _two_boxes), ["event_id"], 127, 2)


def _one_point(a, i):
    a[4 + i % 9, 4 + i % 17] = 1 + i % 255


@query("SELECT event_id, round(20.0 * (1 + event_id % 255) ** 2 / 768, 6) AS focus, round((1 + event_id % 255) / 768.0, 9) AS mean FROM events", views=False)
def picture_focus(spark, sf_dir):
    """Sharpness of pictures: of a point, known in closed form."""
    out = vision.focus_rows(_pictures(spark, sf_dir, _one_point), ["event_id"])
    return out.select("event_id", F.round("focus", 6).alias("focus"), F.round("mean", 9).alias("mean"))


def _stripes(a, i):
    a[:, ::2], a[:, 1::2] = i % 200, i % 151


@query("SELECT event_id, round_even((event_id % 200 + event_id % 151) / 2.0, 0)::DOUBLE AS mean FROM events", views=False)
def picture_downscale(spark, sf_dir):
    """Area averages of striped pictures at half the width."""
    return vision.focus_rows(_pictures(spark, sf_dir, _stripes), ["event_id"], 16).select("event_id", "mean")


@query("SELECT c_custkey, c_name || 'é' AS payload FROM customer", views=False)
def payload_bytes(spark, sf_dir):
    """Decoded bytes as text: UTF-8, else Latin-1."""
    c = td.table(spark, sf_dir, "customer")
    text = F.concat("c_name", F.lit("é"))
    raw = F.when(F.col("c_custkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return c.select("c_custkey", ex.payload_text(raw).alias("payload"))


AB_ROWS = f"{reporting.AB}, r AS ({reporting.AB_OUT.format(e='true', m='true').replace('e2 AS', 'WITH e2 AS', 1)})"


@query(f"""--cte {AB_ROWS} SELECT 0::BIGINT AS place, 'camera,passes_seen,passes_decoded,read_rate,ttfd_median_s,ttfd_p95_s,decodes_per_pass,misses' AS line
UNION ALL SELECT row_number() OVER (ORDER BY source_id), source_id || ',' || passes_seen || ',' || passes_decoded || ',' || printf('%.6f', read_rate) || ',' || printf('%.6f', ttfd_median_s) || ',' || printf('%.6f', ttfd_p95_s) || ',' || printf('%.4f', decodes_per_pass) || ',' || misses FROM r""")
def ab_csv_lines(spark, sf_dir):
    """The comparison as CSV."""
    return reports.ab_csv(reporting.ab_report(spark, sf_dir)).select("place", "line")


@query("""--cte s AS (SELECT event_id, payload, source_id, decode_count FROM sightings) SELECT event_id, payload, decode_count, source_id AS best_camera, event_id AS best_frame, decode_count AS camera_count FROM s""")
def serialized_events(spark, sf_dir):
    """Events as JSON lines and read back."""
    from ..sources import schemas

    s = td.sightings(spark, sf_dir)
    events = s.select(F.col("event_id").cast("string").alias("event_id"), F.lit("pass").alias("kind"), "payload", F.col("decode_count").cast("int").alias("decode_count"), F.create_map("source_id", F.col("decode_count").cast("int")).alias("cameras"), F.struct("source_id", F.col("event_id").alias("frame_index")).alias("best_frame"))
    back = files.event_json(events).select(F.from_json("body", schemas.EVENT).alias("e")).select("e.*")
    return back.select(F.col("event_id").cast("long").alias("event_id"), "payload", F.col("decode_count").cast("long").alias("decode_count"), F.col("best_frame")[0].alias("best_camera"), F.col("best_frame")[1].cast("long").alias("best_frame"), F.map_values("cameras")[0].cast("long").alias("camera_count"))


@query("SELECT c_custkey, printf('PLT-%06d', c_custkey) AS payload FROM customer", views=False)
def rendered_symbols(spark, sf_dir):
    """Symbols drawn small, with falling light and some smear, and read back."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            images = []
            for i in batch.column(0).to_pylist():
                a = rendering.drawn(rendering.symbol(f"PLT-{i:06d}".encode()), 3)
                images.append(rendering.gradient(rendering.motion_blur(a, 1 + i % 2), 0.1 * (i % 3)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.tobytes() for a in images], pa.binary()), pa.array([a.shape[0] for a in images], pa.int32()), pa.array([a.shape[1] for a in images], pa.int32())], names=["frame_index", "image", "h", "w"])

    crops = td.table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(run, "frame_index long, image binary, h int, w int")
    crops = crops.select(F.lit("s").alias("source_id"), "frame_index", "image", "h", "w", F.lit(0).alias("x"), F.lit(0).alias("y"))
    return vision.decoded(crops, rendering.read_symbol).select(F.col("frame_index").alias("c_custkey"), "payload")


@query(r"""--cte t AS (SELECT event_id, payload, ts_us, value FROM timed WHERE event_type <> 'error') SELECT event_id AS pass_id, payload, ts_us AS first_frame, ts_us + 9 AS last_frame, round(value, 3)::VARCHAR AS speed, 'qr "x"' AS note FROM t""")
def truth_round_trip(spark, sf_dir):
    """Truth as flat JSON lines, fixed fields and parameters, and read back."""
    t = td.timed(spark, sf_dir).where("event_type <> 'error'")
    params = F.create_map(F.lit("speed_mph"), F.round("value", 3).cast("string"), F.lit("note"), F.lit('qr "x"'))
    truth = t.select(F.col("event_id").cast("int").alias("pass_id"), "payload", F.lit("qr").alias("symbology"), F.col("ts_us").alias("first_frame"), (F.col("ts_us") + 9).alias("last_frame"), params.alias("params"))
    back = files.parse_truth(files.truth_lines(truth))
    return back.select(F.col("pass_id").cast("long").alias("pass_id"), "payload", "first_frame", "last_frame", F.col("params")["speed_mph"].alias("speed"), F.col("params")["note"].alias("note"))


DEADLINES = f"""--cte {detection.PLAIN}, seg AS (SELECT user_id, seq, min(f.ts_us) AS s, max(f.ts_us) AS e FROM segs JOIN frames f USING (user_id) WHERE f.frame_index BETWEEN first_frame AND last_frame GROUP BY 1, 2),
d AS (SELECT user_id, seq, event_type, count(*) AS n FROM seg JOIN frames f USING (user_id) WHERE f.ts_us BETWEEN s AND e + 7200000000 AND event_type <> 'error' GROUP BY 1, 2, 3)
SELECT user_id, seq, e + 7200000000 AS settled FROM seg WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = seg.user_id AND d.seq = seg.seq AND n >= 2)"""


@query(DEADLINES)
def miss_deadlines(spark, sf_dir):
    """Segments that no payload confirms until a while after their end."""
    frames = td.frames(spark, sf_dir)
    found = detection.timed_segments(spark, sf_dir)
    decodes = frames.where("event_type <> 'error'").select("user_id", F.col("ts_us").alias("at"), F.col("event_type").alias("payload"))
    return station.overdue(found, decodes, ["user_id"], "at", 2 * td.HOUR, 2, td.DAY)


TURNS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


@query("""WITH d(ux, uy) AS (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)), v AS (SELECT p_partkey, ux, uy, p_size * 3 * ux / sqrt(ux * ux + uy * uy) AS vx, p_size * 3 * uy / sqrt(ux * ux + uy * uy) AS vy FROM part, d)
SELECT p_partkey, ux, uy, round(vx, 6) AS vx, round(vy, 6) AS vy, greatest(2, ceil(least(CASE WHEN ux = 0 THEN 1e300 ELSE 1040 / abs(vx) END, CASE WHEN uy = 0 THEN 1e300 ELSE 600 / abs(vy) END)))::INT AS frames FROM v""", views=False)
def trajectories_of_all_directions(spark, sf_dir):
    """Velocity and crossing time in each of the eight directions."""
    part = td.table(spark, sf_dir, "part")
    parts = []
    for ux, uy in TURNS:
        t = ex.trajectory(float(ux), float(uy), F.lit(960), F.lit(540), F.lit(80), F.lit(60), F.col("p_size") * 3)
        parts.append(F.struct(F.lit(ux).alias("ux"), F.lit(uy).alias("uy"), F.round(t["vx"], 6).alias("vx"), F.round(t["vy"], 6).alias("vy"), t["frames"].alias("frames")))
    return part.select("p_partkey", F.explode(F.array(*parts)).alias("t")).select("p_partkey", "t.*")


@query("""--cte o AS (SELECT payload, list({'q': event_id, 't': ts_us, 'c': source_id} ORDER BY arrival_seq, event_id) AS xs FROM sightings GROUP BY payload),
r AS (SELECT payload, list_reduce(list_transform(xs, lambda x: {'x': x, 'a': []::STRUCT(t BIGINT, c VARCHAR[])[], 'out': []::STRUCT(q BIGINT, t BIGINT)[], 'n': NULL::BIGINT}),
  lambda acc, y: CASE WHEN len(list_filter(acc.a, lambda z: abs(z.t - y.x.t) <= $WINDOW)) = 0
      THEN {'x': y.x, 'a': list_append(acc.a, {'t': y.x.t, 'c': [y.x.c]}), 'out': list_append(acc.out, {'q': y.x.q, 't': y.x.t}), 'n': NULL}
    WHEN list_contains(list_filter(acc.a, lambda z: z.t = list_min(list_transform(acc.a, lambda u: {'d': abs(u.t - y.x.t), 't': u.t})).t)[1].c, y.x.c) THEN {'x': y.x, 'a': acc.a, 'out': acc.out, 'n': NULL}
    ELSE {'x': y.x, 'a': list_transform(acc.a, lambda z: CASE WHEN z.t = list_min(list_transform(acc.a, lambda u: {'d': abs(u.t - y.x.t), 't': u.t})).t THEN {'t': z.t, 'c': list_append(z.c, y.x.c)} ELSE z END),
      'out': list_append(acc.out, {'q': y.x.q, 't': list_min(list_transform(acc.a, lambda u: {'d': abs(u.t - y.x.t), 't': u.t})).t}), 'n': NULL} END,
  {'x': {'q': 0::BIGINT, 't': 0::BIGINT, 'c': ''}, 'a': []::STRUCT(t BIGINT, c VARCHAR[])[], 'out': []::STRUCT(q BIGINT, t BIGINT)[], 'n': NULL::BIGINT}) AS z FROM o),
e AS (SELECT unnest(z.out) AS m FROM r)
SELECT payload, m.t AS anchor, count(*)::INT AS n_cameras, min(first_seen_us) AS first_seen, max(ts_us) AS last_seen, min(ts_us) AS first_decode, sum(decode_count)::BIGINT AS decode_count, arg_min(source_id, ts_us) AS best_camera, arg_min(event_id, ts_us) AS best_frame
FROM e JOIN sightings s ON s.event_id = m.q GROUP BY 1, 2""")
def merged_fields(spark, sf_dir):
    """All fields of merged passes at their last revision."""
    actions = detection._actions(spark, sf_dir).where("action in ('emit', 'merge')")
    fields = ["n_cameras", "first_seen", "last_seen", "first_decode", "decode_count", "best_camera", "best_frame"]
    return actions.groupBy("payload", "anchor").agg(F.max_by(F.struct(*fields), "revision").alias("p")).select("payload", "anchor", "p.*")
