"""Offline analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import exclusive_p95
from ..operators import analytics as an
from ..operators import reports
from ..sources import testdata as td
from .registry import TENTHS, query

EDGES = [0, 10, 20, 30, 40, 50]


def _sweep(spark, sf_dir):
    return td.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("exposure"), F.col("l_quantity").alias("blur"), (F.col("l_returnflag") == "R").alias("decoded"), F.col("l_orderkey").alias("okey"), (F.col("l_extendedprice") / 100).alias("ttfd"), "l_partkey", "l_suppkey", "l_linestatus")


SWEEP = "sweep AS (SELECT l_linenumber AS exposure, l_quantity AS blur, l_returnflag = 'R' AS decoded, l_orderkey AS okey, l_extendedprice / 100 AS ttfd, l_partkey, l_suppkey, l_linestatus FROM lineitem), bins AS (SELECT *, CASE WHEN blur >= 0 AND blur < 10 THEN 0 WHEN blur >= 10 AND blur < 20 THEN 1 WHEN blur >= 20 AND blur < 30 THEN 2 WHEN blur >= 30 AND blur < 40 THEN 3 WHEN blur >= 40 AND blur <= 50 THEN 4 END AS bin FROM sweep)"


@query(f"WITH {SWEEP} SELECT r.range::INT AS bin, count(bin) AS n, count(*) FILTER (decoded AND bin IS NOT NULL) AS decoded, round(count(*) FILTER (decoded) * 100.0 / nullif(count(bin), 0), 6) AS rate FROM range(5) r LEFT JOIN bins ON bin = r.range GROUP BY 1", views=False)
def blur_bins(spark, sf_dir):
    """Read rate per blur bin, the last closed on the right."""
    return an.binned_rates(_sweep(spark, sf_dir), "blur", "decoded", EDGES).withColumn("rate", F.round("rate", 6))


@query(f"WITH {SWEEP}, r AS (SELECT exposure, count(*) FILTER (decoded) * 100.0 / count(*) AS rate FROM sweep GROUP BY 1), s AS (SELECT rate - lag(rate) OVER (ORDER BY exposure) AS rise FROM r), h AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM bins WHERE bin >= 3 GROUP BY bin)) SELECT n AS heavy_n, round(greatest(0.0, max(rise)), 6) AS worst_rise, n >= 100 AND greatest(0.0, max(rise)) <= 3 AS passed FROM s, h GROUP BY n", views=False)
def blur_gate(spark, sf_dir):
    """Heavy bin filled, and the rate doesn't rise with exposure."""
    return an.blur_gate(_sweep(spark, sf_dir), "exposure", "blur", "decoded", EDGES, 30, 100).withColumn("worst_rise", F.round("worst_rise", 6))


@query(f"WITH {SWEEP} SELECT exposure, count(*) AS n, count(*) FILTER (decoded) AS decoded, round(count(*) FILTER (decoded) * 100.0 / count(*), 6) AS read_rate, round(median(CASE WHEN decoded THEN ttfd END), 6) AS ttfd_p50_ms, round(avg(blur), 6) AS mean_blur_modules FROM sweep GROUP BY 1", views=False)
def grid_points(spark, sf_dir):
    """Metrics of each point of a sweep."""
    rows = _sweep(spark, sf_dir).withColumn("ttfd", F.when(F.col("decoded"), F.col("ttfd")))
    out = an.grid_points(rows, ["exposure"], "decoded", "ttfd", "blur")
    return out.withColumns({c: F.round(c, 6) for c in ("read_rate", "ttfd_p50_ms", "mean_blur_modules")})


@query("WITH a AS (SELECT p_brand, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part GROUP BY 1) SELECT p_brand, i, round(lo + i * ((hi - lo) / 8), 9) AS value FROM a, (SELECT unnest(range(9)) AS i)", views=False)
def grid_axis(spark, sf_dir):
    """Evenly spaced values of an axis between the ends that its sizes have, for each brand."""
    ends = td.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    axis = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.round(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / 8), 9))
    return ends.select("p_brand", F.posexplode(axis).alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("""SELECT p_brand AS device, p_type AS fourcc, fps, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, fps) AS place
FROM (SELECT DISTINCT p_brand, p_type FROM part) f JOIN (SELECT DISTINCT p_brand, p_size % 3 * 30 + 30 AS fps FROM part) r USING (p_brand)""", views=False)
def mode_matrix(spark, sf_dir):
    """Candidate modes of each device: its formats by its rates."""
    part = td.table(spark, sf_dir, "part")
    formats = part.select(F.col("p_brand").alias("device"), F.col("p_type").alias("fourcc")).distinct()
    every = formats.join(part.select(F.col("p_brand").alias("device"), (F.col("p_size") % 3 * 30 + 30).alias("fps")).distinct(), "device")
    return every.withColumn("place", F.row_number().over(Window.partitionBy("device").orderBy("fourcc", "fps")).cast("long"))


def _results(spark, sf_dir):
    """Variant results on bursts: what each variant decodes, and what was recorded."""
    line = td.table(spark, sf_dir, "lineitem")
    burst = F.col("l_orderkey")
    truth = F.array(F.concat(F.lit("P"), (burst % 10).cast("string")))
    decoded = F.when(F.col("l_quantity") < 30, F.concat(F.lit("P"), F.when(F.col("l_quantity") < 25, burst % 10).otherwise(F.lit(99)).cast("string")))
    return line.select(
        F.format_string("v%d", F.col("l_linenumber") % 3).alias("variant"), F.concat_ws("-", burst.cast("string"), (F.col("l_partkey") % 2).cast("string")).alias("candidate_id"),
        F.when(burst % 4 == 0, "miss").otherwise("pass").alias("outcome"), truth.alias("truth"), decoded.alias("decoded"), F.when(decoded.isNotNull(), F.format_string("d%d", F.col("l_suppkey") % 4)).alias("decoder"))


RESULTS = "res AS (SELECT 'v' || (l_linenumber % 3) AS variant, l_orderkey || '-' || (l_partkey % 2) AS candidate_id, CASE WHEN l_orderkey % 4 = 0 THEN 'miss' ELSE 'pass' END AS outcome, 'P' || (l_orderkey % 10) AS truth, CASE WHEN l_quantity < 25 THEN 'P' || (l_orderkey % 10) WHEN l_quantity < 30 THEN 'P99' END AS decoded, CASE WHEN l_quantity < 30 THEN 'd' || (l_suppkey % 4) END AS decoder FROM lineitem)"


@query(f"WITH {RESULTS} SELECT variant, count(*) AS bursts, count(decoded) AS decoded, round(count(decoded) / count(*)::DOUBLE, 6) AS read_rate, count(*) FILTER (outcome = 'miss' AND decoded IS NOT NULL) AS recovered, count(*) FILTER (outcome = 'pass' AND decoded IS DISTINCT FROM truth) AS regressions FROM res GROUP BY 1", views=False)
def variant_report(spark, sf_dir):
    return an.variant_report(_results(spark, sf_dir)).withColumn("read_rate", F.round("read_rate", 6))


@query(f"""WITH {RESULTS}, s AS (SELECT variant, count(*) AS n, count(decoded) AS r, count(*) FILTER (outcome = 'miss' AND decoded IS NOT NULL) AS f, count(*) FILTER (outcome = 'pass' AND decoded IS DISTINCT FROM truth) AS l FROM res GROUP BY 1),
d AS (SELECT variant, string_agg(decoder || '=' || k, ', ' ORDER BY k DESC, decoder) AS said FROM (SELECT variant, decoder, count(*) AS k FROM res WHERE decoder IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT variant, 0 AS section, '| ' || variant || ' | ' || r || '/' || n || ' | ' || {TENTHS.format(a='r', b='n')} || ' | ' || f || ' | ' || l || ' |' AS line FROM s
UNION ALL SELECT variant, 1, 'read by ' || said FROM d
UNION ALL SELECT variant, 2, 'reads the miss ' || candidate_id || ' as ' || decoded || ' by ' || decoder FROM res WHERE outcome = 'miss' AND decoded IS NOT NULL
UNION ALL SELECT variant, 3, 'loses the pass ' || candidate_id || ' of ' || truth || ' to ' || coalesce(decoded, 'nothing') FROM res WHERE outcome = 'pass' AND decoded IS DISTINCT FROM truth""", views=False)
def variant_text(spark, sf_dir):
    """The replay report in lines."""
    return reports.variant_text(_results(spark, sf_dir))


@query(f"WITH {RESULTS}, c AS (SELECT variant, decoder, count(*) AS n FROM res WHERE decoder IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY variant ORDER BY n DESC, decoder)::INT AS rank FROM c", views=False)
def attribution(spark, sf_dir):
    return an.attribution(_results(spark, sf_dir))


@query(f"WITH {RESULTS} SELECT candidate_id, min(coalesce(decoded, '')) AS low, max(coalesce(decoded, '')) AS high FROM res GROUP BY 1 HAVING min(coalesce(decoded, '')) <> max(coalesce(decoded, ''))", views=False)
def variant_delta(spark, sf_dir):
    """Bursts on which variants disagree."""
    return an.disagreeing(_results(spark, sf_dir))


@query("--cte p AS (SELECT user_id, source_id AS payload, 'd' || (event_id % 3) AS decoder, event_id, row_number() OVER (PARTITION BY user_id, source_id ORDER BY event_id) AS k FROM sightings), c AS (SELECT * FROM p WHERE k = 3) SELECT user_id, payload, decoder, event_id AS frames_to_decode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, payload) AS r FROM c) WHERE r = 1")
def first_confirmed(spark, sf_dir):
    """The first payload of each burst to be seen often enough."""
    s = td.sightings(spark, sf_dir).select("user_id", F.col("source_id").alias("payload"), F.format_string("d%d", F.col("event_id") % 3).alias("decoder"), "event_id")
    return an.first_confirmed(s, "user_id", "event_id", 3)


@query("WITH v AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS a FROM events GROUP BY 1) SELECT event_type, len(v) AS n, round(a, 6) AS avg, v[least(floor(0.95 * len(v)), len(v) - 1)::BIGINT + 1] AS p95, v[len(v)] AS max, round(a / 4, 6) AS avg_per_core, round(v[least(floor(0.95 * len(v)), len(v) - 1)::BIGINT + 1] / 4, 6) AS p95_per_core, round(v[len(v)] / 4, 6) AS max_per_core FROM v", views=False)
def cpu_summary(spark, sf_dir):
    """Mean, floor-rule p95 and largest, raw and per core."""
    out = an.cpu_summary(td.table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("avg", "avg_per_core", "p95_per_core", "max_per_core")})


@query("--cte s AS (SELECT event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value FROM timed), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM s GROUP BY name)) SELECT i, round(sum(value), 6) AS total FROM s, m WHERE i < n GROUP BY i")
def aligned_sum(spark, sf_dir):
    """Series added up by position, as far as the shortest goes."""
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    rows = td.timed(spark, sf_dir).select(F.col("event_type").alias("name"), i.cast("long").alias("i"), "value")
    return an.aligned_sum(rows, "name", "i", "value").withColumn("total", F.round("total", 6))


MEM = "mem AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) * 10.0 - 10 AS t, value FROM timed), rel AS (SELECT user_id, t, value, max(t) OVER (PARTITION BY user_id) AS t1 FROM mem)"


def _memory(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_us", "event_id"))
    return td.timed(spark, sf_dir).select("user_id", (place * 10.0 - 10).alias("t"), "value")


@query(f"--cte {MEM} SELECT user_id, round(coalesce(regr_slope(value, t), 0) * 60, 6) AS slope FROM mem GROUP BY 1")
def slope(spark, sf_dir):
    """Least-squares slope per minute, 0 without variance."""
    return an.slopes(_memory(spark, sf_dir), ["user_id"], "t", "value", 60.0).withColumn("slope", F.round("slope", 6))


KNEE = f"{MEM}, ah AS (SELECT *, coalesce(regr_slope(value, t) OVER w, 0) * 60 AS s, count(*) OVER w AS n FROM rel WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING)), kf AS (SELECT user_id, min(t) FILTER (n < 5) AS stop, min(t) FILTER (s < 2) AS flat FROM ah WHERE t >= 45 AND t <= t1 * 0.5 GROUP BY 1), kn AS (SELECT r.user_id, CASE WHEN max(t1) * 0.5 <= 45 THEN 45.0 WHEN max(flat) IS NOT NULL AND (max(stop) IS NULL OR max(flat) < max(stop)) THEN max(flat) ELSE max(t1) * 0.5 END::DOUBLE AS warmup_s FROM rel r LEFT JOIN kf USING (user_id) GROUP BY 1)"


@query(f"--cte {KNEE} SELECT * FROM kn")
def warmup_knee(spark, sf_dir):
    """The earliest time from which memory is flat."""
    return an.warmup(_memory(spark, sf_dir), ["user_id"], "t", "value")


RSS = f"""--cte {KNEE}, post AS (SELECT m.user_id, t, value, warmup_s, row_number() OVER (PARTITION BY m.user_id ORDER BY t) AS a, row_number() OVER (PARTITION BY m.user_id ORDER BY t DESC) AS z FROM mem m JOIN kn USING (user_id) WHERE t >= warmup_s),
ag AS (SELECT user_id, count(*) AS n, coalesce(regr_slope(value, t), 0) * 60 AS sl, CASE WHEN count(*) >= 5 THEN list_sort(list(value) FILTER (a <= 5))[3] END AS b, CASE WHEN count(*) >= 5 THEN list_sort(list(value) FILTER (z <= 5))[3] END AS f FROM post GROUP BY 1), pk AS (SELECT user_id, max(value) AS p FROM mem GROUP BY 1)
SELECT user_id, warmup_s, p AS peak_mb, coalesce(n, 0) AS n, round(sl, 6) AS slope_mb_min, b AS baseline_mb, f AS final_mb, coalesce(n >= 5 AND sl <= 1 AND f <= b * 1.5, false) AS ok FROM pk JOIN kn USING (user_id) LEFT JOIN ag USING (user_id)"""


@query(RSS)
def rss_verdict(spark, sf_dir):
    """Memory verdict after warm-up."""
    return an.rss_verdict(_memory(spark, sf_dir), ["user_id"], "t", "value", 1.0).withColumn("slope_mb_min", F.round("slope_mb_min", 6))


SNAP = "snap AS (SELECT user_id, ts_us // 86400000000 AS day, (ts_us // 86400000000) * 86400.0 AS uptime_s, CASE WHEN (ts_us // 86400000000) % 7 <> 0 THEN avg(value) / 100 END AS read_rate_1h, max(value) AS decode_p95_ms FROM timed GROUP BY 1, 2)"


def _snapshots(spark, sf_dir):
    day = F.floor(F.col("ts_us") / td.DAY)
    return td.timed(spark, sf_dir).groupBy("user_id", day.alias("day")).agg(F.avg("value").alias("v"), F.max("value").alias("decode_p95_ms")).select(
        "user_id", "day", (F.col("day") * 86400.0).alias("uptime_s"), F.when(F.col("day") % 7 != 0, F.col("v") / 100).alias("read_rate_1h"), "decode_p95_ms")


DRIFT = f"""--cte {SNAP}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS p FROM snap), a AS (SELECT user_id, count(read_rate_1h) AS n_fit, CASE WHEN count(read_rate_1h) >= 3 THEN coalesce(regr_slope(read_rate_1h, uptime_s), 0) * 360000 ELSE 0 END AS rr, CASE WHEN count(read_rate_1h) >= 3 THEN coalesce(regr_slope(decode_p95_ms, uptime_s), 0) * 3600 ELSE 0 END AS p FROM k WHERE p > 1 GROUP BY 1)
SELECT user_id, n_fit, round(rr, 6) AS read_rate_pp_hr, round(p, 6) AS p95_ms_hr, CASE WHEN n_fit < 3 THEN 'insufficient' WHEN rr < -1 OR p > 50 THEN 'drifting' ELSE 'steady' END AS verdict FROM a"""


@query(DRIFT)
def drift(spark, sf_dir):
    """Drift of read rate and latency over snapshots."""
    return an.drift(_snapshots(spark, sf_dir), ["user_id"], "day").withColumns({c: F.round(c, 6) for c in ("read_rate_pp_hr", "p95_ms_hr")})


@query("SELECT count(*) AS frames, count(*) FILTER (event_type <> 'error') AS decoded, count(*) FILTER (event_type = 'error') AS missed, count(DISTINCT user_id) AS sources, round(sum(value), 4) AS cost FROM timed")
def soak_totals(spark, sf_dir):
    """Totals of a run."""
    t = td.timed(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("event_type") != "error").alias("decoded"), F.count_if(F.col("event_type") == "error").alias("missed"), F.count_distinct("user_id").alias("sources"), F.round(F.sum("value"), 4).alias("cost"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS reads, round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 6) AS read_rate, round(median(l_extendedprice), 4) AS p50_ms, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95_ms FROM lineitem GROUP BY 1", views=False)
def decoder_bench(spark, sf_dir):
    """Reads, rate, median and interpolated p95 per workload."""
    line = td.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day"), (F.col("l_returnflag") == "R").alias("read"), "l_extendedprice")
    out = an.decoder_bench(line, ["day"], "l_extendedprice", "read")
    return out.withColumns({"read_rate": F.round("read_rate", 6), "p50_ms": F.round("p50_ms", 4), "p95_ms": F.round("p95_ms", 4)})


@query("WITH v AS (SELECT l_linenumber, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1), i AS (SELECT l_linenumber, v, len(v) AS n, least((19 * (len(v) + 1)) // 20, len(v) - 1) AS j FROM v) SELECT l_linenumber, n, round(CASE WHEN n < 20 THEN v[n] ELSE v[j] + (v[j + 1] - v[j]) * (19 * (n + 1) / 20.0 - j) END, 4) AS p95 FROM i", views=False)
def exclusive_quantile(spark, sf_dir):
    """The exclusive 95 % quantile, the largest value of few."""
    return exclusive_p95(td.table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_extendedprice").withColumn("p95", F.round("p95", 4))


@query("SELECT l_linenumber AS exposure, count(*) FILTER (l_linestatus = 'O') AS chances_o, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS frames_o, count(*) FILTER (l_linestatus = 'F') AS chances_f, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS frames_f FROM lineitem GROUP BY 1", views=False)
def decode_envelope(spark, sf_dir):
    """Frames decoded and chances per exposure, pivoted by speed."""
    line = td.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("exposure"), F.lower("l_linestatus").alias("speed"), (F.col("l_returnflag") == "N").alias("hit"))
    wide = line.groupBy("exposure").pivot("speed", ["o", "f"]).agg(F.count(F.lit(1)).alias("chances"), F.count_if("hit").alias("frames"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return wide.select("exposure", zero("o_chances").alias("chances_o"), zero("o_frames").alias("frames_o"), zero("f_chances").alias("chances_f"), zero("f_frames").alias("frames_f"))


@query("SELECT user_id, event_id, count(*) FILTER (event_type <> 'error') OVER w AS passes, count(*) OVER w AS n, round(count(*) FILTER (event_type <> 'error') OVER w / count(*) OVER w::DOUBLE, 6) AS read_rate FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)".replace("OVER w::DOUBLE", "OVER w"))
def rolling_rate(spark, sf_dir):
    """Read rate over the time before each event."""
    w = Window.partitionBy("user_id").orderBy("ts_us").rangeBetween(-td.DAY, 0)
    ok = F.count_if(F.col("event_type") != "error").over(w)
    n = F.count(F.lit(1)).over(w)
    return td.timed(spark, sf_dir).select("user_id", "event_id", ok.alias("passes"), n.alias("n"), F.round(ok / n, 6).alias("read_rate"))


@query("SELECT o_orderpriority AS reason, o_custkey % 4 AS exit_code, count(*) AS restarts, round(sum(o_totalprice), 2) AS runtime_s FROM orders GROUP BY 1, 2", views=False)
def restart_audit(spark, sf_dir):
    """Restarts by reason and exit code."""
    o = td.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("reason"), (F.col("o_custkey") % 4).alias("exit_code")).agg(F.count(F.lit(1)).alias("restarts"), F.round(F.sum("o_totalprice"), 2).alias("runtime_s"))


GAP = "--cte g AS (SELECT user_id, ts_us - 1000 * (event_id % 50) - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS gap FROM timed) SELECT user_id, max(gap) AS max_gap, count(*) AS restarts FROM g GROUP BY 1"


@query(GAP)
def restart_gap(spark, sf_dir):
    """The longest pause between runs."""
    rows = td.timed(spark, sf_dir).select("user_id", "ts_us", (F.col("event_id") % 50 * 1000).alias("runtime"))
    return an.restart_gaps(rows, ["user_id"], "ts_us", "runtime")


PROBLEMS = f"""--cte rss AS (WITH {RSS.removeprefix("--cte ")}), dr AS (WITH {DRIFT.removeprefix("--cte ")}), gp AS (WITH {GAP.removeprefix("--cte ")})
SELECT user_id, 'memory' AS gate, 'too few samples after warm-up' AS problem FROM rss WHERE n < 5
UNION ALL SELECT user_id, 'memory', 'grows by more than 1 MB a minute' FROM rss WHERE n >= 5 AND slope_mb_min > 1
UNION ALL SELECT user_id, 'memory', 'ends at over 1.5 times its baseline' FROM rss WHERE n >= 5 AND final_mb > baseline_mb * 1.5
UNION ALL SELECT user_id, 'drift', 'read rate falls' FROM dr WHERE verdict = 'drifting' AND read_rate_pp_hr < -1
UNION ALL SELECT user_id, 'drift', 'latency rises' FROM dr WHERE verdict = 'drifting' AND p95_ms_hr > 50
UNION ALL SELECT user_id, 'restart', 'a gap of ' || max_gap // 1000000 || ' s' FROM gp WHERE max_gap >= 172800000000"""


@query(PROBLEMS)
def soak_problems(spark, sf_dir):
    """What a long run fails: a row for each gate and problem."""
    rows = td.timed(spark, sf_dir).select("user_id", "ts_us", (F.col("event_id") % 50 * 1000).alias("runtime"))
    memory = an.rss_verdict(_memory(spark, sf_dir), ["user_id"], "t", "value", 1.0)
    return an.problems(["user_id"], memory, an.drift(_snapshots(spark, sf_dir), ["user_id"], "day"), an.restart_gaps(rows, ["user_id"], "ts_us", "runtime"), 2 * td.DAY)


MODES = "modes AS (SELECT l_suppkey % 20 AS device, l_orderkey * 10 + l_linenumber AS mode, 30.0 AS requested_fps, l_quantity * 1.2 AS achieved_fps, (l_partkey % 4) * 1000 AS area, CASE WHEN l_orderkey % 2 = 0 THEN 'MJPG' ELSE ' yuy2' END AS fourcc FROM lineitem)"


@query(f"WITH {MODES}, f AS (SELECT * FROM modes WHERE achieved_fps >= 0.9 * requested_fps AND area > 0), t AS (SELECT * FROM f QUALIFY area = max(area) OVER (PARTITION BY device)), n AS (SELECT * FROM t QUALIFY achieved_fps >= 0.95 * max(achieved_fps) OVER (PARTITION BY device)) SELECT device, mode, area, round(achieved_fps, 6) AS achieved_fps, fourcc FROM n QUALIFY row_number() OVER (PARTITION BY device ORDER BY (upper(trim(fourcc)) = 'YUY2')::INT DESC, achieved_fps DESC, mode) = 1", views=False)
def mode_choice(spark, sf_dir):
    """The best capture mode of each device."""
    line = td.table(spark, sf_dir, "lineitem")
    modes = line.select((F.col("l_suppkey") % 20).alias("device"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mode"), F.lit(30.0).alias("requested_fps"), (F.col("l_quantity") * 1.2).alias("achieved_fps"), (F.col("l_partkey") % 4 * 1000).alias("area"), F.when(F.col("l_orderkey") % 2 == 0, "MJPG").otherwise(" yuy2").alias("fourcc"))
    return an.choose_mode(modes, ["device"], ["YUY2"]).withColumn("achieved_fps", F.round("achieved_fps", 6))


@query("SELECT event_type AS control, bool_and(floor(value) % 50 <> 49) AS verified, count(*) AS n, count(*) FILTER (floor(value) % 50 = 49) AS failed FROM events GROUP BY 1", views=False)
def control_readback(spark, sf_dir):
    """Whether each control read back as set."""
    ok = F.floor("value") % 50 != 49
    return td.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("control")).agg(F.bool_and(ok).alias("verified"), F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("failed"))


@query("SELECT user_id, round(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0), 6) AS effect, coalesce(avg(value) FILTER (event_id % 2 = 1) - avg(value) FILTER (event_id % 2 = 0) >= 1.0, false) AS works FROM timed GROUP BY 1")
def exposure_effect(spark, sf_dir):
    """Whether longer exposure makes the picture brighter by the margin."""
    odd = F.col("event_id") % 2 == 1
    diff = F.avg(F.when(odd, F.col("value"))) - F.avg(F.when(~odd, F.col("value")))
    return td.timed(spark, sf_dir).groupBy("user_id").agg(F.round(diff, 6).alias("effect"), F.coalesce(diff >= 1.0, F.lit(False)).alias("works"))


@query("SELECT user_id, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END)::BIGINT AS pipeline, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS idle, count(*) AS decodes FROM timed GROUP BY 1")
def decode_counters(spark, sf_dir):
    """Decode counters of two engines, added up."""
    t = td.timed(spark, sf_dir)
    idle = F.col("event_type") == "view"
    each = t.where(~idle).groupBy("user_id").agg(F.count(F.lit(1)).alias("pipeline")).join(t.where(idle).groupBy("user_id").agg(F.count(F.lit(1)).alias("idle")), "user_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("pipeline", "idle")}
    return each.withColumns(zero).withColumn("decodes", F.col("pipeline") + F.col("idle"))
