"""Reports, reconciliation, sessions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import nearest_rank
from ..operators import metrics, reconcile, reports
from ..sources import files
from ..sources import testdata as td
from . import detection
from .registry import TENTHS, query

PCT = "list_sort({v})[round_even({q} * (len({v}) - 1), 0)::BIGINT + 1]"
DEDUP = "g AS (SELECT source_id, payload, list_sort(list(ts_us)) AS ts FROM sightings GROUP BY 1, 2), kept AS (SELECT source_id, payload, unnest(list_reduce(ts, lambda acc, x: CASE WHEN x - acc[-1] > $WINDOW THEN list_append(acc, x) ELSE acc END, [ts[1]])) AS ts_us FROM g)"
AB = f"""{DEDUP}, en AS (SELECT s.source_id, s.decode_count, greatest(0, (s.ts_us - s.first_seen_us) / 1000000.0) AS ttfd, s.ts_us FROM kept JOIN sightings s USING (source_id, payload, ts_us)),
mi AS (SELECT source_id, start FROM misses)"""
AB_OUT = f"""e2 AS (SELECT source_id, count(*) AS dec, sum(decode_count)::BIGINT AS dc, list(ttfd) AS v FROM en WHERE {{e}} GROUP BY 1), m2 AS (SELECT source_id, count(*) AS m FROM mi WHERE {{m}} GROUP BY 1)
SELECT source_id, coalesce(dec, 0) + coalesce(m, 0) AS passes_seen, coalesce(dec, 0) AS passes_decoded, coalesce(dc, 0) AS decode_count, coalesce(m, 0) AS misses, round(coalesce(dec, 0) / nullif(coalesce(dec, 0) + coalesce(m, 0), 0)::DOUBLE, 6) AS read_rate,
  round(dc / nullif(dec, 0)::DOUBLE, 6) AS decodes_per_pass, round({PCT.format(v='v', q=0.5)}, 6) AS ttfd_median_s, round({PCT.format(v='v', q=0.95)}, 6) AS ttfd_p95_s FROM e2 FULL JOIN m2 USING (source_id)"""


def _entries(spark, sf_dir):
    kept = detection.tracker_dedup(spark, sf_dir)
    s = td.sightings(spark, sf_dir).join(kept, ["source_id", "payload", "ts_us"])
    return s.select("source_id", "decode_count", F.greatest(F.lit(0.0), (F.col("ts_us") - F.col("first_seen_us")) / 1e6).alias("ttfd"), F.col("ts_us").alias("at"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


RATES = ("read_rate", "decodes_per_pass", "ttfd_median_s", "ttfd_p95_s")


@query(f"--cte {AB}, {AB_OUT.format(e='true', m='true')}")
def ab_report(spark, sf_dir):
    """Per-camera comparison over deduplicated sightings."""
    return _rounded(reports.ab_report(_entries(spark, sf_dir), td.misses(spark, sf_dir)), *RATES)


@query(f"--cte {AB}, {AB_OUT.format(e='ts_us BETWEEN 1704499200000000 AND 1705363200000000', m='start BETWEEN 1704499200000000 AND 1705363200000000')}")
def ab_report_windowed(spark, sf_dir):
    """The same within a window, both ends inclusive."""
    ends = F.lit(1_704_499_200_000_000), F.lit(1_705_363_200_000_000)
    entries = reports.windowed(_entries(spark, sf_dir), "at", *ends)
    return _rounded(reports.ab_report(entries, reports.windowed(td.misses(spark, sf_dir), "start", *ends)), *RATES)


@query(f"--cte {AB}, r AS ({AB_OUT.format(e='true', m='true').replace('e2 AS', 'WITH e2 AS', 1)}) SELECT arg_min(source_id, {{'r': -coalesce(read_rate, 0), 's': source_id}}) AS source_id, max(coalesce(read_rate, 0)) AS read_rate FROM r")
def best_camera(spark, sf_dir):
    return reports.best_camera(ab_report(spark, sf_dir))


@query("--cte e AS (SELECT event_id, source_id, decode_count, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN greatest(0, (ts_us - first_seen_us) / 1000000.0) END AS ttfd FROM sightings) SELECT source_id, count(*) AS passes, sum(decode_count)::BIGINT AS decodes, count(ttfd) AS timed_passes FROM e GROUP BY 1")
def legacy_rows(spark, sf_dir):
    """Old rows without camera detail fall back to their camera map."""
    s = td.sightings(spark, sf_dir)
    t = F.col("ts_us") / 1e6
    detail = F.create_map("source_id", F.struct((F.col("first_seen_us") / 1e6).alias("first_seen_ts"), F.when(F.col("event_id") % 5 != 0, t).alias("first_decode_ts"), t.alias("last_seen_ts"), F.col("decode_count").cast("int").alias("decode_count")))
    rows = s.select(F.create_map("source_id", F.col("decode_count").cast("int")).alias("cameras"), F.when(F.col("event_id") % 3 != 0, detail).alias("camera_detail"))
    return reports.camera_entries(rows).groupBy("source_id").agg(F.count(F.lit(1)).alias("passes"), F.sum("decode_count").alias("decodes"), F.count("ttfd").alias("timed_passes"))


OUTCOME = """o AS (SELECT pass_id, payload, CASE WHEN payload IN (SELECT payload FROM sightings) THEN 'decoded'
  WHEN EXISTS (SELECT 1 FROM misses m WHERE m.start - 2000000 <= t1 AND m.stop + 2000000 >= t0) THEN 'missed' ELSE 'unaccounted' END AS outcome FROM truth)"""


def _outcome(spark, sf_dir):
    return reconcile.truth_outcome(td.truth(spark, sf_dir), td.sightings(spark, sf_dir), td.misses(spark, sf_dir), 2_000_000, 300_000_000)


@query(f"--cte {OUTCOME} SELECT * FROM o")
def reconcile_truth(spark, sf_dir):
    """Truth against passes (any time) and misses (overlap)."""
    return _outcome(spark, sf_dir).select("pass_id", "payload", "outcome")


@query(f"--cte {OUTCOME} SELECT count(*) AS n_truth, count(*) FILTER (outcome = 'decoded') AS decoded, count(*) FILTER (outcome = 'missed') AS missed, count(*) FILTER (outcome = 'unaccounted') AS unaccounted, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (outcome = 'decoded') / count(*)::DOUBLE END, 6) AS read_rate FROM o")
def run_summary(spark, sf_dir):
    """Counts of the reconciliation."""
    return _rounded(reconcile.truth_counts(_outcome(spark, sf_dir)), "read_rate")


@query(f"""--cte {OUTCOME}, n AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'decoded') AS d, count(*) FILTER (outcome = 'missed') AS m, count(*) FILTER (outcome = 'unaccounted') AS u FROM o),
c AS (SELECT count(*) AS f, count(*) FILTER (event_id % 97 = 0) AS x, count(*) FILTER (event_type <> 'error') AS p, count(*) FILTER (event_type <> 'error' AND event_id % 5 = 0) AS g, count(*) FILTER (event_type = 'error') AS m FROM timed)
SELECT 0 AS section, unnest(range(5)) AS place, unnest(['run summary', 'frames ' || f || ', dropped ' || x, 'passes ' || p || ', merged into others ' || g, 'misses ' || c.m,
  'truth ' || n || ': decoded ' || d || ' (' || {TENTHS.format(a='d', b='n')} || '), missed ' || n.m || ', unaccounted ' || u]) AS line FROM c, n
UNION ALL SELECT 1, pass_id, 'unaccounted: pass ' || pass_id || ', ' || payload FROM o WHERE outcome = 'unaccounted'""")
def run_text(spark, sf_dir):
    """The end of a run in lines, with each truth pass that nothing accounts for."""
    e = F.col("event_id")
    seen = F.col("event_type") != "error"
    counts = td.timed(spark, sf_dir).agg(F.count(F.lit(1)).alias("frames"), F.count_if(e % 97 == 0).alias("dropped"), F.count_if(seen).alias("passes"), F.count_if(seen & (e % 5 == 0)).alias("merged"), F.count_if(~seen).alias("misses"))
    return reports.run_text(counts, _outcome(spark, sf_dir))


@query("--cte l AS (SELECT payload, arg_max(first_seen_us, arrival_seq * 1000000 + event_id) AS fs, arg_max(ts_us, arrival_seq * 1000000 + event_id) AS fd FROM sightings GROUP BY 1) SELECT pass_id, payload, fs IS NOT NULL AS decoded, round((fd - fs) / 1000.0, 6) AS ttfd_ms FROM truth LEFT JOIN l USING (payload)")
def truth_first_decode(spark, sf_dir):
    """Time to first decode of each truth row's last event."""
    s = td.sightings(spark, sf_dir).select("payload", F.col("first_seen_us").alias("first_seen"), F.col("ts_us").alias("first_decode"), (F.col("arrival_seq") * 1_000_000 + F.col("event_id")).alias("o"))
    return _rounded(reconcile.truth_first_decodes(td.truth(spark, sf_dir), s, "o"), "ttfd_ms")


def _status(spark, sf_dir, start=None, end=None):
    s = td.sightings(spark, sf_dir)
    if start is not None:
        s = s.where(F.col("ts_us").between(start, end))
    scanned = s.select(F.when(F.col("event_id") % 9 != 0, F.col("payload")).alias("payload"), F.col("event_id").alias("pos"))
    return reconcile.manifest_status(files.manifest_cells(td.manifest_lines(spark, sf_dir)), scanned)


STATUS = """seen AS (SELECT payload, min(event_id) AS first FROM sightings WHERE event_id % 9 <> 0 AND {w} GROUP BY 1),
st AS (SELECT m.payload, CASE WHEN s.payload IS NULL THEN 'missing' ELSE 'matched' END AS status, pos FROM manifest m LEFT JOIN seen s USING (payload) UNION ALL SELECT payload, 'unexpected', first FROM seen WHERE payload NOT IN (SELECT payload FROM manifest))"""


@query(f"--cte {STATUS.format(w='true')} SELECT * FROM st")
def reconcile_manifest(spark, sf_dir):
    """Expected against scanned payloads, over all time."""
    return _status(spark, sf_dir)


@query(f"--cte {STATUS.format(w='ts_us BETWEEN 1704067200000000 AND 1704153600000000')} SELECT count(*) FILTER (status <> 'unexpected') AS expected, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected, round(count(*) FILTER (status = 'matched') / nullif(count(*) FILTER (status <> 'unexpected'), 0)::DOUBLE, 6) AS true_read_rate FROM st")
def manifest_windowed(spark, sf_dir):
    """The counts within one day."""
    return _rounded(reconcile.manifest_counts(_status(spark, sf_dir, td.START, td.START + td.DAY)), "true_read_rate")


@query("""--cte a AS (SELECT payload, ts_us AS anchor FROM sightings WHERE source_id = 'view'), c AS (SELECT s.event_id, s.payload, s.ts_us, arg_min(anchor, {'d': abs(s.ts_us - anchor), 'a': anchor}) AS anchor FROM sightings s LEFT JOIN a ON a.payload = s.payload AND abs(s.ts_us - anchor) <= $WINDOW WHERE s.source_id = 'click' GROUP BY 1, 2, 3) SELECT * FROM c""")
def nearest_anchor(spark, sf_dir):
    """Each click with the nearest view of its payload within the window, on either side."""
    s = td.sightings(spark, sf_dir)
    anchors = s.where("source_id = 'view'").select("payload", F.col("ts_us").alias("anchor"))
    return reconcile.nearest_anchor(s.where("source_id = 'click'").select("event_id", "payload", "ts_us"), anchors, "payload", "ts_us", td.WINDOW)


def _session_events(spark, sf_dir):
    passes = td.sightings(spark, sf_dir).select(F.lit("pass").alias("kind"), F.when(F.col("event_id") % 1000 != 0, F.col("ts_us")).alias("at"))
    return passes.unionByName(td.misses(spark, sf_dir).select(F.lit("miss").alias("kind"), F.col("start").alias("at")))


SESSIONS = """ev AS (SELECT 'pass' AS kind, CASE WHEN event_id % 1000 <> 0 THEN ts_us END AS seen_at FROM sightings UNION ALL SELECT 'miss', start FROM misses),
sc AS (SELECT id, expected, count(*) FILTER (kind = 'pass') AS decoded, count(*) FILTER (kind = 'miss') AS missed FROM sessions LEFT JOIN ev ON seen_at IS NULL OR seen_at BETWEEN started AND ended GROUP BY 1, 2)"""


@query(f"--cte {SESSIONS} SELECT *, expected - decoded - missed AS shortfall FROM sc")
def session_counts(spark, sf_dir):
    """Per session: decoded, missed, shortfall; unstamped events are in each."""
    return reports.session_counts(td.sessions(spark, sf_dir), _session_events(spark, sf_dir), td.DAY)


@query(f"--cte {SESSIONS} SELECT id, expected - decoded - missed AS shortfall, expected - decoded - missed = 0 OR id % 3 = 0 AS may_close FROM sc")
def session_close(spark, sf_dir):
    """Which sessions may close: without shortfall, or with a note."""
    notes = td.sessions(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, "seen").otherwise("  ").alias("note"))
    return reports.may_close(session_counts(spark, sf_dir), notes)


RATE = """x AS (SELECT CASE WHEN event_type = 'error' THEN 'miss' ELSE 'pass' END AS kind, user_id, ts_us FROM timed), a AS (SELECT user_id, min(ts_us) AS f, max(ts_us) + 1800000000 AS l FROM timed GROUP BY 1),
c AS (SELECT user_id, f, l, count(*) FILTER (kind = 'pass' AND ts_us >= l - 3600000000) AS p1, count(*) FILTER (kind = 'miss' AND ts_us >= l - 3600000000) AS m1, count(*) FILTER (kind = 'pass' AND ts_us >= l - 86400000000) AS p24, count(*) FILTER (kind = 'miss' AND ts_us >= l - 86400000000) AS m24 FROM a JOIN x USING (user_id) GROUP BY 1, 2, 3)"""


def _rates(spark, sf_dir):
    t = td.timed(spark, sf_dir)
    events = t.select("user_id", F.when(F.col("event_type") == "error", "miss").otherwise("pass").alias("kind"), "ts_us")
    clock = t.select("user_id", "ts_us").unionByName(t.groupBy("user_id").agg((F.max("ts_us") + td.HOUR // 2).alias("ts_us")))
    return metrics.rates(events, clock, ["user_id"], "ts_us", 1_000_000)


RATE_COUNTS = f"--cte {RATE} SELECT user_id, p1, m1, p24, m24, round(p1 * 3600 / least(3600.0, greatest((l - f) / 1000000.0, 60.0)), 6) AS passes_per_hour, round(p1 / nullif(p1 + m1, 0)::DOUBLE, 6) AS read_rate_1h, round(p24 / nullif(p24 + m24, 0)::DOUBLE, 6) AS read_rate_24h FROM c"


@query(RATE_COUNTS)
def rates(spark, sf_dir):
    """Rolling rates up to the latest frame."""
    return _rounded(_rates(spark, sf_dir), "passes_per_hour", "read_rate_1h", "read_rate_24h")


FPS = "--cte n AS (SELECT user_id, max(ts_us) / 1000000.0 + 0.25 AS now, min(ts_us) / 1000000.0 AS f FROM timed GROUP BY 1) SELECT user_id, round(count(*) FILTER (floor(ts_us / 1000000.0) > floor(now) - 86400 AND floor(ts_us / 1000000.0) <= floor(now)) / greatest(least(max(now) - max(f), 86399 + max(now) - floor(max(now))), 1e-9), 9) AS fps FROM timed JOIN n USING (user_id) GROUP BY user_id"


@query(FPS)
def fps(spark, sf_dir):
    """Frames per second over whole seconds and the part of the current one."""
    t = td.timed(spark, sf_dir).select("user_id", "ts_us")
    ends = t.groupBy("user_id").agg((F.max("ts_us") / 1e6 + 0.25).alias("now"), (F.min("ts_us") / 1e6).alias("f"))
    out = metrics.fps(t.join(ends, "user_id"), ["user_id"], F.floor(F.col("ts_us") / 1e6), F.col("now"), F.col("now") - F.col("f"), 86_400)
    return out.withColumn("fps", F.round("fps", 9))


LAST = "w AS (SELECT event_type AS source_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events), v AS (SELECT source_id, list(value) AS v FROM w WHERE k <= 512 GROUP BY 1)"


LATENCY = f"WITH {LAST} SELECT source_id, len(v) AS samples, round({PCT.format(v='v', q=0.5)}, 6) AS p50_ms, round({PCT.format(v='v', q=0.95)}, 6) AS p95_ms FROM v"


@query(LATENCY, views=False)
def latency_pct(spark, sf_dir):
    """Percentiles of each source's last samples."""
    rows = td.table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), "event_id", "value")
    return _rounded(metrics.latency(rows, ["source_id"], "event_id", "value", 512), "p50_ms", "p95_ms")


@query(f"WITH v AS (SELECT l_returnflag AS flag, l_linestatus AS status, list(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT flag, status, len(v) AS n, {PCT.format(v='v', q=0.5)} AS p50, {PCT.format(v='v', q=0.95)} AS p95 FROM v", views=False)
def nearest_rank_percentiles(spark, sf_dir):
    """Nearest-rank percentiles with half to even, over large groups."""
    line = td.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice")
    return nearest_rank(line, ["flag", "status"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, min(ts_us) AS first_ts, max(ts_us) AS last_ts, count(*) AS frames, count(DISTINCT ts_us // 1000000) AS seconds FROM timed GROUP BY 1")
def frame_ingest(spark, sf_dir):
    """First and last frame and seconds with frames."""
    t = td.timed(spark, sf_dir)
    seconds = t.groupBy("user_id", F.floor(F.col("ts_us") / 1_000_000).alias("s")).count().groupBy("user_id").agg(F.count(F.lit(1)).alias("seconds"))
    return metrics.clock(t, ["user_id"], "ts_us").join(seconds, "user_id")


@query(f"--cte {RATE}, l AS (SELECT user_id, list(value) AS v FROM timed GROUP BY 1) SELECT user_id, len(v) AS samples, round({PCT.format(v='v', q=0.5)}, 6) AS p50_ms, p1 AS passes_1h, m1 AS misses_1h, round(p24 / nullif(p24 + m24, 0)::DOUBLE, 6) AS read_rate_24h FROM c JOIN l USING (user_id)")
def snapshot(spark, sf_dir):
    """The metrics of each source in one row, whose nested form is the stats contract."""
    t = td.timed(spark, sf_dir)
    lat = nearest_rank(t.select("user_id", "value"), ["user_id"], "value", {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed("n", "samples")
    nested = _rates(spark, sf_dir).join(lat, "user_id").select("user_id", F.struct("samples", "p50_ms", "p95_ms").alias("decode"), F.struct("p1", "m1", "read_rate_1h", "read_rate_24h", "passes_per_hour").alias("events"))
    return nested.select("user_id", "decode.samples", F.round("decode.p50_ms", 6).alias("p50_ms"), F.col("events.p1").alias("passes_1h"), F.col("events.m1").alias("misses_1h"), F.round("events.read_rate_24h", 6).alias("read_rate_24h"))
