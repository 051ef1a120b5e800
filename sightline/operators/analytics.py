"""Offline analytics: sweeps and gates, variant comparisons, memory and drift verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import floor_index, linear_percentile, nearest_rank_index, ranked_values, ratio, slope


def bin_of(value: Column, edges: list[float]) -> Column:
    """Bin number: half open, the last closed on the right, NULL outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (value >= edges[i]) & ((value <= edges[i + 1]) if i == len(edges) - 2 else (value < edges[i + 1]))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def binned_rates(rows: DataFrame, value: str, decoded: str, edges: list[float], keys: list[str] | None = None) -> DataFrame:
    """Read rate per bin; empty bins come with n = 0 and rate NULL."""
    keys = keys or []
    counts = rows.withColumn("bin", bin_of(F.col(value), edges)).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(decoded).alias("decoded"))
    bins = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    every = bins if not keys else rows.select(*keys).distinct().crossJoin(F.broadcast(bins))
    out = every.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("decoded", F.lit(0)).alias("decoded"), (F.col("decoded") * 100.0 / F.col("n")).alias("rate"))


def blur_gate(rows: DataFrame, exposure: str, blur: str, decoded: str, edges: list[float], heavy_from: float, heavy_least: int, tolerance: float = 3.0) -> DataFrame:
    """Passes if a heavy bin is well filled, and the read rate never rises by more than the tolerance from one exposure to the next."""
    heavy = [i for i, lo in enumerate(edges[:-1]) if lo >= heavy_from]
    filled = rows.withColumn("bin", bin_of(F.col(blur), edges)).where(F.col("bin").isin(heavy)).groupBy("bin").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("heavy_n"))
    rates = rows.groupBy(exposure).agg((F.count_if(decoded) * 100.0 / F.count(F.lit(1))).alias("rate"))  # one row per exposure setting
    rise = F.col("rate") - F.lag("rate").over(Window.orderBy(exposure))
    worst = rates.select(rise.alias("rise")).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("rise"), F.lit(0.0))).alias("worst_rise"))
    return filled.crossJoin(worst).select("heavy_n", "worst_rise", ((F.col("heavy_n") >= heavy_least) & (F.col("worst_rise") <= tolerance)).alias("passed"))


def grid_points(truth: DataFrame, keys: list[str], decoded: str, ttfd: str, blur: str) -> DataFrame:
    """Per point: n, decoded, read rate (0 where empty), median time to first decode, mean blur."""
    n = F.count(F.lit(1))
    return truth.groupBy(*keys).agg(n.alias("n"), F.count_if(decoded).alias("decoded"), F.coalesce(F.count_if(decoded) * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("read_rate"), F.median(ttfd).alias("ttfd_p50_ms"), F.avg(blur).alias("mean_blur_modules"))


def variant_report(results: DataFrame) -> DataFrame:
    """Per variant over (variant, candidate_id, outcome, truth, decoded): read rate, recovered misses, regressed passes."""
    read = F.col("decoded").isNotNull()
    lost = (F.col("outcome") == "pass") & ~F.coalesce(F.array_contains("truth", F.col("decoded")), F.lit(False))
    return results.groupBy("variant").agg(
        F.count(F.lit(1)).alias("bursts"), F.count_if(read).alias("decoded"), ratio(F.count_if(read), F.count(F.lit(1))).alias("read_rate"),
        F.count_if((F.col("outcome") == "miss") & read).alias("recovered"), F.count_if(lost).alias("regressions"))


def attribution(results: DataFrame) -> DataFrame:
    """Decodes per decoder and variant, in report order (rank): most first, then by name."""
    counts = results.where(F.col("decoder").isNotNull()).groupBy("variant", "decoder").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("n"), "decoder")))


def disagreeing(results: DataFrame) -> DataFrame:
    """Bursts that some variants decode and others don't, or decode differently."""
    found = F.coalesce("decoded", F.lit("")).alias("d")
    return results.select("candidate_id", found).groupBy("candidate_id").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high")


def first_confirmed(decodes: DataFrame, burst: str, frame: str, k: int) -> DataFrame:
    """Per burst the first payload seen `k` times, in frame order, and its frame. Ties go to the smaller payload."""
    place = F.row_number().over(Window.partitionBy(burst, "payload").orderBy(frame, "decoder"))
    kth = decodes.withColumn("_k", place).where(F.col("_k") == k)
    best = F.min_by(F.struct("payload", "decoder", frame), F.struct(frame, "payload"))
    return kth.groupBy(burst).agg(best.alias("b")).select(burst, F.col("b.payload").alias("payload"), F.col("b.decoder").alias("decoder"), F.col(f"b.{frame}").alias("frames_to_decode"))


def cpu_summary(samples: DataFrame, keys: list[str], value: str, cores: int = 4) -> DataFrame:
    """Mean, p95 by the floor rule, largest; raw and per core."""
    ranks = ranked_values(samples, keys, value, {"p95": (floor_index, 0.95)})
    means = samples.groupBy(*keys).agg(F.avg(value).alias("avg"), F.max(value).alias("max"))
    out = means.join(ranks, keys)
    return out.select(*keys, "n", "avg", "p95", "max", *[(F.col(c) / cores).alias(f"{c}_per_core") for c in ("avg", "p95", "max")])


def aligned_sum(series: DataFrame, name: str, index: str, value: str) -> DataFrame:
    """Sum over series by position, as far as the shortest goes."""
    per = series.groupBy(name).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("shortest"))
    return series.crossJoin(F.broadcast(per)).where(F.col(index) < F.col("shortest")).groupBy(index).agg(F.sum(value).alias("total"))


def slopes(points: DataFrame, keys: list[str], x: str, y: str, scale: float = 1.0) -> DataFrame:
    return points.groupBy(*keys).agg((slope(F.col(y), F.col(x)) * scale).alias("slope"))


def warmup(samples: DataFrame, keys: list[str], t: str, mb: str, window: int = 60, most_slope: float = 2.0, least: float = 45.0, fraction: float = 0.5) -> DataFrame:
    """Warm-up per key: the earliest time from which the slope over `window` seconds is under `most_slope` MB a
    minute, within [least, fraction of the run]; the search ends at a window of fewer than five points."""
    base = samples.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    rel = samples.join(base, keys).withColumn("_t", (F.col(t) - F.col("_t0")).cast("double")).withColumn("_most", (F.col("_t1") - F.col("_t0")) * fraction)
    ahead = Window.partitionBy(*keys).orderBy("_t").rangeBetween(0, window)
    rel = rel.withColumn("_slope", F.coalesce(F.regr_slope(mb, "_t").over(ahead), F.lit(0.0)) * 60).withColumn("_n", F.count(F.lit(1)).over(ahead))
    inside = rel.where((F.col("_t") >= least) & (F.col("_t") <= F.col("_most")))
    firsts = inside.groupBy(*keys).agg(F.min(F.when(F.col("_n") < 5, F.col("_t"))).alias("_stop"), F.min(F.when(F.col("_slope") < most_slope, F.col("_t"))).alias("_flat"))
    most = (F.col("_t1") - F.col("_t0")) * fraction
    found = F.when(F.col("_flat").isNotNull() & (F.col("_stop").isNull() | (F.col("_flat") < F.col("_stop"))), F.col("_flat")).otherwise(most)
    return base.join(firsts, keys, "left").select(*keys, F.when(most <= least, F.lit(least)).otherwise(found).alias("warmup_s"))


def rss_verdict(samples: DataFrame, keys: list[str], t: str, mb: str, most_slope: float, ratio_limit: float = 1.5) -> DataFrame:
    """Slope after warm-up (MB a minute), medians of the first and last five points, peak, and whether all is within limits."""
    knee = warmup(samples, keys, t, mb)
    first = samples.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(mb).alias("peak_mb"))
    post = samples.join(first, keys).join(knee, keys).where(F.col(t) - F.col("_t0") >= F.col("warmup_s"))
    up, down = (Window.partitionBy(*keys).orderBy(o) for o in (F.col(t).asc(), F.col(t).desc()))
    post = post.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down))
    mid = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) <= 5, F.col(mb))))[2]  # noqa: E731  five values
    n = F.count(F.lit(1))
    out = post.groupBy(*keys).agg(n.alias("n"), (slope(F.col(mb), F.col(t)) * 60).alias("slope_mb_min"), F.when(n >= 5, mid("_a")).alias("baseline_mb"), F.when(n >= 5, mid("_z")).alias("final_mb"))
    ok = (F.col("n") >= 5) & (F.col("slope_mb_min") <= most_slope) & (F.col("final_mb") <= F.col("baseline_mb") * ratio_limit)
    return first.drop("_t0").join(knee, keys).join(out, keys, "left").select(*keys, "warmup_s", "peak_mb", F.coalesce("n", F.lit(0)).alias("n"), "slope_mb_min", "baseline_mb", "final_mb", F.coalesce(ok, F.lit(False)).alias("ok"))


def drift(snapshots: DataFrame, keys: list[str], order: str, skip: int = 1, least: int = 3, most_drop: float = 1.0, most_rise: float = 50.0) -> DataFrame:
    """Slopes of read rate (points an hour) and p95 (ms an hour) over (uptime_s, read_rate_1h, decode_p95_ms), the first snapshots left out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    post = snapshots.withColumn("_p", place).where(F.col("_p") > skip)
    rated = F.col("read_rate_1h").isNotNull()
    rate = F.coalesce(F.regr_slope(F.when(rated, F.col("read_rate_1h")), F.when(rated, F.col("uptime_s"))), F.lit(0.0)) * 100 * 3600
    p95 = F.coalesce(F.regr_slope("decode_p95_ms", "uptime_s"), F.lit(0.0)) * 3600
    n = F.count("read_rate_1h")
    out = post.groupBy(*keys).agg(n.alias("n_fit"), F.when(n >= least, rate).otherwise(0.0).alias("read_rate_pp_hr"), F.when(n >= least, p95).otherwise(0.0).alias("p95_ms_hr"))
    bad = (F.col("read_rate_pp_hr") < -abs(most_drop)) | (F.col("p95_ms_hr") > abs(most_rise))
    return out.withColumn("verdict", F.when(F.col("n_fit") < least, "insufficient").when(bad, "drifting").otherwise("steady"))


def decoder_bench(samples: DataFrame, keys: list[str], value: str, read: str) -> DataFrame:
    n = F.count(F.lit(1))
    return samples.groupBy(*keys).agg(n.alias("n"), F.count_if(read).alias("reads"), (F.count_if(read) / n).alias("read_rate"), F.median(value).alias("p50_ms"), linear_percentile(F.col(value), 0.95).alias("p95_ms"))


def choose_mode(modes: DataFrame, keys: list[str], uncompressed: list[str], fraction: float = 0.9, near: float = 0.05) -> DataFrame:
    """Best capture mode per device over (requested_fps, achieved_fps, area, fourcc, mode): largest area, then
    fps; of those within `near` of the best, uncompressed first; ties by mode."""
    fit = modes.where((F.col("achieved_fps") >= fraction * F.col("requested_fps")) & (F.col("area") > 0))
    top = fit.withColumn("_top", F.max("area").over(Window.partitionBy(*keys))).where("area = _top")
    top = top.withColumn("_fps", F.max("achieved_fps").over(Window.partitionBy(*keys))).where(F.col("achieved_fps") >= (1 - near) * F.col("_fps"))
    raw = F.upper(F.trim("fourcc")).isin(uncompressed).cast("int")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(raw.desc(), F.desc("achieved_fps"), "mode"))
    return top.withColumn("_place", place).where("_place = 1").select(*keys, "mode", "area", "achieved_fps", "fourcc")


def restart_gaps(restarts: DataFrame, keys: list[str], at: str, runtime: str) -> DataFrame:
    """Largest pause between a run's end and the next run's first instant; `at` is a run's end."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.col(at) - F.col(runtime) - F.lag(at).over(w)
    return restarts.withColumn("_gap", gap).groupBy(*keys).agg(F.max("_gap").alias("max_gap"), F.count(F.lit(1)).alias("restarts"))


def problems(keys: list[str], memory: DataFrame, drifts: DataFrame, gaps: DataFrame, most_gap: int, most_slope: float = 1.0, ratio_limit: float = 1.5, most_drop: float = 1.0, most_rise: float = 50.0) -> DataFrame:
    """(keys, gate, problem): every limit that a run breaks, by the verdicts of rss_verdict(), drift() and restart_gaps() (gaps in microseconds)."""

    def failed(rows: DataFrame, gate: str, *found: tuple[Column, Column]) -> DataFrame:
        said = F.array_compact(F.array(*[F.when(broken, text) for text, broken in found]))
        return rows.select(*keys, F.lit(gate).alias("gate"), F.explode(said).alias("problem"))

    some, drifting = F.col("n") >= 5, F.col("verdict") == "drifting"
    gap = F.format_string("a gap of %d s", F.floor(F.col("max_gap") / 1_000_000).cast("long"))
    grows, ends = F.lit(f"grows by more than {most_slope:g} MB a minute"), F.lit(f"ends at over {ratio_limit:g} times its baseline")
    return (
        failed(memory, "memory", (F.lit("too few samples after warm-up"), ~some), (grows, some & (F.col("slope_mb_min") > most_slope)), (ends, some & (F.col("final_mb") > F.col("baseline_mb") * ratio_limit)))
        .unionByName(failed(drifts, "drift", (F.lit("read rate falls"), drifting & (F.col("read_rate_pp_hr") < -most_drop)), (F.lit("latency rises"), drifting & (F.col("p95_ms_hr") > most_rise))))
        .unionByName(failed(gaps, "restart", (gap, F.col("max_gap") >= most_gap))))


def exact_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    return ranked_values(df, keys, value, {"value": (nearest_rank_index, q)})
