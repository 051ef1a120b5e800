"""Segments of activity, as window functions: nothing is collected per source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(frames: DataFrame, keys: list[str], order: str, active: str, open_frames: int = 2, quiet_frames: int = 3, gap: str | None = None) -> DataFrame:
    """Hysteresis segments: keys, seq, first_frame, last_frame, n_active.

    A segment opens after `open_frames` active frames in a row, dated back to the
    first; it closes after `quiet_frames` quiet ones, dated at the last active. Runs
    of active frames with fewer quiet ones between are one cluster; the segment
    begins with the cluster's first run that is long enough. Frames with `gap` set
    start anew: nothing reaches across them. The end of the input closes."""
    base = frames.select(*keys, F.col(order).alias("_at"), F.col(active).alias("_on"), (F.col(gap).cast("int") if gap else F.lit(0)).alias("_gap"))
    by_key = Window.partitionBy(*keys).orderBy("_at")
    base = base.withColumn("_part", F.sum("_gap").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    own = [*keys, "_part"]
    w = Window.partitionBy(*own).orderBy("_at")
    base = base.withColumn("_n", F.row_number().over(w))
    on = base.where("_on")
    run_start = F.coalesce((F.col("_n") - F.lag("_n").over(w) > 1).cast("int"), F.lit(1))
    on = on.withColumn("_run", F.sum(run_start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = on.groupBy(*own, "_run").agg(F.min("_n").alias("_n0"), F.max("_n").alias("_n1"), F.min("_at").alias("_t0"), F.max("_at").alias("_t1"), F.count(F.lit(1)).alias("_len"))
    r = Window.partitionBy(*own).orderBy("_run")
    start = F.coalesce((F.col("_n0") - F.lag("_n1").over(r) - 1 >= quiet_frames).cast("int"), F.lit(1))
    runs = runs.withColumn("_cluster", F.sum(start).over(r.rowsBetween(Window.unboundedPreceding, 0)))
    opens = F.min(F.when(F.col("_len") >= open_frames, F.col("_run"))).over(Window.partitionBy(*own, "_cluster"))
    kept = runs.withColumn("_open", opens).where(F.col("_run") >= F.col("_open"))
    found = kept.groupBy(*own, "_cluster").agg(F.min("_t0").alias("first_frame"), F.max("_t1").alias("last_frame"), F.sum("_len").alias("n_active"))
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("first_frame"))
    return found.select(*keys, seq.cast("long").alias("seq"), "first_frame", "last_frame", "n_active")


def candidate_id(source: Column, token: str, seq: Column) -> Column:
    return F.format_string(f"%s-{token}-%06d", source, seq)


def verdicts(found: DataFrame, keys: list[str], decodes: DataFrame, order: str, least_frames: int = 5, grace: int = 30, cell: int = 1024) -> DataFrame:
    """Bench verdicts: `rejected` if the segment is short, `decoded` if a decode falls in it or `grace` frames after, else `missed`."""
    d = decodes.select(*keys, F.col(order).alias("_d")).distinct()
    hit = in_spans(d, "_d", found.select(*keys, "seq", F.col("first_frame").alias("_from"), (F.col("last_frame") + grace).alias("_to")), keys, "_from", "_to", cell).select(*keys, "seq").distinct().withColumn("_hit", F.lit(True))
    out = found.join(hit, [*keys, "seq"], "left")
    verdict = F.when(F.col("last_frame") - F.col("first_frame") + 1 < least_frames, "rejected").when(F.col("_hit"), "decoded").otherwise("missed")
    return out.select(*keys, "seq", "first_frame", "last_frame", verdict.alias("verdict"))


def reservoir(rows: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """Every stride-th row, the stride being the least power of two that keeps at most `cap`."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", n)
    stride = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("_n") / F.lit(float(cap)))).cast("double"))).cast("long")
    return numbered.withColumn("stride", stride).where(F.col("_i") % F.col("stride") == 0).drop("_i", "_n")


def in_spans(rows: DataFrame, at: str, spans: DataFrame, keys: list[str], start: str, end: str, cell: int) -> DataFrame:
    """Rows with each span of their keys that they lie in, both ends included.

    Spans are spread over cells of `cell` units, so rows and spans meet by equality of keys and cell, and the exact range is checked after it."""
    spread = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    near = rows.withColumn("_cell", F.floor(F.col(at) / cell)).join(spread, [*keys, "_cell"])
    return near.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")


def frames_around(frames: DataFrame, found: DataFrame, source: str, at: str, cell: int, pre: int, post: int, cap: int) -> DataFrame:
    """Evidence of each segment (source, seq, start, end): frames up to `pre` before its start, a
    reservoir of those inside, and frames up to `post` after its end, each once.

    Times are integers of one unit."""
    spans = found.select(source, "seq", "start", "end", (F.col("start") - pre).alias("_from"), (F.col("end") + post).alias("_to"))
    return sampled(in_spans(frames, at, spans, [source], "_from", "_to", cell), source, at, cap)


def sampled(near: DataFrame, source: str, at: str, cap: int) -> DataFrame:
    """Frames near segments (source, seq, start, end, at): all before and after, a reservoir of those inside."""
    part = F.when(F.col(at) <= F.col("start"), "pre").when(F.col(at) <= F.col("end"), "inside").otherwise("post")
    marked = near.withColumn("part", part)
    inside = reservoir(marked.where("part = 'inside'"), [source, "seq"], at, cap).drop("stride")
    return marked.where("part <> 'inside'").unionByName(inside).select(source, "seq", at, "part")


def ema_fold(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float, gate: float, stale: int) -> DataFrame:
    """Smoothed value per key and run: outliers (over `gate` times the current one) are ignored, and a pause longer
    than `stale` starts a new run. Rows without a time or value don't count. Sorted rows stream through one
    shuffle; of a key only its current run's numbers are held."""
    dealt = rows.select(*keys, F.col(order).alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null and _v is not null")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "_t", "_v")
    names = [*keys, "run", "ema", "n_used"]

    def fold(batches):
        key, run, last, ema, used, types = None, 0, None, None, 0, []

        def table(done):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.float64(), pa.int64()]
            done = []
            for *own, t, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key or t - last > stale:
                    if key is not None:
                        done.append((*key, run, ema, used))
                    key, run, ema, used = own, run + 1 if own == key else 1, None, 0
                last = t
                if ema is None:
                    ema, used = v, 1
                elif abs(v) <= gate * abs(ema):
                    ema, used = ema + alpha * (v - ema), used + 1
            yield table(done)
        if key is not None:
            yield table([(*key, run, ema, used)])

    return dealt.mapInArrow(fold, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", run long, ema double, n_used long")
