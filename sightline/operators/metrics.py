"""Rolling operational metrics. Windows end at the latest frame, so rates decay while nothing passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank, ratio

HOUR, DAY = 3600, 86400
LEAST_SPAN = 60


def clock(frames: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last frame and their number."""
    return frames.groupBy(*keys).agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count(F.lit(1)).alias("frames"))


def rates(events: DataFrame, frames: DataFrame, keys: list[str], at: str, unit: int = 1) -> DataFrame:
    """Per key: passes and misses of the last hour and day, passes per hour, read rates (NULL without events).

    `unit` is the number of time units in a second."""
    anchor = clock(frames, keys, at)
    # What is a day older than the first source's end counts nowhere, and isn't joined; the bound is one row.
    oldest = F.broadcast(anchor.agg((F.min("last_ts") - DAY * unit).alias("_oldest")))
    rows = events.select(*keys, F.col("kind"), F.col(at).alias("_at")).join(oldest, F.col("_at") >= F.col("_oldest")).drop("_oldest")
    recent = lambda kind, span: F.count_if((F.col("kind") == kind) & (F.col("_at") >= F.col("last_ts") - span * unit))
    counts = {"p1": recent("pass", HOUR), "m1": recent("miss", HOUR), "p24": recent("pass", DAY), "m24": recent("miss", DAY)}
    if keys:
        out = anchor.join(rows, keys, "left").groupBy(*keys, "first_ts", "last_ts").agg(*[c.alias(n) for n, c in counts.items()])
    else:  # the clock is one row: its ends are literals
        ends = anchor.first()
        first, last = (F.lit(ends[c]).alias(c) for c in ("first_ts", "last_ts"))
        out = rows.withColumn("last_ts", last).agg(*[c.alias(n) for n, c in counts.items()]).select("*", first, last)
    return out.select(*keys, *rate_columns(unit))


def rate_columns(unit: int = 1) -> list[Column]:
    """What rates() tells, from first_ts, last_ts and the counts p1, m1, p24, m24."""
    span = F.least(F.lit(float(HOUR)), F.greatest((F.col("last_ts") - F.col("first_ts")) / unit, F.lit(float(LEAST_SPAN))))
    return [
        *map(F.col, ("p1", "m1", "p24", "m24")), (F.col("p1") * HOUR / span).alias("passes_per_hour"),
        ratio(F.col("p1"), F.col("p1") + F.col("m1")).alias("read_rate_1h"), ratio(F.col("p24"), F.col("p24") + F.col("m24")).alias("read_rate_24h")]


def fps(frames: DataFrame, keys: list[str], second: Column, now: Column, elapsed: Column, window: int) -> DataFrame:
    """Frames per second over per-second counts: whole seconds before now and the part of the current one."""
    base = frames.withColumn("_sec", second).withColumn("_now", now).withColumn("_el", elapsed)
    inside = (F.col("_sec") > F.floor("_now") - window) & (F.col("_sec") <= F.floor("_now"))
    coverage = F.lit(window - 1) + F.max("_now") - F.floor(F.max("_now"))
    return base.groupBy(*keys).agg((F.count_if(inside) / F.greatest(F.least(F.max("_el"), coverage), F.lit(1e-9))).alias("fps"))


def latest(rows: DataFrame, keys: list[str], order: str, most: int = 2048) -> DataFrame:
    """The last `most` rows of each key."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def latency(rows: DataFrame, keys: list[str], order: str, value: str, most: int = 2048) -> DataFrame:
    """p50 and p95 of the last `most` samples, by nearest rank."""
    return nearest_rank(latest(rows, keys, order, most), keys, value, {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed("n", "samples")
