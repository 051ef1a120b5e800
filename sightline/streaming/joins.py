"""Interval joins of two streams: rows meet the spans they lie in, and neither side is kept for ever.

Both sides have a watermark. A span may be `longest` long at most; so a row is kept until the spans' watermark
is that much past it, and a span until the rows' watermark is past its end. With outer=True a span that no row
has met is told then, with NULLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_in_spans(rows: DataFrame, at: str, spans: DataFrame, start: str, end: str, keys: list[str], longest: int, lateness: str = "0 seconds", outer: bool = False) -> DataFrame:
    """Spans with each of the rows of their keys between start and end, both included; instants in microseconds."""
    left = spans.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_until", F.timestamp_micros(end)).withWatermark("_until", lateness)
    right = rows.withColumn("_clock", F.timestamp_micros(at)).withWatermark("_clock", lateness)
    same = [F.col(f"_{k}") == F.col(k) for k in keys]
    inside = (F.col("_clock") <= F.col("_until")) & (F.col("_clock") >= F.col("_until") - F.expr(f"make_dt_interval(0, 0, 0, {longest // 1_000_000 + 1})")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    for s in same:
        inside = inside & s
    met = left.join(right, inside, "leftOuter" if outer else "inner")
    return met.drop("_until", "_clock", *keys).withColumnsRenamed({f"_{k}": k for k in keys})
