"""The percentile, ratio and slope rules, one helper each.

Percentiles count equal values first (combined before the shuffle), so a window
sees distinct values only and no group is ever collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for an empty denominator."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def nearest_rank_index(q: float, n: Column) -> Column:
    """0-based index of the nearest-rank percentile: half rounds to even."""
    return F.bround(F.lit(q) * (n - 1), 0).cast("long")


def floor_index(q: float, n: Column) -> Column:
    """0-based index of the floor rule, at most the last."""
    return F.least(F.floor(F.lit(q) * n), n - 1).cast("long")


def ranked_values(df: DataFrame, keys: list[str], value: str, picks: dict[str, tuple], extra: dict | None = None) -> DataFrame:
    """keys, n, and one column per pick: the value at index rule(q, n) in ascending order.

    picks: name -> (rule, q). NULL values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    through = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_to", F.sum("_c").over(through)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = lambda rule, q: F.min(F.when(F.col("_to") > rule(q, F.col("_n")), F.col(value)))
    return cum.groupBy(*keys).agg(F.max("_n").alias("n"), *[at(rule, q).alias(name) for name, (rule, q) in picks.items()], *[e.alias(k) for k, e in (extra or {}).items()])


def nearest_rank(df: DataFrame, keys: list[str], value: str, picks: dict[str, float]) -> DataFrame:
    return ranked_values(df, keys, value, {k: (nearest_rank_index, q) for k, q in picks.items()})


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 where x doesn't vary."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def linear_percentile(value: Column, q: float) -> Column:
    """Interpolated between neighbours."""
    return F.percentile(value, F.lit(q))


def exclusive_p95(df: DataFrame, keys: list[str], value: str, name: str = "p95") -> DataFrame:
    """The 19th of 20 exclusive quantiles; the largest value where there are fewer than 20."""
    low = lambda n: (F.lit(19) * (n + 1) / F.lit(20)).cast("long")
    at = ranked_values(df, keys, value, {
        "_lo": (lambda q, n: F.greatest(F.lit(0), F.least(low(n), n - 1) - 1), 0), "_hi": (lambda q, n: F.greatest(F.lit(0), F.least(low(n), n - 1)), 0),
        "_max": (lambda q, n: n - 1, 0)})
    part = F.lit(19) * (F.col("n") + 1) / 20 - F.least(low(F.col("n")), F.col("n") - 1)
    return at.select(*keys, "n", F.when(F.col("n") < 20, F.col("_max")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias(name))
