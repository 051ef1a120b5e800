"""Connected components of a link table. Up to ONE_TASK distinct links (a few MB)
are joined in one task; more are worked on by alternating large-star and small-star
steps (Kiveris et al. 2014), each one shuffle with minima combined first, until
nothing changes. Links never reach the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ONE_TASK = 300_000


def _joined(batches):
    """Union by the smaller id, with paths halved."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "component"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u")
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the smallest id reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= ONE_TASK:
        return edges.repartition(1).mapInArrow(_joined, "id long, component long")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or now == state:
            break
        state = now
        edges = written(_stars(edges), "edges")
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)
