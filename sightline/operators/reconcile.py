"""Reconciling events with truth and with a manifest of expected payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, rstart: str, rend: str, slack: int, cell: int, keys: list[str] | None = None) -> DataFrame:
    """Left rows that some right interval overlaps, `slack` allowed on both sides, ends inclusive.

    Both sides are spread over time cells and joined by cell (and keys); the exact test follows, so no
    nested loop over all pairs. Long intervals take several cells."""
    keys = keys or []
    l_cells = left.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    r_cells = right.select(*keys, (F.col(rstart) - slack).alias("_rs"), (F.col(rend) + slack).alias("_re"))
    r_cells = r_cells.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_rs") / cell), F.floor(F.col("_re") / cell))))
    condition: Column = (l_cells["_cell"] == r_cells["_cell"]) & (r_cells["_rs"] <= l_cells[end]) & (r_cells["_re"] >= l_cells[start])
    for k in keys:
        condition = condition & (l_cells[k] == r_cells[k])
    return l_cells.join(r_cells, condition, "left_semi").drop("_cell").dropDuplicates()


def truth_outcome(truth: DataFrame, passes: DataFrame, misses: DataFrame, slack: int, cell: int) -> DataFrame:
    """Truth (pass_id, payload, t0, t1) with outcome: `decoded` if its payload was read at any time,
    else `missed` if a miss (start, end) overlaps it, else `unaccounted`."""
    read = truth.join(passes.select("payload").distinct(), "payload", "left_semi")
    rest = truth.join(passes.select("payload").distinct(), "payload", "left_anti")
    missed = overlapping(rest, misses, "t0", "t1", "start", "end", slack, cell).select("pass_id").distinct().withColumn("_m", F.lit(True))
    rest = rest.join(missed, "pass_id", "left").withColumn("outcome", F.when(F.col("_m"), "missed").otherwise("unaccounted")).drop("_m")
    return read.withColumn("outcome", F.lit("decoded")).unionByName(rest)


def truth_counts(outcome: DataFrame) -> DataFrame:
    """Counts, and the read rate: 1 where there is no truth."""
    n = lambda v: F.count_if(F.col("outcome") == v)
    total = F.count(F.lit(1))
    return outcome.agg(total.alias("n_truth"), n("decoded").alias("decoded"), n("missed").alias("missed"), n("unaccounted").alias("unaccounted"), F.when(total == 0, 1.0).otherwise(n("decoded") / F.nullif(total, F.lit(0))).alias("read_rate"))


def truth_first_decodes(truth: DataFrame, passes: DataFrame, arrival: str) -> DataFrame:
    """Per truth row: decoded, and ms from first seen to first decode of the payload's last event."""
    last = passes.groupBy("payload").agg(F.max_by(F.struct("first_seen", "first_decode"), F.col(arrival)).alias("p"))
    joined = truth.join(last, "payload", "left")
    return joined.select("pass_id", "payload", F.col("p").isNotNull().alias("decoded"), ((F.col("p.first_decode") - F.col("p.first_seen")) / 1000).alias("ttfd_ms"))


def manifest_status(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """(payload, status, pos): matched and missing keep the manifest's duplicates and order, unexpected
    payloads come once, in the order of their first scan. Scans without a payload don't count."""
    seen = scanned.where(F.col("payload").isNotNull()).groupBy("payload").agg(F.min("pos").alias("_first"))
    listed = manifest.select("payload", "pos").join(seen, "payload", "left")
    status = F.when(F.col("_first").isNotNull(), "matched").otherwise("missing")
    extra = seen.join(manifest.select("payload").distinct(), "payload", "left_anti")
    return listed.select("payload", status.alias("status"), "pos").unionByName(extra.select("payload", F.lit("unexpected").alias("status"), F.col("_first").alias("pos")))


def manifest_counts(status: DataFrame) -> DataFrame:
    """Counts and the true read rate, NULL for an empty manifest."""
    n = lambda v: F.count_if(F.col("status") == v)
    expected = n("matched") + n("missing")
    return status.agg(expected.alias("expected"), n("matched").alias("matched"), n("missing").alias("missing"), n("unexpected").alias("unexpected"), (n("matched").cast("double") / F.nullif(expected, F.lit(0))).alias("true_read_rate"))


def nearest_anchor(sightings: DataFrame, anchors: DataFrame, key: str, at: str, window: int) -> DataFrame:
    """Each sighting with the nearest anchor of its key within the window, ties to the older, or NULL.

    Joined by key and time cell of the window's size (three neighbours), not by a scan of all anchors."""
    columns = sightings.columns
    cell = F.floor(F.col("anchor") / window)
    near = anchors.select(F.col(key).alias("_k"), F.col("anchor").alias("_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    rows = sightings.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times")).withColumn("_cell", F.floor(F.col(at) / window))
    apart = F.abs(F.col(at) - F.col("_a"))
    joined = rows.join(near, (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_c")) & (apart <= window), "left")
    found = joined.groupBy(*columns, "_times").agg(F.min_by("_a", F.struct(apart.alias("d"), F.col("_a"))).alias("anchor"))
    return found.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*columns, "anchor")  # repeated rows stay as many
