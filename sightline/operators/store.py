"""Append-only storage with views: revisions, reviews, manifest, outbox, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def current_view(log: DataFrame, key: str, revision: str, arrival: str) -> DataFrame:
    """One row per key: the highest revision, of equals the last to arrive; first_arrival keeps the list order.

    Both aggregates combine before the shuffle; no window over a key's history."""
    others = [c for c in log.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(revision, arrival))
    return log.groupBy(key).agg(best.alias("_row"), F.min(arrival).alias("first_arrival")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others], "first_arrival")


def last_wins(log: DataFrame, key: str, arrival: str) -> DataFrame:
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.col(arrival)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def clamp_limit(n: int, most: int = 500) -> int:
    return max(1, min(n, most))


def newest_first(view: DataFrame, order: str, limit: int) -> DataFrame:
    return view.orderBy(F.col(order).desc()).limit(clamp_limit(limit))


def with_reviews(misses: DataFrame, reviews: DataFrame, key: str = "event_id", only_open: bool = False) -> DataFrame:
    out = misses.join(reviews, key, "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(0)))
    return out.where("reviewed = 0") if only_open else out


def event_rows(events: DataFrame) -> DataFrame:
    """The stored columns of either kind of event."""
    is_pass = F.col("kind") == "pass"
    return events.select(
        "event_id", "kind", F.when(is_pass, F.col("payload")).alias("payload"), F.when(~is_pass, F.col("candidate_id")).otherwise(F.get("candidate_ids", F.lit(0))).alias("candidate_id"),
        F.when(is_pass, F.get(F.map_keys("cameras"), F.lit(0))).otherwise(F.col("source_id")).alias("source_id"),
        F.when(is_pass, F.col("first_seen_ts")).otherwise(F.col("start_ts")).alias("first_seen_ts"), F.when(is_pass, F.col("last_seen_ts")).otherwise(F.col("end_ts")).alias("last_seen_ts"),
        F.when(is_pass, F.col("decode_count")).otherwise(0).alias("decode_count"), F.when(is_pass, F.col("revision")).otherwise(0).alias("revision"))


CELLS, CUT_ROWS = 1024, 100_000


def _kept_by_size(rows: DataFrame, order: str, tie: str, size: str, cap: int, protected: Column) -> DataFrame:
    """Newest rows within a total size, oldest dropped first, of equal age those with the lower `tie`; protected rows count but stay.

    What would be left from a row on, with older protected rows, only falls from old to new, so one cut decides.
    It is searched for by totals of CELLS ranges of `order`, then of the one range that holds it, until that is
    short; only its rows meet in a window."""
    at, n_bytes = F.col(order), F.coalesce(F.col(size), F.lit(0))
    marked = rows.withColumn("_safe", F.coalesce(protected, F.lit(False)))
    safe_bytes = F.when(F.col("_safe"), n_bytes).otherwise(0)
    low, high = marked.agg(F.min(at), F.max(at)).first()
    newer = older_safe = 0
    while True:
        if low is None:
            return rows
        place = (F.col(order) - F.lit(low)) * F.lit(float(CELLS)) / F.lit(float((high - low) or 1))
        cell = F.least(F.lit(CELLS - 1), F.floor(place)).cast("int")
        inside = marked.where(at.between(low, high))
        totals = inside.groupBy(cell.alias("cell")).agg(F.sum(n_bytes).alias("all"), F.sum(safe_bytes).alias("safe"), F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).collect()  # CELLS rows at most
        below = older_safe + sum(t["safe"] for t in totals)
        for t in sorted(totals, key=lambda t: -t["cell"]):
            below -= t["safe"]
            if newer + t["all"] + below > cap:
                break
            newer += t["all"]
        else:
            return rows
        low, high, older_safe = t["low"], t["high"], below
        if t["n"] <= CUT_ROWS or low == high:
            break
    newest = Window.partitionBy(F.lit(0)).orderBy(at.desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum(n_bytes).over(newest) + newer + t["safe"] - F.sum(safe_bytes).over(newest) + older_safe
    edge = marked.where(at.between(low, high)).withColumn("_left", left).where((F.col("_left") <= cap) | F.col("_safe"))
    return marked.where((at > high) | (at < low) & F.col("_safe")).select(*rows.columns).unionByName(edge.select(*rows.columns))


def prune_outbox(outbox: DataFrame, now: float, max_age_days: float, cap_bytes: int, in_flight: int | None = None) -> DataFrame:
    """Rows (seq, body, enqueued_utc) that stay: not too old, then the newest within the size; the row in flight stays."""
    flying = F.col("seq").eqNullSafe(F.lit(in_flight).cast("long"))
    young = outbox.where((F.col("enqueued_utc") >= now - max_age_days * 86400) | flying).withColumn("_size", F.length("body"))
    return _kept_by_size(young, "seq", "body", "_size", cap_bytes, flying).drop("_size")


def outbox_stats(outbox: DataFrame, now: float) -> DataFrame:
    return outbox.agg(F.count(F.lit(1)).alias("depth"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("bytes"), F.min("seq").alias("oldest_seq"), (F.lit(now) - F.min("enqueued_utc")).alias("oldest_age_s"))


def prune_evidence(files: DataFrame, now: float, max_age_days: float, cap_bytes: int, keep: str | None = None) -> DataFrame:
    """Directories (dir, mtime, size) that stay: not older than the age, then the newest within the size (of equal times, the later names); `keep` stays."""
    kept = F.col("dir").eqNullSafe(F.lit(keep))
    young = files.where((F.lit(now) - F.col("mtime") <= max_age_days * 86400) | kept)
    return _kept_by_size(young, "mtime", "dir", "size", cap_bytes, kept)


def delivered(sent: DataFrame, emitted: DataFrame, key: str = "event_id") -> DataFrame:
    """Set equality of what was sent and emitted: counts of both, missing, unexpected."""
    a = sent.select(key).distinct().withColumn("_s", F.lit(1))
    b = emitted.select(key).distinct().withColumn("_e", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count("_s").alias("n_sent"), F.count("_e").alias("n_emitted"), F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"))
