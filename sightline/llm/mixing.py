"""Mixing sources to target sizes by subset sums over exact lengths.

Each source gets a share by weight, at most `max_repeats` times its own size,
what is above being reshared. A target is so many whole passes over the source
and a rest. For the rest, documents are counted by exact length: the same
fraction of each length's count is taken whatever the budget, then one more of each
length, longest first, as long as it fits. What is left is less than the longest
document, and bounded-knapsack dynamic programming over the counts that remain
fills it. Where that misses the nearest sum there could be, choices are undone, of
ever more lengths and documents, and the sums of these are gone through as bit
sets. The nearest sum differs from the even choice by at most 2L + 1 documents, L
being the longest length (in units of what divides all), so no more of a length are
undone, and the sets are bounded by lengths, not by budgets. Which documents of a
length are taken is decided by a seeded hash: those in lower hash buckets first,
and only inside the one bucket at the edge by rank, so no task sees more of a
length than a bucket of it.

Sources are a catalogue of a row each, as many as there are: their shares are one
pass over them in a window, and tables by length stay distributed.

Defined cases: a null source is a source, after all others; a null or empty text
has size 0 and is never taken; repeated rows with equal ids are taken together
(ties share their hash); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, written

WEIGHTS = (5, 2, 1)
BUCKETS = 1024


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, max_repeats: float = 3) -> dict[str | None, float]:
    """Target size of each source, for a catalogue at hand; source_targets() is the same for a table."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, budget = {}, list(order), float(sum(sizes.values()))
    while free:
        share = budget / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > max_repeats * sizes[s]]
        if not over:
            out |= {s: share * weight[s] for s in free}
            break
        for s in over:
            out[s] = float(max_repeats * sizes[s])
            budget -= out[s]
        free = [s for s in free if s not in out]
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = 3) -> DataFrame:
    """Adds their target sizes to sources (_src, source_size).

    Sources are filled together, by weight, and one that is full (`max_repeats` times its size) leaves the rest to the
    others. So in the order in which they get full, the level that a source and all after it would be filled to is
    known from those before it, and the first that this level doesn't fill ends the filling."""
    every = Window.partitionBy(F.lit(0))  # one row a source
    null = F.max((F.col("_src") == "n").cast("int")).over(every)  # the null source's key is before the others; it counts as the last
    place = F.row_number().over(every.orderBy("_src")) - 1
    place = F.when(F.col("_src") == "n", F.count(F.lit(1)).over(every) - 1).otherwise(place - null)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumns({"_weight": weight, "_full": (F.col("source_size") * F.lit(max_repeats)).cast("double"), "_budget": F.sum("source_size").over(every).cast("double")})
    in_turn = every.orderBy(F.col("_full") / F.col("_weight"), "_src")
    before = lambda c: F.coalesce(F.sum(c).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_level", (F.col("_budget") - before("_full")) / (F.sum("_weight").over(every) - before("_weight")))
    not_full = F.when(F.col("_level") * F.col("_weight") <= F.col("_full"), F.col("_level"))
    rows = rows.withColumn("_end", F.first(not_full, ignorenulls=True).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select(*sizes.columns, F.least(F.col("_full"), F.coalesce(F.col("_end") * F.col("_weight"), F.col("_full"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, so that the sum comes as near to the budget as can be; of equals the lower one."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable").tolist():
        if take[i] < counts[i] and 0 < lengths[i] <= rest:
            take[i] += 1
            rest -= int(lengths[i])
    if rest:
        take = take + _knapsack(lengths, counts - take, rest)
    return _nearest(lengths, counts, budget, take)


def _nearest(lengths: np.ndarray, counts: np.ndarray, budget: int, take: np.ndarray) -> np.ndarray:
    """The choice whose sum is nearest to the budget, from one that may be so: up to `each` documents of `some`
    lengths are chosen anew, until the sum is the nearest multiple of what divides all lengths or all are that could be."""
    # a longer document alone misses by more than the choice at hand
    used = np.flatnonzero((lengths > 0) & (counts > 0) & (lengths <= budget + abs(int((lengths * take).sum()) - budget)))
    if not len(used):
        return take
    unit = int(np.gcd.reduce(lengths[used]))
    low = budget // unit * unit
    miss = lambda s: (abs(s - budget), s)
    best = min(low, low + unit, key=miss)
    some, each, most = 64, 1, min(int(counts[used].max()), 2 * int(lengths[used].max()) // unit + 1)
    while (total := int((lengths * take).sum())) != best:
        core = used[np.unique(np.linspace(0, len(used) - 1, min(some, len(used))).astype(int))]
        freed = np.zeros(len(take), np.int64)
        freed[core] = np.minimum(take[core], each)
        open_ = freed.copy()
        open_[core] += np.minimum(counts[core] - take[core], each)
        lots = []
        for i in core[::-1].tolist():
            left, lot = int(open_[i]), 1
            while left > 0:
                lot = min(lot, left)
                lots.append((i, lot, lot * int(lengths[i]) // unit))
                left -= lot
                lot *= 2
        base = total - int((lengths * freed).sum())
        chosen = _subset([w for _, _, w in lots], budget - base, unit)
        new = take - freed
        for k in chosen:
            new[lots[k][0]] += lots[k][1]
        if miss(int((lengths * new).sum())) < miss(total):
            take = new
        if some >= len(used) and each >= most:
            break
        some, each = some * 8, each * 8
    return take


def _subset(weights: list[int], goal: int, unit: int) -> list[int]:
    """Places of the weights whose sum, times the unit, is nearest to the goal; of equals the lower one."""
    if goal <= 0 or not weights:
        return []
    low, top = goal // unit, min(2 * goal, goal + max(weights) * unit) // unit
    best = low if goal - low * unit <= (low + 1) * unit - goal else low + 1
    step = math.isqrt(len(weights)) + 1
    mask, sums, marks = (1 << (top + 1)) - 1, 1, []  # bit s of sums: s can be reached; one of every `step` sets is kept
    for k, w in enumerate(weights):
        if k % step == 0:
            marks.append((k, sums))
        sums |= (sums << w) & mask
        if sums >> best & 1:
            weights = weights[: k + 1]
            break
    at = (sums & ((1 << (low + 1)) - 1)).bit_length() - 1
    if above := sums >> (low + 1):
        over = low + (above & -above).bit_length()
        if over * unit - goal < goal - at * unit:
            at = over
    chosen, end = [], len(weights)
    for k, sums in reversed(marks):
        mask = (1 << (at + 1)) - 1
        before = [sums & mask]
        for w in weights[k : end - 1]:
            before.append(before[-1] | before[-1] << w & mask)
        for j in range(end - 1, k - 1, -1):
            if not before[j - k] >> at & 1:
                chosen.append(j)
                at -= weights[j]
        end = k
    return chosen


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: for each sum, the item (a power-of-two lot of a length) that first reached it. Sums
    somewhat above the budget are covered, too, as one of them may be the nearest."""
    most = min(2 * budget, budget + int(lengths.max()))
    by = np.full(most + 1, -1, np.int64)
    by[0] = 0
    lots: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, left, lot = int(lengths[i]), int(counts[i]), 1
        while length and left > 0 and lot * length <= most:
            lot = min(lot, left)
            weight = lot * length
            if weight <= most:
                new = (by[: most + 1 - weight] >= 0) & (by[weight:] < 0)
                if new.any():
                    by[weight:][new] = len(lots)
                lots.append((i, lot))
            left -= lot
            lot *= 2
        if by[budget] >= 0:
            break
    take = np.zeros(len(lengths), np.int64)
    sums = np.flatnonzero(by >= 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:  # a sum's lot came after the lots of the sum before it, so none is used twice
        i, lot = lots[by[at]]
        take[i] += lot
        at -= lot * int(lengths[i])
    return take


def n_words(text_col: str):
    """Words of a text: the gaps in it, once white space is one space and none at the ends."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).cast("long")


def source_key(source_col: str):
    """A source's name that is never null."""
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    sized = docs.select(
        F.col(id_col).alias("_id"),
        source_key(source_col).alias("_src"),
        n_words(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_hash"),
    ).withColumn("_bucket", F.pmod(F.shiftright("_hash", 40), F.lit(BUCKETS)).cast("int"))
    sized = written(sized, "sizes")
    by_bucket = sized.groupBy("_src", "size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    by_length = by_bucket.groupBy("_src", "size").agg(F.sum("n").alias("n"))
    totals = by_length.groupBy("_src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goal = F.bround("target", 0).cast("long")
    table = source_targets(totals, weights, max_repeats).withColumn("_goal", goal)
    whole = F.col("source_size") > 0
    table = table.select(
        "_src", "source_size", "target", F.when(whole, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
        F.when(whole, F.pmod("_goal", F.nullif("source_size", F.lit(0)))).otherwise(0).cast("long").alias("rest"))
    table = written(table, "sources")
    sources = F.broadcast(table) if table.count() < 20_000 else table

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        take = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rows["rest"].iloc[0]))
        return pd.DataFrame({"_src": rows["_src"], "size": rows["size"], "take": take})

    chosen = by_length.join(sources.select("_src", "rest"), "_src").groupBy("_src").applyInPandas(choose, "_src string, size long, take long")
    before = Window.partitionBy("_src", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = by_bucket.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(chosen, ["_src", "size"])
    # of this bucket's documents of that length, so many are taken
    cuts = cuts.select("_src", "size", "_bucket", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("_before"))).alias("_some"))
    place = F.row_number().over(Window.partitionBy("_src", "size", "_bucket").orderBy("_hash", "_id"))
    picked = sized.withColumn("_place", place).join(cuts, ["_src", "size", "_bucket"]).join(sources, "_src")
    times = F.col("passes") + F.when(F.col("_place") <= F.col("_some"), 1).otherwise(0)
    return picked.select(
        F.col("_id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * times).cast("long").alias("taken"), times.cast("long").alias("times"), "_src")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).drop("times", "_src")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with all its columns.

    Rows equal in id, source and size count as one choice: each comes as often as the most taken of them."""
    chosen = mix(docs, id_col, text_col, source_col, **options)
    named = chosen.groupBy(F.col(id_col).alias("_mid"), F.col("_src").alias("_msrc"), F.col("size").alias("_msize")).agg(F.max("times").alias("_times")).where("_times > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_oid"), source_key(source_col).alias("_osrc"), n_words(text_col).alias("_osize"))
    same = F.col("_oid").eqNullSafe(F.col("_mid")) & (F.col("_osrc") == F.col("_msrc")) & (F.col("_osize") == F.col("_msize"))
    taken = rows.join(named, same)
    return taken.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
