"""Exact dedup by content sort.

Normalised texts are dealt to ranges by sampled splitters (the text's first 64
characters, then its 64-bit hash, so that splitters are short however long texts
are and a common beginning doesn't fill one range). In a range an external sort by
the whole text places equals side by side, and each row's whole text is compared
with its neighbour's: where they differ, a run of equals starts, and its first row
has the smallest id.

A text with so many copies that they would fill a task is cut into pieces, which
are further splitters inside its range. Such texts are known beforehand, from
counts by hash that combine before the shuffle: those with more than 1 / SHARE of
all rows or bytes, so there are 2 * SHARE at most, whatever the size of the data,
and as many pieces again. Each run of a piece then sends one row, its first, with
the whole text, to a second sort, in which neighbours are compared in the same
way; what that finds goes back to the pieces' rows. Hashes only deal rows; whether
texts are equal is decided by comparing them.

Defined cases: a null text counts as empty; empty texts equal each other; ids
that are null come last; rows equal in id and text are copies of which one
stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, written

#: Copies of a text are cut into pieces above this share of all rows or bytes, and above these numbers.
SHARE, PIECE_ROWS, PIECE_BYTES = 1 << 15, 256, 4 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _crowded(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """(hash, pieces) of the texts whose copies are cut: 2 * SHARE rows at most."""
    counts = written(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_norm")).alias("b")), "text-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    most_rows, most_bytes = max(piece_rows, total["n"] // SHARE), max(piece_bytes, total["b"] // SHARE)
    pieces = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / most_rows), F.ceil(F.col("b") / most_bytes)))
    return counts.where((F.col("n") > most_rows) | ((F.col("n") > 1) & (F.col("b") > most_bytes))).select("_hash", pieces.cast("int").alias("_pieces"))


def _in_runs(rows: DataFrame, among: list[str], text: str, ids: str, size: Column, shown: Column) -> DataFrame:
    """Adds _run, _first (of its run), _keep (its id) and _size to rows, dealt by `among`, by comparing neighbours in the
    order of text and id. The text stays with the first of a run where `shown`, and goes no further with others."""
    in_order = Window.partitionBy(*among).orderBy(F.col(text), F.col(ids).asc_nulls_last())
    before = F.lag(text).over(in_order)
    told = rows.withColumns({"_place": F.row_number().over(in_order), "_new": before.isNull() | (before != F.col(text))})
    told = told.withColumn(text, F.when(F.col("_new") & shown, F.col(text)))
    so_far = Window.partitionBy(*among).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    runs = told.withColumn("_run", F.max(F.when(F.col("_new"), F.col("_place"))).over(so_far))
    whole = Window.partitionBy(*among, "_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return runs.withColumns({"_keep": F.first(ids).over(whole), "_size": F.sum(size).over(whole)}).withColumnRenamed("_new", "_first").drop("_place")


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool, piece_rows: int, piece_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Written: one row per row of docs, or with `carry` one per run with the row itself; and what the second sort says of pieces' runs."""
    found = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []))
    found = found.withColumn("_hash", F.xxhash64("_norm"))
    crowded = F.broadcast(_crowded(found.select("_hash", "_norm"), piece_rows, piece_bytes))
    pieces = F.coalesce("_pieces", F.lit(1))
    cut = found.withColumn("_head", F.substring("_norm", 1, 64)).join(crowded, "_hash", "left")
    cut = cut.withColumns({"_pieces": pieces, "_piece": F.when(pieces > 1, F.pmod(F.xxhash64("_id"), pieces)).otherwise(0)})
    if carry:  # the row has the text: it isn't sent twice
        cut = cut.drop("_norm")
    ranges = cut.repartitionByRange("_head", "_hash", "_piece")
    if carry:
        ranges = ranges.withColumn("_norm", normalised(F.col("_row").getField(text_col)))
    told = ranges.withColumn("_sha", F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)))
    runs = _in_runs(told, ["_head", "_hash", "_piece"], "_norm", "_id", F.lit(1), F.col("_pieces") > 1)
    at = F.when(F.col("_pieces") > 1, F.struct("_hash", "_head", "_piece", "_run")).alias("_at")
    local = runs.select("_id", "_sha", "_first", "_keep", "_size", at, F.col("_norm").alias("_text"), *(["_row"] if carry else []))
    local = written(local.where("_first") if carry else local, "exact-runs")
    firsts = local.where("_first and _at is not null").select(F.col("_at._hash").alias("_hash"), "_at", "_text", F.col("_keep").alias("_of"), F.col("_size").alias("_n"))
    merged = _in_runs(firsts, ["_hash"], "_text", "_of", F.col("_n"), F.lit(False))
    return local, merged.select("_at", F.col("_first").alias("_leads"), F.col("_keep").alias("_all_keep"), F.col("_size").alias("_all_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    local, merged = _sorted(docs, id_col, text_col, False, piece_rows, piece_bytes)
    alone = F.col("_leads").isNull()
    return local.drop("_text").join(F.broadcast(merged), "_at", "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_keep")).otherwise(F.col("_all_keep")).alias("keep_id"),
        F.when(alone, F.col("_size")).otherwise(F.col("_all_size")).cast("long").alias("group_size"),
        (F.col("_first") & F.coalesce("_leads", F.lit(True))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: they travel through the sort themselves, and the first of each run goes on."""
    local, merged = _sorted(docs, id_col, text_col, True, piece_rows, piece_bytes)
    return local.select("_at", "_row").join(F.broadcast(merged), "_at", "left").where("coalesce(_leads, true)").select("_row.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
