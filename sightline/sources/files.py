"""Readers and writers of the stored files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schemas

# Header cells of a manifest's first row.
HEADER_CELLS = ["payload", "pallet_id", "pallet", "id", "code"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log, one JSON object a line, several revisions per event. Lines that can't be read keep
    their text in _corrupt_record. `best_frame` comes as a struct."""
    rows = spark.read.schema(schemas.EVENT).option("mode", "PERMISSIVE").json(path)
    best = F.when(F.size("best_frame") == 2, F.struct(F.col("best_frame")[0].alias("source_id"), F.col("best_frame")[1].cast("bigint").alias("frame_index")))
    return rows.withColumn("best_frame", best)


def event_json(events: DataFrame) -> DataFrame:
    """The events as JSON objects, the best frame as a pair again."""
    best = F.when(F.col("best_frame").isNotNull(), F.array(F.col("best_frame.source_id"), F.col("best_frame.frame_index").cast("string")))
    return events.withColumn("best_frame", best).select("event_id", F.to_json(F.struct(*[c for c in events.columns if c != "_corrupt_record"])).alias("body"))


def append_events(events: DataFrame, path: str) -> None:
    event_json(events).select(F.col("body").alias("value")).write.mode("append").text(path)


def read_detail(rows: DataFrame, column: str = "detail_json") -> DataFrame:
    """Stored rows with their detail parsed; a corrupt detail gives NULL fields, never an error."""
    return rows.withColumn("detail", F.from_json(column, schemas.PASS_EVENT, {"mode": "PERMISSIVE"}))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth lines: the fixed fields, and all others as a map."""
    return parse_truth(spark.read.text(path))


def parse_truth(lines: DataFrame) -> DataFrame:
    """Truth lines (value): the fixed fields, and all others as a map."""
    fixed = F.from_json("value", schemas.TRUTH)
    every = F.from_json("value", "map<string,string>")
    names = [f.split()[0] for f in schemas.TRUTH.split(", ")]
    return lines.select(fixed.alias("t"), F.map_filter(every, lambda k, v: ~k.isin(names)).alias("params")).select("t.*", "params")


def write_truth(truth: DataFrame, path: str) -> None:
    truth_lines(truth).write.mode("append").text(path)


def truth_lines(truth: DataFrame) -> DataFrame:
    """One flat object a line (value): the fixed fields, then the parameters."""
    names = [f.split()[0] for f in schemas.TRUTH.split(", ")]
    own = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.to_json(F.struct(F.col(n).alias("v"))) for n in names]))
    plain = F.transform(F.map_entries(own), lambda e: F.concat(F.lit('"'), e.key, F.lit('":'), F.regexp_extract(e.value, r'^\{"v":(.*)\}$', 1)))
    more = F.transform(F.map_entries("params"), lambda e: F.concat(F.lit('"'), e.key, F.lit('":'), F.when(e.value.rlike(r"^(-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null)$"), e.value).otherwise(F.regexp_extract(F.to_json(F.struct(e.value.alias("v"))), r'^\{"v":(.*)\}$', 1))))
    return truth.select(F.concat(F.lit("{"), F.array_join(F.filter(F.concat(plain, F.coalesce(more, F.array())), lambda x: x.isNotNull()), ","), F.lit("}")).alias("value"))


def manifest_cells(lines: DataFrame, text: str = "line", pos: str = "pos") -> DataFrame:
    """(payload, pos) of manifest lines: byte-order mark and header dropped (row 1 only), first cell, trimmed,
    blanks skipped, each payload at its first place."""
    line = F.regexp_replace(F.col(text), "^﻿", "")
    quoted = F.regexp_extract(line, '^"((?:[^"]|"")*)"', 1)
    cell = F.trim(F.when(line.startswith('"'), F.regexp_replace(quoted, '""', '"')).otherwise(F.regexp_extract(line, "^([^,\r\n]*)", 1)))
    cells = lines.select(cell.alias("payload"), F.col(pos).alias("pos"))
    head = (F.col("pos") == F.lit(0)) & F.lower("payload").isin(HEADER_CELLS)
    return cells.where((F.col("payload") != "") & ~head).groupBy("payload").agg(F.min("pos").alias("pos"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file. Its lines are numbered within the one file, which is small and read whole."""
    whole = spark.read.text(path, wholetext=True)
    return manifest_cells(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")))


def first_given(table: DataFrame, fallback: DataFrame) -> DataFrame:
    """The table's rows, or the fallback's if it has none."""
    some = table.limit(1).select(F.lit(1).alias("_some"))
    return table.unionByName(fallback.join(some, how="left_anti", on=F.lit(True)))


def find_bursts(spark: SparkSession, path: str) -> DataFrame:
    """Burst metas (dir, fields of meta.json) that can be read and have frames, sorted by directory."""
    metas = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="meta.json")
    folder = lambda p: F.regexp_replace(F.regexp_replace(p, "^file:/+", "file:///"), "/[^/]*$", "")
    rows = metas.select(folder(F.col("_metadata.file_path")).alias("dir"), F.from_json("value", schemas.BURST, {"mode": "PERMISSIVE"}).alias("m"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "frame_*.jpg").load(path)
    frames = files.select(folder(F.col("path")).alias("dir")).distinct()
    good = rows.where(F.col("m.candidate_id").isNotNull()).join(frames, "dir", "left_semi").select("dir", "m.*")
    outcome = F.coalesce("outcome", F.lit("miss"))
    return good.withColumn("outcome", outcome).withColumn("roi", F.when(F.size("roi") == 4, F.col("roi"))).orderBy("dir")


def burst_frames(spark: SparkSession, directory: str) -> DataFrame:
    """Frames of a burst with their numbers, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.jpg").load(directory)
    return files.select(F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("bigint").alias("frame_index"), "content").orderBy("frame_index")


def read_restarts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESTART).json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOT).json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG).json(path)


def read_injected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INJECT).option("header", True).csv(path)


def upgrade(rows: DataFrame, version: int) -> DataFrame:
    """Stored rows of an older layout in the current one; unknown versions are refused."""
    if version > schemas.VERSION:
        raise ValueError(f"stored version {version} is newer than {schemas.VERSION}")
    return rows if version == schemas.VERSION else rows.withColumn("revision", F.lit(0))


def sampled(frames: DataFrame, keys: list[str], order: str, stride: int) -> DataFrame:
    """Every stride-th frame of a burst, as evidence keeps them."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return frames.withColumn("_i", i).where(F.col("_i") % stride == 0).drop("_i")


def evidence_meta(found: DataFrame, frames: Column, reason: str) -> DataFrame:
    """meta.json bodies of segments with their kept frames."""
    meta = F.struct("candidate_id", F.size(frames).alias("frame_count"), frames.alias("frame_indices"), "source_id", F.array("first_frame", "last_frame").alias("segment_frames"), F.lit(reason).alias("reason"))
    return found.select("candidate_id", F.to_json(meta).alias("body"))


def to_lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
