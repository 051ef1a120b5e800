"""Views of the engine's inputs over the driver's tables, in Spark and in DuckDB SQL.

Instants are integer microseconds, computed without a session time zone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 21_600_000_000
CAMERAS = ["click", "purchase", "signup", "view"]
HOUR, DAY = 3_600_000_000, 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01


def micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with `place`, the number of a row in the order in which the table is stored: by file, and in it by row."""
    rows = table(spark, sf_dir, name)
    files = sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    file = F.array_position(F.array(*map(F.lit, files)), path) if len(files) > 1 else F.lit(0)
    return rows.withColumn("place", F.shiftleft(file.cast("long"), 40) + F.col("_metadata.row_index"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("ts_us"), F.format_string("PLT-%06d", "user_id").alias("payload"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings by camera; arrival differs from time order on purpose."""
    return timed(spark, sf_dir).where("event_type <> 'error'").select(
        "event_id", "user_id", "payload", F.col("event_type").alias("source_id"), "ts_us", "value",
        (F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(5)) * 700).alias("arrival_seq"),
        (1 + F.floor("value") % 8).cast("long").alias("decode_count"), (F.col("ts_us") - F.floor(F.col("value") * 1000)).cast("long").alias("first_seen_us"))


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    camera = F.element_at(F.array(*map(F.lit, CAMERAS)), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return timed(spark, sf_dir).where("event_type = 'error'").select("event_id", "payload", camera.alias("source_id"), F.col("ts_us").alias("start"), (F.col("ts_us") + F.floor(F.col("value") * 1_000_000)).cast("long").alias("end"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth payloads, one an event: of two in three a variant that is never read."""
    payload = F.when(F.col("event_id") % 3 == 0, F.col("payload")).otherwise(F.concat("payload", F.lit("-X")))
    return timed(spark, sf_dir).select(F.col("event_id").alias("pass_id"), payload.alias("payload"), F.col("ts_us").alias("t0"), (F.col("ts_us") + 60_000_000).alias("t1"))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a manifest file: a header, repeats, blanks and spaces."""
    rows = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 50 == 0, F.lit("  ,note")).otherwise(F.format_string(" PLT-%06d ,%s", F.col("c_custkey") % 700, F.col("c_mktsegment")))
    head = spark.range(1).select(F.lit("﻿Pallet_ID,segment").alias("line"), F.lit(0).cast("long").alias("pos"))
    return rows.select(line.alias("line"), F.col("c_custkey").alias("pos")).unionByName(head)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_us", "event_id"))
    return timed(spark, sf_dir).select("user_id", "payload", place.cast("long").alias("frame_index"), "ts_us", (F.col("value") > 30).alias("active"), (F.col("event_id") % 97 == 0).alias("discontinuity"), "event_type", "event_id", "value")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a day, of the days that have events."""
    days = timed(spark, sf_dir).select(F.floor((F.col("ts_us") - START) / DAY).cast("long").alias("id")).distinct()
    return days.select("id", (START + F.col("id") * DAY).alias("started"), (START + F.col("id") * DAY + DAY - 1).alias("ended"), F.lit(300).cast("long").alias("expected"))


SQL = r"""
timed AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts_us, printf('PLT-%06d', user_id) AS payload FROM events),
sightings AS (SELECT event_id, user_id, payload, event_type AS source_id, ts_us, value, event_id + (event_id * 7919 % 5) * 700 AS arrival_seq,
    (1 + floor(value)::BIGINT % 8)::BIGINT AS decode_count, (ts_us - floor(value * 1000)::BIGINT)::BIGINT AS first_seen_us FROM timed WHERE event_type <> 'error'),
misses AS (SELECT event_id, payload, (['click', 'purchase', 'signup', 'view'])[user_id % 4 + 1] AS source_id, ts_us AS start, ts_us + floor(value * 1000000)::BIGINT AS stop FROM timed WHERE event_type = 'error'),
truth AS (SELECT event_id AS pass_id, CASE WHEN event_id % 3 = 0 THEN payload ELSE payload || '-X' END AS payload, ts_us AS t0, ts_us + 60000000 AS t1 FROM timed),
manifest_lines AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN '  ,note' ELSE printf(' PLT-%06d ,%s', c_custkey % 700, c_mktsegment) END AS line, c_custkey AS pos FROM customer
    UNION ALL SELECT chr(65279) || 'Pallet_ID,segment', 0),
manifest AS (SELECT trim(split_part(line, ',', 1)) AS payload, min(pos) AS pos FROM manifest_lines WHERE pos > 0 AND trim(split_part(line, ',', 1)) <> '' GROUP BY 1),
frames AS (SELECT user_id, payload, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS frame_index, ts_us, value > 30 AS active, event_id % 97 = 0 AS discontinuity, event_type, event_id, value FROM timed),
sessions AS (SELECT id, 1704067200000000 + id * 86400000000 AS started, 1704067200000000 + id * 86400000000 + 86400000000 - 1 AS ended, 300 AS expected FROM (SELECT DISTINCT (ts_us - 1704067200000000) // 86400000000 AS id FROM timed))
"""
