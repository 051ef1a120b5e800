"""A seeded generator of pass events, as a data source for batch reads and streams.

Each pass is planned from its own number and the seed alone, so partitions plan theirs
independently, any number of them gives the same rows, and a lost task repeats its own."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "pass_id bigint, payload string, symbology string, speed_mph double, angle_deg double, exposure_ms double, contrast double, noise_sigma double, idle_s double, px_per_module double, blur_modules double, frames int"
MPH_TO_MM_S = 447.04


def plan_pass(i: int, seed: int, fps: float = 30.0, module_mm: float = 1.0, width: int = 960) -> tuple:
    """Draws and derived values of pass i."""
    r = random.Random(seed * 1_000_003 + i)
    speed, angle, exposure = r.uniform(3, 5), r.uniform(0, 10), r.uniform(0.5, 4)
    contrast, noise, idle, pitch = r.uniform(0.6, 1), r.uniform(1, 3), r.uniform(0.4, 0.6), r.uniform(3, 6)
    step = speed * MPH_TO_MM_S / fps * pitch / module_mm
    frames = max(2, math.ceil((width + 30 * pitch) / step))
    blur = speed * MPH_TO_MM_S * exposure / 1000 / module_mm
    return i, f"PLT-{i:06d}", "qr" if r.random() < 0.5 else "datamatrix", speed, angle, exposure, contrast, noise, idle, pitch, blur, frames


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.n, self.seed, self.parts = int(options.get("passes", 100)), int(options.get("seed", 1234)), int(options.get("partitions", 8))

    def partitions(self):
        step = max(1, -(-self.n // self.parts))
        return [_Range(lo, min(lo + step, self.n)) for lo in range(0, self.n, step)]

    def read(self, partition):
        for i in range(partition.lo, partition.hi):
            yield plan_pass(i, self.seed)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.n, self.seed, self.batch = int(options.get("passes", 100)), int(options.get("seed", 1234)), int(options.get("batch", 50))

    def initialOffset(self):
        return {"at": 0}

    def read(self, start):
        end = min(start["at"] + self.batch, self.n)
        return iter([plan_pass(i, self.seed) for i in range(start["at"], end)]), {"at": end}

    def readBetweenOffsets(self, start, end):
        return iter([plan_pass(i, self.seed) for i in range(start["at"], end["at"])])


class SyntheticPasses(DataSource):
    """format("synthetic-passes") with options passes, seed, partitions, batch."""

    @classmethod
    def name(cls):
        return "synthetic-passes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)


def open_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A source by its kind: synthetic, events (JSON lines) or frames (files)."""
    if kind == "synthetic":
        spark.dataSource.register(SyntheticPasses)
        return spark.read.format("synthetic-passes").options(**{k: str(v) for k, v in options.items()}).load()
    if kind == "events":
        from .files import read_events

        return read_events(spark, options["path"])
    if kind == "frames":
        fps = float(options.get("fps", 30.0))
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(options["path"])
        index = F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("bigint")
        return files.select(index.alias("frame_index"), (index / fps).alias("ts"), F.col("content").alias("image"))
    raise ValueError(f"unknown source {kind!r}")


def truth_ticks(at_s, fps):
    """A live instant as a nominal frame number."""
    return F.bround(at_s * fps).cast("bigint")
