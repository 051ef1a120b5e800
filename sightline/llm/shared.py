"""Helpers that several operators use: the shared folder, tables written there,
and ranks inside groups of any size."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as all word and text rules here define it.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Tables that written() has made in this process.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir), with its file system.

    A path without one is of the cluster's default file system. Only where none is named and Spark runs in this one
    process, as in tests, a temporary folder is set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sightline-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/sightline-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_written(spark: SparkSession) -> int:
    """Deletes the tables written so far, once no result that reads them is needed any more; how many."""
    n = len(WRITTEN)
    while WRITTEN:
        dropped(spark, WRITTEN.pop())
    return n


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path, if anything is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now: it does so when the
    driver's collectors find their plans unused, which may otherwise take half an hour.
    The first round frees what Python held, the second what that had kept in the JVM."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def dealt_bucket(buckets: int, *cols: str) -> Column:
    """A bucket number from the row's own values, the same on each run."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def bucket_bases(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each (keys, bucket) inside its keys: counts combine before the
    shuffle, and a window sees one row per bucket only, however large a group is."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n_in_bucket"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n_in_bucket").over(before), F.lit(0)))
