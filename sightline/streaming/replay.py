"""Stored tables as streams: rows land in arrival order, and a stream over them runs to its end.

A micro-batch is one file of each folder. Folders, checkpoints and results are in the folder
that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys are dealt to so many groups, each of which calls its handler once a micro-batch: a call of the state costs as much for
#: one key as for hundreds.
GROUPS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_KINDS = {"long": "Int64", "bigint": "Int64", "int": "Int32", "double": "Float64"}


def table(rows: list, schema: str) -> pd.DataFrame:
    """Rows as a frame whose columns have the same types whatever is in them: Spark puts those of several keys together."""
    columns = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=_KINDS.get(kind, object)) for i, (name, kind) in enumerate(columns)})


def grouped(rows: DataFrame, key: str):
    """Rows by groups of keys."""
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")).groupBy("_group")


def held(state) -> list[tuple]:
    """The rows of a list state."""
    return list(state.get()) if state.exists() else []


def hold(state, rows: list[tuple]) -> None:
    """Puts rows in place of those of a list state."""
    if rows:
        state.put(rows)
    else:
        state.clear()


class Timer:
    """The one timer of a group, at the first instant (ms) at which something in it is over. It may fire too soon, never too late."""

    def __init__(self, handle):
        self.handle, self.due = handle, handle.getValueState("due", "at long")

    def wait(self, at: int) -> None:
        """To be fired once the clock is past `at`."""
        if self.due.exists():
            before = self.due.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.due.update((at,))
        self.handle.registerTimer(at)

    def again(self, fired: int, at: int | None) -> None:
        """After it has fired: for what is over next, if anything."""
        self.due.clear()
        if at is not None:
            self.wait(max(at, fired + 1))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set and Spark runs in this one process, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sightline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/stream-{tag}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, partitions: int = 8, **more: str) -> Iterator[None]:
    """What stateful streams need, for the time of a run; the number of state partitions stays with the checkpoint."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions), "spark.sql.streaming.multipleWatermarkPolicy": "min", **more}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cuts(rows: DataFrame, arrival: str, batches: int) -> list[float]:
    """Arrival numbers at which micro-batches end; the last has the rest."""
    return rows.approxQuantile(arrival, [k / batches for k in range(1, batches)], 0.005) if batches > 1 else []


def land(rows: DataFrame, arrival: str, batches: int, folders: dict[str, str], split: str | None = None, ends: list[float] | None = None) -> None:
    """Writes rows as one file per micro-batch, in order of arrival, to a folder for each value of `split` (or to the one
    folder there is). A file is written even where it has no row, so all folders keep step.

    Rows are dealt to micro-batches and folders in one pass; of each part a task then makes the file, folders beside each other."""
    ends = cuts(rows, arrival, batches) if ends is None else ends
    values, paths = list(folders), list(folders.values())
    if not ends and split is None:
        rows.coalesce(1).write.mode("append").parquet(paths[0])
        return
    batch = sum(((F.col(arrival) > e).cast("int") for e in ends), F.lit(0))
    folder = F.lit(1) if split is None else F.array_position(F.array(*map(F.lit, values)), F.col(split)).cast("int")
    staged = f"{paths[0]}-staged-{uuid.uuid4().hex}"
    rows.withColumns({"_batch": batch, "_folder": folder}).where("_batch is not null and _folder > 0").write.partitionBy("_batch", "_folder").parquet(staged)
    parts = rows.sparkSession.read.schema(rows.withColumns({"_batch": batch, "_folder": folder}).schema).parquet(staged)

    def one(k: int, i: int) -> None:
        parts.where((F.col("_batch") == k) & (F.col("_folder") == i + 1)).select(*rows.columns).coalesce(1).write.mode("append").parquet(paths[i])

    with ThreadPoolExecutor(4) as pool:
        for k in range(len(ends) + 1):
            list(pool.map(lambda i, k=k: one(k, i), range(len(paths))))


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(build: Callable[[], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Runs the stream until its input is used up; what it has written so far, as a table."""
    stream = build()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def state(spark: SparkSession, checkpoint: str, name: str, operator: int = 0) -> DataFrame:
    """Rows of a state variable after the last finished micro-batch."""
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", name).load()
