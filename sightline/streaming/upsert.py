"""A guarded upsert that stays small: an append log, folded into a base by key buckets now and then.

    log/batch_id=<b>/            rows of a micro-batch, as they came
    base/version=<v>/bucket=<k>/ the current view of a bucket's keys, one file
    state/<v>.json               {"upto": b, "buckets": {k: version}}, the commit of version v

A batch lands in the log under its own number, so one that runs again replaces itself; one that the base has
already is passed over. Folding reads the log after `upto` and the buckets that it touches, writes these anew, and
commits by one small file; what no commit names is garbage of a failed run. Then the log up to `upto` and replaced
buckets go. A reader takes the newest commit, and sees either the one or the other."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import current_view


class Upserts:
    """The current view of a log by key: the highest revision, of equals the last to arrive; it keeps its first arrival."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, revision: str, arrival: str, buckets: int = 16, every: int = 4, kept: int = 2):
        self.spark, self.path, self.key, self.revision, self.arrival = spark, path.rstrip("/"), key, revision, arrival
        self.buckets, self.every, self.kept = buckets, every, kept
        empty = spark.createDataFrame([], schema)
        self.columns, self.log_schema = empty.columns, empty.schema
        self.base_schema = empty.withColumn("first_arrival", F.col(arrival)).schema

    # Files, through Hadoop's own interface: the folder may be in any store.

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        store, path = self._at(*parts)
        return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []

    def _drop(self, *parts: str) -> None:
        store, path = self._at(*parts)
        store.delete(path, True)

    def committed(self) -> dict:
        versions = sorted(int(n.removesuffix(".json")) for n in self._names("state") if n.endswith(".json"))
        if not versions:
            return {"version": 0, "upto": -1, "buckets": {}}
        store, path = self._at("state", f"{versions[-1]}.json")
        stream = store.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {"version": versions[-1]} | json.loads(text)

    def _commit(self, version: int, upto: int, buckets: dict) -> None:
        """By a rename, so that a reader never sees half a commit."""
        store, path = self._at("state", f"{version}.json")
        _, draft = self._at("state", f".{version}.draft")
        out = store.create(draft, True)
        out.write(json.dumps({"upto": upto, "buckets": buckets}).encode())
        out.close()
        if not store.rename(draft, path):
            raise OSError(f"{path} could not be committed")

    def _base(self, state: dict, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/base/version={v}/bucket={k}" for k, v in state["buckets"].items() if only is None or k in only]
        return self.spark.read.schema(self.base_schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.base_schema)

    def _log(self, state: dict) -> tuple[DataFrame, list[int]]:
        batches = sorted(b for n in self._names("log") if n.startswith("batch_id=") and (b := int(n[9:])) > state["upto"])
        paths = [f"{self.path}/log/batch_id={b}" for b in batches]
        rows = self.spark.read.schema(self.log_schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.log_schema)
        return rows.withColumn("first_arrival", F.col(self.arrival)), batches

    def _folded(self, rows: DataFrame) -> DataFrame:
        """current_view() of rows that may be folded already."""
        earliest = rows.groupBy(self.key).agg(F.min("first_arrival").alias("first_arrival"))
        return current_view(rows.drop("first_arrival"), self.key, self.revision, self.arrival).drop("first_arrival").join(earliest, self.key).select(*self.columns, "first_arrival")

    def view(self) -> DataFrame:
        state = self.committed()
        return self._folded(self._base(state).unionByName(self._log(state)[0]))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string")

    def fold(self) -> dict:
        """Puts the log into the base; what there was before stays until that is committed."""
        state = self.committed()
        rows, batches = self._log(state)
        if not batches:
            return state
        touched = {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # `buckets` values at most
        version = state["version"] + 1
        self._drop("base", f"version={version}")  # of a run that failed
        every = self._folded(self._base(state, touched).unionByName(rows)).withColumn("bucket", self._bucket())
        every.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/base/version={version}")
        self._commit(version, batches[-1], state["buckets"] | dict.fromkeys(sorted(touched), version))
        now = self.committed()
        for b in batches:
            self._drop("log", f"batch_id={b}")
        live = {(str(v), k) for k, v in now["buckets"].items()}
        for name in self._names("base"):
            for bucket in self._names("base", name):
                if bucket.startswith("bucket=") and (name[8:], bucket[7:]) not in live:
                    self._drop("base", name, bucket)
            if not any(v == name[8:] for v, _ in live):
                self._drop("base", name)
        for old in sorted(int(n.removesuffix(".json")) for n in self._names("state") if n.endswith(".json"))[: -self.kept]:
            self._drop("state", f"{old}.json")
        return now

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: a batch that is in the base already changes nothing."""
        state = self.committed()
        if batch_id <= state["upto"]:
            return
        batch.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
        if batch_id - state["upto"] >= self.every:
            self.fold()

    def files(self) -> int:
        """Data files there are: at most buckets, and those of `every` batches."""
        found = [n for name in self._names("log") for n in self._names("log", name)]
        found += [n for v in self._names("base") for b in self._names("base", v) if b.startswith("bucket=") for n in self._names("base", v, b)]
        return sum(n.endswith(".parquet") for n in found)
