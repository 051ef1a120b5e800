"""Sinks of event streams: one foreachBatch that fans out, each sink failing alone.

Every sink is idempotent by micro-batch: a batch that runs again replaces what its first
run wrote."""

from __future__ import annotations

import json
import logging
import random
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]


LOST = "rows long, error string, batch_id long, sink string"


def fan_out(sinks: dict[str, Sink], counts: dict[str, dict[str, int]] | None = None, lost: dict[str, int] | None = None, losses: str | None = None) -> Sink:
    """All sinks in turn; an error in one is counted and logged, and doesn't stop the others.

    `counts` has batches by sink, `lost` the rows of failed ones, in this run; `losses` is a table (LOST) that has them
    over all runs, a batch that runs again replacing what it told. A sink that must not lose rows writes them to its
    outbox first, as http_sink() does."""
    counts, lost = counts if counts is not None else {}, lost if lost is not None else {}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                own = counts.setdefault(name, {"ok": 0, "failed": 0})
                try:
                    sink(batch, batch_id)
                    own["ok"] += 1
                    if losses is not None:
                        _table_gone(batch.sparkSession, f"{losses}/batch_id={batch_id}/sink={name}")
                except Exception as error:
                    own["failed"] += 1
                    n = batch.count()
                    lost[name] = lost.get(name, 0) + n
                    log.exception("sink %s failed on batch %s", name, batch_id)
                    if losses is not None:
                        batch.sparkSession.createDataFrame([(n, repr(error)[:500])], "rows long, error string").coalesce(1).write.mode("overwrite").parquet(f"{losses}/batch_id={batch_id}/sink={name}")
        finally:
            batch.unpersist()

    return write


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """Rows that sinks have lost: rows, error, batch_id, sink."""
    return _table(spark, path, LOST)


def _table_gone(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def log_sink(path: str, key: str = "event_id") -> Sink:
    """Append-only Parquet log by batch; rows carry batch_id and an arrival number for the current view."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("ingest_seq", F.lit(batch_id) * (1 << 40) + F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def json_sink(path: str) -> Sink:
    return lambda batch, batch_id: batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def console_sink(rows: int = 20) -> Sink:
    return lambda batch, _: batch.show(rows, truncate=False)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")


def outbox_sink(path: str) -> Sink:
    """Bodies to deliver: (seq, event_id, body, enqueued_utc), by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        body = F.to_json(F.struct(*batch.columns))
        seq = F.lit(batch_id) * (1 << 40) + F.monotonically_increasing_id()
        batch.select(seq.alias("seq"), F.col("event_id").cast("string").alias("event_id"), body.alias("body"), F.lit(time.time()).alias("enqueued_utc")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


ACK = "seq long, event_id string, delivered boolean"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, empty if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def pending(spark: SparkSession, path: str) -> DataFrame:
    """What an outbox has that isn't acknowledged: its rows without those whose seq an acknowledgement names."""
    box = _table(spark, path, "seq long, event_id string, body string, enqueued_utc double, batch_id long")
    return box.join(_table(spark, path + "-acks", ACK), "seq", "left_anti")


def drain(spark: SparkSession, path: str, send: Callable[[str], bool], lanes: int = 1, **options) -> tuple[int, int]:
    """Delivers what is pending, and writes down what was taken; the numbers of bodies taken and left.

    At least once: a body that was taken just before a failure is sent again. Acknowledged batches leave the outbox
    when all of their bodies are taken."""
    taken = deliver(pending(spark, path), send, lanes=lanes, **options).where("delivered")
    taken.write.mode("append").parquet(path + "-acks")
    left = pending(spark, path)
    n_left, waiting = left.count(), {r[0] for r in left.select("batch_id").distinct().collect()}
    n_taken = _table(spark, path + "-acks", ACK).select("seq").distinct().count()
    box = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = box.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(box) if store.exists(box) else []:
        name = folder.getPath().getName()
        if name.startswith("batch_id=") and int(name[9:]) not in waiting:
            store.delete(folder.getPath(), True)
    return n_taken, n_left


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def post(url: str, body: str, timeout: float = 10.0) -> bool:
    """Whether the endpoint took the body: a 2xx answer, redirects refused."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except OSError:
        return False


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait before an attempt, with up to a half added or taken."""
    return min(most, base * 2**attempt) * (0.5 + jitter())


def deliver(outbox: DataFrame, send: Callable[[str], bool], tries: int = 5, wait: Callable[[int], float] = backoff, lanes: int = 1) -> DataFrame:
    """Sends bodies in order of seq, at least once; (seq, event_id, delivered).

    One lane keeps the order of all. Several keep that of each event_id, whose revisions share a lane. A body that
    isn't taken stops its lane, so order is kept; the rest stays for the next run."""

    def run(batches):
        stopped = False
        for frame in batches:
            done = []
            for body in frame["body"]:
                ok = False
                for attempt in range(0 if stopped else tries):
                    ok = send(body)
                    if ok:
                        break
                    time.sleep(wait(attempt))
                stopped = stopped or not ok
                done.append(ok)
            yield frame[["seq", "event_id"]].assign(delivered=done)

    rows = outbox.select("seq", "event_id", "body")
    dealt = rows.repartition(1) if lanes == 1 else rows.repartition(lanes, "event_id")
    return dealt.sortWithinPartitions("seq").mapInPandas(run, ACK)


def http_sink(path: str, url: str, send: Callable[[str, str], bool] = post, lanes: int = 1, **options) -> Sink:
    """Store and forward: a batch goes to the outbox at `path` and then all that is pending to the address, oldest
    first. What isn't taken stays for the next batch; nothing is lost while the endpoint is down."""
    keep = outbox_sink(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id)
        _, left = drain(batch.sparkSession, path, lambda body: send(url, body), lanes, **options)
        if left:
            log.warning("%s bodies wait for %s", left, url)

    return write


def collector_sink(kept: list, cap: int = 100_000) -> Sink:
    """Keeps the first `cap` rows of a run on the driver, as (kept, number left out): kept[0] a list, kept[1] a count."""
    kept[:] = [[], 0]

    def write(batch: DataFrame, batch_id: int) -> None:
        room, n = cap - len(kept[0]), batch.count()
        kept[0] += batch.limit(room).collect() if room > 0 else []
        kept[1] += max(0, n - max(0, room))

    return write


def build(config: dict[str, str]) -> dict[str, Sink]:
    """Sinks by name: console, log, json, outbox, http, each with its path; that of http is followed by a blank and the address."""
    makers = {"console": lambda _: console_sink(), "log": log_sink, "json": json_sink, "outbox": outbox_sink, "http": lambda where: http_sink(*where.split(" ", 1))}
    return {name: makers[name](where) for name, where in config.items()}


def as_json(event: dict) -> str:
    return json.dumps(event, ensure_ascii=False)
