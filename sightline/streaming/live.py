"""Cross-camera dedup as a live stream: one input stream per camera, state that ends.

Each camera is a stream of its own with its own watermark, its newest instant less the window.
Spark takes the least of them for all keys (multipleWatermarkPolicy min), which is what the
slowest camera has left behind: a camera that hasn't spoken holds everything. A group of payloads
has a timer at its first anchor, so a payload's pass goes even if none of its cameras speaks again.

A camera's rows come in the order of its clock; one that is later than the watermark by its own
camera's doing would be dropped by Spark and counted in its progress (numRowsDroppedByWatermark)."""

from __future__ import annotations

import json
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import ACTIONS, CrossCamera, action_row, evicted_row
from . import replay

SIGHTING = "payload string, source_id string, at long, arrival_seq long, frame long, first_seen long, first_decode long, decode_count long"


class LiveCrossCamera(StatefulProcessor):
    """Passes of a group of payloads, one state row each; an empty body is a seed. A row without a camera is a marker: the
    pass at its instant is evicted."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passes = handle.getListState("passes", "payload string, anchor long, body string")
        self.timer = replay.Timer(handle)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        seeds = [(p, int(a), "") for p, a in zip(initialState["payload"].tolist(), initialState["anchor"].tolist(), strict=True)]
        self.passes.appendList(seeds)
        self.timer.wait(min(a for _, a, _ in seeds) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        held: dict[str, dict[int, str]] = {}
        for payload, anchor, body in replay.held(self.passes):
            held.setdefault(payload, {})[anchor] = body
        whole = lambda v: None if pd.isna(v) else int(v)
        out = []
        frame = pd.concat(list(rows)).sort_values(["payload", "arrival_seq", "frame"])
        columns = ("payload", "source_id", "at", "arrival_seq", "frame", "first_seen", "first_decode", "decode_count")
        for payload, own in groupby(zip(*(frame[c].tolist() for c in columns), strict=True), key=lambda r: r[0]):
            bodies = held.setdefault(payload, {})
            fold, changed = CrossCamera(self.window), set()
            fold.passes = {a: json.loads(body) if body else None for a, body in bodies.items()}
            fold.anchors = sorted(fold.passes)
            for _, source, at, seq, index, seen, decode, count in own:
                if not isinstance(source, str):
                    if int(at) in fold.passes:
                        fold.anchors.remove(int(at))
                        del fold.passes[int(at)]
                        bodies.pop(int(at), None)
                        out.append(evicted_row(payload, int(seq), 1))
                    continue
                action, anchor, now = fold.absorb(int(at), source, whole(seen), whole(decode), int(count), int(index))
                out.append(action_row(payload, int(seq), source, action, anchor, now))
                if now is not None:
                    changed.add(anchor)
            for anchor in changed & set(fold.passes):
                bodies[anchor] = json.dumps(fold.passes[anchor])
        self._hold(held)
        if anchors := [a for bodies in held.values() for a in bodies]:
            self.timer.wait(min(anchors) // 1000)
        yield replay.table(out, ACTIONS)

    def _hold(self, held: dict[str, dict[int, str]]) -> None:
        replay.hold(self.passes, [(p, a, body) for p, bodies in held.items() for a, body in bodies.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        left = [r for r in replay.held(self.passes) if r[1] // 1000 >= now]
        replay.hold(self.passes, left)
        self.timer.again(expiredTimerInfo.getExpiryTimeInMs(), min(a for _, a, _ in left) // 1000 if left else None)
        return iter(())

    def close(self) -> None:
        pass


def cross_camera(cameras: list[DataFrame], window: int, seeds: DataFrame | None = None) -> DataFrame:
    """Actions from a stream of sightings per camera; instants in microseconds. Seeds (payload, anchor): passes of an earlier run,
    which swallow what is near them."""
    union = None
    for rows in cameras:
        clocked = rows.withColumn("clock", F.timestamp_micros("at")).withWatermark("clock", f"{window // 1000} milliseconds")
        union = clocked if union is None else union.unionByName(clocked)
    first = None if seeds is None else replay.grouped(seeds.select("payload", F.col("anchor").cast("long").alias("anchor")).where("anchor is not null"), "payload")
    return replay.grouped(union, "payload").transformWithStateInPandas(LiveCrossCamera(window), ACTIONS, "append", "eventTime", first)


def replay_cross_camera(spark: SparkSession, sightings: DataFrame, window: int, cameras: list[str], batches: int = 3, seeds: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Stored sightings run through the stream in order of arrival_seq: its actions, and its checkpoint."""
    base = replay.fresh(spark, "cross-camera")
    folders = {c: f"{base}/in/{i}" for i, c in enumerate(cameras)}
    rows = sightings.select(*[c.split()[0] for c in SIGHTING.split(", ")])
    replay.land(rows, "arrival_seq", batches, folders, "source_id")
    with replay.settings(spark):
        done = replay.finished(lambda: cross_camera([replay.source(spark, p, SIGHTING) for p in folders.values()], window, seeds), f"{base}/out", f"{base}/checkpoint")
    return done, f"{base}/checkpoint"


def live_passes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the stream still holds: (payload, anchor, seeded)."""
    return replay.state(spark, checkpoint, "passes").select("list_element.payload", "list_element.anchor", (F.col("list_element.body") == "").alias("seeded"))


def run_capped(spark: SparkSession, sightings: DataFrame, window: int, cameras: list[str], most: int, batches: int = 4) -> tuple[DataFrame, DataFrame]:
    """The stream with at most `most` passes over all payloads after each micro-batch: its actions, and what it holds in the end.

    No group knows of the others, so the number is read from the state between micro-batches, and marker rows evict what is
    before the oldest that stays (ties by payload). Each eviction is an action, so the counters see it."""
    base = replay.fresh(spark, "capped")
    folders = {c: f"{base}/in/{i}" for i, c in enumerate(cameras)}
    rows = sightings.select(*[c.split()[0] for c in SIGHTING.split(", ")])
    ends = replay.cuts(rows, "arrival_seq", batches)
    edges = [None, *ends, None]

    def step() -> DataFrame:
        return replay.finished(lambda: cross_camera([replay.source(spark, p, SIGHTING) for p in folders.values()], window), f"{base}/out", f"{base}/checkpoint")

    with replay.settings(spark):
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = rows if lo is None else rows.where(F.col("arrival_seq") > lo)
            part = part if hi is None else part.where(F.col("arrival_seq") <= hi)
            replay.land(part, "arrival_seq", 1, folders, "source_id", [])
            done = step()
            held = live_passes(spark, f"{base}/checkpoint")
            if held.count() > most:
                none, place = F.lit(None), F.struct("anchor", "payload")
                stays = held.select(place.alias("p")).orderBy(F.desc("p")).limit(most).agg(F.min("p").alias("_stays"))
                marks = held.join(F.broadcast(stays), place < F.col("_stays")) if most else held
                marks = marks.select("payload", none.cast("string").alias("source_id"), F.col("anchor").alias("at"), F.lit(hi if hi is not None else 0).cast("long").alias("arrival_seq"), *[none.cast("long").alias(c) for c in ("frame", "first_seen", "first_decode", "decode_count")])
                marks.coalesce(1).write.mode("append").parquet(folders[cameras[0]])
                done = step()
    return done, live_passes(spark, f"{base}/checkpoint")
