"""Streaming forms: the batch operators' state machines behind transformWithState.

Within a micro-batch rows of a key are sorted by arrival number in the handler, as a
batch doesn't promise an order. Dedup runs without event time, so late rows are never
dropped; deadlines need event time and are an operator of their own."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import ACTIONS, CrossCamera, action_row, evicted_row
from .replay import table

SEGMENT_EVENTS = "source_id string, seq long, kind string, frame_index long"
MISSES = "candidate_id string, start_ms long, stop_ms long"


class _TrackerDedup(StatefulProcessor):
    """Keeps the last emitted instant of its key; with timers, until nothing can be within the window of it any more."""

    def __init__(self, window: int, schema: str, at: str, ends: bool):
        self.window, self.schema, self.at, self.ends = window, schema, at, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def _keep(self, last: int) -> None:
        self.last.update((last,))
        if self.ends:
            self.handle.registerTimer((last + self.window) // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(int(initialState["anchor"].max()))

    def handleInputRows(self, key, rows, timerValues):
        times = sorted(t for frame in rows for t in frame[self.at].tolist())
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in times:
            if last is None or t - last > self.window:
                last = t
                out.append(t)
        if out:
            self._keep(last)
        yield table([(*key, t) for t in out], self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and (self.last.get()[0] + self.window) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def tracker_dedup(sightings: DataFrame, keys: list[str], at: str, window: int, seeds: DataFrame | None = None, lateness: str | None = None) -> DataFrame:
    """Passes as in batch. `seeds` (keys, anchor), not a stream: passes of an earlier run. With `lateness` (sightings come at most so
    late; `at` in microseconds) a key's state ends when its window is over; without it keys are kept."""
    schema = ", ".join(f"{k} {sightings.schema[k].dataType.simpleString()}" for k in keys) + f", {at} long"
    rows = sightings.select(*keys, at)
    if lateness is not None:
        rows = rows.withColumn("_clock", F.timestamp_micros(at)).withWatermark("_clock", lateness)
    first = None if seeds is None else seeds.select(*keys, F.col("anchor").cast("long").alias("anchor")).groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(_TrackerDedup(window, schema, at, lateness is not None), schema, "append", "none" if lateness is None else "eventTime", first)


class _CrossCamera(StatefulProcessor):
    """Keeps a payload's passes; the same fold as in batch, so both agree row by row.

    Passes that the slowest of `cameras` has left behind are forgotten, and the oldest above `most`, which a row counts;
    without these all are kept. Late rows are never dropped: one meets the pass near it, or is a pass of its own."""

    def __init__(self, window: int, cameras: list[str] | None, most: int | None):
        self.window, self.cameras, self.most = window, cameras, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("passes", "body string")

    def handleInputRows(self, key, rows, timerValues):
        fold = CrossCamera(self.window)
        if self.state.exists():
            kept = json.loads(self.state.get()[0])
            fold.passes = {int(a): p for a, p in kept["passes"].items()}
            fold.anchors, fold.marks = sorted(fold.passes), kept["marks"]
        frame = pd.concat(list(rows)).sort_values(["arrival_seq", "frame"])
        whole = lambda v: None if pd.isna(v) else int(v)
        out = []
        for r in frame.itertuples(index=False):
            out.append(action_row(key[0], int(r.arrival_seq), r.source_id, *fold.absorb(int(r.at), r.source_id, whole(r.first_seen), whole(r.first_decode), int(r.decode_count), int(r.frame))))
            if self.cameras is not None:
                fold.settle(self.cameras)
            if self.most is not None and (gone := fold.evict(self.most)):
                out.append(evicted_row(key[0], int(r.arrival_seq), gone))
        self.state.update((json.dumps({"passes": fold.passes, "marks": fold.marks}),))
        yield table(out, ACTIONS)

    def close(self) -> None:
        pass


def cross_camera(sightings: DataFrame, window: int, cameras: list[str] | None = None, most: int | None = None) -> DataFrame:
    columns = ["payload", "source_id", "at", "arrival_seq", "frame", "first_seen", "first_decode", "decode_count"]
    return sightings.select(*columns).groupBy("payload").transformWithStateInPandas(_CrossCamera(window, cameras, most), ACTIONS, "append", "none")


class _Segments(StatefulProcessor):
    """Hysteresis per source: emits open and close events as frames arrive in order. A frame whose `active` is
    NULL ends its source: what is open closes."""

    def __init__(self, open_frames: int, quiet_frames: int):
        self.open_frames, self.quiet_frames = open_frames, quiet_frames

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "seq long, opened boolean, streak long, quiet long, began long, last long")

    def handleInputRows(self, key, rows, timerValues):
        seq, opened, streak, quiet, began, last = self.state.get() if self.state.exists() else (0, False, 0, 0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_index").itertuples(index=False):
            ends = pd.isna(r.active)
            if ends or r.discontinuity:
                if opened:
                    out.append((key[0], seq, "close", last))
                opened, streak, quiet = False, 0, 0
            if ends:
                continue
            if r.active:
                streak, quiet, last = streak + 1, 0, int(r.frame_index)
                began = last if streak == 1 else began
                if not opened and streak >= self.open_frames:
                    opened, seq = True, seq + 1
                    out.append((key[0], seq, "open", began))
            else:
                streak, quiet = 0, quiet + 1
                if opened and quiet >= self.quiet_frames:
                    opened = False
                    out.append((key[0], seq, "close", last))
        self.state.update((seq, opened, streak, quiet, began, last))
        yield table(out, SEGMENT_EVENTS)

    def close(self) -> None:
        pass


def segment_events(frames: DataFrame, open_frames: int, quiet_frames: int) -> DataFrame:
    """(source_id, seq, kind, frame_index) from (source_id, frame_index, active, discontinuity)."""
    columns = ["source_id", "frame_index", "active", "discontinuity"]
    return frames.select(*columns).groupBy("source_id").transformWithStateInPandas(_Segments(open_frames, quiet_frames), SEGMENT_EVENTS, "append", "none")


class _Misses(StatefulProcessor):
    """A closed segment without a confirmed payload is a miss once its post-roll is over."""

    def __init__(self, post_ms: int, confirmations: int):
        self.post_ms, self.confirmations = post_ms, confirmations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "payload string", "n long")
        self.span = handle.getValueState("span", "start long, stop long")

    def handleInputRows(self, key, rows, timerValues):
        for r in pd.concat(list(rows)).sort_values("at").itertuples(index=False):
            at = int(pd.Timestamp(r.at).timestamp() * 1000)
            if r.kind == "decode":
                n = self.counts.getValue((r.payload,))[0] if self.counts.containsKey((r.payload,)) else 0
                self.counts.updateValue((r.payload,), (n + 1,))
            else:
                start, stop = self.span.get() if self.span.exists() else (at, at)
                self.span.update((min(start, at), max(stop, at)))
                if r.kind == "close":
                    self.handle.registerTimer(at + self.post_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        counts = [v[0] for v in self.counts.values()]
        out = [] if any(n >= self.confirmations for n in counts) else [(key[0], *self.span.get())]
        self.counts.clear()
        self.span.clear()
        if out:
            yield table(out, MISSES)

    def close(self) -> None:
        pass


def misses(events: DataFrame, post_ms: int, confirmations: int, lateness: str = "10 seconds") -> DataFrame:
    """(candidate_id, start_ms, stop_ms) from (candidate_id, kind open/decode/close, payload, at TIMESTAMP)."""
    marked = events.select("candidate_id", "kind", "payload", "at").withWatermark("at", lateness)
    return marked.groupBy("candidate_id").transformWithStateInPandas(_Misses(post_ms, confirmations), MISSES, "append", "eventTime")


def windowed_rates(events: DataFrame, at: str, width: str = "1 hour", slide: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Passes and misses per sliding window of event time; late rows count until the watermark passes."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width, slide), "source_id").agg(F.count_if(F.col("kind") == "pass").alias("passes"), F.count_if(F.col("kind") == "miss").alias("misses"))
