"""Segments and misses as live streams: sources that fall silent, misses told in first-in order.

Timers do what the end of the input does in batch. In event time (the default) a source is silent when the
others have gone on for so long; `wall=True` counts by the clock on the wall instead, for a source that is alone."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import replay

EVENTS = "source_id string, seq long, kind string, frame_index long"


class LiveSegments(StatefulProcessor):
    """Hysteresis per source. What is open closes at a gap, or `silence` (ms) after the source's last frame."""

    def __init__(self, open_frames: int, quiet_frames: int, silence: int, wall: bool):
        self.open_frames, self.quiet_frames, self.silence, self.wall = open_frames, quiet_frames, silence, wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "seq long, opened boolean, streak long, quiet long, began long, last long")
        self.due = handle.getValueState("due", "at long")

    def _wait(self, at: int) -> None:
        """One timer a source: that of its last frame."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        seq, opened, streak, quiet, began, last = self.gate.get() if self.gate.exists() else (0, False, 0, 0, 0, 0)
        out = []
        frames = pd.concat(list(rows)).sort_values("frame_index")
        for index, active, gap in zip(frames["frame_index"].tolist(), frames["active"].tolist(), frames["discontinuity"].tolist(), strict=True):
            if gap:
                if opened:
                    out.append((key[0], seq, "close", last))
                opened, streak, quiet = False, 0, 0
            if active:
                streak, quiet, last = streak + 1, 0, index
                began = index if streak == 1 else began
                if not opened and streak >= self.open_frames:
                    opened, seq = True, seq + 1
                    out.append((key[0], seq, "open", began))
            else:
                streak, quiet = 0, quiet + 1
                if opened and quiet >= self.quiet_frames:
                    opened = False
                    out.append((key[0], seq, "close", last))
        self.gate.update((seq, opened, streak, quiet, began, last))
        newest = timerValues.getCurrentProcessingTimeInMs() if self.wall else int(frames["at"].max()) // 1000
        due = self.due.get()[0] if self.due.exists() else 0
        if newest + self.silence > due:
            self._wait(newest + self.silence)
        yield replay.table(out, EVENTS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        seq, opened, _, _, began, last = self.gate.get()
        self.gate.update((seq, False, 0, 0, began, last))
        if opened:
            yield replay.table([(key[0], seq, "close", last)], EVENTS)

    def close(self) -> None:
        pass


def segment_events(frames: DataFrame, open_frames: int, quiet_frames: int, silence_us: int, lateness: str = "0 seconds", wall: bool = False) -> DataFrame:
    """(source_id, seq, kind, frame_index) from (source_id, frame_index, at, active, discontinuity), `at` in microseconds."""
    rows = frames.select("source_id", "frame_index", "at", "active", "discontinuity")
    if not wall:
        rows = rows.withColumn("_clock", F.timestamp_micros("at")).withWatermark("_clock", lateness)
    return rows.groupBy("source_id").transformWithStateInPandas(LiveSegments(open_frames, quiet_frames, silence_us // 1000, wall), EVENTS, "append", "processingTime" if wall else "eventTime")


MISSES = "source_id string, seq long, settled long, place long"


class LiveMisses(StatefulProcessor):
    """Segments of a group of sources until they are settled: confirmed by a payload decoded often enough from their start to `post`
    after their end, or a miss. A source's misses are told in order of their deadlines, numbered; at a gap all that wait are settled."""

    def __init__(self, post: int, confirmations: int):
        self.post, self.confirmations = post, confirmations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getListState("spans", "source string, seq long, start long, stop long")
        self.counts = handle.getListState("counts", "source string, seq long, payload string, n long")
        self.told = handle.getListState("told", "source string, n long")
        self.timer = replay.Timer(handle)

    def _load(self) -> tuple[dict, dict, dict]:
        """By source: (start, stop) of each segment, its payloads' counts, and how many misses it has told."""
        spans: dict = {}
        counts: dict = {}
        for source, seq, start, stop in replay.held(self.spans):
            spans.setdefault(source, {})[seq] = (start, stop)
        for source, seq, payload, n in replay.held(self.counts):
            counts.setdefault(source, {}).setdefault(seq, {})[payload] = n
        return spans, counts, dict(replay.held(self.told))

    def _hold(self, spans: dict, counts: dict, told: dict) -> None:
        replay.hold(self.spans, [(source, seq, *span) for source, own in spans.items() for seq, span in own.items()])
        replay.hold(self.counts, [(source, seq, payload, n) for source, own in counts.items() for seq, said in own.items() for payload, n in said.items()])
        replay.hold(self.told, list(told.items()))

    def _first(self, spans: dict) -> int | None:
        """The first deadline, in milliseconds."""
        return min(((stop + self.post) // 1000 for own in spans.values() for _, stop in own.values() if stop is not None), default=None)

    def _settle(self, source, spans: dict, counts: dict, told: dict, due: list[tuple[int, int]]) -> list[tuple]:
        """The misses of a source's (deadline, seq), which are forgotten."""
        out = []
        for deadline, seq in sorted(due):
            del spans[seq]
            if max(counts.pop(seq, {}).values(), default=0) < self.confirmations:
                told[source] = told.get(source, 0) + 1
                out.append((source, seq, deadline, told[source]))
        return out

    def handleInputRows(self, key, rows, timerValues):
        held = self._load()
        order = {"open": 0, "close": 1, "decode": 2, "gap": 3}
        frame = pd.concat(list(rows))
        frame = frame.assign(_o=frame["kind"].map(order)).sort_values(["source_id", "at", "_o"])
        out = []
        for source, own in groupby(zip(*(frame[c].tolist() for c in ("source_id", "kind", "at", "seq", "payload")), strict=True), key=lambda r: r[0]):
            spans, counts = (h.setdefault(source, {}) for h in held[:2])
            for _, kind, at, seq, payload in own:
                if kind == "open":
                    spans[int(seq)] = (at, None)
                elif kind == "close" and int(seq) in spans:
                    spans[int(seq)] = (spans[int(seq)][0], at)
                elif kind == "decode":
                    for s, (start, stop) in spans.items():
                        if start <= at and (stop is None or at <= stop + self.post):
                            said = counts.setdefault(s, {})
                            said[payload] = said.get(payload, 0) + 1
                elif kind == "gap":
                    out += self._settle(source, spans, counts, held[2], [(stop + self.post, s) for s, (_, stop) in spans.items() if stop is not None])
        self._hold(*held)
        if (first := self._first(held[0])) is not None:
            self.timer.wait(first)
        yield replay.table(out, MISSES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, held, out = timerValues.getCurrentWatermarkInMs(), self._load(), []
        for source, spans in held[0].items():
            due = [(stop + self.post, seq) for seq, (_, stop) in spans.items() if stop is not None and (stop + self.post) // 1000 < now]
            out += self._settle(source, spans, held[1].get(source, {}), held[2], due)
        self._hold(*held)
        self.timer.again(expiredTimerInfo.getExpiryTimeInMs(), self._first(held[0]))
        if out:
            yield replay.table(out, MISSES)

    def close(self) -> None:
        pass


def misses(rows: DataFrame, post_us: int, confirmations: int, lateness: str = "0 seconds") -> DataFrame:
    """(source_id, seq, settled, place) from rows (source_id, kind, at, seq, payload): open and close of segment seq, a decode of a
    payload, or a gap in the source; `at` in microseconds."""
    clocked = rows.select("source_id", "kind", "at", "seq", "payload").withColumn("_clock", F.timestamp_micros("at")).withWatermark("_clock", lateness)
    return replay.grouped(clocked, "source_id").transformWithStateInPandas(LiveMisses(post_us, confirmations), MISSES, "append", "eventTime")
