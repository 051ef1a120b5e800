"""Two dedup operators whose anchors suppressed sightings don't refresh.

Tracker dedup is one-sided and per source; cross-camera dedup is two-sided, takes
sightings in arrival order and merges cameras into one pass with revisions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracker_dedup(sightings: DataFrame, keys: list[str], at: str, window: int, seeds: DataFrame | None = None) -> DataFrame:
    """Sightings that become passes: the first, then each later than the last pass by more than `window`.

    `seeds` (keys, anchor) suppress like an earlier pass. Sorted sightings stream through one shuffle; a key's
    state is its last pass, and a search in the sorted times leads from each pass to the next. Sightings without a
    time are none."""
    rows = sightings.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(False).alias("_seed")).where("_at is not null")
    if seeds is not None:
        rows = rows.unionByName(seeds.select(*keys, F.col("anchor").cast("long").alias("_at"), F.lit(True).alias("_seed")))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_at", F.desc("_seed"))

    def run(batches):
        key, last = None, None
        for batch in batches:
            times, seeded = batch.column("_at").to_numpy(), batch.column("_seed").to_numpy(zero_copy_only=False)
            coded = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:-2]]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1 if len(times) else []
            kept = []
            for lo, hi in zip([0, *changes], [*changes, len(times)], strict=True):
                own = [c[int(lo)].as_py() for c in batch.columns[:-2]] if hi > lo else key
                if own != key:
                    key, last = own, None
                i = lo
                while i < hi:
                    if last is not None and times[i] - last <= window:
                        i = lo + int(np.searchsorted(times[lo:hi], last + window, "right"))
                        continue
                    last = int(times[i])
                    if not seeded[i]:
                        kept.append(i)
                    i += 1
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(kept, pa.int64())).columns[:-1], names=[*keys, at])

    return dealt.mapInArrow(run, ", ".join(f"`{k}` {sightings.schema[k].dataType.simpleString()}" for k in keys) + f", `{at}` long")


@dataclass(frozen=True)
class Sighting:
    at: int
    camera: str
    first_seen: int | None
    first_decode: int | None
    count: int
    frame: int


def new_pass(s: Sighting) -> dict:
    return {"first_seen": s.first_seen, "last_seen": s.at, "first_decode": s.first_decode, "decode_count": s.count, "cameras": {s.camera: s.count}, "best_camera": s.camera, "best_frame": s.frame, "frames": [s.frame], "revision": 0}


def merged_pass(p: dict, s: Sighting) -> dict:
    """The next revision: earliest starts, latest end, sums, and the best frame of whoever decoded first."""
    earliest = lambda *times: min((t for t in times if t is not None), default=None)
    first_decode = earliest(p["first_decode"], s.first_decode)
    sooner = p["first_decode"] is None or first_decode != p["first_decode"]
    best = {"best_camera": s.camera, "best_frame": s.frame} if sooner else {}
    return p | best | {
        "first_seen": earliest(p["first_seen"], s.first_seen), "last_seen": max(p["last_seen"], s.at), "first_decode": first_decode, "decode_count": p["decode_count"] + s.count,
        "cameras": p["cameras"] | {s.camera: s.count}, "frames": [*p["frames"], s.frame], "revision": p["revision"] + 1}


class CrossCamera:
    """State of one payload: passes by anchor, None for a seed. Anchors never move.

    What a sighting does follows from the pass at the nearest anchor within the window, on either side, ties
    to the older: none there, it makes one (emit); a seed swallows it (restart_repeat); one that its camera has a
    part in already, too (repeat); any other takes it in (merge). `marks` has the newest instant of each camera: what
    the slowest of them has left behind by more than the window can be forgotten."""

    def __init__(self, window: int, seeds: tuple[int, ...] = ()):
        self.window, self.anchors, self.marks = window, sorted(seeds), {}
        self.passes: dict[int, dict | None] = dict.fromkeys(self.anchors)

    def nearest(self, at: int) -> int | None:
        lo, hi = bisect_left(self.anchors, at - self.window), bisect_right(self.anchors, at + self.window)
        return min(self.anchors[lo:hi], key=lambda a: (abs(at - a), a), default=None)

    def action(self, anchor: int | None, camera: str) -> str:
        if anchor is None:
            return "emit"
        at_anchor = self.passes[anchor]
        return "restart_repeat" if at_anchor is None else "repeat" if camera in at_anchor["cameras"] else "merge"

    def absorb(self, at: int, camera: str, first_seen: int | None, first_decode: int | None, count: int, frame: int) -> tuple[str, int, dict | None]:
        """The action, its anchor, and the pass as it is then (None where nothing is sent on)."""
        s = Sighting(at, camera, first_seen, first_decode, count, frame)
        self.marks[camera] = max(at, self.marks.get(camera, at))
        anchor = self.nearest(at)
        what = self.action(anchor, camera)
        if what == "emit":
            anchor = at
            insort(self.anchors, anchor)
            self.passes[anchor] = new_pass(s)
        elif what == "merge":
            self.passes[anchor] = merged_pass(self.passes[anchor], s)
        return what, anchor, self.passes[anchor] if what in ("emit", "merge") else None

    def forget(self, before: int) -> int:
        """Drops passes that no camera can still reach; the count of them."""
        k = bisect_left(self.anchors, before)
        for a in self.anchors[:k]:
            del self.passes[a]
        self.anchors = self.anchors[k:]
        return k

    def settle(self, cameras: list[str]) -> int:
        """Drops passes that none of the cameras can still reach, as the slowest of them is past; the count of them."""
        if not all(c in self.marks for c in cameras):
            return 0
        return self.forget(min(self.marks[c] for c in cameras) - self.window)

    def evict(self, most: int) -> int:
        """Forced eviction of the oldest passes above a number of them; the count, for the counters."""
        over = len(self.anchors) - most
        return self.forget(self.anchors[over]) if over > 0 else 0


ACTIONS = "payload string, arrival_seq long, source_id string, action string, anchor long, revision int, first_seen long, last_seen long, first_decode long, decode_count long, n_cameras int, best_camera string, best_frame long"
_COLUMNS = [c.split()[0] for c in ACTIONS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def action_row(payload: str, seq: int, source: str, action: str, anchor: int, p: dict | None) -> list:
    if p is None:
        return [payload, seq, source, action, anchor, *[None] * 8]
    return [payload, seq, source, action, anchor, p["revision"], p["first_seen"], p["last_seen"], p["first_decode"], p["decode_count"], len(p["cameras"]), p["best_camera"], p["best_frame"]]


def evicted_row(payload: str, seq: int, n: int) -> list:
    """A row that counts passes forgotten above the cap."""
    return [payload, seq, None, "evict", None, None, None, None, None, n, None, None, None]


def cross_camera(sightings: DataFrame, window: int, seeds: DataFrame | None = None, cameras: list[str] | None = None, most: int | None = None) -> DataFrame:
    """One action per sighting (payload, source_id, at, arrival_seq, frame, first_seen, first_decode, decode_count).

    Sorted rows stream through each task, so a payload's state, not its rows, is held. Seeds: (payload, anchor). With
    `cameras` (all there are) passes that the slowest has left behind are forgotten; with `most` the oldest above that
    number are, and a row with action evict and their number as decode_count says so."""
    columns = ["payload", "source_id", "at", "arrival_seq", "frame", "first_seen", "first_decode", "decode_count"]
    rows = sightings.select(*columns)
    if seeds is not None:
        none = F.lit(None)
        rows = rows.unionByName(seeds.select("payload", none.cast("string").alias("source_id"), F.col("anchor").alias("at"), F.lit(-(1 << 62)).alias("arrival_seq"), *[none.cast("long").alias(c) for c in columns[4:]]))
    dealt = rows.repartition("payload").sortWithinPartitions("payload", "arrival_seq", "frame")

    def run(batches):
        payload, state = None, None
        for batch in batches:
            out: list[list] = []
            for p, source, at, seq, frame, seen, decode, count in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if state is None or p != payload:
                    payload, state = p, CrossCamera(window)
                if source is None:
                    insort(state.anchors, at)
                    state.passes[at] = None
                    continue
                action, anchor, merged = state.absorb(at, source, seen, decode, count, frame)
                out.append(action_row(p, seq, source, action, anchor, merged))
                if cameras is not None:
                    state.settle(cameras)
                if most is not None and (gone := state.evict(most)):
                    out.append(evicted_row(p, seq, gone))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], _TYPES[c.split()[1]]) for i, c in enumerate(ACTIONS.split(", "))], names=_COLUMNS)

    return dealt.mapInArrow(run, ACTIONS)


def counters(actions: DataFrame) -> DataFrame:
    """The deduper's counters."""
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.agg(n("emit").alias("passes_emitted"), n("merge").alias("cross_camera_merges"), n("repeat").alias("repeats_suppressed"), n("restart_repeat").alias("restart_repeats_suppressed"), n("merge").alias("reemits"))


def restart_seeds(passes: DataFrame, epoch_us: int, window_us: int, slack_us: int = 60_000_000, camera: str | None = None, tolerance_us: int = 500_000) -> DataFrame:
    """(payload, anchor) from stored passes (payload, wall_us, wall_iso, cameras): the latest instant before this start.

    The cut-off compares ISO texts, as the store does; stamps after the start beyond the tolerance are dropped."""
    cutoff = F.date_format(F.timestamp_micros(F.lit(epoch_us - window_us - slack_us)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = passes.where(F.col("payload").isNotNull() & (F.col("wall_iso") >= cutoff))
    if camera is not None:
        rows = rows.where(F.map_contains_key("cameras", F.lit(camera)))
    anchor = F.col("wall_us") - epoch_us
    return rows.where(anchor <= tolerance_us).groupBy("payload").agg(F.max(F.least(anchor, F.lit(0))).alias("anchor"))


def reachable(actions: DataFrame, sightings: DataFrame, window: int) -> DataFrame:
    """Passes that some camera can still merge with: (payload, anchor, alive).

    The slowest camera decides: anchors older than its latest instant minus the window are done with. Each
    camera is one row, so the cut-off is a scalar joined to all."""
    marks = sightings.groupBy("source_id").agg(F.max("at").alias("high")).agg((F.min("high") - window).alias("cutoff"))
    anchors = actions.where("action = 'emit'").select("payload", "anchor")
    return anchors.crossJoin(F.broadcast(marks)).select("payload", "anchor", (F.col("anchor") >= F.col("cutoff")).alias("alive"))
