"""Object tracking as a live stream: a source's live tracks are its list state, a row each.

A micro-batch brings whole frames. They are taken in order of their numbers by the same rules as
in batch; what is told are the events (open, close) and, frame by frame, the primary track. A
frame whose discontinuity is NULL ends its source: what is open closes."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import BOX, LIVE, Rules, Tracker
from .replay import table

TOLD = "source_id string, frame_index long, kind string, segment long, at_frame long"
_TYPES = {"f": "double", "i": "long"}


class LiveTracks(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", ", ".join(f"{c} {_TYPES[LIVE[c].kind]}" for c in LIVE.names))
        self.opened = handle.getValueState("opened", "n long")

    def handleInputRows(self, key, rows, timerValues):
        tracker = Tracker(self.rules)
        tracker.n_segments = int(self.opened.get()[0]) if self.opened.exists() else 0
        if self.live.exists():
            tracker.live = np.array([tuple(t) for t in self.live.get()], LIVE)
        out = []
        frames = pd.concat(list(rows)).sort_values(["frame_index", *BOX])
        for index, blobs in groupby(zip(*(frames[c].tolist() for c in ["frame_index", "discontinuity", *BOX, "area"]), strict=True), key=lambda r: r[0]):
            index, blobs, primary = int(index), list(blobs), None
            ends, gap = any(pd.isna(b[1]) for b in blobs), any(not pd.isna(b[1]) and b[1] for b in blobs)
            events = tracker.end() if ends or gap else []
            if not ends:
                seen = [(tuple(b[2:6]), (b[2] + b[4] / 2, b[3] + b[5] / 2), b[6]) for b in blobs if not pd.isna(b[4])]
                now, primary = tracker.frame(index, seen)
                events = events + now
            out += [(key[0], index, kind, segment, at) for kind, segment, at in events]
            if not ends:
                out.append((key[0], index, "primary", primary, None))
        self.live.put([tuple(t.item()) for t in tracker.live]) if len(tracker.live) else self.live.clear()
        self.opened.update((tracker.n_segments,))
        yield table(out, TOLD)

    def close(self) -> None:
        pass


def object_tracks(blobs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(source_id, frame_index, kind, segment, at_frame) from a stream of blobs (source_id, frame_index, discontinuity, x, y, w, h, area):
    opens and closes with the frame that they count from, and each frame's primary segment (NULL if none is seen)."""
    columns = ["source_id", "frame_index", "discontinuity", *BOX, "area"]
    return blobs.select(*columns).groupBy("source_id").transformWithStateInPandas(LiveTracks(rules or Rules()), TOLD, "append", "none")
