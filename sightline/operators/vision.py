"""Frame-level operators over grey images, as one Arrow pass per source.

Images are bytes with height and width. numpy does the pixel work of a frame at a
time; frames of a source stream in order, so only the one before is kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pictures import VARIANTS, Mixture, box_back, parts


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: colour images (blue, green, red) by the usual luma weights."""
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299), 0, 255).astype(np.uint8)


def downscale(image: np.ndarray, width: int) -> np.ndarray:
    """Area average to about `width` columns; never enlarges."""
    k = max(1, image.shape[1] // width)
    h, w = image.shape[0] // k * k, image.shape[1] // k * k
    return np.rint(image[:h, :w].reshape(h // k, k, w // k, k).mean(axis=(1, 3))).astype(np.uint8)


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Grows a mask by one pixel in all eight directions, `times` times."""
    for _ in range(times):
        p = np.pad(mask, 1)
        rows = p[:-2] | p[1:-1] | p[2:]
        mask = rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]
    return mask


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    return ~dilate(~mask, times)


def motion_mask(before: np.ndarray | None, now: np.ndarray, threshold: int = 25, grow: int = 2) -> np.ndarray:
    """Where two frames differ; the first frame is warm-up and shows none."""
    if before is None or before.shape != now.shape:
        return np.zeros(now.shape, bool)
    return dilate(np.abs(now.astype(np.int16) - before) > threshold, grow)


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)) if len(ys) else None


def blobs(mask: np.ndarray, least_area: int = 1, most: int = 8, closing: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of eight-connected parts, gaps closed first, largest first, at most `most`."""
    if closing:
        mask = erode(dilate(np.pad(mask, closing), closing), closing)[closing:-closing, closing:-closing]
    return sorted((p for p in parts(mask) if p[4] >= least_area), key=lambda b: (-b[4], b[:4]))[:most]


def focus(image: np.ndarray) -> float:
    """Variance of the Laplacian, edges mirrored."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def turned_box(box: tuple[int, int, int, int], width: int, height: int, quarter_turns: int) -> tuple[int, int, int, int]:
    """A box found in a picture turned counter-clockwise, in the picture before turning (of that width and height)."""
    x, y, w, h = box
    return {0: (x, y, w, h), 1: (width - y - h, x, h, w), 2: (width - x - w, height - y - h, w, h), 3: (y, height - x - w, h, w)}[quarter_turns % 4]


ACTIVITY = "source_id string, frame_index long, active boolean, motion_frac double, x int, y int, w int, h int"


def by_gaps(frames: DataFrame) -> DataFrame:
    """Frames dealt by source and run between gaps, in order: `gap` marks a run's first frame. Runs are told from one short row a
    frame; pictures travel once."""
    short = frames.select("source_id", "frame_index", F.coalesce("discontinuity", F.lit(False)).alias("_gap"))
    so_far = Window.partitionBy("source_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    runs = short.withColumn("run", F.sum(F.col("_gap").cast("int")).over(so_far))
    rows = frames.select("source_id", "frame_index", "image", "h", "w").join(runs.drop("_gap"), ["source_id", "frame_index"])
    return rows.repartition("source_id", "run").sortWithinPartitions("source_id", "run", "frame_index").select("source_id", "run", "frame_index", "image", "h", "w")


def activity(frames: DataFrame, width: int = 320, threshold: int = 25, least_fraction: float = 0.002, mixture: dict | None = None, grow: int = 2) -> DataFrame:
    """Motion per frame: (source_id, frame_index, active, motion_frac, box), which segmentation takes.

    frames: source_id, frame_index, image BINARY, h, w, discontinuity (starts anew). Frames are scaled down and
    compared with the one before, or with `mixture` (options of Mixture) with the background learnt since the last gap, whose
    first frame only teaches. Runs between gaps are dealt to tasks, which hold one frame or one background each."""

    def run(batches):
        own, before, model = None, None, Mixture()
        for batch in batches:
            rows = []
            for s, part, index, image, h, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = downscale(np.frombuffer(image, np.uint8).reshape(h, w), width)
                if (s, part) != own:
                    own, before, model = (s, part), None, Mixture(**(mixture or {}))
                if mixture is None:
                    mask = motion_mask(before, now, threshold, grow)
                    before = now
                else:
                    found = model.apply(now)
                    mask = np.zeros(now.shape, bool) if found is None else dilate(found, grow)
                share = float(mask.mean())
                k = max(1, w // width)
                box = bounding_box(mask)
                rows.append((s, index, share >= least_fraction and box is not None, share, *([v * k for v in box] if box else [None] * 4)))
            types = (pa.string(), pa.int64(), pa.bool_(), pa.float64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in ACTIVITY.split(", ")])

    return by_gaps(frames).mapInArrow(run, ACTIVITY)


def _by_picture(frames: DataFrame, keys: list[str], measure, schema: str) -> DataFrame:
    """Rows that measure(picture) gives for each of frames (keys, image, h, w), in one pass."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, (image, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("image", "h", "w")), strict=True)):
                found = measure(np.frombuffer(image, np.uint8).reshape(h, w))
                rows += found
                at += [i] * len(found)
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[*keys, *names])

    head = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, "image", "h", "w").mapInArrow(run, f"{head}, {schema}")


def blob_rows(frames: DataFrame, keys: list[str], threshold: int = 127, least_area: int = 1, most: int = 8, closing: int = 0) -> DataFrame:
    """The parts of each picture brighter than a threshold: keys, place (largest first), box and area."""
    measure = lambda a: [(i + 1, *b) for i, b in enumerate(blobs(a > threshold, least_area, most, closing))]
    return _by_picture(frames, keys, measure, "place int, x int, y int, w int, h int, area int")


def focus_rows(frames: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Sharpness and mean of each picture, scaled down to `width` columns if given."""
    small = lambda a: a if width is None else downscale(a, width)
    return _by_picture(frames, keys, lambda a: [(focus(small(a)), float(small(a).mean()))], "focus double, mean double")


#: Pixels of a stack of pictures that are worked on together.
STACK = 1 << 14


def _by_stack(frames: DataFrame, keys: list[str], measure, schema: str) -> DataFrame:
    """Columns that measure(stack) gives, (pictures, rows a picture) each, for frames (keys, image, h, w): pictures of one size go in
    stacks, so that small ones don't cost a call each."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            heights, widths = (batch.column(c).to_numpy() for c in ("h", "w"))
            sizes = heights.astype(np.int64) << 32 | widths
            for size in np.unique(sizes):
                of, h, w = np.flatnonzero(sizes == size), int(size) >> 32, int(size) & 0xFFFFFFFF
                most = max(1, STACK // max(1, h * w))
                for part in (of[i : i + most] for i in range(0, len(of), most)):
                    images = batch.column("image").take(pa.array(part)).to_pylist()
                    found = measure(np.frombuffer(b"".join(images), np.uint8).reshape(len(part), h, w))
                    own = batch.select(keys).take(pa.array(np.repeat(part, found[0].shape[1])))
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c.ravel(), t) for c, t in zip(found, types, strict=True))], names=[*keys, *names])

    head = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, "image", "h", "w").mapInArrow(run, f"{head}, {schema}")


def variant_rows(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Each picture's variants: keys, the variant's place in order, mean, least and largest pixel."""

    def measure(stack):
        made = [change(stack).reshape(len(stack), -1) for change in VARIANTS.values()]
        places = np.broadcast_to(np.arange(1, len(made) + 1, dtype=np.int32), (len(stack), len(made)))
        return [places, *(np.stack(c, axis=1) for c in ([v.mean(axis=1) for v in made], [v.min(axis=1).astype(np.int32) for v in made], [v.max(axis=1).astype(np.int32) for v in made]))]

    return _by_stack(frames, keys, measure, "place int, mean double, least int, most int")


def cascade(crops: DataFrame, decode, accept=lambda payload: bool(payload), confirmations: int = 2, symbologies: tuple[str, ...] = ("qr", "datamatrix")) -> DataFrame:
    """Attempts of each segment's crops (candidate_id, frame_index, image, h, w) in frame order: one row per frame with
    the first accepted payload or NULL, its symbology and variant, and how many payloads were rejected.

    Data Matrix is tried on every fifth frame only once a payload is confirmed; variants from the fifth attempt on while none
    is. The state is a segment's counts of payloads."""
    columns = ["candidate_id", "frame_index", "image", "h", "w"]
    dealt = crops.select(*columns).repartition("candidate_id").sortWithinPartitions("candidate_id", "frame_index")

    def text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    def run(batches):
        own, n, counts = object(), 0, {}
        for batch in batches:
            rows = []
            for candidate, index, image, h, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if candidate != own:
                    own, n, counts = candidate, 0, {}
                sure = any(k >= confirmations for k in counts.values())
                ways = {"plain": lambda a: a} | (VARIANTS if n >= 4 and not sure else {})
                tried = [s for s in symbologies if s != "datamatrix" or not sure or n % 5 == 0]
                picture, hit, rejected = np.frombuffer(image, np.uint8).reshape(h, w), (None, None, None), 0
                for name, symbology in ((v, s) for v in ways for s in tried):
                    said = [text(raw) for raw, _ in decode(ways[name](picture), symbology)]
                    good = [p for p in said if accept(p)]
                    rejected += len(said) - len(good)
                    if good:
                        hit = (good[0], symbology, name)
                        break
                if hit[0] is not None:
                    counts[hit[0]] = counts.get(hit[0], 0) + 1
                n += 1
                rows.append((candidate, index, *hit, rejected))
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["candidate_id", "frame_index", "payload", "symbology", "variant", "rejected"])

    return dealt.mapInArrow(run, "candidate_id string, frame_index long, payload string, symbology string, variant string, rejected int")


def decoded(crops: DataFrame, decode, accept=lambda payload: bool(payload), symbologies: tuple[str, ...] = ("qr", "datamatrix")) -> DataFrame:
    """Payloads of crops (source_id, frame_index, image, h, w, x, y) by a given decoder.

    decode(image, symbology) gives [(payload bytes, box)]. Symbologies are tried in order and plain before
    each variant; the first accepted payload ends a crop's search. Boxes come back in the whole frame."""

    def text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    def first(image, x, y):
        for name, change in {"plain": lambda a: a, **VARIANTS}.items():
            for symbology in symbologies:
                for raw, box in decode(change(image), symbology):
                    if accept(payload := text(raw)):
                        box = box_back(name, box, image.shape)
                        return payload, symbology, name, x + box[0], y + box[1], box[2], box[3]
        return None

    def run(batches):
        for batch in batches:
            rows = []
            for s, index, image, h, w, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hit := first(np.frombuffer(image, np.uint8).reshape(h, w), x, y):
                    rows.append((s, index, *hit))
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["source_id", "frame_index", "payload", "symbology", "variant", "x", "y", "w", "h"])

    return crops.select("source_id", "frame_index", "image", "h", "w", "x", "y").mapInArrow(run, "source_id string, frame_index long, payload string, symbology string, variant string, x int, y int, w int, h int")
