"""Rendered symbols and passes: pictures for tests of the frame-level operators.

No decoding library is at hand, so symbols are of a plain matrix code of our own: a dark
left column and bottom row, alternating modules on top and at the right, inside the payload's length, its
bytes and a checksum, bit by bit. `read_symbol` is the decoder that vision.decoded() and vision.cascade() take."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = range(8, 42, 2)


def symbol(payload: bytes) -> np.ndarray:
    """The payload's modules, True where dark: the smallest square that holds it."""
    data = bytes([len(payload)]) + payload + bytes([zlib.crc32(payload) & 255])
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    side = next(n for n in SIDES if (n - 2) ** 2 >= len(bits))
    m = np.zeros((side, side), bool)
    m[0, ::2] = m[1::2, -1] = m[:, 0] = m[-1, :] = True
    inside = np.zeros((side - 2) ** 2, bool)
    inside[: len(bits)] = bits
    m[1:-1, 1:-1] = inside.reshape(side - 2, side - 2)
    return m


def drawn(modules: np.ndarray, pitch: int, quiet: int = 2, dark: int = 20, light: int = 235) -> np.ndarray:
    """A picture of modules, `pitch` pixels each, with a quiet zone around."""
    return np.kron(np.pad(~modules, quiet, constant_values=True), np.ones((pitch, pitch), np.uint8)) * np.uint8(light - dark) + np.uint8(dark)


def motion_blur(a: np.ndarray, pixels: int) -> np.ndarray:
    """Smear along the rows: the mean of so many neighbours."""
    p = np.pad(a.astype(np.float64), ((0, 0), (pixels // 2, (pixels - 1) // 2)), mode="edge")
    sums = np.cumsum(np.pad(p, ((0, 0), (1, 0))), axis=1)
    return np.rint((sums[:, pixels:] - sums[:, :-pixels]) / pixels).astype(np.uint8)


def contrast(a: np.ndarray, factor: float) -> np.ndarray:
    return np.rint((a - 127.5) * factor + 127.5).clip(0, 255).astype(np.uint8)


def gradient(a: np.ndarray, fall: float) -> np.ndarray:
    """Light that falls by a share from left to right."""
    return np.rint(a * np.linspace(1, 1 - fall, a.shape[1])).astype(np.uint8)


def noise(a: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    return (a + np.random.default_rng(seed).normal(0, sigma, a.shape)).clip(0, 255).astype(np.uint8)


def occluded(a: np.ndarray, share: float) -> np.ndarray:
    """The right part covered."""
    out = a.copy()
    out[:, a.shape[1] - round(a.shape[1] * share) :] = 127
    return out


def composite(frame: np.ndarray, patch: np.ndarray, x: int, y: int) -> np.ndarray:
    """The frame with a patch over it; what lies outside is cut off."""
    out = frame.copy()
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + patch.shape[1], frame.shape[1]), min(y + patch.shape[0], frame.shape[0])
    if x0 < x1 and y0 < y1:
        out[y0:y1, x0:x1] = patch[y0 - y : y1 - y, x0 - x : x1 - x]
    return out


def read_symbol(picture: np.ndarray, symbology: str = "qr") -> list[tuple[bytes, tuple[int, int, int, int]]]:
    """Payload and box of the one symbol of a light picture, [] if none is read."""
    low, high = int(picture.min()), int(picture.max())
    if high - low < 16:
        return []
    dark = picture < (low + high) / 2
    ys, xs = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    x, y, w, h = int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)
    for side in SIDES:
        rows, columns = (((np.arange(side) + 0.5) * size / side).astype(int) for size in (h, w))
        m = dark[y : y + h, x : x + w][np.ix_(rows, columns)]
        if not (m[:, 0].all() and m[-1].all() and (m[0, :-1] == (np.arange(side - 1) % 2 == 0)).all() and (m[:-1, -1] == (np.arange(side - 1) % 2 == 1)).all()):
            continue
        data = np.packbits(m[1:-1, 1:-1].ravel()).tobytes()
        payload = data[1 : 1 + data[0]]
        if len(data) > 1 + data[0] and data[1 + data[0]] == zlib.crc32(payload) & 255:
            return [(payload, (x, y, w, h))]
    return []


def rendered_passes(plans: DataFrame, width: int = 160, height: int = 90, pitch: int = 2, frames: int = 24) -> DataFrame:
    """Frames (source_id, frame_index, image, h, w, discontinuity) of passes (source_id, pass_id, payload), in their order by
    pass_id: a symbol crosses a light picture from left to right, each pass in `frames` frames from pass_id * frames on."""

    def run(batches):
        for batch in batches:
            for source, number, payload in zip(*(batch.column(c).to_pylist() for c in ("source_id", "pass_id", "payload")), strict=True):
                patch, images = drawn(symbol(payload.encode()), pitch), []
                for k in range(frames):
                    x = -patch.shape[1] + round((width + patch.shape[1]) * k / (frames - 1))
                    images.append(composite(np.full((height, width), 235, np.uint8), patch, x, (height - patch.shape[0]) // 2).tobytes())
                n = len(images)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * n), pa.array(number * frames + np.arange(n)), pa.array(images, pa.binary()), pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array([False] * n)],
                    names=["source_id", "frame_index", "image", "h", "w", "discontinuity"])

    return plans.select("source_id", F.col("pass_id").cast("long").alias("pass_id"), "payload").mapInArrow(run, "source_id string, frame_index long, image binary, h int, w int, discontinuity boolean")

