"""Scalar rules as column expressions: boxes, payloads, clocks, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def clamp_box(r: Column, width: Column, height: Column) -> Column:
    """The part of a box inside a frame; its size is never negative."""
    x0, y0 = F.greatest(F.lit(0), F.least(r.x, width)), F.greatest(F.lit(0), F.least(r.y, height))
    x1, y1 = F.greatest(x0, F.least(r.x + r.w, width)), F.greatest(y0, F.least(r.y + r.h, height))
    return box(x0, y0, x1 - x0, y1 - y0)


def pad_box(r: Column, by: Column) -> Column:
    return box(r.x - by, r.y - by, r.w + 2 * by, r.h + 2 * by)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 where they don't meet."""
    ix = F.greatest(F.lit(0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    iy = F.greatest(F.lit(0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
    inter = ix.cast("double") * iy
    return F.when(inter > 0, inter / (a.w.cast("double") * a.h + b.w.cast("double") * b.h - inter)).otherwise(0.0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def code_size(points: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Longest side, and square root of the area, of a quadrangle."""
    pairs = list(zip(points, points[1:] + points[:1], strict=True))
    area = sum((ax * by - bx * ay for (ax, ay), (bx, by) in pairs), F.lit(0.0))
    return F.greatest(*[distance(*a, *b) for a, b in pairs]), F.sqrt(F.abs(area) / 2)


def pixels_per_module(module_mm: Column, distance_mm: Column, focal_mm: Column, pixel_um: Column) -> Column:
    return module_mm * focal_mm / distance_mm / (pixel_um / 1000)


def blur_modules(speed_mm_s: Column, exposure_ms: Column, module_mm: Column) -> Column:
    """Smear during the exposure, in modules."""
    return speed_mm_s * exposure_ms / 1000 / module_mm


def payload_text(raw: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else Latin-1, never a replacement character."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))


# Fixed value: control characters that no payload holds; tab, line ends and the separators of standard data carriers are fine.
BAD_CONTROLS = "[\\x00-\\x03\\x05-\\x08\\x0B\\x0C\\x0E-\\x1B\\x1F]"


def payload_accepted(payload: Column, symbology: Column, pattern: str | None = None, least_datamatrix: int = 4) -> Column:
    """A pattern, if given, decides alone (found anywhere); else no empty text, no control characters, no short Data Matrix."""
    if pattern is not None:
        return payload.rlike(pattern)
    return (F.length(payload) > 0) & ~payload.rlike(BAD_CONTROLS) & ~((symbology == "datamatrix") & (F.length(payload) < least_datamatrix))


def stamp(iso: Column) -> Column:
    """An ISO-8601 stamp as a timestamp; NULL if it can't be read; without a zone it is UTC (the session's)."""
    return F.try_to_timestamp(iso)


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Inclusive on both sides; unknown stamps and open ends are inside."""
    return at.isNull() | ((start.isNull() | (at >= start)) & (end.isNull() | (at <= end)))


def wall_clock(epoch_s: Column, source_s: Column) -> Column:
    """Wall instant of a source-clock second."""
    return F.timestamp_micros(((epoch_s + source_s) * 1_000_000).cast("long"))


def frames_of(seconds: Column, fps: Column, fallback: Column) -> Column:
    """A debounce time in frames, at least one; the fallback count where the rate is unknown."""
    return F.when(fps > 0, F.greatest(F.lit(1), F.bround(seconds * fps).cast("int"))).otherwise(fallback)


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts, added up."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def trajectory(ux: float, uy: float, width: Column, height: Column, patch_w: Column, patch_h: Column, step: Column) -> dict[str, Column]:
    """Velocity, and frames until a patch that enters off one edge is off the other: the shorter of the axes' crossings."""
    norm = (ux * ux + uy * uy) ** 0.5 or 1.0
    vx, vy = step * (ux / norm), step * (uy / norm)
    times = [t for u, t in ((ux, (width + patch_w) / F.abs(vx)), (uy, (height + patch_h) / F.abs(vy))) if u]
    first = times[0] if len(times) == 1 else F.least(*times)
    return {"vx": vx, "vy": vy, "frames": F.greatest(F.lit(2), F.ceil(first)).cast("int")}
