"""Pixel algorithms over grey pictures: preprocessing variants, connected parts, a background model.

The variants take a picture (h, w) or a stack of equal ones (..., h, w), and do the same to each."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache

import numpy as np

Box = tuple[int, int, int, int]


def gauss(size: int, sigma: float) -> np.ndarray:
    x = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return x / x.sum()


def _padded(image: np.ndarray, top: tuple[int, int], side: tuple[int, int], mode: str) -> np.ndarray:
    return np.pad(image, [*[(0, 0)] * (image.ndim - 2), top, side], mode=mode)


def blurred(image: np.ndarray, size: int, sigma: float, border: str) -> np.ndarray:
    """Weighted means over `size` x `size` pixels, as floats; beyond the border the picture is mirrored or its edge repeated."""
    k, r = gauss(size, sigma), size // 2
    h, w = image.shape[-2:]
    out = _padded(image.astype(np.float64), (r, r), (r, r), border)
    out = _weighted(k, [out[..., i : i + h, :] for i in range(size)])
    return _weighted(k, [out[..., i : i + w] for i in range(size)])


def _weighted(k: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    total, one = np.zeros(parts[0].shape), np.empty(parts[0].shape)
    for weight, part in zip(k, parts, strict=True):
        total += np.multiply(part, weight, out=one)
    return total


def as_pixels(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def unsharp(image: np.ndarray) -> np.ndarray:
    """Details lifted: two and a half times the picture less one and a half times its blur (sigma 1.5)."""
    return as_pixels(2.5 * image - 1.5 * as_pixels(blurred(image, 11, 1.5, "reflect")))


def local_threshold(image: np.ndarray) -> np.ndarray:
    """White where a pixel is over the weighted mean of the 31 x 31 around it, less 5."""
    return np.where(image > as_pixels(blurred(image, 31, 5.0, "edge")).astype(int) - 5, 255, 0).astype(np.uint8)


def equalised(image: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles: counts above the limit are spread over all levels, and a pixel takes the mean of the
    four tiles around it, by distance."""
    h, w = image.shape[-2:]
    stack = image.reshape(-1, h, w)
    th, tw = -(-h // tiles), -(-w // tiles)
    full = _padded(stack, (0, th * tiles - h), (0, tw * tiles - w), "reflect")
    tile = np.arange(th * tiles)[:, None] // th * tiles + np.arange(tw * tiles)[None, :] // tw
    first = np.arange(len(stack))[:, None, None] * (tiles * tiles) + tile  # each picture's tiles by themselves
    counts = np.bincount((first * 256 + full).ravel(), minlength=len(stack) * tiles * tiles * 256).astype(np.int32).reshape(-1, 256)
    limit = max(1, int(clip * th * tw / 256))
    cut = np.minimum(counts, limit)
    over = th * tw - cut.sum(axis=1)
    cut += (over // 256).astype(np.int32)[:, None]
    cut += _spread()[over % 256]
    # The level of a value is worked out where a pixel asks for it.
    below = np.cumsum(cut, axis=1, dtype=np.int32).ravel()
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    base = np.arange(len(stack))[:, None, None] * (tiles * tiles)

    def at(dy, dx):
        rows, cols = np.clip(y0 + dy, 0, tiles - 1)[:, None], np.clip(x0 + dx, 0, tiles - 1)[None, :]
        return np.clip(np.rint(below[(base + rows * tiles + cols) * 256 + stack] * (255.0 / (th * tw))), 0, 255)

    return as_pixels((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy).reshape(image.shape)


@cache
def _spread() -> np.ndarray:
    """Which levels get one more of a rest of 0 to 255 counts, evenly spaced."""
    more = np.zeros((256, 256), np.int32)
    for rest in range(1, 256):
        more[rest, np.arange(0, 256, max(1, 256 // rest))[:rest]] = 1
    return more


def _turned_points(x, y, shape: tuple[int, int], degrees: float):
    """Where points go when a picture is turned counter-clockwise about its middle."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    my, mx = shape[0] / 2, shape[1] / 2
    return c * (x - mx) + s * (y - my) + mx, -s * (x - mx) + c * (y - my) + my


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The picture turned about its middle, of the same size: means of the four pixels around, edges repeated."""
    h, w = image.shape[-2:]
    x, y = _turned_points(np.arange(w)[None, :].astype(float), np.arange(h)[:, None].astype(float), (h, w), -degrees)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    flat = image.reshape(*image.shape[:-2], h * w)
    at = lambda dy, dx: np.take(flat, np.clip(y0 + dy, 0, h - 1) * w + np.clip(x0 + dx, 0, w - 1), axis=-1)
    return as_pixels((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy)


# The preprocessing variants that a stubborn crop is tried with, in order, and how far those that turn it do.
VARIANTS = {"unsharp": unsharp, "athresh": local_threshold, "clahe": equalised, "rot+10": lambda a: turned(a, 10.0), "rot-10": lambda a: turned(a, -10.0)}
TURNS = {"rot+10": 10.0, "rot-10": -10.0}


def box_back(variant: str, box: Box, shape: tuple[int, int]) -> Box:
    """A box found in a variant, in the picture it was made of: the bounds of its corners turned back, within the picture."""
    if variant not in TURNS:
        return box
    x, y, w, h = box
    px, py = zip(*(_turned_points(u, v, shape, -TURNS[variant]) for u in (x, x + w) for v in (y, y + h)), strict=True)
    x0, x1 = (min(max(v, 0), shape[1]) for v in (math.floor(min(px)), math.ceil(max(px))))
    y0, y1 = (min(max(v, 0), shape[0]) for v in (math.floor(min(py)), math.ceil(max(py))))
    return x0, y0, x1 - x0, y1 - y0


def parts(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of the eight-connected parts of a mask, in one pass over its runs.

    A row's runs are compared with those of the row above, side by side; runs that touch, by a corner too, are put
    together in a forest of runs, and each tree's bounds and area are summed up."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]  # one behind the last pixel
    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    a, b = starts.tolist(), ends.tolist()
    parent = list(range(len(a)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if a[i] <= b[j] and a[j] <= b[i]:
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    if not a:
        return []
    tree = np.fromiter((root(i) for i in range(len(a))), np.int64, len(a))
    keys, of = np.unique(tree, return_inverse=True)
    low = lambda v: np.minimum.reduceat(v[np.argsort(of, kind="stable")], np.searchsorted(np.sort(of), np.arange(len(keys))))
    x0, y0, x1, y1 = low(starts), low(rows), -low(-ends), -low(-rows) + 1
    return list(zip(x0.tolist(), y0.tolist(), (x1 - x0).tolist(), (y1 - y0).tolist(), np.bincount(of, ends - starts).astype(int).tolist(), strict=True))


@dataclass
class Mixture:
    """A background of up to `modes` Gaussians per pixel, learnt frame by frame.

    A value fits the weightiest Gaussian within `fit` variances of its mean, which then moves towards it, or founds a new
    one in place of the least. It is background if it lies within `background` variances of one of those that come before
    `share` of the weight is reached, up to the one it fits. Weights fade by the learning rate, which is 1 / (2t) in the t-th
    frame and 1 / history at least, and by `prune` of it more, so Gaussians that nothing fits any more go."""

    modes: int = 5
    history: int = 500
    background: float = 16.0
    fit: float = 9.0
    share: float = 0.9
    prune: float = 0.05
    first_variance: float = 15.0
    variances: tuple[float, float] = (4.0, 75.0)
    seen: int = 0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    variance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def apply(self, image: np.ndarray) -> np.ndarray | None:
        """Where the picture isn't background; None for the first one, which only teaches."""
        x = image.astype(np.float64)
        if self.seen == 0 or self.weight.shape[1:] != x.shape:
            self.seen, self.weight, self.mean = 0, np.zeros((self.modes, *x.shape)), np.zeros((self.modes, *x.shape))
            self.variance = np.full((self.modes, *x.shape), self.first_variance)
        self.seen += 1
        rate = 1.0 / min(2 * self.seen, self.history)
        live = self.weight > 0
        weight = np.where(live, (1 - rate) * self.weight - rate * self.prune, 0.0)
        apart = (x - self.mean) ** 2
        fits = live & (apart < self.fit * self.variance)
        one = fits.any(axis=0)
        at = np.where(one, fits.argmax(axis=0), self.modes)
        kept = np.where(weight < rate * self.prune, 0.0, weight)
        before = np.cumsum(kept, axis=0) - kept
        up_to = np.arange(self.modes)[:, None, None] <= at
        known = (live & up_to & (apart < self.background * self.variance) & (before < self.share)).any(axis=0)
        # The one that fits takes the value in.
        own = np.arange(self.modes)[:, None, None] == at
        kept = np.where(own, weight + rate, kept)
        pull = np.where(own, rate / np.where(own, kept, 1.0), 0.0)
        self.mean = self.mean + pull * (x - self.mean)
        self.variance = np.where(own, np.clip(self.variance + pull * (apart - self.variance), *self.variances), self.variance)
        total = kept.sum(axis=0)
        kept = np.divide(kept, total, out=np.zeros_like(kept), where=total > 0)
        # What fits nothing founds one, in a free place or that of the least.
        new = ~one
        slot = np.where((kept > 0).all(axis=0), self.modes - 1, (kept <= 0).argmax(axis=0))
        here = new & (np.arange(self.modes)[:, None, None] == slot)
        others = (kept * ~here).sum(axis=0) > 0
        kept = np.where(here, np.where(others, rate, 1.0), np.where(new & others, kept * (1 - rate), kept))
        self.mean, self.variance = np.where(here, x, self.mean), np.where(here, self.first_variance, self.variance)
        order = np.argsort(-kept, axis=0, kind="stable")
        self.weight, self.mean, self.variance = (np.take_along_axis(v, order, axis=0) for v in (kept, self.mean, self.variance))
        return None if self.seen == 1 else ~known
