"""Pixel operators on small pictures."""

import math
import time

import numpy as np
import pytest

from sightline.operators import pictures, segment, vision
from sightline.sources import evidence


def test_masks_and_boxes():
    a = np.zeros((20, 30), np.uint8)
    b = a.copy()
    b[5:8, 10:14] = 200
    assert not vision.motion_mask(None, a).any()
    assert vision.bounding_box(vision.motion_mask(a, b, grow=1)) == (9, 4, 6, 5)
    assert vision.bounding_box(a > 0) is None
    assert vision.downscale(b, 10).shape == (6, 10)


def test_blobs():
    m = np.zeros((12, 20), bool)
    m[1:4, 1:4] = m[8:10, 10:18] = True
    m[4, 4] = True  # touches the first by a corner
    m[0, 19] = True
    assert vision.blobs(m, 2) == [(10, 8, 8, 2, 16), (1, 1, 4, 4, 10)]
    assert vision.blobs(m, 1, most=1)[0][4] == 16
    gap = np.zeros((5, 9), bool)
    gap[1:4, 1:4] = gap[1:4, 5:8] = True
    assert len(vision.blobs(gap)) == 2 and len(vision.blobs(gap, closing=1)) == 1


def test_focus_and_turns():
    r = np.random.default_rng(0)
    sharp = r.integers(0, 255, (40, 40)).astype(np.uint8)
    assert vision.focus(sharp) > vision.focus(vision.downscale(sharp, 20).repeat(2, 0).repeat(2, 1)) > 0 == vision.focus(np.full((5, 5), 7, np.uint8))
    picture = np.zeros((30, 50), np.uint8)
    picture[4:9, 20:32] = 1
    for k in range(4):
        found = vision.bounding_box(np.rot90(picture, k) > 0)
        assert vision.turned_box(found, 50, 30, k) == (20, 4, 12, 5)


def test_activity_feeds_segments(spark):
    rows = []
    for i in range(12):
        p = np.zeros((24, 32), np.uint8)
        if 3 <= i <= 8:
            p[5:12, 2 * i : 2 * i + 6] = 255
        rows.append(("a", i, bytearray(p.tobytes()), 24, 32, False))
    frames = spark.createDataFrame(rows, "source_id string, frame_index long, image binary, h int, w int, discontinuity boolean")
    act = vision.activity(frames, 32)
    assert [r.frame_index for r in act.where("active").orderBy("frame_index").collect()] == [3, 4, 5, 6, 7, 8, 9]
    found = segment.segments(act, ["source_id"], "frame_index", "active", 2, 2).collect()
    assert [(r.first_frame, r.last_frame) for r in found] == [(3, 9)]


def test_cascade_uses_variants(spark):
    def decode(image, symbology):
        return [(b"P\xe9", (2, 4, 6, 8))] if symbology == "qr" and image[0, 0] == 255 else []

    rows = [("a", 0, bytearray(np.full((10, 10), 255, np.uint8).tobytes()), 10, 10, 5, 5), ("a", 1, bytearray(np.zeros((10, 10), np.uint8).tobytes()), 10, 10, 0, 0)]
    got = vision.decoded(spark.createDataFrame(rows, "source_id string, frame_index long, image binary, h int, w int, x int, y int"), decode).orderBy("frame_index").collect()
    assert [tuple(r)[2:] for r in got] == [("Pé", "qr", "plain", 7, 9, 6, 8), ("Pé", "qr", "athresh", 2, 4, 6, 8)]


def test_cascade_counts_attempts(spark):
    """Variants from the fifth attempt without a confirmed payload; Data Matrix on every fifth frame after one."""
    def decode(image, symbology):
        if symbology == "datamatrix":
            return [(b"D", None)] if image[0, 0] == 9 else [(b"", None)]
        return [(b"Q", None)] if image[0, 0] == 255 else []

    picture = lambda v: bytearray(np.full((4, 4), v, np.uint8).tobytes())
    rows = [("s", i, picture(v), 4, 4) for i, v in enumerate([0, 0, 0, 0, 0, 255, 9, 9, 9, 9, 9])] + [("t", 0, picture(9), 4, 4)]
    df = spark.createDataFrame(rows, "candidate_id string, frame_index long, image binary, h int, w int")
    got = vision.cascade(df, decode).orderBy("candidate_id", "frame_index").collect()
    assert [r.payload for r in got] == [None] * 4 + ["Q", "Q", None, None, None, None, "D", "D"]
    assert [r.variant for r in got if r.payload] == ["athresh", "plain", "plain", "plain"]
    assert [r.rejected for r in got] == [1, 1, 1, 1, 2, 0, 0, 0, 0, 0, 0, 0]


def test_symbols_survive_what_a_camera_does():
    from sightline.sources import rendering as r

    for payload in (b"A", b"PLT-000123", b"x" * 60):
        a = r.drawn(r.symbol(payload), 4)
        assert r.read_symbol(a)[0][0] == payload
        for worse in (r.contrast(a, 0.4), r.gradient(a, 0.3), r.motion_blur(a, 2), r.noise(a, 8, 1), np.rot90(a, 4)):
            assert r.read_symbol(worse)[0][0] == payload
        assert r.read_symbol(r.occluded(a, 0.5)) == [] and r.read_symbol(255 - a) == []
    assert r.read_symbol(np.full((9, 9), 200, np.uint8)) == []
    frame = np.zeros((10, 10), np.uint8)
    assert r.composite(frame, np.ones((4, 4), np.uint8), 8, -2).sum() == 4 and r.composite(frame, np.ones((4, 4), np.uint8), 20, 0).sum() == 0


def test_from_rendered_passes_to_payloads(spark):
    """Motion, segments, crops and the decoder on rendered passes: each pass is found and read."""
    from pyspark.sql import functions as F

    from sightline.sources import rendering as r

    plans = spark.createDataFrame([("a", 0, "PLT-000001"), ("a", 1, "PLT-000002"), ("b", 0, "PLT-000003")], "source_id string, pass_id long, payload string")
    frames = r.rendered_passes(plans)
    found = segment.segments(vision.activity(frames, 160), ["source_id"], "frame_index", "active", 2, 3)
    assert found.count() >= 2
    crops = frames.select("source_id", "frame_index", "image", "h", "w", F.lit(0).alias("x"), F.lit(0).alias("y"))
    got = vision.decoded(crops, r.read_symbol)
    assert {(x.source_id, x.payload) for x in got.collect()} == {("a", "PLT-000001"), ("a", "PLT-000002"), ("b", "PLT-000003")}
    inside = segment.in_spans(got, "frame_index", found, ["source_id"], "first_frame", "last_frame", 64)
    assert inside.select("source_id", "payload").distinct().count() == 3


# Pixel algorithms against loops over pixels


def mirrored(i, n):
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def slow_blur(a, size, sigma, at):
    k = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    k = [v / sum(k) for v in k]
    h, w = a.shape
    r = size // 2
    return [[sum(k[i] * k[j] * int(a[at(y + i - r, h), at(x + j - r, w)]) for i in range(size) for j in range(size)) for x in range(w)] for y in range(h)]


def half_even(v):
    return min(255, max(0, round(v)))


def close(a, b):
    """Equal but for pixels whose exact value lies on a rounding border."""
    d = np.abs(a.astype(int) - np.array(b))
    return d.max() <= 1 and (d > 0).mean() < 0.01


@pytest.mark.parametrize("shape", [(9, 14), (1, 5), (24, 24)])
def test_unsharp_and_local_threshold(shape):
    a = np.random.default_rng(shape[1]).integers(0, 256, shape).astype(np.uint8)
    blur = slow_blur(a, 11, 1.5, mirrored)
    assert close(pictures.unsharp(a), [[half_even(2.5 * int(a[y, x]) - 1.5 * half_even(blur[y][x])) for x in range(shape[1])] for y in range(shape[0])])
    mean = slow_blur(a, 31, 5.0, lambda i, n: min(max(i, 0), n - 1))
    want = np.array([[255 * (int(a[y, x]) > half_even(mean[y][x]) - 5) for x in range(shape[1])] for y in range(shape[0])])
    assert (pictures.local_threshold(a) != want).mean() < 0.02


def slow_equalised(a, tiles=8, clip=3.0):
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    level = {}
    for ty in range(tiles):
        for tx in range(tiles):
            counts = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    counts[a[mirrored(y, h), mirrored(x, w)]] += 1
            limit = max(1, int(clip * th * tw / 256))
            over = sum(max(0, c - limit) for c in counts)
            counts = [min(c, limit) + over // 256 for c in counts]
            rest = over % 256
            i = 0
            while rest:
                counts[i] += 1
                i, rest = i + max(1, 256 // (over % 256)), rest - 1
            total = 0
            for v in range(256):
                total += counts[v]
                level[ty, tx, v] = half_even(total * 255 / (th * tw))
    inside = lambda t: min(max(t, 0), tiles - 1)
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            u, v = y / th - 0.5, x / tw - 0.5
            ty, tx = math.floor(u), math.floor(v)
            fy, fx = u - ty, v - tx
            at = lambda dy, dx: level[inside(ty + dy), inside(tx + dx), a[y, x]]  # noqa: B023, E731
            row.append(half_even((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy))
        out.append(row)
    return out


@pytest.mark.parametrize("shape", [(32, 24), (19, 27), (64, 80)])
def test_equalised_by_tiles(shape):
    a = np.random.default_rng(shape[0]).integers(60, 140, shape).astype(np.uint8)
    assert close(pictures.equalised(a), slow_equalised(a))


@pytest.mark.parametrize("degrees", [10.0, -10.0])
def test_turned_and_boxes_back(degrees):
    a = np.random.default_rng(2).integers(0, 256, (21, 33)).astype(np.uint8)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    want = []
    for y in range(21):
        row = []
        for x in range(33):
            u, v = c * (x - 16.5) - s * (y - 10.5) + 16.5, s * (x - 16.5) + c * (y - 10.5) + 10.5
            x0, y0 = math.floor(u), math.floor(v)
            at = lambda dy, dx: int(a[min(max(y0 + dy, 0), 20), min(max(x0 + dx, 0), 32)])  # noqa: B023, E731
            row.append(half_even((at(0, 0) * (1 - u + x0) + at(0, 1) * (u - x0)) * (1 - v + y0) + (at(1, 0) * (1 - u + x0) + at(1, 1) * (u - x0)) * (v - y0)))
        want.append(row)
    assert close(pictures.turned(a, degrees), want)
    name = "rot+10" if degrees > 0 else "rot-10"
    r = np.random.default_rng(5)
    for _ in range(20):  # a patch found in the turned picture lies in the box it is mapped back to
        x, y = int(r.integers(20, 60)), int(r.integers(20, 40))
        p = np.zeros((80, 100), np.uint8)
        p[y : y + 12, x : x + 20] = 255
        found = vision.bounding_box(pictures.turned(p, degrees) > 127)
        bx, by, bw, bh = pictures.box_back(name, found, p.shape)
        assert bx <= x + 1 and by <= y + 1 and bx + bw >= x + 19 and by + bh >= y + 11 and bw < 20 + 16 and bh < 12 + 16
    assert pictures.box_back("clahe", (1, 2, 3, 4), (9, 9)) == (1, 2, 3, 4) and pictures.box_back(name, (0, 0, 9, 9), (9, 9)) == (0, 0, 9, 9)


def slow_parts(mask):
    left, out = set(zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)), []
    while left:
        todo = [left.pop()]
        own = []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            todo += near
        ys, xs = zip(*own, strict=True)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    return sorted(out)


def test_connected_parts_by_runs():
    r = np.random.default_rng(7)
    for share in (0.05, 0.3, 0.5, 0.8):
        for shape in ((1, 1), (1, 30), (30, 1), (17, 23)):
            m = r.random(shape) < share
            assert sorted(pictures.parts(m)) == slow_parts(m)
    assert pictures.parts(np.zeros((4, 4), bool)) == [] and pictures.parts(np.ones((4, 4), bool)) == [(0, 0, 4, 4, 16)]
    snake = np.zeros((1001, 1000), bool)
    snake[::2] = True
    for k in range(1, 1001, 2):
        snake[k, -1 if k // 2 % 2 == 0 else 0] = True
    start = time.perf_counter()
    assert pictures.parts(snake) == [(0, 0, 1000, 1001, 501 * 1000 + 500)]
    assert time.perf_counter() - start < 2


def slow_mixture(values, modes=5):
    """One pixel's mixture; whether each value but the first stands out."""
    g, out = [], []
    for t, x in enumerate(values, 1):
        rate, known, one, total = 1 / min(2 * t, 500), False, None, 0.0
        for m in g:
            near = m["w"] > 0
            m["w"] = (1 - rate) * m["w"] - rate * 0.05
            apart = (x - m["m"]) ** 2
            if one is None and near:
                known = known or (total < 0.9 and apart < 16 * m["v"])
                if apart < 9 * m["v"]:
                    one = m
                    m["w"] += rate
                    pull = rate / m["w"]
                    m["m"] += pull * (x - m["m"])
                    m["v"] = min(75.0, max(4.0, m["v"] + pull * (apart - m["v"])))
            if m is not one and m["w"] < rate * 0.05:
                m["w"] = 0.0
            total += m["w"]
        g = [m for m in g if m["w"] > 0]
        for m in g:
            m["w"] /= total
        if one is None:
            g = g[: modes - 1]
            for m in g:
                m["w"] *= 1 - rate
            g.append({"w": rate if g else 1.0, "m": float(x), "v": 15.0})
        g.sort(key=lambda m: -m["w"])
        out.append(not known)
    return out[1:]


def test_background_mixture():
    r = np.random.default_rng(1)
    frames = (r.choice([20, 24, 90, 180, 250], (120, 6, 7), p=[0.6, 0.2, 0.1, 0.06, 0.04]) + r.integers(-3, 4, (120, 6, 7))).clip(0, 255).astype(np.uint8)
    model = pictures.Mixture()
    got = [model.apply(f) for f in frames]
    assert got[0] is None
    for y in range(6):
        for x in range(7):
            assert [bool(g[y, x]) for g in got[1:]] == slow_mixture(frames[:, y, x].tolist())
    share = np.mean(got[60:])
    assert 0.02 < share < 0.3
    assert model.apply(np.zeros((3, 3), np.uint8)) is None  # another size starts anew


def test_background_starts_anew_after_gaps(spark):
    rows = []
    for i in range(30):
        p = np.full((24, 32), 20 if i < 15 else 120, np.uint8)
        p[3:9, 4:9] = 250 if i in (8, 9, 22) else p[0, 0]
        rows.append(("a", i, bytearray(p.tobytes()), 24, 32, i == 15))
    frames = spark.createDataFrame(rows, "source_id string, frame_index long, image binary, h int, w int, discontinuity boolean")
    got = vision.activity(frames, 32, mixture={}, grow=1).where("active").orderBy("frame_index").collect()
    assert [(r.frame_index, r.x, r.y, r.w, r.h) for r in got] == [(i, 3, 2, 7, 8) for i in (8, 22)]  # the second time in a row it is known


# Evidence files


def evidence_frames(spark, n=5):
    rows = [(f"s-{c}", "cam", i, i / 10, bytearray(np.full((3, 4), (c * 40 + i) % 256, np.uint8).tobytes()), 3, 4, 0, 9, "miss") for c in range(n) for i in range(4)]
    return spark.createDataFrame(rows, evidence.SCHEMA)


def test_evidence_is_read_back(spark, tmp_path):
    spark.dataSource.register(evidence.EvidenceFiles)
    frames = evidence_frames(spark)
    for _ in range(2):  # the second burst of a name stands beside the first
        evidence.clustered(frames).write.format("evidence").option("path", str(tmp_path)).option("day", "2026-06-10").option("stride", "2").mode("append").save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2026-06-10"]
    assert sorted(p.name for p in (tmp_path / "2026-06-10").iterdir()) == sorted([f"s-{c}" for c in range(5)] + [f"s-{c}-r1" for c in range(5)])
    back = {(r.candidate_id, r.frame_index): (r.h, r.w, bytes(r.image)) for r in evidence.read_pictures(spark, str(tmp_path)).where("candidate_id not like '%-r1'").collect()}
    assert back == {(r.candidate_id, r.frame_index): (3, 4, bytes(r.image)) for r in frames.collect() if r.frame_index % 2 == 0}
    meta = evidence.read_meta(spark, str(tmp_path)).collect()
    assert len(meta) == 10 and all(r.frame_count == 2 and r.frame_indices == [0, 2] and r.ts_range == [0.0, 0.3] and r.segment_frames == [0, 9] and r.reason == "miss" for r in meta)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(evidence.EvidenceFiles)
    broken = evidence_frames(spark).withColumn("w", F.when((F.col("candidate_id") == "s-3") & (F.col("frame_index") == 2), 7).otherwise(F.col("w")))
    with pytest.raises(Exception, match="reshape"):
        evidence.clustered(broken).write.format("evidence").option("path", str(tmp_path)).mode("append").save()
    assert list(tmp_path.iterdir()) == []


def test_png():
    a = np.random.default_rng(4).integers(0, 256, (13, 7)).astype(np.uint8)
    assert (evidence.from_png(evidence.png(a)) == a).all() and evidence.png(a)[:4] == b"\x89PNG"


def test_variants_of_a_stack_and_of_mixed_sizes(spark):
    """A stack gives what its pictures give one by one; a table may mix sizes."""
    r = np.random.default_rng(5)
    stack = r.integers(0, 256, (7, 30, 41), dtype=np.uint8)
    for name, change in pictures.VARIANTS.items():
        assert (change(stack) == np.stack([change(a) for a in stack])).all(), name
    images = [r.integers(0, 256, (8 + i % 3 * 9, 12 + i % 2 * 20), dtype=np.uint8) for i in range(40)]
    frames = spark.createDataFrame([(i, a.tobytes(), *a.shape) for i, a in enumerate(images)], "i long, image binary, h int, w int")
    got = {(x.i, x.place): (x.mean, x.least, x.most) for x in vision.variant_rows(frames, ["i"]).collect()}
    made = {(i, k + 1): change(a) for i, a in enumerate(images) for k, change in enumerate(pictures.VARIANTS.values())}
    assert got == {k: (pytest.approx(float(v.mean())), v.min(), v.max()) for k, v in made.items()}


def test_evidence_is_read_by_tasks_that_list_their_share(spark, tmp_path):
    """All candidates' pictures and bodies, below a root, a day or a candidate, by few tasks; what an attempt has left is not seen."""
    body = evidence.png(np.full((2, 3), 9, np.uint8))
    for day in ("2026-06-10", "2026-06-11", ".attempts-x"):
        for c in range(60):
            folder = tmp_path / day / f"{day}-{c}"
            folder.mkdir(parents=True)
            (folder / f"frame_{c:08d}.png").write_bytes(body)
            (folder / "meta.json").write_text(f'{{"candidate_id": "{day}-{c}", "frame_count": 1}}')
    read = evidence.read_pictures(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and not read.inputFiles()
    both = {f"{d}-{c}" for d in ("2026-06-10", "2026-06-11") for c in range(60)}
    assert {(r.candidate_id, r.frame_index) for r in read.collect()} == {(c, int(c.rsplit("-", 1)[1])) for c in both} and read.count() == 120
    assert {r.candidate_id for r in evidence.read_meta(spark, str(tmp_path)).collect()} == both
    assert evidence.read_pictures(spark, str(tmp_path / "2026-06-10")).count() == 60
    assert [r.frame_index for r in evidence.read_pictures(spark, str(tmp_path / "2026-06-10" / "2026-06-10-7")).collect()] == [7]
