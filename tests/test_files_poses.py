"""PNG depth against an own encoder, flipped sets, merged poses."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.operators import matching, overlap, points, sets
from annolake.sources import rasters


def encode_png(a, filters, split=1000):
    """A grey PNG whose line r has filter filters[r % n], by the definition of the filters."""
    n = a.dtype.itemsize
    rows = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(a), -1).astype(int)
    out = b""
    for r, line in enumerate(rows):
        kind, coded = filters[r % len(filters)], []
        for i, x in enumerate(line):
            left, up = line[i - n] if i >= n else 0, rows[r - 1][i] if r else 0
            corner = rows[r - 1][i - n] if r and i >= n else 0
            p = left + up - corner
            nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            coded.append((x - [0, left, up, (left + up) // 2, nearest][kind]) % 256)
        out += bytes([kind, *coded])
    data = zlib.compress(out)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * n, 0, 0, 0, 0)
    return rasters.PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"k") + b"".join(chunk(b"IDAT", data[i : i + split]) for i in range(0, len(data), split)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 0, 2, 1]])
@pytest.mark.parametrize("kind", [np.uint16, np.uint8])
def test_png_of_every_filter(filters, kind):
    rng = np.random.default_rng(1)
    for shape in ((7, 5), (1, 9), (6, 1), (1, 1)):
        a = rng.integers(0, np.iinfo(kind).max + 1, shape).astype(kind)
        assert (rasters.png_array(encode_png(a, filters, 11)) == a).all()


def test_png_and_npy_of_one_image_are_equal(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 65536, (48, 64)).astype(np.uint16)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    np.save(tmp_path / "a/7.npy", a)
    (tmp_path / "b/7.png").write_bytes(encode_png(a, [1, 2, 3, 4]))
    lines = [rasters.read_depth(spark, str(tmp_path / x)).orderBy("v").collect() for x in "ab"]
    assert lines[0] == lines[1] and len(lines[0]) == 48 and abs(lines[0][3].depth[5] - a[3, 5] / 8000) < 1e-6


def test_png_that_is_damaged(spark, tmp_path):
    good = encode_png(np.arange(40, dtype=np.uint16).reshape(5, 8), [4])
    flipped = bytearray(good)
    flipped[60] ^= 1
    colour = bytearray(good)
    colour[25] = 2
    colour[29:33] = struct.pack(">I", zlib.crc32(bytes(colour[12:29])))
    for bad in (good[:-20], bytes(flipped), b"nothing", bytes(colour), good[: len(rasters.PNG)]):
        with pytest.raises(ValueError):
            rasters.png_array(bad)
    (tmp_path / "x.png").write_bytes(good[:-20])
    with pytest.raises(Exception, match="x.png: damaged PNG"):
        rasters.read_depth(spark, str(tmp_path)).count()


def test_flipping_twice_gives_the_set_back(spark):
    rng = random.Random(3)
    matrix = lambda: [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(3)]
    rows = [(i, i % 3, [1.0 + i, 2.0, 30.0, 40.0] if i % 4 else None, [0.5 * i, 1.0, 5.0] if i % 5 else None, [[1.0 * i, 2.0, k + 1.0] for k in range(8)] if i % 3 else None, matrix() if i % 2 else None, [3.0, 4.0]) for i in range(20)]
    anns = spark.createDataFrame(rows, "ann_id int, image_id int, bbox2D_trunc array<double>, center_cam array<double>, bbox3D_cam array<array<double>>, R_cam array<array<double>>, center_proj array<double>")
    images = spark.createDataFrame([(i, 100 + 10 * i, [[50.0, 0.0, 40.0], [0.0, 50.0, 30.0], [0.0, 0.0, 1.0]]) for i in range(3)], "image_id int, width int, k array<array<double>>")
    once = sets.mirror_annotations(anns, images)
    got = {r.ann_id: r for r in once.collect()}
    m1, m2 = np.diag([1, -1, -1]), np.diag([-1, -1, 1])
    for r in anns.collect():
        w, x = 100 + 10 * r.image_id, got[r.ann_id]
        assert x.bbox2D_trunc == (None if r.bbox2D_trunc is None else [w - r.bbox2D_trunc[2], 2.0, w - r.bbox2D_trunc[0], 40.0]) and x.center_proj == [w - 3.0, 4.0]
        assert x.center_cam == (None if r.center_cam is None else [-r.center_cam[0], *r.center_cam[1:]])
        assert x.bbox3D_cam == (None if r.bbox3D_cam is None else [[-p[0], *p[1:]] for p in r.bbox3D_cam])
        assert (x.R_cam is None) == (r.R_cam is None) and (r.R_cam is None or np.allclose(x.R_cam, m1 @ np.array(r.R_cam) @ m2))
    assert sorted(sets.mirror_annotations(once, images).collect()) == sorted(anns.collect())
    flipped = sets.mirror_images(images)
    assert {r.image_id: r.k[0][2] for r in flipped.collect()} == {0: 60.0, 1: 70.0, 2: 80.0} and sorted(sets.mirror_images(flipped).collect()) == sorted(images.collect())


def test_near_equal_poses_are_merged(spark):
    rng = random.Random(4)
    half = lambda y: (z := (y + math.pi) % (2 * math.pi) - math.pi) - math.pi * (z > math.pi / 2) + math.pi * (z < -math.pi / 2)

    def yaws_of(values):
        kept = []
        for y in values:
            if y is not None and math.isfinite(y) and all(abs(half(half(y) - k)) > math.radians(5) for k in kept):
                kept.append(half(y))
        return kept

    def scales_of(values):
        kept = []
        for s in values:
            if s is not None and math.isfinite(s) and s > 1e-5 and all(abs(math.log(s / k)) >= 0.04 for k in kept):
                kept.append(s)
        return kept

    odd = [None, float("nan"), float("inf"), 0.0, -1.0]
    rows = [(i, [rng.choice([rng.uniform(-7, 7), rng.uniform(0, 0.2), *odd]) for _ in range(12)], [rng.choice([rng.uniform(0.9, 1.1), rng.uniform(0.1, 3), *odd]) for _ in range(10)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, y array<double>, s array<double>")
    for r in df.select("id", points.distinct_yaws(F.col("y")).alias("y"), points.distinct_scales(F.col("s")).alias("s"), points.yaws_around(F.col("y")).alias("a")).collect():
        y, s = rows[r.id][1:]
        assert np.allclose(r.y, yaws_of(y)) and np.allclose(r.s, scales_of(s))
        assert np.allclose(r.a, yaws_of([b + math.radians(o) for b in yaws_of(y) for o in (-30, -15, 0, 15, 30)]))
    grid = points.pose_grid(df.select("id", "y", "s"), F.col("y"), F.col("s")).where("id = 7").orderBy("order").collect()
    assert np.allclose([(g.yaw, g.scale) for g in grid], [(y, s) for y in yaws_of(rows[7][1]) for s in scales_of(rows[7][2])]) and [g.order for g in grid] == list(range(len(grid)))


@pytest.mark.parametrize("cell,levels", [(1.0, (0, 1, 2, 3, 4, 5, 6)), (4.0, (0, 2)), (1000.0, (0,))])
@pytest.mark.parametrize("closed", [False, True])
def test_overlap_join_against_all_pairs(spark, cell, levels, closed):
    """Boxes of all sizes, some of them points or beyond the coarsest cells, with negative places, borders on cells' borders and repeated boxes."""
    rng = random.Random(9)

    def box():
        x, y, w, h = rng.randrange(-30, 60), rng.uniform(-30, 60), rng.choice([0, 1, 2, 7, 40, 200]), rng.choice([0, 0.5, 4, 30.0])
        return [float(x), float(y), float(x + w), float(y + h)]

    a, b = [(k % 3, k, *box()) for k in range(90)], [(k % 4, k, *box()) for k in range(80)]
    b += [(0, 900, *a[0][2:]), (0, 901, *a[0][2:])]
    df = lambda rows, n: spark.createDataFrame(rows, f"key int, {n} int, " + ", ".join(f"{n}{i} double" for i in range(4)))
    got = overlap.overlap_join(df(a, "a"), df(b, "b"), ["key"], [("a0", "a2"), ("a1", "a3")], [("b0", "b2"), ("b1", "b3")], cell, levels, closed)
    less = (lambda p, q: p <= q) if closed else (lambda p, q: p < q)
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and all(less(max(p[i], q[i]), min(p[i + 2], q[i + 2])) for i in (2, 3)))
    assert sorted((r.a, r.b) for r in got.collect()) == want and len(want) > 40
    line = overlap.overlap_join(df(a, "a"), df(b, "b"), ["key"], [("a0", "a2")], [("b0", "b2")], cell, levels, closed)
    assert line.count() == sum(p[0] == q[0] and less(max(p[2], q[2]), min(p[4], q[4])) for p in a for q in b)


def test_pairs_of_a_large_image_grow_with_overlaps(spark):
    """One image with 10,000 truths and 10,000 proposals: of 10^8 pairs some 10^5 meet, and all that overlap are found."""
    rng = np.random.default_rng(5)

    def some(n):
        at, size = rng.uniform(0, 40_000, (n, 2)), rng.uniform(20, 200, (n, 2))
        return np.hstack([at, at + size])

    g, d = some(10_000), some(10_000)
    rows = lambda v, n: spark.createDataFrame([(0, i, False, b.tolist()) for i, b in enumerate(v)], f"image_id int, {n} int, ignore boolean, {'g' if n == 'ann_id' else 'd'} array<double>")
    got = matching.proposal_pairs(rows(g, "ann_id"), rows(d, "det_id"))
    found = {(r.ann_id, r.det_id) for r in got.collect()}
    want = {(int(i), int(j)) for i in range(len(g)) for j in np.flatnonzero((np.maximum(g[i, 0], d[:, 0]) < np.minimum(g[i, 2], d[:, 2])) & (np.maximum(g[i, 1], d[:, 1]) < np.minimum(g[i, 3], d[:, 3])))}
    assert found == want
    cells = [overlap._placed(rows(v, n).select("image_id", *(F.get(c, i).alias(f"{c}{i}") for i in range(4))), [(f"{c}0", f"{c}2"), (f"{c}1", f"{c}3")], 256.0, (0, 2), m) for v, n, c, m in ((g, "ann_id", "g", "a"), (d, "det_id", "d", "b"))]
    formed = cells[0].join(cells[1], ["image_id", "_level", "_c0", "_c1"]).count()
    assert formed < 60 * len(want) and formed < 2_000_000
