"""Small hand-made cases whose results are known."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.functions import boxes, geometry as g
from annolake.functions.iou3d import iou3d_of
from annolake.operators import matching, metrics, points, raster, stats, suppression


def corners(center=(0, 0, 0), dims=(1, 1, 1), yaw=0.0):
    w, h, length = dims
    c, s = math.cos(yaw), math.sin(yaw)
    out = []
    for sx, sy, sz in g.CORNER_SIGNS:
        x, y, z = sx * length / 2, sy * h / 2, sz * w / 2
        out.append([c * x + s * z + center[0], y + center[1], -s * x + c * z + center[2]])
    return out


def test_iou3d_cases():
    unit = corners()
    assert iou3d_of(unit, unit) == pytest.approx(1)
    assert iou3d_of(unit, corners((0.5, 0, 0))) == pytest.approx(1 / 3)
    assert iou3d_of(unit, corners((3, 0, 0))) == 0
    assert iou3d_of(unit, corners(yaw=math.pi / 4)) == pytest.approx((2 * math.sqrt(2) - 2) / (4 - 2 * math.sqrt(2)), abs=1e-9)
    assert iou3d_of(unit, corners(dims=(1, 0, 1))) == 0
    a, b = corners((0.1, 0.2, 0.3), (1, 2, 3), 0.4), corners((0.5, 0.1, 0.2), (2, 1, 2), 1.1)
    assert iou3d_of(a, b) == pytest.approx(iou3d_of(b, a), abs=1e-9)
    turn = np.array(corners(yaw=0.7))[:3]
    q, _ = np.linalg.qr(np.array(turn))
    assert iou3d_of(np.array(a) @ q, np.array(b) @ q) == pytest.approx(iou3d_of(a, b), abs=1e-9)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_box_rules(spark):
    w, h = F.lit(100), F.lit(80)
    r = one(
        spark,
        missing=boxes.valid_box(boxes.box(-1, -1, -1, -1), w, h), nan=boxes.valid_box(boxes.box(float("nan"), 0, 5, 5), w, h), flat=boxes.valid_box(boxes.box(5, 5, 5, 9), w, h),
        outside=boxes.valid_box(boxes.box(200, 5, 300, 9), w, h), clipped=boxes.valid_box(boxes.box(-5, 5, 300, 9), w, h), unit=boxes.det_box_to_pixels(boxes.box(0.5, 0.5, 0.2, 0.2), w, h),
    )
    assert r.missing is r.nan is r.flat is r.outside is None
    assert r.clipped == [0, 5, 99, 9] and r.unit == pytest.approx([40, 32, 60, 48])


def test_geometry_pairs(spark):
    m = g.euler_to_matrix(F.lit(0.1), F.lit(0.2), F.lit(0.3))
    args = [F.lit(float(x)) for x in (400, 300, 500, 500, 320, 240)]
    back = g.from_allocentric(g.to_allocentric(m, *args), *args)
    r = one(
        spark,
        angle=g.rotation_angle(back, m), euler=g.matrix_to_euler(m), same=g.align_vectors(g.vec(0, 1, 0), g.vec(0, 2, 0)), to=g.times(g.align_vectors(g.vec(1, 0, 0), g.vec(0, 1, 1)), g.vec(1, 0, 0)),
        twice=g.rotation_angle(g.mirror_pose(g.mirror_pose(m)), m), quarter=g.quaternion_to_matrix(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))), flat=g.box3d_valid(F.array(*(g.vec(*c) for c in corners(dims=(1, 0, 1))))),
        sound=g.box3d_valid(F.array(*(g.vec(*c) for c in corners(yaw=0.3)))), bent=g.box3d_valid(F.array(*(g.vec(*c) for c in [*corners()[:7], [2, 3, 1]]))),
    )
    assert r.angle < 1e-6 and r.twice < 1e-6 and r.euler == pytest.approx([0.1, 0.2, 0.3])
    assert r.same == [[1, 0, 0], [0, 1, 0], [0, 0, 1]] == r.quarter and r.to == pytest.approx([0, math.sqrt(0.5), math.sqrt(0.5)])
    assert r.sound and not r.flat and not r.bent


def greedy(truths, dets, thr, lo, hi):
    """Sequential matcher: truths (id, ignore, size), dets (id, size, {truth: iou}, far)."""
    used, out = set(), []
    order = sorted(truths, key=lambda t: (t[1] or not lo <= t[2] <= hi, t[0]))
    for d, size, ious, far in dets:
        best, m = min(thr, 1 - 1e-10), None
        for t, ign, tsize in order:
            flag = ign or not lo <= tsize <= hi
            if t in used or t not in ious:
                continue
            if m is not None and not m[1] and flag:
                break
            if ious[t] < best:
                continue
            best, m = ious[t], (t, flag)
        if m:
            used.add(m[0])
        out.append((d, m[0] if m else None, (m[1] if m else not lo <= size <= hi) or far))
    return out


def test_matcher_against_loop(spark):
    rng = random.Random(7)
    gt, det, pairs, expected = [], [], [], []
    for image in range(60):
        truths = [(image * 100 + i, rng.random() < 0.3, rng.choice([5.0, 50.0])) for i in range(rng.randrange(5))]
        dets = []
        for i in range(rng.randrange(6)):
            ious = {t[0]: rng.choice([0.3, 0.5, 0.6, 0.6, 0.9]) for t in truths if rng.random() < 0.7}
            dets.append((image * 1000 + i, rng.choice([5.0, 50.0]), ious, False))
        gt += [(t[0], image, "c", t[1], t[2]) for t in truths]
        det += [(d[0], image, "c", r + 1, 1.0 - r / 10, d[1]) for r, d in enumerate(dets)]
        pairs += [(t, d[0], v) for d in dets for t, v in d[2].items()]
        for k, (lo, hi) in enumerate(((0, 100), (0, 10))):
            for thr, at in enumerate((0.5, 0.6)):
                expected += [(image, k, thr, *row) for row in greedy(truths, dets, at, lo, hi)]
    g_df = spark.createDataFrame(gt, "ann_id long, image_id long, category_name string, ignore boolean, area double")
    d_df = spark.createDataFrame(det, "det_id long, image_id long, category_name string, rank int, score double, area double")
    p_df = spark.createDataFrame(pairs, "ann_id long, det_id long, iou double")
    got = matching.match_greedy(g_df, d_df, p_df, [0.5, 0.6], [("0", 0, 100), ("1", 0, 10)]).collect()
    assert sorted(((r.image_id, int(r.area_range), r.thr, r.det_id, r.matched, r.ignored) for r in got), key=repr) == sorted(expected, key=repr)


def test_average_precision_against_loop(spark):
    rng = random.Random(3)
    rows = [(i, "c", "all", 0, i % 7 + 1, 1000 + i, rng.randrange(50) / 50, i if rng.random() < 0.6 else None, rng.random() < 0.1) for i in range(200)]
    m = spark.createDataFrame(rows, "image_id long, category_name string, area_range string, thr int, rank int, det_id long, score double, matched long, ignored boolean")
    npig = spark.createDataFrame([("c", "all", 150)], "category_name string, area_range string, npig long")
    got = metrics.average_precision(metrics.precision_recall(m, npig), npig, 1).first()
    tp = fp = 0
    curve = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0], r[4], r[5])):
        tp += r[7] is not None and not r[8]
        fp += r[7] is None and not r[8]
        curve.append((tp / 150, tp / (tp + fp) if tp + fp else 0.0))
    for i in range(len(curve) - 2, -1, -1):
        curve[i] = (curve[i][0], max(curve[i][1], curve[i + 1][1]))
    want = sum(next((p for rc, p in curve if rc * 100 >= k - 1e-7), 0.0) for k in range(101)) / 101
    assert got.ap == pytest.approx(want) and got.ar == pytest.approx(tp / 150)


def test_planes(spark):
    rng, rows = np.random.default_rng(1), []
    for k, normal in enumerate(([0.1, -0.99, 0.1], [0.99, -0.1, 0.05], [0.05, -0.1, 0.99])):
        n = np.array(normal) / np.linalg.norm(normal)
        p = rng.normal(size=(40, 3))
        p = p - np.outer(p @ n + 1.5, n)
        rows += [(k, *map(float, x)) for x in p]
    rows += [(3, float(i), 0.0, 1.0) for i in range(10)]
    rows += [(4, float(i), float(i), float(i)) for i in range(20)]
    got = {r.k: r for r in points.fit_ground_plane(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"]).collect()}
    for k in range(3):
        assert got[k].mse < 1e-9 and got[k].d == pytest.approx(1.5, abs=1e-6) and got[k].b < 0
    assert got[3].a is None and got[4].a is None


def test_box_fit_and_runs(spark):
    rng = np.random.default_rng(2)
    u = rng.uniform(-1, 1, (300, 3)) * [3, 0.2, 1]
    t = 0.5
    p = np.stack([math.cos(t) * u[:, 0] - math.sin(t) * u[:, 2], u[:, 1], math.sin(t) * u[:, 0] + math.cos(t) * u[:, 2]], axis=1)
    df = spark.createDataFrame([(1, *map(float, x)) for x in p], "k int, x double, y double, z double")
    prior = spark.createDataFrame([(1, "bed", 2.0, 1.0, 6.0)], "k int, category_name string, w double, h double, l double")
    r = points.fit_box(df, ["k"], prior).first()
    assert r.yaw == pytest.approx(t, abs=0.05) and r.dx == pytest.approx(6, abs=0.2) and r.dy == 1.0 and r.ok
    runs = spark.createDataFrame([(1, 1, v, u0, u1) for v, u0, u1 in ((0, 0, 4), (0, 3, 6), (0, 8, 9), (1, 0, 9), (2, 0, 9))], "image_id long, inst_id long, v int, u0 int, u1 int")
    merged = raster.merge_runs(runs)
    assert sorted((x.v, x.u0, x.u1) for x in merged.collect()) == [(0, 0, 6), (0, 8, 9), (1, 0, 9), (2, 0, 9)]
    eroded = raster.erode_mask(merged, 1, 1, 10, 10)
    # Row 2 is the mask's lower end inside the image and falls; the border at row 0 and at both sides does not erode.
    assert sorted((x.v, x.u0, x.u1) for x in eroded.collect()) == [(0, 0, 5), (0, 9, 9), (1, 0, 6), (1, 8, 9)]


def test_suppression_and_sampling(spark):
    det = spark.createDataFrame([(1, 1, "c", 0.9, 0.0, 0.0, 10.0, 10.0), (2, 1, "c", 0.8, 1.0, 1.0, 10.0, 10.0), (3, 1, "c", 0.7, 50.0, 50.0, 60.0, 60.0), (4, 1, "d", 0.6, 0.0, 0.0, 10.0, 10.0), (5, 1, "c", float("nan"), 0.0, 0.0, 1.0, 1.0)], "det_id long, image_id long, category_name string, score double, x1 double, y1 double, x2 double, y2 double")
    assert [r.det_id for r in suppression.nms(det, 0.5, 3).orderBy("place").collect()] == [1, 3, 4]
    masks = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.1)], "image_id long, inst_id long, conf double")
    laps = spark.createDataFrame([(1, 1, 2, 0.95), (1, 2, 3, 0.5)], "image_id long, a long, b long, iou double")
    assert sorted(r.inst_id for r in suppression.dedup_masks(masks, laps).collect()) == [2, 3]
    rows = spark.range(1000).select((F.col("id") % 10).alias("image_id"), F.col("id").alias("det_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    got = stats.weighted_subsample(rows, 20, 0.25, F.lit(1.0)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("label").alias("fg")).collect()
    assert all(r.n == 20 and r.fg <= 5 for r in got)
