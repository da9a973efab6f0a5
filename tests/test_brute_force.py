"""Queries that SQL does not express well, against plain loops over the same views."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.operators import metrics, stats
from annolake.plans import registry
from annolake.plans.fixtures import with_views
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def dicts(con, sql):
    rel = con.sql(with_views(sql))
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def iou_2d(g, d):
    both = max(min(g["x2"], d["x2"]) - max(g["x1"], d["x1"]), 0) * max(min(g["y2"], d["y2"]) - max(g["y1"], d["y1"]), 0)
    return both / ((g["x2"] - g["x1"]) * (g["y2"] - g["y1"]) + (d["x2"] - d["x1"]) * (d["y2"] - d["y1"]) - both)


def iou_3d(g, d):
    both = 1.0
    for c, s in (("cxm", "l3"), ("cym", "h3"), ("czm", "w3")):
        both *= max(min(g[c] + g[s] / 2, d[c] + d[s] / 2) - max(g[c] - g[s] / 2, d[c] - d[s] / 2), 0)
    return both / (g["w3"] * g["h3"] * g["l3"] + d["w3"] * d["h3"] * d["l3"] - both)


def statistics(gt, det, iou, thresholds, areas, size, named, proximity, scopes):
    """The thirteen statistics of each scope, detection by detection."""
    groups = defaultdict(lambda: ([], []))
    for side, rows in ((0, gt), (1, det)):
        for r in rows:
            groups[r["image_id"], r["category_name"]][side].append(r)
    marks = defaultdict(list)  # (scope, category, area, thr) -> (-score, dataset, image, rank, det), matched, ignored
    npig = defaultdict(int)
    for (_, category), (truths, found) in groups.items():
        found = sorted(found, key=lambda d: (-d["score"], d["det_id"]))[:100]
        pairs = [[iou(g, d) for g in truths] for d in found]
        for name, lo, hi in areas:
            off = [not g["valid3d"] or not lo <= size(g) <= hi for g in truths]
            for g, o in zip(truths, off, strict=True):
                for scope in scopes(g):
                    npig[scope, category, name] += not o
            for thr, t in enumerate(thresholds):
                used = set()
                for rank, d in enumerate(found, 1):
                    far = proximity and not any(p > 0.3 for p in pairs[rank - 1])
                    free = [(not off[k], pairs[rank - 1][k], g["ann_id"], k) for k, g in enumerate(truths) if k not in used and pairs[rank - 1][k] >= t]
                    best = max(free, default=None)
                    if best:
                        used.add(best[3])
                    ignored = (off[best[3]] or far) if best else (not lo <= size(d) <= hi or far)
                    for scope in scopes(d):
                        marks[scope, category, name, thr].append(((-d["score"], d["dataset_id"], d["image_id"], rank, d["det_id"]), best is not None, ignored))
    ap, ar = {}, {}
    for (scope, category, name), n in npig.items():
        for thr in range(len(thresholds)):
            if not n:
                continue
            rows = sorted(marks[scope, category, name, thr])
            tp, fp = np.cumsum([m and not i for _, m, i in rows]), np.cumsum([not m and not i for _, m, i in rows])
            precision = np.array([a / (a + b) if a + b else 0.0 for a, b in zip(tp, fp, strict=True)])
            levels = [precision[k:].max() if k < len(tp) else 0.0 for k in (np.searchsorted(tp * 100, i * n) for i in range(101))]
            ap[scope, category, name, thr] = np.mean(levels)
            for most in (1, 10, 100):
                ar[scope, category, name, thr, most] = sum(m and not i and key[3] <= most for key, m, i in rows) / n
    out = {}
    for scope in {k[0] for k in ap}:
        mean = lambda table, ok: (lambda v: round(float(np.mean(v)), 6) if v else None)([x for k, x in table.items() if k[0] == scope and ok(k)])  # noqa: B023, E731
        row = {"ap": mean(ap, lambda k: k[2] == "all")}
        row |= {f"ap{n}": mean(ap, lambda k, i=i: k[2] == "all" and k[3] == i) for n, i in named}
        row |= {f"ar_{m}": mean(ar, lambda k, m=m: k[2] == "all" and k[4] == m) for m in (1, 10, 100)}
        for part, _, _ in areas[1:]:
            row |= {f"ap_{part}": mean(ap, lambda k, p=part: k[2] == p), f"ar_{part}": mean(ar, lambda k, p=part: k[2] == p and k[4] == 100)}
        out[scope] = row
    return out


_GT = "SELECT a.*, i.dataset_id FROM fx_annotations a JOIN fx_images i USING (image_id)"
_DET = "SELECT d.*, i.dataset_id FROM fx_detections d JOIN fx_images i USING (image_id)"


def same(got, want, tolerance=2e-6):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=tolerance)), k


def test_summary_2d(spark, con):
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    want = statistics(dicts(con, _GT), dicts(con, _DET), iou_2d, metrics.THRESHOLDS_2D, metrics.AREAS_2D, area, (("50", 0), ("75", 5), ("95", 9)), True, lambda r: (str(r["dataset_id"]), "<Concat>"))
    got = {r.scope: r.asDict() for r in registry.QUERIES["summary_2d"](spark, SF).collect()}
    assert len(want) == 5
    for scope in want:
        same(got[scope], want[scope] | {"scope": scope})


def test_summary_3d(spark, con):
    det = [d | {"dataset_id": 0} for d in dicts(con, _DET)]
    want = statistics(dicts(con, _GT), det, iou_3d, metrics.THRESHOLDS_3D, metrics.AREAS_3D, lambda r: r["czm"], (("15", 2), ("25", 4), ("50", 9)), False, lambda r: ("all",))
    # An IoU that equals a threshold but for its last bit may fall on either side.
    same(registry.QUERIES["summary_3d"](spark, SF).first().asDict(), want["all"], 1e-4)


def test_depth_bins(spark, con):
    rows, want = defaultdict(list), {}
    for r in dicts(con, "SELECT * FROM fx_annotations"):
        rows[r["category_name"]].append((math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]), r["czm"]))
    for name, own in rows.items():
        s, z = np.array([o[0] for o in own]), np.array([o[1] for o in own])
        centres, best = s.min() * (s.max() / s.min()) ** (np.arange(4) / 3), None
        for _ in range(1000):
            at = np.abs(s[:, None] - centres[None, :]).argmin(axis=1)
            score = round(float(np.abs(s - centres[at]).mean()), 4)
            if best is not None and score >= best:
                break
            best, centres = score, np.array([s[at == k].mean() if (at == k).any() else c for k, c in enumerate(centres)])
        at = np.abs(s[:, None] - centres[None, :]).argmin(axis=1)
        for k, c in enumerate(centres):
            n = int((at == k).sum())
            own_z = z[at == k] if n >= 5 else z[np.lexsort((z, s, np.abs(s - c)))[:5]]
            want[name, k] = (c, n, own_z.mean(), own_z.std(ddof=1))
    got = {(r.category_name, r.bin): (r.centre, r.n, r.depth_mean, r.depth_std) for r in registry.QUERIES["depth_bins_of_sizes"](spark, SF).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_deduplicated_masks(spark, con):
    pixels = defaultdict(set)
    for r in dicts(con, "SELECT * FROM fx_mask_runs"):
        pixels[r["image_id"], r["inst_id"]] |= {(r["v"], u) for u in range(r["u0"], r["u1"] + 1)}
    want = set()
    for image in {k[0] for k in pixels}:
        kept = []
        for inst in sorted(k[1] for k in pixels if k[0] == image):
            p, conf = pixels[image, inst], len(pixels[image, inst]) % 97 / 97.0
            hit = next((k for k in kept if len(p & k[1]) / len(p | k[1]) > 0.3), None)
            if hit is None:
                kept.append((inst, p, conf))
            elif conf > hit[2]:
                kept = [k for k in kept if k is not hit] + [(inst, p, conf)]
        want |= {(image, k[0], place) for place, k in enumerate(kept)}
    assert {(r.image_id, r.inst_id, r.place) for r in registry.QUERIES["deduplicated_masks"](spark, SF).collect()} == want


def test_envelope_over_bands(spark):
    """Many bands and few give the same curve, also for scores beyond [0, 1] and equal ones."""
    rng = np.random.default_rng(3)
    rows = [(i % 2 and "a" or "b", "all", 0, 1, int(i), float(np.round(rng.normal(0.5, 0.5), 2)), int(i) if rng.random() < 0.6 else None, bool(rng.random() < 0.1)) for i in range(400)]
    m = spark.createDataFrame(rows, "category_name string, area_range string, thr int, rank int, det_id long, score double, matched long, ignored boolean").withColumn("image_id", rng_id())
    npig = spark.createDataFrame([("a", "all", 150), ("b", "all", 130)], "category_name string, area_range string, npig long")
    curves = [sorted(map(tuple, metrics.precision_recall(m, npig, bands=b).collect())) for b in (1, 7)]
    assert curves[0] == curves[1] and len(curves[0]) == 400


def rng_id():
    return (F.col("det_id") % 10).cast("long")


def test_medians_of_groups_that_many_ranges_share(spark):
    """Odd and even numbers of values, repeated and single values, nulls as keys and values, NaN, and one group of most rows."""
    nan = float("nan")
    rows = [("a", float(v % 37)) for v in range(4001)] + [(None, float(v)) for v in range(10)] + [("b", 5.0), ("c", None), ("d", 1.0), ("d", nan), ("e", 2.0), ("e", None), ("e", 4.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    want = {r.k: r.m for r in df.where("value IS NOT NULL").groupBy("k").agg(F.median("value").alias("m")).collect()}
    got = {r.k: r.median for r in stats.medians(df, ["k"], "value").collect()}
    assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))
    assert set(got) == {"a", "b", "d", "e", None}
    assert stats.medians(df.limit(0), ["k"], "value").count() == 0


def test_field_statistics_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 3.0, None), ("x", 5.0, 6.0)], "k string, u double, v double")
    got = {(r.k, r.field): (r.n, r.mean, r.median) for r in stats.field_stats(df, ["u", "v"], ["k"]).collect()}
    assert got == {(None, "u"): (2, 2.0, 2.0), (None, "v"): (1, 2.0, 2.0), ("x", "u"): (1, 5.0, 5.0), ("x", "v"): (1, 6.0, 6.0)}


def test_envelope_of_saturated_scores(spark):
    """All scores in [.99, 1], many of them exactly 1, one group far larger than the others: several bands share it, and the curve is that of a loop."""
    rng = random.Random(8)
    rows = [(i, "big" if i % 10 else "small", "all", 0, 1, i, rng.choice([1.0, 0.99 + rng.randrange(100) / 10_000]), i if rng.random() < 0.5 else None, rng.random() < 0.1) for i in range(1500)]
    m = spark.createDataFrame(rows, "image_id long, category_name string, area_range string, thr int, rank int, det_id long, score double, matched long, ignored boolean")
    npig = spark.createDataFrame([("big", "all", 900), ("small", "all", 90)], "category_name string, area_range string, npig long")
    got = metrics.precision_recall(m, npig, bands=9).collect()
    for name, total in (("big", 900), ("small", 90)):
        own, tp, fp, want = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[6], r[0])), 0, 0, []
        for pos, r in enumerate(own, 1):
            tp += r[7] is not None and not r[8]
            fp += r[7] is None and not r[8]
            want.append([pos, tp / total, tp / (tp + fp) if tp + fp else 0.0])
        best = 0.0
        for w in reversed(want):
            best = max(best, w[2])
            w.append(best)
        mine = sorted([r.pos, r.rc, r.pr, r.env] for r in got if r.category_name == name)
        assert len(mine) == len(want) and all(abs(x - y) < 1e-12 for p, q in zip(mine, want, strict=True) for x, y in zip(p, q, strict=True))
    rows_of = m.select("category_name", "area_range", "thr", F.lit(100).alias("max_dets"), "score", "image_id").repartitionByRange(9, "category_name", F.desc("score"), "image_id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows_of) == 9 and max(r["count"] for r in rows_of) < 600
