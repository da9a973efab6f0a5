"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import boxes, geometry
from annolake.functions.iou3d import posed_iou3d
from annolake.operators import matching, metrics, suppression
from annolake.plans.fixtures import scene_columns, scenes, view, with_views
from annolake.sources.shared import settled


def _box(*names: str):
    return boxes.box(*(F.col(n) for n in names or ("x1", "y1", "x2", "y2")))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = view(spark, sf_dir, "fx_annotations")
    return gt.select("ann_id", "image_id", "category_name", _box().alias("g"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), (~F.col("valid3d")).alias("ignore"), F.col("czm").alias("depth"), "cxm", "cym", "czm", "w3", "h3", "l3")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = view(spark, sf_dir, "fx_detections")
    return det.select("det_id", "image_id", "category_name", "score", _box().alias("d"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.col("czm").alias("depth"), "cxm", "cym", "czm", "w3", "h3", "l3")


def pairs_2d(gt: DataFrame, det: DataFrame) -> DataFrame:
    d = matching.rank_detections(det).select("det_id", "image_id", "category_name", "d", "rank", "score")
    return matching.match_pairs(gt.select("ann_id", "image_id", "category_name", "g", "ignore", F.col("area").alias("gsize")), d, boxes.iou2d)


def ap50_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2D AP at IoU .5 of every category, nothing ignored."""
    gt, det = truths(spark, sf_dir).withColumn("ignore", F.lit(False)), detections(spark, sf_dir)
    areas = metrics.AREAS_2D[:1]
    found = settled(matching.match_cells(gt, matching.rank_detections(det), boxes.iou2d, [0.5], areas), "matches")
    table = metrics.cell_precision(found, metrics.positives(gt, areas), areas, 1)
    return table.select("category_name", F.round("ap", 6).alias("ap"), F.round("ar", 6).alias("ar"), "npig")


def matches_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches at IoU .5 over all areas, with ignored truths."""
    gt, det = truths(spark, sf_dir), detections(spark, sf_dir)
    found = matching.match_greedy(gt, matching.rank_detections(det), pairs_2d(gt, det), [0.5], metrics.AREAS_2D[:1])
    return found.select("det_id", "rank", "matched", "ignored")


def summary_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen 2D statistics, per data set and over all sets."""
    sets = view(spark, sf_dir, "fx_images").select("image_id", "dataset_id")
    by, areas, n = ("scope", "category_name"), metrics.AREAS_2D, len(metrics.THRESHOLDS_2D)
    ranked = scene_columns(matching.ranked_scenes(scenes(spark, sf_dir).join(sets, "image_id")), truth=("valid3d",))
    ranked = ranked.withColumn("ignore", ~F.col("valid3d")).withColumn("size", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    cells = settled(matching.scene_cells(ranked, metrics.THRESHOLDS_2D, areas, near=0.3, keep=("dataset_id",)), "matches")
    found = cells.where("rank > 0")
    npig = settled(metrics.cell_positives(metrics.both_scopes(cells), areas, by), "positives")
    precision = metrics.cell_precision(found, npig, areas, n, ties=("dataset_id", "image_id", "rank"), own="dataset_id")
    out = metrics.summarize(precision, metrics.cell_recall(metrics.both_scopes(found), npig, areas, n, by), "2D", ("scope",))
    return out.select("scope", *(F.round(c, 6).alias(c) for c in out.columns if c != "scope"))


def _aabb(rows: DataFrame, name: str) -> DataFrame:
    """rows with the sides and the volume of the box without rotation."""
    return rows.withColumn(name, geometry.extent(_centre(), _dims()))


def _centre():
    return geometry.vec(F.col("cxm"), F.col("cym"), F.col("czm"))


def _dims():
    return geometry.vec(F.col("w3"), F.col("h3"), F.col("l3"))


def pairs_3d(gt: DataFrame, det: DataFrame, whole: bool = False) -> DataFrame:
    """Pairs with the IoU of boxes without rotation; whole: with centres and dimensions too (gc, gs, dc, ds)."""
    more = lambda n: [_centre().alias(f"{n}c"), _dims().alias(f"{n}s")] if whole else []
    g = _aabb(gt, "g").select("ann_id", "image_id", "category_name", "ignore", F.col("depth").alias("gsize"), "g", *more("g"))
    d = _aabb(matching.rank_detections(det), "d").select("det_id", "image_id", "category_name", "rank", "score", "d", *more("d"))
    return matching.match_pairs(g, d, geometry.extent_iou3d)


def iou_pairs_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_3d(truths(spark, sf_dir), detections(spark, sf_dir)).where("iou > 0")
    return pairs.select("ann_id", "det_id", F.round(F.col("iou") + 1e-9, 6).alias("iou"))


def iou_pairs_3d_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs through the general clipping of corner lists."""
    pairs = pairs_3d(truths(spark, sf_dir), detections(spark, sf_dir), True).where("iou > 0")
    return pairs.select("ann_id", "det_id", F.round(posed_iou3d(*(F.col(c) for c in ("gc", "gs", "dc", "ds"))) + 1e-8, 5).alias("iou"))


def summary_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen 3D statistics over all sets."""
    gt, det = truths(spark, sf_dir), detections(spark, sf_dir)
    areas, n = metrics.AREAS_3D, len(metrics.THRESHOLDS_3D)
    g, d = (_aabb(x, name) for x, name in ((gt, "g"), (matching.rank_detections(det), "d")))
    found = settled(matching.match_cells(g, d, geometry.extent_iou3d, metrics.THRESHOLDS_3D, areas, "depth"), "matches")
    npig = metrics.positives(gt, areas, "depth")
    out = metrics.summarize(metrics.cell_precision(found, npig, areas, n), metrics.cell_recall(found, npig, areas, n), "3D")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def iou_pairs_3d_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, each image's scene turned about y and tilted about x: the boxes are clipped, their IoU stays."""
    pairs = pairs_3d(truths(spark, sf_dir), detections(spark, sf_dir), True).where("iou > 0")
    t, s = (F.col("image_id") % 7) * 0.2 + 0.1, (F.col("image_id") % 5) * 0.15 + 0.05
    c, n, a, b = F.cos(t), F.sin(t), F.cos(s), F.sin(s)
    turn = F.array(F.array(c, F.lit(0.0), n), F.array(n * b, a, -c * b), F.array(-n * a, b, c * a))
    return pairs.select("ann_id", "det_id", F.round(posed_iou3d(*(F.col(c) for c in ("gc", "gs", "dc", "ds")), turn) + 1e-8, 5).alias("iou"))


def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP at IoU .5 in percent of every category, and means over two vocabularies, one of them with a name that no truth has."""
    table = ap50_by_category(spark, sf_dir).withColumns({"area_range": F.lit("all"), "thr": F.lit(0), "max_dets": F.lit(100)})
    each = settled(metrics.category_ap(table), "categories")
    means = metrics.vocabulary_mean(each, {"two": ["ECONOMY", "SMALL"], "partly": ["ECONOMY", "nothing"]})
    return each.select(F.col("category_name").alias("name"), F.round(F.col("ap") + 1e-9, 4).alias("ap")).unionByName(means.select(F.col("vocabulary").alias("name"), F.round(F.col("ap") + 1e-9, 4).alias("ap")))


def nearest_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.nearest_truth(pairs_2d(truths(spark, sf_dir), detections(spark, sf_dir)))
    return best.select("det_id", "ann_id", F.round(F.col("iou") + 1e-9, 6).alias("iou"))


def localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = ("czm", "w3", "h3", "l3", "cxm")
    best = matching.scene_nearest(scene_columns(matching.ranked_scenes(scenes(spark, sf_dir)), *more), keep=(*matching.SIDES, *more))
    def part(s: str):
        u, v = boxes.centre(_box(*(f"{s}_{c}" for c in matching.SIDES)))
        z, w, h, l, r = (F.col(f"{s}_{c}") for c in more)
        return F.struct(u.alias("u"), v.alias("v"), z.alias("z"), w.alias("w"), h.alias("h"), l.alias("l"), geometry.rotate_y(r).alias("r")).alias(s)
    out = metrics.localisation_errors(best.select(part("g"), part("d")))
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns if c != "n"))


def proposal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = truths(spark, sf_dir), detections(spark, sf_dir)
    out = matching.label_best(matching.best_truths(gt, det))
    return out.select("det_id", "ann_id", F.round(F.col("iou") + 1e-9, 6).alias("iou"), "label")


def nms_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suppression.nms(view(spark, sf_dir, "fx_detections"), 0.5, 5, 0.05)
    return out.select("det_id", "image_id", "score", "place")


def nms_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = view(spark, sf_dir, "fx_detections").withColumn("quality", F.col("score")).withColumn("valid", F.col("score") > 0.1)
    return suppression.nms_quality(det).select("det_id", "image_id", "quality")


def assignment_2d_to_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = truths(spark, sf_dir), detections(spark, sf_dir)
    pairs = gt.join(det.select("det_id", "image_id", "category_name", "d"), ["image_id", "category_name"])
    score = boxes.alignment_score(boxes.alignment_metrics(F.col("g"), F.col("d")))
    out = matching.assign_2d_to_3d(pairs.select("image_id", "category_name", "det_id", F.col("ann_id").alias("cand_id"), score.alias("score")))
    return out.select("det_id", "cand_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


_IOU2D = """(greatest(least(g.x2, d.x2) - greatest(g.x1, d.x1), 0) * greatest(least(g.y2, d.y2) - greatest(g.y1, d.y1), 0))
    / ((g.x2 - g.x1) * (g.y2 - g.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - greatest(least(g.x2, d.x2) - greatest(g.x1, d.x1), 0) * greatest(least(g.y2, d.y2) - greatest(g.y1, d.y1), 0))"""
_PAIRS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_name ORDER BY score DESC, det_id) AS rank FROM fx_detections),
    pairs AS (SELECT g.ann_id, NOT g.valid3d AS ign, d.det_id, d.rank, g.image_id, g.category_name, {_IOU2D} AS iou
              FROM fx_annotations g JOIN ranked d ON g.image_id = d.image_id AND g.category_name = d.category_name WHERE d.rank <= 100)"""


def _greedy(ignores: bool) -> str:
    """Walks the detections of each group in order of rank, carrying the list of used truths."""
    counts = "NOT p.ign" if ignores else "true"
    return f"""{_PAIRS},
    likely AS (SELECT * FROM pairs WHERE iou >= 0.5),
    walk AS (
        SELECT r.image_id, r.category_name, r.rank, r.det_id, r.score,
               (SELECT arg_max(p.ann_id, ({counts}, p.iou, p.ann_id)) FROM likely p WHERE p.det_id = r.det_id) AS matched,
               [coalesce((SELECT arg_max(p.ann_id, ({counts}, p.iou, p.ann_id)) FROM likely p WHERE p.det_id = r.det_id), -1)] AS used
        FROM ranked r WHERE r.rank = 1
        UNION ALL
        SELECT r.image_id, r.category_name, r.rank, r.det_id, r.score, b.m, list_append(w.used, coalesce(b.m, -1))
        FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.category_name = w.category_name AND r.rank = w.rank + 1 AND r.rank <= 100
        LEFT JOIN LATERAL (SELECT arg_max(p.ann_id, ({counts}, p.iou, p.ann_id)) AS m FROM likely p WHERE p.det_id = r.det_id AND NOT list_contains(w.used, p.ann_id)) b ON true
    )"""


def _suppressed(where: str, clash: str) -> str:
    """Walks each image and category by score, carrying the list of what is kept."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_name ORDER BY score DESC, det_id) AS rk FROM fx_detections WHERE {where}),
    walk AS (
        SELECT image_id, category_name, rk, det_id, score, true AS kept, [det_id] AS ids FROM r WHERE rk = 1
        UNION ALL
        SELECT d.image_id, d.category_name, d.rk, d.det_id, d.score, NOT b.hit, CASE WHEN b.hit THEN w.ids ELSE list_append(w.ids, d.det_id) END
        FROM walk w JOIN r d ON d.image_id = w.image_id AND d.category_name = w.category_name AND d.rk = w.rk + 1
        LEFT JOIN LATERAL (SELECT count(*) > 0 AS hit FROM r g WHERE g.image_id = d.image_id AND g.category_name = d.category_name AND list_contains(w.ids, g.det_id) AND ({clash})) b ON true
    )"""


QUERIES = {
    "ap50_by_category": ap50_by_category,
    "matches_2d": matches_2d,
    "summary_2d": summary_2d,
    "iou_pairs_3d": iou_pairs_3d,
    "iou_pairs_3d_general": iou_pairs_3d_general,
    "iou_pairs_3d_rotated": iou_pairs_3d_rotated,
    "category_means": category_means,
    "summary_3d": summary_3d,
    "nearest_truths": nearest_truths,
    "localisation": localisation,
    "proposal_labels": proposal_labels,
    "nms_detections": nms_detections,
    "nms_by_quality": nms_by_quality,
    "assignment_2d_to_3d": assignment_2d_to_3d,
}

_IOU3D = """SELECT g.ann_id, d.det_id,
    greatest(least(g.cxm + g.l3 / 2, d.cxm + d.l3 / 2) - greatest(g.cxm - g.l3 / 2, d.cxm - d.l3 / 2), 0)
    * greatest(least(g.cym + g.h3 / 2, d.cym + d.h3 / 2) - greatest(g.cym - g.h3 / 2, d.cym - d.h3 / 2), 0)
    * greatest(least(g.czm + g.w3 / 2, d.czm + d.w3 / 2) - greatest(g.czm - g.w3 / 2, d.czm - d.w3 / 2), 0) AS vol, g.w3 * g.h3 * g.l3 + d.w3 * d.h3 * d.l3 AS both_vol
    FROM fx_annotations g JOIN fx_detections d ON g.image_id = d.image_id AND g.category_name = d.category_name"""

ORACLE = {
    "ap50_by_category": with_views(f"""WITH RECURSIVE {_greedy(False)},
        npig AS (SELECT category_name, count(*) AS npig FROM fx_annotations GROUP BY 1),
        run AS (SELECT *, sum(CASE WHEN matched IS NULL THEN 0 ELSE 1 END) OVER o AS tp, row_number() OVER o AS pos FROM walk WINDOW o AS (PARTITION BY category_name ORDER BY score DESC, image_id, rank, det_id ROWS UNBOUNDED PRECEDING)),
        curve AS (SELECT category_name, pos, tp, npig, tp::DOUBLE / npig AS rc, max(tp::DOUBLE / pos) OVER (PARTITION BY category_name ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM run JOIN npig USING (category_name)),
        lv AS (SELECT category_name, i, coalesce(max(env) FILTER (100 * tp >= i * npig), 0) AS p FROM curve CROSS JOIN range(0, 101) t(i) GROUP BY 1, 2)
        SELECT category_name, round(avg(p), 6) AS ap, (SELECT round(max(rc), 6) FROM curve c WHERE c.category_name = lv.category_name) AS ar, (SELECT npig FROM npig n WHERE n.category_name = lv.category_name) AS npig FROM lv GROUP BY category_name"""),
    "matches_2d": with_views(f"""WITH RECURSIVE {_greedy(True)}
        SELECT det_id, rank, matched, coalesce((SELECT NOT valid3d FROM fx_annotations a WHERE a.ann_id = matched), false) AS ignored FROM walk"""),
    "iou_pairs_3d": with_views(f"WITH p AS ({_IOU3D}) SELECT ann_id, det_id, round(vol / (both_vol - vol) + 1e-9, 6) AS iou FROM p WHERE vol / (both_vol - vol) > 0"),
    "iou_pairs_3d_general": with_views(f"WITH p AS ({_IOU3D}) SELECT ann_id, det_id, round(vol / (both_vol - vol) + 1e-8, 5) AS iou FROM p WHERE vol / (both_vol - vol) > 0"),
    "iou_pairs_3d_rotated": with_views(f"WITH p AS ({_IOU3D}) SELECT ann_id, det_id, round(vol / (both_vol - vol) + 1e-8, 5) AS iou FROM p WHERE vol / (both_vol - vol) > 0"),
    "nearest_truths": with_views(f"WITH {_PAIRS} SELECT det_id, arg_max(ann_id, (iou, -ann_id)) AS ann_id, round(max(iou) + 1e-9, 6) AS iou FROM pairs WHERE iou >= 0.5 GROUP BY 1"),
    "localisation": with_views(f"""WITH {_PAIRS}, best AS (SELECT det_id, arg_max(ann_id, (iou, -ann_id)) AS ann_id FROM pairs WHERE iou >= 0.5 GROUP BY 1)
        SELECT count(*) AS n, round(avg(sqrt(power((g.x1 + g.x2) / 2 - (d.x1 + d.x2) / 2, 2) + power((g.y1 + g.y2) / 2 - (d.y1 + d.y2) / 2, 2))), 6) AS pixel_error, round(avg(abs(g.czm - d.czm)), 6) AS z_error,
               round(avg(abs(g.w3 - d.w3)), 6) AS w_error, round(avg(abs(g.h3 - d.h3)), 6) AS h_error, round(avg(abs(g.l3 - d.l3)), 6) AS l_error, round(avg(acos(cos(g.cxm - d.cxm))), 6) AS angle_error
        FROM best JOIN fx_annotations g USING (ann_id) JOIN fx_detections d USING (det_id)"""),
    # Views first, and only the image in the join's condition, so that no planner turns it into a join of ranges.
    "proposal_labels": with_views(f"""WITH g AS MATERIALIZED (SELECT ann_id, image_id, valid3d, x1, y1, x2, y2 FROM fx_annotations), d AS MATERIALIZED (SELECT det_id, image_id, x1, y1, x2, y2 FROM fx_detections),
        m AS MATERIALIZED (SELECT g.ann_id, g.valid3d, d.det_id, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2, d.x1 AS dx1, d.y1 AS dy1, d.x2 AS dx2, d.y2 AS dy2 FROM g JOIN d ON g.image_id = d.image_id),
        o AS (SELECT *, greatest(least(gx2, dx2) - greatest(gx1, dx1), 0) * greatest(least(gy2, dy2) - greatest(gy1, dy1), 0) AS shared FROM m),
        c AS MATERIALIZED (SELECT ann_id, valid3d, det_id, shared / ((gx2 - gx1) * (gy2 - gy1) + (dx2 - dx1) * (dy2 - dy1) - shared) AS iou, shared / ((dx2 - dx1) * (dy2 - dy1)) AS ioa FROM o WHERE shared > 0),
        b AS (SELECT det_id, max(iou) FILTER (valid3d) AS iou, max(ioa) FILTER (NOT valid3d) AS ioa FROM c GROUP BY 1),
        f AS (SELECT c.det_id, min(c.ann_id) AS ann_id FROM c JOIN b ON c.det_id = b.det_id AND c.iou = b.iou WHERE c.valid3d AND c.iou >= 0.5 GROUP BY 1)
        SELECT d.det_id, f.ann_id, round(coalesce(iou, 0) + 1e-9, 6) AS iou, CASE WHEN coalesce(iou, 0) >= 0.5 THEN 1 WHEN coalesce(ioa, 0) > 0.5 THEN -1 ELSE 0 END AS label
        FROM d LEFT JOIN b USING (det_id) LEFT JOIN f USING (det_id)"""),
    "nms_detections": with_views(f"""WITH RECURSIVE {_suppressed("score > 0.05", f"{_IOU2D} > 0.5")}, p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS place FROM walk WHERE kept)
        SELECT det_id, image_id, score, place FROM p WHERE place <= 5"""),
    "nms_by_quality": with_views(f"""WITH RECURSIVE {_suppressed("score > 0.1", f"{_IOU2D} >= 0.75 OR ({_IOU2D} >= 0.3 AND sqrt(power(g.cxm - d.cxm, 2) + power(g.cym - d.cym, 2) + power(g.czm - d.czm, 2)) <= 0.35 * (sqrt(g.w3 * g.w3 + g.h3 * g.h3 + g.l3 * g.l3) + sqrt(d.w3 * d.w3 + d.h3 * d.h3 + d.l3 * d.l3)) / 2)")}
        SELECT det_id, image_id, score AS quality FROM walk WHERE kept"""),
}
ORACLE["category_means"] = f"""WITH t AS ({ORACLE["ap50_by_category"]}), e AS (SELECT category_name AS name, ap * 100 AS ap FROM t)
    SELECT name, round(ap + 1e-9, 4) AS ap FROM e UNION ALL SELECT 'two', (SELECT round(avg(ap) + 1e-9, 4) FROM e WHERE name IN ('ECONOMY', 'SMALL')) UNION ALL SELECT 'partly', NULL"""
ORACLE["assignment_2d_to_3d"] = with_views(f"""WITH RECURSIVE c AS (SELECT g.image_id, g.category_name, g.ann_id AS cand_id, d.det_id, {_IOU2D} AS iou,
        sqrt(power((g.x1 + g.x2) / 2 - (d.x1 + d.x2) / 2, 2) + power((g.y1 + g.y2) / 2 - (d.y1 + d.y2) / 2, 2)) / sqrt(power(d.x2 - d.x1, 2) + power(d.y2 - d.y1, 2)) AS apart,
        (g.x2 - g.x1) * (g.y2 - g.y1) / ((d.x2 - d.x1) * (d.y2 - d.y1)) AS ratio FROM fx_annotations g JOIN fx_detections d ON g.image_id = d.image_id AND g.category_name = d.category_name),
    p AS MATERIALIZED (SELECT image_id, category_name, det_id, cand_id, score, row_number() OVER (PARTITION BY image_id, category_name ORDER BY score DESC, det_id, cand_id) AS rk
        FROM (SELECT *, iou - 0.05 * apart - 0.01 * abs(ln(greatest(ratio, 1e-6))) AS score FROM c)),
    walk AS (SELECT image_id, category_name, rk, det_id, cand_id, score, true AS taken, [det_id] AS dets, [cand_id] AS cands FROM p WHERE rk = 1
        UNION ALL SELECT p.image_id, p.category_name, p.rk, p.det_id, p.cand_id, p.score, NOT (list_contains(w.dets, p.det_id) OR list_contains(w.cands, p.cand_id)),
            CASE WHEN list_contains(w.dets, p.det_id) OR list_contains(w.cands, p.cand_id) THEN w.dets ELSE list_append(w.dets, p.det_id) END,
            CASE WHEN list_contains(w.dets, p.det_id) OR list_contains(w.cands, p.cand_id) THEN w.cands ELSE list_append(w.cands, p.cand_id) END
        FROM walk w JOIN p ON p.image_id = w.image_id AND p.category_name = w.category_name AND p.rk = w.rk + 1)
    SELECT det_id, cand_id, round(score + 1e-9, 6) AS score FROM walk WHERE taken""")


def _summary(pairs: str, first: float, size: str, areas: list[tuple[str, float, float]], named: tuple[tuple[str, int], ...], scopes: bool) -> str:
    """The thirteen statistics. pairs: truths with detections of their image and category (ann_id, ign, gsize, det_id, iou).

    Only detections that some truth overlaps are walked, each with its truths in order of preference for every area and threshold.
    """
    ranges = ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in areas)
    far = "coalesce((SELECT max(p.iou) FROM pairs p WHERE p.det_id = r.det_id), 0) <= 0.3" if scopes else "false"
    parts = [n for n, *_ in areas[1:]]
    stats = [("ap", "avg(ap) FILTER (name = 'all')"), *((n, f"avg(ap) FILTER (name = 'all' AND thr = {i})") for n, i in named), *((f"ap_{n}", f"avg(ap) FILTER (name = '{n}')") for n in parts)]
    stats += [*((f"ar_{m}", f"avg(ar_{m}) FILTER (name = 'all')") for m in metrics.PREFIXES), *((f"ar_{n}", f"avg(ar_100) FILTER (name = '{n}')") for n in parts)]
    both = "SELECT i.dataset_id::VARCHAR AS scope, i.dataset_id AS ds, x.* FROM {0} x JOIN fx_images i USING (image_id) UNION ALL SELECT '<Concat>', i.dataset_id, x.* FROM {0} x JOIN fx_images i USING (image_id)" if scopes else "SELECT '' AS scope, 0 AS ds, x.* FROM {0} x"
    return with_views(f"""WITH RECURSIVE ranked AS (SELECT *, {size.format("d")} AS dsize, row_number() OVER (PARTITION BY image_id, category_name ORDER BY score DESC, det_id) AS rank FROM fx_detections d),
    pairs AS MATERIALIZED ({pairs}),
    area AS (SELECT * FROM (VALUES {ranges}) v(name, lo, hi)), th AS (SELECT i::INT AS thr, {first} + 0.05::DOUBLE * i AS t FROM range(10) v(i)),
    likely AS MATERIALIZED (SELECT * FROM pairs WHERE iou >= {first}),
    cand AS MATERIALIZED (SELECT image_id, category_name, det_id, row_number() OVER (PARTITION BY image_id, category_name ORDER BY rank) AS rk FROM ranked WHERE rank <= 100 AND det_id IN (SELECT det_id FROM likely)),
    opts AS MATERIALIZED (SELECT l.det_id, name, thr, list(l.ann_id ORDER BY (NOT l.ign AND l.gsize >= lo AND l.gsize <= hi) DESC, l.iou DESC, l.ann_id DESC) AS anns FROM likely l CROSS JOIN area JOIN th ON l.iou >= t GROUP BY 1, 2, 3),
    step AS MATERIALIZED (SELECT c.*, name, thr, coalesce(o.anns, []) AS anns FROM cand c CROSS JOIN area CROSS JOIN th LEFT JOIN opts o USING (det_id, name, thr)),
    walk AS (SELECT image_id, category_name, name, thr, rk, det_id, anns[1] AS matched, anns[1:1] AS used FROM step WHERE rk = 1
        UNION ALL SELECT s.image_id, s.category_name, s.name, s.thr, s.rk, s.det_id, list_filter(s.anns, lambda a: NOT list_contains(w.used, a))[1], list_concat(w.used, list_filter(s.anns, lambda a: NOT list_contains(w.used, a))[1:1])
        FROM walk w JOIN step s ON s.image_id = w.image_id AND s.category_name = w.category_name AND s.name = w.name AND s.thr = w.thr AND s.rk = w.rk + 1),
    truth AS (SELECT image_id, category_name, ann_id, NOT valid3d AS ign, {size.format("g")} AS gsize FROM fx_annotations g),
    placed AS MATERIALIZED (SELECT r.image_id, r.category_name, r.det_id, r.rank, r.score, r.dsize, {far} AS far FROM ranked r WHERE r.rank <= 100),
    match AS MATERIALIZED (SELECT r.image_id, r.category_name, r.det_id, r.rank, r.score, a.name, th.thr, w.matched,
            CASE WHEN w.matched IS NULL THEN r.far OR r.dsize < a.lo OR r.dsize > a.hi ELSE r.far OR t.ign OR t.gsize < a.lo OR t.gsize > a.hi END AS ignored
        FROM placed r CROSS JOIN area a CROSS JOIN th LEFT JOIN walk w ON w.det_id = r.det_id AND w.name = a.name AND w.thr = th.thr LEFT JOIN truth t ON t.ann_id = w.matched),
    scoped AS ({both.format("match")}), counted AS ({both.format("truth")}),
    npig AS (SELECT scope, category_name, name, count(*) AS npig FROM counted JOIN area ON NOT ign AND gsize >= lo AND gsize <= hi GROUP BY 1, 2, 3),
    run AS (SELECT *, (matched IS NOT NULL AND NOT ignored)::INT AS hit, sum((matched IS NOT NULL AND NOT ignored)::INT) OVER o AS tp, sum((matched IS NULL AND NOT ignored)::INT) OVER o AS fp, row_number() OVER o AS pos
        FROM scoped WINDOW o AS (PARTITION BY scope, category_name, name, thr ORDER BY score DESC, ds, image_id, rank, det_id ROWS UNBOUNDED PRECEDING)),
    curve AS (SELECT scope, category_name, name, thr, pos, tp, tp - hit AS before, npig, max(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END) OVER (PARTITION BY scope, category_name, name, thr ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS env FROM run JOIN npig USING (scope, category_name, name)),
    prec AS (SELECT scope, category_name, name, thr, sum(env * (100 * tp // npig - CASE WHEN pos = 1 THEN -1 ELSE 100 * before // npig END)) / 101 AS ap FROM curve GROUP BY 1, 2, 3, 4),
    rec AS (SELECT scope, category_name, name, thr, {", ".join(f"sum(hit) FILTER (rank <= {m}) AS tp_{m}" for m in metrics.PREFIXES)} FROM run GROUP BY 1, 2, 3, 4),
    each AS (SELECT n.scope, n.name, th.thr, coalesce(p.ap, 0) AS ap, {", ".join(f"coalesce(r.tp_{m}, 0) / npig::DOUBLE AS ar_{m}" for m in metrics.PREFIXES)}
        FROM npig n CROSS JOIN th LEFT JOIN prec p ON p.scope = n.scope AND p.category_name = n.category_name AND p.name = n.name AND p.thr = th.thr LEFT JOIN rec r ON r.scope = n.scope AND r.category_name = n.category_name AND r.name = n.name AND r.thr = th.thr)
    SELECT {"scope, " if scopes else ""}{", ".join(f"round({v}, 6) AS {n}" for n, v in stats)} FROM each GROUP BY scope""")


ORACLE["summary_2d"] = _summary(f"SELECT g.ann_id, NOT g.valid3d AS ign, (g.x2 - g.x1) * (g.y2 - g.y1) AS gsize, d.det_id, {_IOU2D} AS iou FROM fx_annotations g JOIN ranked d ON g.image_id = d.image_id AND g.category_name = d.category_name", 0.5, "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)", metrics.AREAS_2D, (("ap50", 0), ("ap75", 5), ("ap95", 9)), True)
# IoUs near a threshold depend on their last bit: the volumes are multiplied in the order of the Spark columns.
ORACLE["summary_3d"] = _summary(f"SELECT v.ann_id, NOT g.valid3d AS ign, g.czm AS gsize, v.det_id, vol / (g.l3 * g.h3 * g.w3 + d.l3 * d.h3 * d.w3 - vol) AS iou FROM ({_IOU3D}) v JOIN fx_annotations g USING (ann_id) JOIN fx_detections d USING (det_id)", 0.05, "{0}.czm", metrics.AREAS_3D, (("ap15", 2), ("ap25", 4), ("ap50", 9)), False)
