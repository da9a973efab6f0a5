"""Suppression of duplicate boxes and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_IOU = """(CASE WHEN greatest(least(x.x2, k.x2) - greatest(x.x1, k.x1), 0D) * greatest(least(x.y2, k.y2) - greatest(x.y1, k.y1), 0D) = 0 THEN 0D ELSE
    greatest(least(x.x2, k.x2) - greatest(x.x1, k.x1), 0D) * greatest(least(x.y2, k.y2) - greatest(x.y1, k.y1), 0D)
    / ((x.x2 - x.x1) * (x.y2 - x.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - greatest(least(x.x2, k.x2) - greatest(x.x1, k.x1), 0D) * greatest(least(x.y2, k.y2) - greatest(x.y1, k.y1), 0D)) END)"""


def _fold(lists: DataFrame, clash: str) -> DataFrame:
    """Keep, in list order, what clashes with nothing kept."""
    kept = F.expr(f"aggregate(dets, slice(dets, 1, 0), (s, x) -> CASE WHEN exists(s, k -> {clash}) THEN s ELSE concat(s, array(x)) END)")
    return lists.select("image_id", "category_name", F.explode(kept).alias("k"))


def nms(det: DataFrame, threshold: float = 0.5, top_k: int = 100, least_score: float = 0.0) -> DataFrame:
    """Class-wise non-maximum suppression, then the top_k of an image: det_id, image_id, category_name, score, place."""
    # The test is part of the aggregate: as a filter it is pushed into how the boxes are made, whose code then is too long to be compiled.
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in ("x1", "y1", "x2", "y2", "score"))
    boxes = F.expr(f"array_sort(collect_list(struct(-score AS o, det_id, x1, y1, x2, y2)) FILTER (WHERE {finite} AND score > {least_score}D))")
    lists = det.groupBy("image_id", "category_name").agg(boxes.alias("dets"))
    kept = _fold(lists, f"{_IOU} > {threshold}").select(F.col("k.det_id").alias("det_id"), "image_id", "category_name", (-F.col("k.o")).alias("score"))
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_k)


def nms_quality(boxes: DataFrame, iou_at: float = 0.75, near_iou: float = 0.30, near_share: float = 0.35) -> DataFrame:
    """By quality, of valid boxes: one is dropped if a kept one of its class overlaps by iou_at, or by near_iou with centres within near_share of the mean diagonal.

    boxes: det_id, image_id, category_name, quality, valid, x1..y2, cxm, cym, czm, w3, h3, l3.
    """
    lists = boxes.where("valid").groupBy("image_id", "category_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("o"), "det_id", "x1", "y1", "x2", "y2", "cxm", "cym", "czm", "w3", "h3", "l3"))).alias("dets"))
    apart = "sqrt(pow(x.cxm - k.cxm, 2) + pow(x.cym - k.cym, 2) + pow(x.czm - k.czm, 2))"
    mean = "(sqrt(x.w3 * x.w3 + x.h3 * x.h3 + x.l3 * x.l3) + sqrt(k.w3 * k.w3 + k.h3 * k.h3 + k.l3 * k.l3)) / 2"
    clash = f"({_IOU} >= {iou_at} OR ({_IOU} >= {near_iou} AND {apart} <= {near_share} * {mean}))"
    return _fold(lists, clash).select(F.col("k.det_id").alias("det_id"), "image_id", "category_name", (-F.col("k.o")).alias("quality"))


def dedup_masks(instances: DataFrame, overlaps: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per image, in order of instance: a mask meets the first kept one that it overlaps by more than threshold, and
    the more confident of the two stays, at the end of the list. instances: image_id, inst_id, conf; overlaps: image_id, a, b, iou (either order).
    """
    high = overlaps.where(F.col("iou") > threshold)
    both = high.select("image_id", F.col("a").alias("inst_id"), F.col("b").alias("other")).unionByName(high.select("image_id", F.col("b").alias("inst_id"), F.col("a").alias("other")))
    with_others = instances.join(both.groupBy("image_id", "inst_id").agg(F.collect_set("other").alias("others")), ["image_id", "inst_id"], "left")
    lists = with_others.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("inst_id", "conf", F.coalesce("others", F.array().cast("array<bigint>")).alias("others")))).alias("m"))
    fold = F.expr("""
        aggregate(m, slice(m, 1, 0), (s, x) ->
            CASE WHEN NOT exists(s, k -> array_contains(x.others, k.inst_id)) THEN concat(s, array(x))
                 WHEN x.conf > filter(s, k -> array_contains(x.others, k.inst_id))[0].conf
                 THEN concat(filter(s, k -> k.inst_id <> filter(s, j -> array_contains(x.others, j.inst_id))[0].inst_id), array(x))
                 ELSE s END)
    """)
    return lists.select("image_id", F.posexplode(fold).alias("place", "k")).select("image_id", F.col("k.inst_id").alias("inst_id"), F.col("k.conf").alias("conf"), "place")
