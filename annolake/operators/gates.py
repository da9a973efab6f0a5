"""Gates and repairs of 3D boxes against priors, ground planes, projections and depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions import boxes, geometry as g

# Classes that stand on the ground, lie flat on something, or are large furniture.
GROUND_SUPPORTED = ("bathtub", "bed", "bin", "bookcase", "box", "cabinet", "chair", "counter", "desk", "floor mat", "machine", "night stand", "oven", "refrigerator", "shelves", "sofa", "stove", "table", "toilet")
THIN_OR_WALL = ("blinds", "curtain", "door", "floor mat", "mirror", "picture", "television", "towel", "window")
LARGE_FURNITURE = ("bathtub", "bed", "bookcase", "cabinet", "chair", "counter", "desk", "refrigerator", "shelves", "sofa", "stove", "table", "toilet")


@dataclass(frozen=True)
class GateSettings:
    least_prior_ratio: float = 0.35
    most_prior_ratio: float = 3.0
    adjust_below: float = 0.5
    ground_distance: float = 0.55
    least_proj_iou: float = 0.03
    most_rel_depth_error: float = 0.5
    depth_shift: float = 0.25
    quality: tuple[float, float, float] = (0.40, 0.55, 0.42)


def gate_prior(dims: Column, prior: Column, s: GateSettings = GateSettings()) -> Column:
    """struct<violation, ok, swapped>: the better of the prior and the prior with w and l swapped, by its worst violation."""
    def candidate(order: tuple[int, int, int], swapped: bool) -> Column:
        ratios = [F.get(dims, i) / F.greatest(F.get(prior, j), F.lit(1e-6)) for i, j in enumerate(order)]
        worst = F.greatest(*(F.greatest(s.least_prior_ratio / F.greatest(r, F.lit(1e-6)), r / s.most_prior_ratio) for r in ratios))
        ok = ratios[0].between(s.least_prior_ratio, s.most_prior_ratio) & ratios[1].between(s.least_prior_ratio, s.most_prior_ratio) & ratios[2].between(s.least_prior_ratio, s.most_prior_ratio)
        return F.struct(worst.alias("violation"), F.lit(swapped).alias("swapped"), ok.alias("ok"))

    positive = ~F.exists(dims, lambda x: x <= 0) & ~F.exists(prior, lambda x: x <= 0)
    best = F.array_min(F.array(candidate((0, 1, 2), False), candidate((2, 1, 0), True)))
    return F.when(prior.isNull(), F.struct(F.lit(None).cast("double").alias("violation"), F.lit(False).alias("swapped"), F.lit(True).alias("ok"))).when(~positive, F.struct(F.lit(None).cast("double").alias("violation"), F.lit(False).alias("swapped"), F.lit(False).alias("ok"))).otherwise(best)


def _lowest(corners: Column, plane: Column, signed: bool) -> Column:
    """The least distance of a corner. The normal's length is taken out of the corners' lambda, which is interpreted."""
    a, b, c, d = (F.get(plane, i) for i in range(4))
    n = F.sqrt(a * a + b * b + c * c)
    place = lambda p: a * p[0] + b * p[1] + c * p[2] + d
    least = F.array_min(F.transform(corners, place if signed else lambda p: F.abs(place(p))))
    return F.when(n <= 1e-8, float("inf")).otherwise(least / n)


def gate_ground(label: Column, corners: Column, plane: Column, required: bool = False, s: GateSettings = GateSettings()) -> Column:
    """Classes that need no ground pass; without a plane it depends on required; else some corner must be near the plane."""
    near = _lowest(corners, plane, False) <= s.ground_distance
    return F.when(~F.lower(label).isin(*GROUND_SUPPORTED), True).when(plane.isNull(), not required).otherwise(F.coalesce(near, F.lit(False)))


def repair_box(df: DataFrame, prior: Column, plane: Column, rotation: Column | None = None, s: GateSettings = GateSettings()) -> DataFrame:
    """df (label, center, dims) with repaired center, dims and corners, and adjusted, snapped.

    Dims far below the prior become the prior's; a supported box near the plane moves onto it. Steps are columns, so that
    each is computed once.
    """
    grown = [F.when((F.get("dims", i) > 0) & (F.get(prior, i) > 0) & (F.get("dims", i) < F.get(prior, i) * s.adjust_below), F.get(prior, i)).otherwise(F.get("dims", i)) for i in range(3)]
    out = df.withColumn("_dims", F.when(prior.isNull(), F.col("dims")).otherwise(g.vec(*grown))).withColumn("_plane", plane)
    out = out.withColumn("_corners", g.box_corners(F.col("center"), F.col("_dims"), rotation))
    out = out.withColumn("_low", _lowest(F.col("_corners"), F.col("_plane"), True)).withColumn("_n", F.sqrt(F.get("_plane", 0) ** 2 + F.get("_plane", 1) ** 2 + F.get("_plane", 2) ** 2))
    snap = F.lower("label").isin(*GROUND_SUPPORTED) & (F.col("_n") > 1e-8) & (F.abs("_low") <= s.ground_distance)
    out = out.withColumn("snapped", F.coalesce(snap, F.lit(False)))
    out = out.withColumn("_shift", F.when(F.col("snapped"), g.vec(*(F.try_divide(-F.col("_low") * F.get("_plane", i), F.col("_n")) for i in range(3)))).otherwise(g.vec(0, 0, 0)))
    out = out.withColumn("adjusted", F.coalesce(F.col("_dims") != F.col("dims"), F.lit(False))).withColumn("center", g.plus(F.col("center"), F.col("_shift"))).withColumn("dims", F.col("_dims"))
    out = out.withColumn("corners", F.transform("_corners", lambda p: g.plus(p, F.col("_shift"))))
    return out.drop("_dims", "_plane", "_corners", "_low", "_n", "_shift")


def refine_depth(center_z: Column, lowest_z: Column, median: Column, s: GateSettings = GateSettings()) -> Column:
    """The shift along z that puts the box's front at the median depth, at most a share of its depth; 0 below a millimetre."""
    raw = median + F.greatest(center_z - lowest_z, F.lit(0.0)) - center_z
    most = s.depth_shift * F.greatest(center_z, F.lit(1e-3))
    shift = F.greatest(F.least(raw, most), -most)
    return F.when(median.isNull() | (center_z <= 1e-4) | (F.abs(shift) < 1e-3), 0.0).otherwise(shift)


def gate_geometry(df: DataFrame, prior: Column) -> DataFrame:
    """df (center, dims, corners, target, fx, fy, cx, cy, width, height) with `reason`, the first one against a box, or null."""
    camera = [F.col(c) for c in ("fx", "fy", "cx", "cy")]
    out = df.withColumn("_xy", F.flatten(g.project_points(F.col("corners"), *camera))).withColumn("_p", g.project_box(F.col("corners"), *camera, F.col("width"), F.col("height"))["clipped"])
    out = out.withColumn("_m", boxes.alignment_metrics(F.col("_p"), F.col("target"))).withColumn("_z", F.array_min(F.transform("corners", lambda p: p[2])))
    whd = [F.get("dims", i) for i in (2, 1, 0)]
    priors = [F.get(F.coalesce(prior, boxes.box(0.5, 0.5, 0.5)), i) for i in range(3)]
    ratios = [d / F.greatest(p, F.lit(1e-6)) for d, p in zip(whd, priors, strict=True)]
    volume = whd[0] * whd[1] * whd[2] / F.greatest(priors[0] * priors[1] * priors[2], F.lit(1e-6))
    m = F.col("_m")
    rules = [
        ("bad_bbox3d_shape", F.coalesce(F.size("corners") != 8, F.lit(True))),
        ("nonfinite_3d", ~(boxes.all_finite(F.flatten("corners")) & boxes.all_finite(F.col("dims")) & boxes.all_finite(F.col("center")))),
        ("bad_center_or_dim", (F.get("center", 2) <= 0) | F.exists("dims", lambda x: x <= 0)),
        ("corner_too_close", F.col("_z") <= 0.5),
        ("dim_abs_too_large", F.array_max("dims") > 8),
        ("project_depth_zero", F.exists("corners", lambda p: F.abs(p[2]) < 1e-6)),
        ("project_nonfinite", ~boxes.all_finite(F.col("_xy"))),
        ("project_too_large", F.array_max(F.transform("_xy", F.abs)) > 5000),
        ("project_clipped_bad", F.col("_p").isNull()),
        ("project_iou", m["iou"] < 0.03),
        ("project_center", m["centre_offset"] > 1.0),
        ("project_area_small", m["area_ratio"] < 0.05),
        ("project_area_large", m["area_ratio"] > 20),
        ("axis_prior_ratio", F.greatest(*ratios) > 6),
        ("volume_prior_ratio", volume > 30),
    ]
    return out.withColumn("reason", F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules))).drop("_xy", "_p", "_m", "_z")


def gate_projection(metrics: Column, support: Column | None = None) -> Column:
    """IoU at least .15, centre within .5, area ratio from .2 to 5, and a quarter of the points inside where counted."""
    parts = [metrics["iou"], metrics["centre_offset"], metrics["area_ratio"], *([support] if support is not None else [])]
    finite = boxes.all_finite(F.array(*parts))
    ok = finite & (metrics["iou"] >= 0.15) & (metrics["centre_offset"] <= 0.5) & metrics["area_ratio"].between(0.2, 5.0)
    return F.coalesce(ok & (support >= 0.25) if support is not None else ok, F.lit(False))


def gate_alignment(silhouette: Column, bbox: Column, rel_depth_error: Column, pixels: Column, least_sil: float = 0.08, least_box: float = 0.15, least_pixels: int = 24, most_error: float = 0.35) -> Column:
    """Silhouette or box overlap must do, and the depth must agree where enough of it is there; else the silhouette must be better."""
    overlaps = (silhouette >= least_sil) | (bbox >= least_box)
    deep = pixels >= least_pixels
    agrees = rel_depth_error.isNotNull() & ~F.isnan(rel_depth_error) & (rel_depth_error <= most_error)
    return F.coalesce(overlaps & F.when(deep, agrees).otherwise(silhouette >= max(least_sil * 1.5, 0.16)), F.lit(False))


def gate_alignment_strict(silhouette: Column, rel_depth_error: Column, pixels: Column, proj_iou: Column, support: Column, least_proj: float = 0.25, least_sil: float = 0.18, least_support: float = 0.25, least_pixels: int = 24, most_error: float = 0.2) -> Column:
    ok = (proj_iou >= least_proj) & (silhouette >= least_sil) & (support >= least_support) & (pixels >= least_pixels) & ~F.isnan(rel_depth_error) & (rel_depth_error <= most_error)
    return F.coalesce(ok, F.lit(False))


def quality_score(score: Column, proj_iou: Column, support: Column, rel_error: Column, violation: Column, ground_failed: Column, s: GateSettings = GateSettings()) -> Column:
    """Weighted terms for the score, projection, depth support and depth error, less penalties for prior and ground, within [0, 1]."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    proj = unit(proj_iou / max(s.least_proj_iou * 4, 0.20))
    backed = F.when(support.isNull() | (support < 0), 0.5).otherwise(unit(support))
    deep = F.when(rel_error.isNull() | F.isnan(rel_error) | (rel_error < 0) | (rel_error == float("inf")), 0.5).otherwise(1 - unit(rel_error / max(s.most_rel_depth_error, 1e-3)))
    prior = F.least(F.greatest(F.coalesce(violation, F.lit(1.0)) - 1, F.lit(0.0)), F.lit(2.0))
    ground = F.when(ground_failed, 0.5).otherwise(0.0)
    return unit(0.35 * unit(score) + 0.25 * proj + 0.25 * backed + 0.15 * deep - 0.10 * prior - 0.15 * ground)


def quality_threshold(label: Column, s: GateSettings = GateSettings()) -> Column:
    usual, thin, large = s.quality
    return F.when(F.lower(label).isin(*THIN_OR_WALL), thin).when(F.lower(label).isin(*LARGE_FURNITURE), large).otherwise(usual)


def category_bounds(prior: Column) -> Column:
    """struct<least, most> of a category's dimensions."""
    return F.struct(F.transform(prior, lambda p: F.greatest(0.15 * p, F.lit(0.02))).alias("least"), F.transform(prior, lambda p: F.greatest(4.0 * p, F.lit(0.25))).alias("most"))


def _useful(ratio: Column, lo: float, hi: float) -> Column:
    return F.when(ratio.between(lo, hi) & (F.abs(F.log(ratio)) >= 0.03), ratio)


def depth_rescale(kind: str, a: Column, b: Column, center_z: Column | None = None) -> Column:
    """A factor for the scale, or null. "median": real over rendered median depth; "refined": the same from the box's
    centre on; "silhouette": root of the real over the rendered area."""
    if kind == "median":
        return _useful(a / b, 0.4, 2.5)
    if kind == "refined":
        return F.when(F.abs(b - center_z) >= 0.03, _useful((a - center_z) / (b - center_z), 0.5, 2.0))
    return F.when(b > 0, _useful(F.sqrt(a / b), 0.6, 2.0))
