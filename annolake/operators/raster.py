"""Raster layers as rows: depth lines (image_id, v, depth array) and mask runs (image_id, inst_id, v, u0, u1), ends inclusive."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.operators.matching import by_groups, changes
from annolake.operators.overlap import overlap_join


def merge_runs(runs: DataFrame, by: tuple[str, ...] = ("image_id", "inst_id")) -> DataFrame:
    """Disjoint runs per row; runs that touch become one."""
    keys = [*by, "v"]
    w = Window.partitionBy(*keys).orderBy("u0", "u1")
    before = F.max("u1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select(*keys, "u0", "u1").withColumn("new", F.when(before.isNull() | (F.col("u0") > before + 1), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("u0").alias("u0"), F.max("u1").alias("u1")).drop("island")


def mask_stats(runs: DataFrame, by: tuple[str, ...] = ("image_id", "inst_id")) -> DataFrame:
    """(by, pixels, x1, y1, x2, y2, cu, cv) of merged runs."""
    n = F.col("u1") - F.col("u0") + 1
    s = runs.groupBy(*by).agg(F.sum(n).alias("pixels"), F.min("u0").alias("x1"), F.min("v").alias("y1"), F.max("u1").alias("x2"), F.max("v").alias("y2"), F.sum(n * (F.col("u0") + F.col("u1")) / 2).alias("su"), F.sum(n * F.col("v")).alias("sv"))
    return s.select(*by, "pixels", "x1", "y1", "x2", "y2", (F.col("su") / F.col("pixels")).alias("cu"), (F.col("sv") / F.col("pixels")).alias("cv"))


def mask_size_ok(stats: DataFrame, image_pixels: int, least: int = 10, least_width: int = 3, alternative: tuple[int, float] = (100, 0.001)) -> DataFrame:
    """stats of masks that are large enough: pixels and width, and pixels or share of the image."""
    pixels, share = alternative
    width = F.col("x2") - F.col("x1") + 1
    return stats.where((F.col("pixels") >= least) & (width >= least_width) & ((F.col("pixels") >= pixels) | (F.col("pixels") / image_pixels >= share)))


def mask_overlaps(runs: DataFrame) -> DataFrame:
    """(image_id, a, b, both, iou), a < b: pixels that two masks of an image share. Runs must be merged; runs of a line meet where they lie near."""
    other = runs.select("image_id", "v", F.col("inst_id").alias("b"), F.col("u0").alias("b0"), F.col("u1").alias("b1"))
    own = runs.select("image_id", "v", F.col("inst_id").alias("a"), "u0", "u1")
    met = overlap_join(own, other, ["image_id", "v"], [("u0", "u1")], [("b0", "b1")], cell=64.0, levels=(0, 3), closed=True, also=F.col("a") < F.col("b"))
    both = met.groupBy("image_id", "a", "b").agg(F.sum(F.least("u1", "b1") - F.greatest("u0", "b0") + 1).alias("both"))
    size = runs.groupBy("image_id", "inst_id").agg(F.sum(F.col("u1") - F.col("u0") + 1).alias("n"))
    out = both.join(size.withColumnsRenamed({"inst_id": "a", "n": "na"}), ["image_id", "a"]).join(size.withColumnsRenamed({"inst_id": "b", "n": "nb"}), ["image_id", "b"])
    return out.select("image_id", "a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("iou"))


def erode_mask(runs: DataFrame, kv: int, kh: int, height: int, width: int, adaptive: int | None = None, small: int = 1) -> DataFrame:
    """Pixels of merged runs whose vertical run of kv and horizontal run of kh pixels to either side are all set.

    Beyond the image's border everything counts as set. adaptive: an axis along which the mask's indices span less than this
    uses `small` instead of its k. Gives merged runs. Runs stay runs: whole masks meet in sorted batches and runs are cut by those
    of the lines around them, so no pixel has a row.
    """
    keys, columns = ["image_id", "inst_id"], ["image_id", "inst_id", "v", "u0", "u1"]
    rows = runs.select(*columns).dropna().repartition(*keys).sortWithinPartitions(*keys, "v", "u0")
    return rows.mapInArrow(by_groups(_eroded(kv, kh, height, width, adaptive, small), keys), ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in columns))


def _eroded(kv: int, kh: int, height: int, width: int, adaptive: int | None, small: int):
    """Whole masks, sorted by mask, v and u0. All lines lie behind one another on one axis, with kv free ones after each mask."""
    def eroded(t: pa.Table) -> pa.RecordBatch:
        v, u0, u1 = (t.column(c).to_numpy().astype(np.int64) for c in ("v", "u0", "u1"))
        starts = np.flatnonzero(changes(t, ("image_id", "inst_id")))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(v))))
        top, left = np.minimum.reduceat(v, starts), np.minimum.reduceat(u0, starts)
        spans = [np.maximum.reduceat(x, starts) - lo for x, lo in ((v, top), (u1, left))]
        down, across = (np.where(span >= adaptive, k, min(small, k)) if adaptive is not None else np.full(len(starts), k) for span, k in zip(spans, (kv, kh), strict=True))
        line = (np.cumsum(spans[0] + kv + 1) - spans[0] - top)[of] + v
        wide = u1.max() - u0.min() + 1
        at = line * wide - u0.min()
        b0, b1 = at + u0, at + u1
        a0, a1 = np.where(u0 > 0, b0 + across[of], b0), np.where(u1 < width - 1, b1 - across[of], b1)
        own = np.flatnonzero(a0 <= a1)
        a0, a1 = a0[own], a1[own]
        for step in (s * d for d in range(1, kv + 1) for s in (-1, 1)):
            other = v[own] + step
            needed = (down[of[own]] >= abs(step)) & ((other >= 0) if step < 0 else (other < height))
            # The runs b of the line beside that each run a meets; a run whose line beside is not needed stays whole.
            first, last = np.searchsorted(b1, a0 + step * wide), np.searchsorted(b0, a1 + step * wide, "right")
            n = np.where(needed, last - first, 1)
            a = np.repeat(np.arange(len(own)), n)
            b = np.minimum(first[a] + np.arange(len(a)) - (np.cumsum(n) - n)[a], len(b0) - 1)
            a0, a1 = (np.where(needed[a], f(x[a], y[b] - step * wide), x[a]) for f, x, y in ((np.maximum, a0, b0), (np.minimum, a1, b1)))
            own = own[a]
        out = t.select(["image_id", "inst_id", "v"]).take(pa.array(own))
        for c, x in (("u0", a0), ("u1", a1)):
            out = out.append_column(c, pa.array(x - at[own]).cast(t.schema.field(c).type))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=out.column_names)

    return eroded


#: Side of the tiles in which depth edges are looked for, and the rim of pixels around one that decide on its own.
TILE, RIM = 64, 2


def _edges(threshold: float, by: int):
    """Of a tile's own pixels (the first `by` columns, u, v, depth) which are good. Neighbours without a logarithm count as the pixel itself; a pixel without one is no edge."""
    def marked(t: pa.Table) -> pa.Table:
        u, v, tu, tv = (t.column(c).to_numpy() for c in ("u", "v", "_tu", "_tv"))
        x, y = (u - u.min() + 1).astype(int), (v - v.min() + 1).astype(int)
        d, there = np.full((y.max() + 2, x.max() + 2), np.nan), np.zeros((y.max() + 2, x.max() + 2), bool)
        d[y, x], there[y, x] = t.column("d").to_numpy(), t.column("d").is_valid().to_numpy()
        inner = (slice(1, -1), slice(1, -1))
        moved = lambda g, du, dv: g[1 + dv : g.shape[0] - 1 + dv, 1 + du : g.shape[1] - 1 + du]
        n = {(du, dv): np.where(moved(there, du, dv), moved(d, du, dv), d[inner]) for du in (-1, 0, 1) for dv in (-1, 0, 1)}
        with np.errstate(invalid="ignore"):
            gx = n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]
            gy = n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]
            edge = np.zeros_like(there)
            edge[inner] = there[inner] & ~(np.sqrt(gx * gx + gy * gy) <= threshold)
        bad = np.logical_or.reduce([moved(edge, du, dv) for du, dv in n])
        own = np.flatnonzero((u // TILE == tu) & (v // TILE == tv))
        own = own[np.unique(np.stack([u[own], v[own]]), axis=1, return_index=True)[1]]  # a pixel that is there twice counts once
        return t.select([*range(by), "u", "v", "depth"]).take(pa.array(own)).append_column("good", pa.array(~bad[y[own] - 1, x[own] - 1]))

    return marked


def drop_depth_edges(pixels: DataFrame, by: list[str], threshold: float = 0.08, least: int = 20, share: float = 0.35) -> DataFrame:
    """Pixels (by, u, v, depth) away from depth edges: Sobel of log depth above the threshold, grown by a pixel to all sides.

    A group that would keep fewer than `least` pixels or less than `share` of them is left whole. A neighbour that is not there
    counts as the pixel itself. Pixels meet in tiles with a rim of two pixels, so none is joined with its neighbours.
    """
    rows = pixels.select(*by, "u", "v", "depth", F.log("depth").alias("d"))
    tiles = lambda c: F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + k) / TILE) for k in (-RIM, RIM)))))
    tiled = rows.withColumn("_tu", tiles("u")).withColumn("_tv", tiles("v"))
    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in (*by, "u", "v", "depth"))
    marked = tiled.groupBy(*by, "_tu", "_tv").applyInArrow(_edges(threshold, len(by)), f"{kinds}, good boolean")
    n = F.count("*").over(Window.partitionBy(*by))
    kept = F.sum(F.col("good").cast("int")).over(Window.partitionBy(*by))
    whole = marked.withColumn("n", n).withColumn("kept", kept)
    return whole.where(f"good OR kept < {least} OR kept < {share} * n").select(*by, "u", "v", "depth")


def box_lines(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """(box keys, v, values): for every box the slices of the depth lines it covers. The range becomes an equi-join by row number."""
    rows = boxes.withColumn("v", F.explode(F.sequence(F.floor("y1").cast("int"), F.ceil("y2").cast("int"))))
    first = F.greatest(F.floor("x1"), F.lit(0)).cast("int")
    last = F.ceil("x2").cast("int")
    met = rows.join(lines.select("image_id", "v", "depth"), ["image_id", "v"])
    size = F.greatest(F.least(last + 1, F.size("depth")) - first, F.lit(0))
    return met.select(*boxes.columns, "v", F.filter(F.slice("depth", first + 1, size), lambda d: d > 0).alias("values"))


def depth_support(boxes: DataFrame, lines: DataFrame, key: str = "det_id", margin: float = 0.2, least_pixels: int = 16, least_support: float = 0.2, most_error: float = 0.5) -> DataFrame:
    """(key, pixels, support, median, rel_error, ok): how the depth inside a box agrees with it; boxes without any depth line pass.

    boxes: key, image_id, x1, y1, x2, y2, z_min, z_max, center_z.
    """
    values = box_lines(boxes, lines).select(key, "z_min", "z_max", "center_z", F.explode("values").alias("d"))
    inside = F.col("d").between(F.col("z_min") - margin, F.col("z_max") + margin)
    got = values.groupBy(key).agg(F.count("*").alias("pixels"), (F.count_if(inside) / F.count("*")).alias("support"), F.median("d").alias("median"), F.first("center_z").alias("cz"))
    error = F.abs(F.col("median") - F.col("cz")) / F.greatest(F.abs("cz"), F.lit(1e-3))
    got = got.withColumn("rel_error", error).drop("cz")
    there = lines.select("image_id").distinct().withColumn("there", F.lit(True))
    out = boxes.select(key, "image_id").join(got, key, "left").join(there, "image_id", "left")
    ok = F.when(F.col("there").isNull(), True).otherwise(F.coalesce((F.col("pixels") >= least_pixels) & (F.col("support") >= least_support) & (F.col("rel_error") <= most_error), F.lit(False)))
    return out.select(key, F.coalesce("pixels", F.lit(0)).alias("pixels"), "support", "median", "rel_error", ok.alias("ok"))


def layer_alignment(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two layers of pixels (by, u, v, depth): silhouette_iou, bbox_iou, overlap, medians, rel_error, bias and score (.60, .25, .15)."""
    both = a.select(*by, "u", "v", F.col("depth").alias("da")).join(b.select(*by, "u", "v", F.col("depth").alias("db")), [*by, "u", "v"], "full")
    lap = F.col("da").isNotNull() & F.col("db").isNotNull()
    e = lambda c, x, f: f(F.when(F.col(x).isNotNull(), F.col(c)))
    out = both.groupBy(*by).agg(
        (F.count_if(lap) / F.count("*")).alias("silhouette_iou"), F.count_if(lap).alias("overlap"),
        F.median(F.when(lap, F.col("da"))).alias("median_a"), F.median(F.when(lap, F.col("db"))).alias("median_b"),
        F.median(F.when(lap, F.abs(F.col("db") - F.col("da")) / F.col("da"))).alias("rel_error"), F.median(F.when(lap, F.col("db") - F.col("da"))).alias("bias"),
        *(e(c, f"d{s}", f).alias(f"{s}{c}{n}") for s in "ab" for c in "uv" for n, f in (("0", F.min), ("1", F.max))),
    )
    w = F.greatest(F.least("au1", "bu1") - F.greatest("au0", "bu0") + 1, F.lit(0)) * F.greatest(F.least("av1", "bv1") - F.greatest("av0", "bv0") + 1, F.lit(0))
    area = lambda s: (F.col(f"{s}u1") - F.col(f"{s}u0") + 1) * (F.col(f"{s}v1") - F.col(f"{s}v0") + 1)
    out = out.withColumn("bbox_iou", F.coalesce(w / (area("a") + area("b") - w), F.lit(0.0)))
    score = 0.60 * F.col("silhouette_iou") + 0.25 * F.col("bbox_iou") + 0.15 * (1 - F.least(F.coalesce("rel_error", F.lit(1.0)), F.lit(1.0)))
    return out.select(*by, "silhouette_iou", "bbox_iou", "overlap", "median_a", "median_b", "rel_error", "bias", score.alias("score"))


def raster_health(pixels: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """(by, channel, n, nan, inf, valid, min, max): counts of bad values and the range of the others."""
    pairs = ", ".join(f"'{c}', {c}" for c in channels)
    long = pixels.select(*by, F.expr(f"stack({len(channels)}, {pairs}) AS (channel, x)"))
    bad = F.isnan("x") | F.col("x").isNull()
    inf = F.abs("x") == float("inf")
    fine = ~bad & ~F.coalesce(inf, F.lit(False))
    return long.groupBy(*by, "channel").agg(F.count("*").alias("n"), F.count_if(bad).alias("nan"), F.count_if(F.coalesce(inf, F.lit(False))).alias("inf"), F.count_if(fine).alias("valid"), F.min(F.when(fine, F.col("x"))).alias("min"), F.max(F.when(fine, F.col("x"))).alias("max"))
