"""Annotation sets: concatenation, filters, flags, ids and set operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.functions import boxes, geometry
from annolake.sources.shared import settled


@dataclass(frozen=True)
class FilterSettings:
    """What makes an annotation ignored. Bounds of the height are shares of the image's height."""

    max_depth: float = 1e8
    min_height: float = 0.0
    max_height: float = 1e8
    truncation: float = 0.99
    visibility: float = 0.01
    max_depth_error: float = 0.5
    ignore_names: tuple[str, ...] = ()
    category_names: tuple[str, ...] = ()


def concat_sets(*sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Images and annotations of all sets; categories by id, the first set's winning; each set's known category ids."""
    images, anns, cats, known = [], [], [], []
    for order, s in enumerate(sets):
        images.append(s["images"])
        anns.append(s["annotations"])
        cats.append(s["categories"].withColumn("_order", F.lit(order)))
        known.append(s["categories"].select(F.lit(order).alias("set_order"), "category_id"))

    def union(dfs: list[DataFrame]) -> DataFrame:
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d, allowMissingColumns=True)
        return out

    columns = [c for c in sets[0]["categories"].columns if c != "category_id"]
    categories = union(cats).groupBy("category_id").agg(F.min_by(F.struct(*columns), "_order").alias("c")).select("category_id", "c.*")
    return {"images": union(images), "annotations": union(anns), "categories": categories, "known": union(known).groupBy("set_order").agg(F.sort_array(F.collect_set("category_id")).alias("known_category_ids"))}


def known_differences(known: DataFrame, num_classes: int) -> DataFrame:
    """known with the ids 0 .. num_classes - 1 that a set knows and does not know."""
    every = F.sequence(F.lit(0), F.lit(num_classes - 1))
    return known.select("*", F.array_intersect(every, "known_category_ids").alias("known"), F.array_except(every, "known_category_ids").alias("unknown"))


def is_ignored(s: FilterSettings, columns: dict[str, Column], image_height: Column) -> Column:
    """Whether an annotation is ignored. columns: behind_camera, valid3d, w, h, l, depth, lidar_pts, segmentation_pts,
    depth_error, box_height, truncation, visibility, name; those that are missing decide nothing. Null means unknown.
    """
    c, no = columns, F.lit(False)

    def if_there(name: str, test) -> Column:
        return F.coalesce(test(c[name]), no) if name in c else no

    out = if_there("behind_camera", lambda x: x) | if_there("valid3d", lambda x: ~x)
    for d in ("w", "h", "l"):
        out = out | if_there(d, lambda x: x <= 0)
    out = out | if_there("depth", lambda x: x > s.max_depth)
    out = out | if_there("lidar_pts", lambda x: x == 0) | if_there("segmentation_pts", lambda x: x == 0) | if_there("depth_error", lambda x: x > s.max_depth_error)
    out = out | if_there("box_height", lambda x: (x <= s.min_height * image_height) | (x >= s.max_height * image_height))
    out = out | if_there("truncation", lambda x: (x >= 0) & (x >= s.truncation)) | if_there("visibility", lambda x: (x >= 0) & (x <= s.visibility))
    if s.ignore_names:
        out = out | if_there("name", lambda x: x.isin(*s.ignore_names))
    return out


def prepare_ground_truth(anns: DataFrame, images: DataFrame, s: FilterSettings, candidates: tuple[str, ...], flags: dict[str, str]) -> DataFrame:
    """Join the image, choose the box from candidates (rows without one drop out), set bbox (XYWH), area and ignore, and keep trainable names.

    flags: name of is_ignored's column -> column of anns.
    """
    rows = anns.join(images.select("image_id", "width", "height"), "image_id")
    rows = rows.withColumn("box", boxes.choose_box(F.col("width"), F.col("height"), *(F.col(c) for c in candidates))).where("box IS NOT NULL")
    x1, y1, x2, y2 = boxes.parts(F.col("box"))
    columns = {k: F.col(v) for k, v in flags.items()} | {"box_height": y2 - y1}
    rows = rows.withColumn("bbox", boxes.xyxy_to_xywh(F.col("box"))).withColumn("area", boxes.area(F.col("box"))).withColumn("ignore", is_ignored(s, columns, F.col("height").cast("double")))
    names = set(s.ignore_names) | set(s.category_names)
    return rows.where(F.col(flags["name"]).isin(*names)) if names and "name" in flags else rows


def contiguous_ids(categories: DataFrame, names: list[str]) -> DataFrame:
    """(category_id, name, contiguous_id): rank of the chosen categories by id, from 0. One row per category of the vocabulary."""
    chosen = categories.where(F.col("name").isin(*names))
    return chosen.withColumn("contiguous_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("category_id")) - 1)


def training_records(gt: DataFrame, images: DataFrame, ids: DataFrame, filter_empty: bool = True) -> DataFrame:
    """One record per image: image_id, width, height, annotations (array, by ann_id); the category of an ignored one is -1.

    With filter_empty, images without an annotation that counts are left out.
    """
    cat = F.when(F.col("ignore"), -1).otherwise(F.coalesce("contiguous_id", F.lit(-1)))
    rows = gt.join(F.broadcast(ids.select(F.col("name").alias("category_name"), "contiguous_id")), "category_name", "left").select("image_id", "ignore", F.struct("ann_id", cat.alias("category_id"), "bbox").alias("a"))
    per_image = rows.groupBy("image_id").agg(F.sort_array(F.collect_list("a")).alias("annotations"), F.max(~F.col("ignore")).alias("counts"))
    out = images.select("image_id", "width", "height").join(per_image, "image_id", "left").withColumn("counts", F.coalesce("counts", F.lit(False)))
    return (out.where("counts") if filter_empty else out).drop("counts")


def assign_ann_ids(df: DataFrame, order: list[str], dataset_col: str = "dataset_id", span: int = 10_000_000) -> DataFrame:
    """df with new_ann_id = dataset_id * span + n, n from 1 in the order given; an error where a set outgrows the span."""
    # Ranges of the order, numbered within; what the ranges before hold of the same set is added. A set may lie in many ranges.
    ranged = settled(df.repartitionByRange(dataset_col, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(dataset_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(dataset_col, "_part").agg(F.count("*").alias("_c"))
    counts = counts.select(F.col(dataset_col).alias("_set"), F.col("_part").alias("_range"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy(dataset_col, "_part").orderBy(*order)) + F.col("_before")
    rows = ranged.join(counts, (F.col(dataset_col).eqNullSafe(F.col("_set"))) & (F.col("_part") == F.col("_range"))).withColumn("_n", n).drop("_set", "_part", "_range", "_before")
    ok = F.when(F.col("_n") < span, F.col(dataset_col) * F.lit(span).cast("long") + F.col("_n")).otherwise(F.raise_error(F.lit("a data set has more annotations than its span of ids")))
    return rows.withColumn("new_ann_id", ok.cast("long")).drop("_n")


def with_category(df: DataFrame, categories: DataFrame, name_col: str = "category_name", on_unknown: str = "drop") -> DataFrame:
    """df with category_id by name. on_unknown: "drop" the row, "zero" for id 0, or "error"."""
    out = df.join(F.broadcast(categories.select(F.col("name").alias(name_col), "category_id")), name_col, "inner" if on_unknown == "drop" else "left")
    if on_unknown == "zero":
        return out.withColumn("category_id", F.coalesce("category_id", F.lit(0)))
    if on_unknown == "error":
        return out.withColumn("category_id", F.when(F.col("category_id").isNull(), F.raise_error(F.concat(F.lit("unknown category "), F.col(name_col))).cast("int")).otherwise(F.col("category_id")))
    return out


def with_prior(df: DataFrame, priors: DataFrame, name_col: str = "category_name", default: float | None = 0.5) -> DataFrame:
    """df with pw, ph, pl of its lower-cased category; default where it has none."""
    p = priors.select(F.lower("category_name").alias("_name"), F.col("w").alias("pw"), F.col("h").alias("ph"), F.col("l").alias("pl"))
    out = df.withColumn("_name", F.lower(name_col)).join(F.broadcast(p), "_name", "left").drop("_name")
    return out.fillna({"pw": default, "ph": default, "pl": default}) if default is not None else out


def pending(images: DataFrame, done: DataFrame, failed: Column | None = None) -> DataFrame:
    """Images that have no result yet, or only one that failed."""
    fine = done.where(~failed) if failed is not None else done
    return images.join(fine.select("image_id").distinct(), "image_id", "left_anti")


def with_pseudo_labels(images: DataFrame, raw: DataFrame, how: str = "left_semi") -> DataFrame:
    return images.join(raw.select("image_id").distinct(), "image_id", how)


def match_files(names: DataFrame, listing: DataFrame) -> DataFrame:
    """(image_id, phrase, idx, path): the first existing file of each object by the priority of its possible names. listing: name, path.

    Each phrase and index is looked up once, however many objects have it; a missing phrase leaves the names made of the index. The join
    is a merge: the size that Spark assumes for the names leaves out that there are five of each, so it would broadcast them.
    """
    p, i = F.col("phrase"), F.col("idx").cast("string")
    tries = F.posexplode(F.array(F.concat(p, F.lit("_"), i, F.lit(".ply")), F.concat(p, F.lit(".ply")), F.concat(p, F.lit("_"), i, F.lit(".glb")), F.concat(F.lit("mask_"), i, F.lit(".ply")), F.concat(F.lit("object_"), i, F.lit(".ply")))).alias("priority", "name")
    found = names.select("phrase", "idx").distinct().select("phrase", "idx", tries).join(listing.select("name", "path").hint("merge"), "name")
    best = found.groupBy("phrase", "idx").agg(F.min_by("path", "priority").alias("path"))
    best = best.select(F.col("phrase").alias("_phrase"), F.col("idx").alias("_idx"), "path")
    return names.join(best, F.col("phrase").eqNullSafe(F.col("_phrase")) & F.col("idx").eqNullSafe(F.col("_idx")), "left").drop("_phrase", "_idx")


def explode_pseudo(raw: DataFrame, arrays: list[str], shortest: bool = False) -> DataFrame:
    """One row per object of per-image parallel arrays: image_id, pos and one column per array. shortest: stop at the shortest array."""
    rows = raw.select("image_id", *arrays, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"))
    if shortest:
        rows = rows.where(F.col("pos") < F.least(*(F.coalesce(F.size(a), F.lit(0)) for a in arrays)) if len(arrays) > 1 else F.lit(True))
    return rows.select("image_id", "pos", *(F.col(f"z.{a}").alias(a) for a in arrays))


def detection_source(kind: str, df: DataFrame) -> DataFrame:
    """Rows of one kind of 2D source in one shape: image_id, src_idx, label, score, box, kind.

    kind: "annotations" (ann_id, category_name, box), "external" (label, score, box) or "pseudo" (phrase, conf, box).
    """
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("src")) - 1
    named = {
        "annotations": lambda: df.select("image_id", F.col("ann_id").alias("src"), F.lower("category_name").alias("label"), F.lit(1.0).alias("score"), "box"),
        "external": lambda: df.select("image_id", F.col("det_id").alias("src"), F.lower("label").alias("label"), "score", "box"),
        "pseudo": lambda: df.select("image_id", F.col("pos").cast("long").alias("src"), F.lower("phrase").alias("label"), F.col("conf").alias("score"), "box"),
    }[kind]()
    return named.withColumn("src_idx", n).drop("src").withColumn("kind", F.lit(kind))


def filter_cascade(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `reason`: the first rule that fails (its condition holds), null if none does."""
    reason = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules))
    return df.withColumn("reason", reason)


def funnel_stats(df: DataFrame, reason_col: str = "reason") -> DataFrame:
    """(reason, n), "kept" for rows without one."""
    return df.groupBy(F.coalesce(F.col(reason_col), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def gate_counts(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row: how many rows each gate rejects; a row may fail several."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(~ok).alias(name) for name, ok in gates.items()))


def valid3d(policy: str, dims: Column, center_z: Column, corner: Column, reason: Column | None = None) -> Column:
    """corner: some value of the corner list. policy: "corner" (it is not the missing mark), "dimension" (the first
    one is not), or "geometry" (sizes and depth positive and finite, and the source gave no reason against it)."""
    if policy == "corner":
        return F.coalesce(corner != -1, F.lit(False))
    if policy == "dimension":
        return F.coalesce(F.get(dims, 0) != -1, F.lit(False))
    ok = boxes.all_finite(dims) & ~F.exists(dims, lambda x: x <= 0) & (center_z > 0)
    if reason is not None:
        ok = ok & (reason.isNull() | reason.isin("valid", "valid_render_back", "valid_render_back_strict"))
    return F.coalesce(ok, F.lit(False))


def fill_invalid(df: DataFrame, valid: Column) -> DataFrame:
    """Neutral values where a row is not valid: centre (0, 0, -1), dims 1, box null."""
    def neutral(name: str, values: list[float]) -> Column:
        return F.when(valid, F.col(name)).otherwise(boxes.box(*values)).alias(name)

    out = df.withColumn("valid3d", valid)
    fills = {"center": [0.0, 0.0, -1.0], "dims": [1.0, 1.0, 1.0]}
    return out.select(*(neutral(c, fills[c]) if c in fills else F.col(c) for c in out.columns))


def placeholders(images: DataFrame, anns: DataFrame) -> DataFrame:
    """(image_id, placeholder): one row for every image without a valid annotation."""
    return images.select("image_id").join(anns.where("valid3d").select("image_id").distinct(), "image_id", "left_anti").withColumn("placeholder", F.lit(True))


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): values that only one of the two has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def merge_shards(*shards: DataFrame) -> DataFrame:
    """Per image the row of the last shard that has one."""
    parts = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    columns = [c for c in shards[0].columns if c != "image_id"]
    return out.groupBy("image_id").agg(F.max_by(F.struct(*columns), "_shard").alias("r")).select("image_id", "r.*")


def universes(*frames: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column over several frames."""
    out = frames[0].select(column)
    for f in frames[1:]:
        out = out.unionByName(f.select(column))
    return out.distinct()


def vocabulary_filter(df: DataFrame, vocabulary: DataFrame, name_col: str = "category_name") -> DataFrame:
    return df.join(F.broadcast(vocabulary.select(F.lower("name").alias("_v")).distinct()), F.lower(name_col) == F.col("_v"), "left_semi")


#: Columns of a set that a flip changes, where they are there.
MIRRORED_BOXES, MIRRORED_POSES = ("bbox2D_tight", "bbox2D_trunc", "bbox2D_proj", "box"), ("R_cam", "pose")


def mirror_images(images: DataFrame) -> DataFrame:
    """images with the principal point where a horizontal flip puts it: k, or cx."""
    width = F.col("width").cast("double")
    if "k" in images.columns:
        images = images.withColumn("k", F.when(F.col("k").isNotNull(), F.transform("k", lambda row, i: F.when(i == 0, F.transform(row, lambda x, j: F.when(j == 2, width - x).otherwise(x))).otherwise(row))))
    return images.withColumn("cx", width - F.col("cx")) if "cx" in images.columns else images


def mirror_annotations(anns: DataFrame, images: DataFrame) -> DataFrame:
    """A set's annotations after a horizontal flip of their images: doing it twice gives them back.

    2D boxes go from x to width - x, and so does the column of a projected centre (center_proj); centres and corners
    (center_cam, bbox3D_cam) change the sign of x, corners keeping their order; poses become M1 * R * M2. Columns that are not
    there are left out, nulls stay null. Annotations of images that are not listed keep null boxes.
    """
    rows = anns.join(images.select("image_id", F.col("width").cast("double").alias("_width")), "image_id", "left")
    for c in anns.columns:
        value = F.col(c)
        if c in MIRRORED_BOXES:
            rows = rows.withColumn(c, boxes.mirror_box(value, F.col("_width")))
        elif c == "center_proj":
            rows = rows.withColumn(c, F.when(value.isNotNull(), F.array(F.col("_width") - F.get(value, 0), F.get(value, 1))))
        elif c == "center_cam":
            rows = rows.withColumn(c, F.when(value.isNotNull(), geometry.mirror_center(value)))
        elif c == "bbox3D_cam":
            rows = rows.withColumn(c, F.transform(value, geometry.mirror_center))
        elif c in MIRRORED_POSES:
            rows = rows.withColumn(c, F.when(value.isNotNull(), geometry.mirror_pose(value)))
    return rows.select(*anns.columns)
