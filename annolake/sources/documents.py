"""Annotation documents: COCO-like JSON in and out, and lenient records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.sources.json_ranges import RANGE, read_records, write_documents

IMAGE = "struct<id:bigint,width:int,height:int,file_path:string,K:array<array<double>>,dataset_id:int>"
CATEGORY = "struct<id:int,name:string,supercategory:string>"
ANNOTATION = (
    "struct<id:bigint,image_id:bigint,dataset_id:int,category_id:int,category_name:string,valid3D:boolean,bbox2D_tight:array<double>,bbox2D_trunc:array<double>,bbox2D_proj:array<double>,"
    "bbox3D_cam:array<array<double>>,center_cam:array<double>,dimensions:array<double>,R_cam:array<array<double>>,behind_camera:boolean,visibility:double,truncation:double,"
    "segmentation_pts:int,lidar_pts:int,depth_error:double,score:double>"
)
INFO = "struct<id:int,source:string,name:string,split:string>"
#: Annotation fields whose -1 stands for "not there".
BOXES, SCALARS = ("bbox2D_tight", "bbox2D_trunc", "bbox2D_proj", "center_cam", "dimensions"), ("visibility", "truncation", "segmentation_pts", "lidar_pts", "depth_error")


def _missing_to_null(c: Column, array: bool) -> Column:
    return F.when(~F.forall(c, lambda x: x == -1), c) if array else F.when(c != -1, c)


def read_annotation_sets(spark: SparkSession, paths: list[str], range_bytes: int = RANGE) -> dict[str, DataFrame]:
    """info, images, categories and annotations of documents of any size; info may be a record or a list, of which the first counts.

    A path is a file, a folder named *.json whose files are one document, or a folder of such. Records are found by byte ranges; Spark parses them.
    """
    records = read_records(spark, paths, range_bytes)
    parsed = lambda section, kind: records(section).select("document", "offset", F.from_json("value", kind).alias("r"))
    anns = parsed("annotations", ANNOTATION).select("r.*")
    for c in BOXES:
        anns = anns.withColumn(c, _missing_to_null(F.col(c), True))
    for c in SCALARS:
        anns = anns.withColumn(c, _missing_to_null(F.col(c), False))
    return {
        "info": parsed("info", INFO).groupBy(F.col("document").alias("path")).agg(F.min_by("r", "offset").alias("i")).select("path", "i.*"),
        "images": parsed("images", IMAGE).select(F.col("r.id").alias("image_id"), "r.width", "r.height", "r.file_path", F.col("r.K").alias("k"), "r.dataset_id"),
        "categories": parsed("categories", CATEGORY).select(F.col("r.id").alias("category_id"), "r.name", "r.supercategory"),
        "annotations": anns.withColumnRenamed("id", "ann_id"),
    }


def document_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(set_name, section, id, value): every record as JSON, nulls back to -1, under the set that it belongs to; all sets get all categories."""
    anns = tables["annotations"].withColumnRenamed("ann_id", "id")
    for c in BOXES:
        n = 4 if c.startswith("bbox2D") else 3
        anns = anns.withColumn(c, F.coalesce(F.col(c), F.array(*(F.lit(-1.0) for _ in range(n)))))
    for c in SCALARS:
        anns = anns.withColumn(c, F.coalesce(F.col(c), F.lit(-1)))
    images = tables["images"].select(F.col("image_id").alias("id"), "width", "height", "file_path", F.col("k").alias("K"), "dataset_id")
    sets = tables["info"].select(F.col("id").cast("int").alias("dataset_id")).unionByName(images.select("dataset_id")).unionByName(anns.select("dataset_id")).distinct()
    cats = tables["categories"].select(F.col("category_id").alias("id"), "name", "supercategory").distinct()
    parts = [
        tables["info"].select(F.col("id").alias("dataset_id"), "id", "source", "name", "split").dropDuplicates(["dataset_id"]),
        images,
        cats.crossJoin(F.broadcast(sets)),  # sets are few: each has an info record
        anns.select("id", *(c for c in anns.columns if c != "id")),
    ]
    out = None
    for i, part in enumerate(parts):
        fields = [c for c in part.columns if i in (1, 3) or c != "dataset_id"]
        rows = part.select(F.concat(F.lit("dataset_id="), F.coalesce(F.col("dataset_id").cast("string"), F.lit("null"))).alias("set_name"), F.lit(i).alias("section"), F.col("id").cast("long").alias("id"), F.to_json(F.struct(*fields)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_annotation_set(tables: dict[str, DataFrame], path: str, single: bool = False) -> None:
    """One valid document for each set, dataset_id=N.json below path: a folder of parts that follow one another, or with single one file."""
    write_documents(document_rows(tables), path, single)


#: Keys under which a container holds its records, and the names that a record's fields go by, in order.
CONTAINERS = ("annotations", "detections", "results", "proposals", "objects")
NAMES = {"box": ("bbox", "bbox2D_tight", "box", "bbox_xyxy"), "label": ("label", "category_name", "category", "class_name", "name", "phrase"), "score": ("score", "confidence", "conf")}


def normalize_records(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(record_no, image_id, box, label, score) of raw JSON: a list, an object with the list under a usual key, or a map from image ids to lists.

    A field is the first of its names that holds something; an empty string or array counts as nothing. The text is parsed once, into a
    VARIANT. Text that is no JSON gives no record, as does an element of a list that is no object; what cannot be read as its kind
    (a score of letters, say) is null. Records of a map are numbered in the order of its keys.
    """
    records = "array<map<string,variant>>"
    # The variant is a column of its own, so that the paths below read it and do not parse again.
    parsed = raw.select(*(c for c in raw.columns if c != json_col), F.try_parse_json(json_col).alias("_v"))
    lists = [F.try_variant_get("_v", path, records) for path in ("$", *(f"$.{c}" for c in CONTAINERS))]
    of_images = F.map_entries(F.try_variant_get("_v", "$", f"map<string,{records}>"))
    by_image = F.flatten(F.transform(F.filter(of_images, lambda e: e["value"].isNotNull()), lambda e: F.transform(e["value"], lambda r: F.struct(e["key"].alias("image"), r.alias("r")))))
    plain = F.transform(F.coalesce(*lists), lambda r: F.struct(F.lit(None).cast("string").alias("image"), r.alias("r")))
    rows = parsed.select(*(c for c in parsed.columns if c != "_v"), F.posexplode(F.coalesce(plain, by_image)).alias("record_no", "e"))
    rows = rows.select(*(c for c in rows.columns if c != "e"), F.col("e.image").alias("_image"), F.col("e.r").alias("_r")).where(F.col("_r").isNotNull())

    def first(names: tuple[str, ...], value) -> Column:
        texts = {n: F.try_variant_get(F.try_element_at("_r", F.lit(n)), "$", "string") for n in names}
        return F.coalesce(*(F.when(~F.trim(t).isin("", "[]", "null"), F.struct(value(n, t).alias("v"))) for n, t in texts.items()))["v"]

    def numbers(n: str, text: Column) -> Column:
        """Of an array, or of one that was written as a string."""
        written = F.transform(F.split(F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1), ","), lambda x: F.trim(x).try_cast("double"))
        return F.coalesce(F.try_variant_get(F.try_element_at("_r", F.lit(n)), "$", "array<double>"), F.when(text.rlike(r"^\s*\["), written))

    image = F.coalesce(F.col("_image").try_cast("long"), F.try_variant_get(F.try_element_at("_r", F.lit("image_id")), "$", "long"))
    return rows.select(
        *(c for c in rows.columns if c not in ("_image", "_r")), image.alias("image_id"), first(NAMES["box"], numbers).alias("box"),
        first(NAMES["label"], lambda _, t: t).alias("label"), first(NAMES["score"], lambda _, t: t.try_cast("double")).alias("score"),
    )


def write_predictions(det: DataFrame, path: str, vocabulary: DataFrame | None = None) -> None:
    """Detections as Parquet, with a vocabulary only its categories."""
    out = det if vocabulary is None else det.join(F.broadcast(vocabulary.select(F.col("name").alias("category_name")).distinct()), "category_name", "left_semi")
    out.write.mode("overwrite").parquet(path)


def write_flat(df: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
