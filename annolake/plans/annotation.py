"""Queries of the set, box, gate, label and statistics operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import boxes, geometry, labels
from annolake.operators import gates, priors, sets, stats, vocabulary
from annolake.plans.fixtures import view, with_views
from annolake.sources.shared import settled
from annolake.sources import documents
from annolake.sources.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its function's name, with its SQL over the fixture views."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def _r(c, digits: int = 6):
    """Rounded, a hair above, so that halves fall alike in both engines."""
    return F.round(c + 1e-9, digits)


def _anns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_annotations").withColumn("box", boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))


def _with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anns(spark, sf_dir).join(view(spark, sf_dir, "fx_images"), "image_id")


@_query("SELECT ann_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, x2 AS back_x2, y2 AS back_y2 FROM fx_annotations")
def box_modes(spark, sf_dir):
    rows = _anns(spark, sf_dir).withColumn("xywh", boxes.xyxy_to_xywh(F.col("box")))
    x, y, w, h = boxes.parts(F.col("xywh"))
    back = boxes.xywh_to_xyxy(F.col("xywh"))
    return rows.select("ann_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.get(back, 2).alias("back_x2"), F.get(back, 3).alias("back_y2"))


@_query("""WITH d AS (SELECT a.*, width, height, ann_id % 3 AS k FROM fx_annotations a JOIN fx_images i USING (image_id)),
    p AS (SELECT ann_id, width, height,
        CASE k WHEN 0 THEN ((x1 + x2) / 2 / width - (x2 - x1) / width / 2) * width WHEN 1 THEN x1 ELSE x1 END AS a, CASE k WHEN 0 THEN ((y1 + y2) / 2 / height - (y2 - y1) / height / 2) * height ELSE y1 END AS b,
        CASE k WHEN 0 THEN ((x1 + x2) / 2 / width + (x2 - x1) / width / 2) * width WHEN 1 THEN x2 ELSE CASE WHEN x2 - x1 <= x1 OR y2 - y1 <= y1 THEN x2 ELSE x2 - x1 END END AS c,
        CASE k WHEN 0 THEN ((y1 + y2) / 2 / height + (y2 - y1) / height / 2) * height WHEN 1 THEN y2 ELSE CASE WHEN x2 - x1 <= x1 OR y2 - y1 <= y1 THEN y2 ELSE y2 - y1 END END AS d FROM d)
    SELECT ann_id, round(greatest(least(a, width - 1), 0) + 1e-9, 4) AS px1, round(greatest(least(b, height - 1), 0) + 1e-9, 4) AS py1, round(greatest(least(c, width - 1), 0) + 1e-9, 4) AS px2, round(greatest(least(d, height - 1), 0) + 1e-9, 4) AS py2 FROM p""")
def detector_boxes(spark, sf_dir):
    """Normalised, XYXY and XYWH boxes to pixels."""
    rows = _with_images(spark, sf_dir)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    norm = boxes.box((F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h)
    b = F.when(F.col("ann_id") % 3 == 0, norm).when(F.col("ann_id") % 3 == 1, F.col("box")).otherwise(boxes.xyxy_to_xywh(F.col("box")))
    out = rows.select("ann_id", boxes.det_box_to_pixels(b, F.col("width"), F.col("height")).alias("b"))
    return out.select("ann_id", *(F.round(F.get("b", i) + 1e-9, 4).alias(n) for i, n in enumerate(("px1", "py1", "px2", "py2"))))


@_query("""WITH d AS (SELECT d.*, width, height FROM fx_detections d JOIN fx_images USING (image_id)),
    v AS (SELECT det_id, (det_id % 7 <> 0 AND greatest(x1, 0) < least(x2, width - 1) AND greatest(y1, 0) < least(y2, height - 1)) AS ok, greatest(x1, 0) AS a, greatest(y1, 0) AS b, least(x2, width - 1) AS c, least(y2, height - 1) AS d, width, height FROM d)
    SELECT det_id, CASE WHEN ok THEN a ELSE 1 END AS cx1, CASE WHEN ok THEN c ELSE 9 END AS cx2, ((CASE WHEN ok THEN (c - a) * (d - b) ELSE 64 END) / (width * height) BETWEEN 0.0002 AND 0.85) AS area_ok FROM v""")
def chosen_boxes(spark, sf_dir):
    """The first valid box, of the detection (missing for every seventh) and a constant one; and whether its area is usual."""
    rows = view(spark, sf_dir, "fx_detections").join(view(spark, sf_dir, "fx_images"), "image_id")
    b = F.when(F.col("det_id") % 7 == 0, boxes.box(-1, -1, -1, -1)).otherwise(boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    rows = rows.withColumn("b", boxes.choose_box(F.col("width"), F.col("height"), b, boxes.box(1, 1, 9, 9)))
    return rows.select("det_id", F.get("b", 0).alias("cx1"), F.get("b", 2).alias("cx2"), boxes.area_ratio_ok(F.col("b"), F.col("width"), F.col("height")).alias("area_ok"))


@_query("""WITH a AS (SELECT a.*, width, height FROM fx_annotations a JOIN fx_images USING (image_id)), c AS (SELECT *, least(y2, height - 1) - greatest(y1, 0) AS bh, least(x2, width - 1) - greatest(x1, 0) AS bw FROM a)
    SELECT ann_id, bw * bh AS area, (NOT valid3d OR czm > 9 OR bh <= 0.0625 * height OR bh >= 0.2 * height OR truncation >= 0.7 OR visibility <= 0.05) AS ignored FROM c WHERE bw > 0 AND bh > 0 AND category_name IN ('PROMO', 'ECONOMY')""")
def prepared_truths(spark, sf_dir):
    s = sets.FilterSettings(max_depth=9.0, min_height=0.0625, max_height=0.2, truncation=0.7, visibility=0.05, category_names=("PROMO", "ECONOMY"))
    flags = {"valid3d": "valid3d", "depth": "czm", "truncation": "truncation", "visibility": "visibility", "name": "category_name", "w": "w3", "h": "h3", "l": "l3"}
    gt = sets.prepare_ground_truth(_anns(spark, sf_dir), view(spark, sf_dir, "fx_images"), s, ("box",), flags)
    return gt.select("ann_id", "area", F.col("ignore").alias("ignored"))


def _vocabulary(spark, sf_dir) -> DataFrame:
    """Categories numbered by name."""
    names = view(spark, sf_dir, "fx_base").select(F.col("category_name").alias("name")).distinct()
    return names.withColumn("category_id", F.crc32("name").cast("long") % 1000).withColumn("supercategory", F.lit("object"))


@_query("""WITH n AS (SELECT image_id, count(*) AS n, count(*) FILTER (valid3d) AS good, sum(ann_id * CASE WHEN valid3d THEN 1 ELSE 0 END) AS key FROM fx_annotations GROUP BY 1) SELECT image_id, n, good, key FROM n WHERE good > 0""")
def records_of_images(spark, sf_dir):
    """Training records: annotations per image, those that count, and their keys."""
    gt = _anns(spark, sf_dir).select("ann_id", "image_id", "category_name", (~F.col("valid3d")).alias("ignore"), F.col("box").alias("bbox"))
    names = [r.name for r in _vocabulary(spark, sf_dir).select("name").collect()]  # a vocabulary
    out = sets.training_records(gt, view(spark, sf_dir, "fx_images"), sets.contiguous_ids(_vocabulary(spark, sf_dir), names))
    good = F.filter("annotations", lambda a: a["category_id"] >= 0)
    return out.select("image_id", F.size("annotations").alias("n"), F.size(good).alias("good"), F.aggregate(F.transform(good, lambda a: a["ann_id"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("key"))


@_query("""SELECT dataset_id * 10000000 + row_number() OVER (PARTITION BY dataset_id ORDER BY ann_id) AS new_ann_id, ann_id FROM fx_annotations JOIN fx_images USING (image_id)""")
def new_annotation_ids(spark, sf_dir):
    return sets.assign_ann_ids(_with_images(spark, sf_dir).select("ann_id", "dataset_id"), ["ann_id"]).select("new_ann_id", "ann_id")


@_query("""WITH u AS (SELECT image_id, category_name, 'a' AS src FROM fx_annotations UNION ALL SELECT image_id, category_name, 'd' FROM fx_detections), s AS (SELECT category_name, min(src) AS first_source, count(*) AS n FROM u GROUP BY 1) SELECT * FROM s""")
def concatenated_sets(spark, sf_dir):
    """Two sets in one; categories come from the first that has them."""
    img = view(spark, sf_dir, "fx_images")
    def one(name: str, src: str) -> dict:
        rows = view(spark, sf_dir, name).select("image_id", "category_name")
        cats = rows.select("category_name").distinct().select(F.col("category_name").alias("name"), F.crc32("category_name").alias("category_id"), F.lit(src).alias("supercategory"))
        return {"images": img, "annotations": rows, "categories": cats}
    out = sets.concat_sets(one("fx_annotations", "a"), one("fx_detections", "d"))
    n = out["annotations"].groupBy("category_name").agg(F.count("*").alias("n"))
    return n.join(out["categories"], F.col("category_name") == F.col("name")).select("category_name", F.col("supercategory").alias("first_source"), "n")


@_query("""WITH k AS (SELECT DISTINCT dataset_id, CAST(pk % 12 AS INT) AS c FROM fx_base JOIN fx_images USING (image_id) WHERE pk % 12 <> dataset_id * 3)
    SELECT dataset_id, count(*) FILTER (c < 10) AS n_known, 10 - count(*) FILTER (c < 10) AS n_unknown FROM k GROUP BY 1""")
def known_categories(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_base").join(view(spark, sf_dir, "fx_images"), "image_id").where("pk % 12 <> dataset_id * 3")
    known = rows.groupBy("dataset_id").agg(F.collect_set((F.col("pk") % 12).cast("int")).alias("known_category_ids"))
    return sets.known_differences(known, 10).select("dataset_id", F.size("known").alias("n_known"), F.size("unknown").alias("n_unknown"))


@_query("""SELECT image_id, CAST(seq - 1 AS INT) AS pos, category_name AS phrase, sk AS conf FROM fx_base""")
def exploded_pseudo_labels(spark, sf_dir):
    base = view(spark, sf_dir, "fx_base")
    raw = base.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("seq", "category_name", "sk"))).alias("o")).select("image_id", F.expr("transform(o, x -> x.category_name)").alias("phrase"), F.expr("transform(o, x -> x.sk)").alias("conf"))
    return sets.explode_pseudo(raw, ["phrase", "conf"], shortest=True)


@_query("""WITH s AS (SELECT image_id, lower(category_name) AS label, ann_id AS src, 1.0 AS score, 'annotations' AS kind FROM fx_annotations UNION ALL SELECT image_id, lower(category_name), det_id, score, 'external' FROM fx_detections)
    SELECT image_id, label, CAST(score AS DOUBLE) AS score, kind, CAST(row_number() OVER (PARTITION BY image_id, kind ORDER BY src) - 1 AS INT) AS src_idx FROM s""")
def detection_sources(spark, sf_dir):
    a = sets.detection_source("annotations", _anns(spark, sf_dir))
    d = view(spark, sf_dir, "fx_detections").withColumn("box", boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).withColumn("label", F.col("category_name"))
    return a.unionByName(sets.detection_source("external", d)).select("image_id", "label", "score", "kind", "src_idx")


_CASCADE = "CASE WHEN score < 0.3 THEN 'score' WHEN x1 < 0 OR y1 < 0 THEN 'bbox' WHEN (x2 - x1) * (y2 - y1) < 1500 THEN 'area' ELSE 'kept' END"


@_query(f"SELECT {_CASCADE} AS reason, count(*) AS n FROM fx_detections GROUP BY 1")
def rejection_funnel(spark, sf_dir):
    rules = [("score", F.col("score") < 0.3), ("bbox", F.expr("x1 < 0 OR y1 < 0")), ("area", F.expr("(x2 - x1) * (y2 - y1) < 1500"))]
    return sets.funnel_stats(sets.filter_cascade(view(spark, sf_dir, "fx_detections"), rules))


@_query("SELECT count(*) AS n, count(*) FILTER (score < 0.3) AS score, count(*) FILTER (x1 < 0 OR y1 < 0) AS bbox FROM fx_detections")
def gate_counters(spark, sf_dir):
    return sets.gate_counts(view(spark, sf_dir, "fx_detections"), {"score": F.col("score") >= 0.3, "bbox": F.expr("x1 >= 0 AND y1 >= 0")})


@_query("SELECT a.ann_id, CASE WHEN category_name IN ('PROMO', 'SMALL', 'LARGE') THEN length(category_name) ELSE 0 END AS category_id FROM fx_annotations a")
def categories_with_unknown(spark, sf_dir):
    cats = view(spark, sf_dir, "fx_base").select(F.col("category_name").alias("name")).distinct().where("name IN ('PROMO', 'SMALL', 'LARGE')").withColumn("category_id", F.length("name"))
    return sets.with_category(_anns(spark, sf_dir), cats, on_unknown="zero").select("ann_id", "category_id")


@_query("""WITH f AS (SELECT image_id FROM fx_detections WHERE score > 0.9) SELECT image_id FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM f)""")
def pending_images(spark, sf_dir):
    return sets.pending(view(spark, sf_dir, "fx_images"), view(spark, sf_dir, "fx_detections"), F.col("score") <= 0.9).select("image_id")


@_query("""SELECT image_id, 'a' AS side FROM (SELECT image_id FROM fx_annotations EXCEPT SELECT image_id FROM fx_detections) UNION ALL SELECT image_id, 'b' FROM (SELECT image_id FROM fx_detections EXCEPT SELECT image_id FROM fx_annotations)""")
def images_in_one_set(spark, sf_dir):
    return sets.only_in_one(view(spark, sf_dir, "fx_annotations"), view(spark, sf_dir, "fx_detections"), "image_id")


@_query("""WITH d AS (SELECT image_id, count(*) AS n FROM fx_detections GROUP BY 1), a AS (SELECT image_id, count(*) AS n FROM fx_annotations GROUP BY 1) SELECT image_id, coalesce(d.n, a.n) AS n FROM a FULL JOIN d USING (image_id)""")
def merged_shards(spark, sf_dir):
    """Counts of the annotations, overwritten by those of the detections."""
    a, d = (view(spark, sf_dir, v).groupBy("image_id").agg(F.count("*").alias("n")) for v in ("fx_annotations", "fx_detections"))
    return sets.merge_shards(a, d)


@_query("""SELECT image_id FROM fx_annotations UNION SELECT image_id FROM fx_detections""")
def image_universe(spark, sf_dir):
    return sets.universes(view(spark, sf_dir, "fx_annotations"), view(spark, sf_dir, "fx_detections"), column="image_id")


@_query("""SELECT image_id, true AS placeholder FROM fx_images WHERE image_id NOT IN (SELECT image_id FROM fx_annotations WHERE valid3d)""")
def placeholder_images(spark, sf_dir):
    return sets.placeholders(view(spark, sf_dir, "fx_images"), view(spark, sf_dir, "fx_annotations"))


@_query("""SELECT ann_id, valid3d, CASE WHEN valid3d THEN cxm ELSE 0 END AS x, CASE WHEN valid3d THEN czm ELSE -1 END AS z, CASE WHEN valid3d THEN l3 ELSE 1 END AS l FROM fx_annotations""")
def filled_annotations(spark, sf_dir):
    rows = _anns(spark, sf_dir).withColumn("center", geometry.vec(F.col("cxm"), F.col("cym"), F.col("czm"))).withColumn("dims", geometry.vec(F.col("w3"), F.col("h3"), F.col("l3")))
    out = sets.fill_invalid(rows, F.col("valid3d"))
    return out.select("ann_id", "valid3d", F.get("center", 0).alias("x"), F.get("center", 2).alias("z"), F.get("dims", 2).alias("l"))


_NAME = "(CASE WHEN p_partkey % 2 = 0 THEN '  ' || replace(p_name, ' ', '_') ELSE upper(p_name) || ' ' END)"


@_query("""WITH w AS (SELECT *, string_split(lower(p_name), ' ') AS ws FROM part)
    SELECT p_partkey, lower(p_name) AS norm, CASE WHEN ws[-1] = 'widget' AND len(ws) > 1 THEN 'gadget' ELSE ws[-1] END AS standard, len(ws) * (len(ws) + 1) // 2 AS spans, array_to_string(list_sort(flatten([[array_to_string(ws[i:j], ' ') FOR j IN range(i, len(ws) + 1)] FOR i IN range(1, len(ws) + 1)])), ';') AS each FROM w""")
def standard_labels(spark, sf_dir):
    """The last words of the names are the vocabulary, a table; a name whose last word is widget is mapped to gadget."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("raw", F.expr(_NAME))
    norm = labels.normalize_label(F.col("raw"))
    last = F.element_at(F.split(F.lower("p_name"), " "), -1)
    vocab = part.select(last.alias("name")).distinct()
    mapping = part.where("lower(p_name) LIKE '% widget'").select(F.lower("p_name").alias("phrase"), F.lit("gadget").alias("name")).distinct()
    named = vocabulary.standard_categories(part.select("p_partkey", norm.alias("label")), vocab, mapping)
    spans = labels.word_spans(F.col("label"))
    return named.select("p_partkey", F.col("label").alias("norm"), F.col("category").alias("standard"), F.size(spans).alias("spans"), F.array_join(F.array_sort(spans), ";").alias("each"))


@_query("""SELECT p_brand, 'Brand#' || lpad(substr(p_brand, 7), 2, '0') AS m, count(*) AS n FROM part GROUP BY 1, 2""")
def fuzzy_brands(spark, sf_dir):
    """Brand names to the closest name of the vocabulary, which has two digits in each."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand")
    two = F.concat(F.lit("Brand#"), F.lpad(F.substring("p_brand", 7, 9), 2, "0"))
    vocab = [r[0] for r in part.select(two).distinct().collect()]  # at most a hundred
    m = vocabulary.fuzzy_label(part.select(F.col("p_brand").alias("label")).distinct(), vocab)
    return part.join(m, F.col("p_brand") == F.col("label")).groupBy("p_brand", F.col("match").alias("m")).agg(F.count("*").alias("n"))


@_query("""WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
    d AS (SELECT vec_id, c.label, sum(x * m) AS s FROM e JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, arg_max(label::VARCHAR, s) AS name, round(exp(max(s)) / sum(exp(s)) + 1e-9, 5) AS score FROM d GROUP BY 1""")
def open_vocabulary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))
    classes = means.select(F.col("label").alias("name"), F.expr("transform(l, x -> x.m)").alias("e"))
    return vocabulary.open_vocab_assign(e, classes).select("vec_id", "name", F.round(F.col("score") + 1e-9, 5).alias("score"))


_FIELDS = ("cxm", "cym", "czm", "w3", "h3", "l3")
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, dataset_id, valid3d FROM a" for f in _FIELDS)


@_query(f"""WITH a AS (SELECT * FROM fx_annotations JOIN fx_images USING (image_id)), l AS ({_LONG})
    SELECT dataset_id, field, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS std, round(median(value) + 1e-9, 6) AS median FROM l GROUP BY 1, 2""")
def field_statistics(spark, sf_dir):
    out = stats.field_stats(_with_images(spark, sf_dir), list(_FIELDS), ["dataset_id"])
    return out.select("dataset_id", "field", "n", "min", "max", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"), _r(F.col("median")).alias("median"))


@_query("""WITH r AS (SELECT ann_id, unnest(list_filter([CASE WHEN greatest(abs(cxm), abs(cym), abs(czm)) > 20 THEN 'center_far' END, CASE WHEN sqrt(cxm * cxm + cym * cym + czm * czm) > 10 THEN 'distance' END, CASE WHEN greatest(w3, h3, l3) > 2.7 THEN 'dim_large' END, CASE WHEN cxm = -1 OR cym = -1 THEN 'missing_mark' END], lambda x: x IS NOT NULL)) AS rule FROM fx_annotations)
    SELECT rule, count(*) AS n, array_to_string(list_sort(list(ann_id))[1:3], ' ') AS samples FROM r GROUP BY 1""")
def anomalies(spark, sf_dir):
    rules = stats.usual_rules("cxm", "cym", "czm", "w3", "h3", "l3")
    far = F.sqrt(F.col("cxm") ** 2 + F.col("cym") ** 2 + F.col("czm") ** 2)
    rules = {"center_far": rules["center_far"], "distance": far > 10, "dim_large": F.greatest("w3", "h3", "l3") > 2.7, "missing_mark": F.expr("cxm = -1 OR cym = -1")}
    return stats.anomaly_report(_anns(spark, sf_dir), rules, "ann_id").withColumn("samples", F.array_join("samples", " "))


@_query("SELECT category_name AS category, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM fx_annotations) + 1e-9, 6) AS share FROM fx_annotations GROUP BY 1 ORDER BY n DESC, category LIMIT 4")
def category_counts(spark, sf_dir):
    out = stats.category_histogram(_anns(spark, sf_dir), top=4)
    return out.select("category", "n", _r(F.col("share")).alias("share"))


_FACTORS = """p AS (SELECT DISTINCT image_id, category_name FROM fx_annotations WHERE valid3d), f AS (SELECT category_name, greatest(1, sqrt(0.8 / (count(*)::DOUBLE / (SELECT count(*) FROM fx_images)))) AS f FROM p GROUP BY 1),
    b AS (SELECT image_id, max(f) AS f FROM p JOIN f USING (category_name) GROUP BY 1), rf AS (SELECT image_id, dataset_id, coalesce(f, 1) AS factor FROM fx_images LEFT JOIN b USING (image_id)),
    s AS (SELECT dataset_id, 1 - count(*)::DOUBLE / (SELECT count(*) FROM fx_images) AS w FROM fx_images GROUP BY 1), sw AS (SELECT dataset_id, w / (SELECT min(w) FROM s) AS weight FROM s)"""


@_query(f"WITH {_FACTORS}, x AS (SELECT image_id, factor, factor * weight AS w FROM rf JOIN sw USING (dataset_id)) SELECT image_id, round(factor + 1e-9, 6) AS factor, round(w / (SELECT min(w) FROM x) + 1e-9, 6) AS weight FROM x")
def sampling_of_images(spark, sf_dir):
    """Repeat factors, and their product with the sources' weights."""
    img = view(spark, sf_dir, "fx_images")
    recs = _anns(spark, sf_dir).select("image_id", F.when(F.col("valid3d"), F.crc32("category_name")).otherwise(-1).alias("category_id"))
    f = stats.repeat_factors(recs, img, 0.8)
    w = stats.sampling_weights(img, f, stats.source_weights(img))
    return f.join(w, "image_id").select("image_id", _r(F.col("factor")).alias("factor"), _r(F.col("weight")).alias("weight"))


_STATS_OF = lambda t: f"SELECT field, 'mean' AS stat, avg(value) AS value FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM {t}" for f in _FIELDS) + ") GROUP BY 1"


@_query(f"""WITH a AS ({_STATS_OF('fx_annotations')}), b AS ({_STATS_OF('fx_detections')}) SELECT field, stat, round(a.value + 1e-9, 6) AS a, round(b.value + 1e-9, 6) AS b, round(b.value - a.value + 1e-9, 6) AS delta, array_to_string(list_filter([CASE WHEN b.value / a.value > 2 OR b.value / a.value < 0.5 THEN 'ratio' END, CASE WHEN abs(b.value / a.value - 1) > 0.5 THEN 'ratio_off' END, CASE WHEN field LIKE 'c%' AND abs(b.value - a.value) > 1 THEN 'center_moved' END, CASE WHEN field LIKE 'c%' AND abs(b.value - a.value) > 5 THEN 'center_far_moved' END, CASE WHEN abs(b.value) > 10 THEN 'mean_large' END], lambda x: x IS NOT NULL), ',') AS findings FROM a FULL JOIN b USING (field, stat)""")
def drift_of_versions(spark, sf_dir):
    def long(name: str) -> DataFrame:
        return stats.field_stats(view(spark, sf_dir, name), list(_FIELDS), median=False).select("field", F.lit("mean").alias("stat"), F.col("mean").alias("value"))
    out = stats.drift_findings(stats.compare_versions(long("fx_annotations"), long("fx_detections"), ["field", "stat"]))
    return out.select("field", "stat", _r(F.col("a")).alias("a"), _r(F.col("b")).alias("b"), _r(F.col("delta")).alias("delta"), F.array_join("findings", ",").alias("findings"))


@_query("SELECT round(avg(w3) + 1e-9, 6) AS m0, round(avg(h3) + 1e-9, 6) AS m1, round(avg(l3) + 1e-9, 6) AS m2, avg(w3) >= avg(h3) AND avg(w3) >= avg(l3) AS first_is_longest, avg(l3) >= avg(w3) AND avg(l3) >= avg(h3) AS last_is_longest FROM fx_annotations")
def dimension_order(spark, sf_dir):
    out = stats.dimension_order_check(_anns(spark, sf_dir), "w3", "h3", "l3")
    return out.select(*(_r(F.col(c)).alias(c) for c in ("m0", "m1", "m2")), "first_is_longest", "last_is_longest")


@_query("SELECT ann_id, image_id FROM fx_annotations ORDER BY ann_id LIMIT 100")
def first_annotations(spark, sf_dir):
    return stats.sample_first(_anns(spark, sf_dir).select("ann_id", "image_id"), 100, "ann_id")


@_query("""WITH k AS (SELECT det_id, image_id, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS label, -ln((('0x' || substr(md5('0:' || det_id), 1, 10))::BIGINT + 0.5) / 1099511627776.0::DOUBLE) / greatest(score, 1e-9) AS k FROM fx_detections),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY k, det_id) AS r FROM k), f AS (SELECT image_id, count(*) AS n FROM r WHERE label = 1 AND r <= 2 GROUP BY 1)
    SELECT det_id, image_id, label FROM r LEFT JOIN f USING (image_id) WHERE (label = 1 AND r <= 2) OR (label = 0 AND r <= 4 - coalesce(n, 0))""")
def proposals_subsampled(spark, sf_dir):
    det = view(spark, sf_dir, "fx_detections").withColumn("label", (F.col("score") > 0.5).cast("int"))
    return stats.weighted_subsample(det, 4, 0.5, F.col("score")).select("det_id", "image_id", "label")


@_query("""SELECT category_name, count(*) AS n, round(avg(w3) + 1e-9, 6) AS w_mean, round(stddev_samp(w3) + 1e-9, 6) AS w_std, round(avg(czm) + 1e-9, 6) AS z_mean FROM fx_annotations GROUP BY 1 UNION ALL SELECT '<all>', count(*), round(avg(w3) + 1e-9, 6), round(stddev_samp(w3) + 1e-9, 6), round(avg(czm) + 1e-9, 6) FROM fx_annotations""")
def size_priors(spark, sf_dir):
    anns = _anns(spark, sf_dir)
    out = priors.compute_priors(anns, anns.select("category_name").distinct())
    return out.select("category_name", "n", _r(F.col("w3_mean")).alias("w_mean"), _r(F.col("w3_std")).alias("w_std"), _r(F.col("czm_mean")).alias("z_mean"))


@_query()
def depth_bins_of_sizes(spark, sf_dir):
    rows = _anns(spark, sf_dir).select("category_name", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2).alias("diagonal"), F.col("czm").alias("depth"))
    return priors.depth_bins(rows, 4)


def _cuboids(spark, sf_dir) -> DataFrame:
    rows = _with_images(spark, sf_dir).withColumn("center", geometry.vec(F.col("cxm"), F.col("cym"), F.col("czm"))).withColumn("dims", geometry.vec(F.col("w3"), F.col("h3"), F.col("l3")))
    return rows.withColumn("corners", geometry.box_corners(F.col("center"), F.col("dims")))


def _camera():
    return [F.col(c) for c in ("fx", "fy", "cx", "cy")]


_PROJ = """k AS (SELECT a.*, i.width, i.height, i.dataset_id, i.fx, i.fy, i.cx, i.cy FROM fx_annotations a JOIN fx_images i USING (image_id)),
    q AS (SELECT *, czm - w3 / 2 AS zn, czm + w3 / 2 AS zf FROM k),
    r AS (SELECT *, least(fx * (cxm - l3 / 2) / zn, fx * (cxm - l3 / 2) / zf) + cx AS rx1, greatest(fx * (cxm + l3 / 2) / zn, fx * (cxm + l3 / 2) / zf) + cx AS rx2, least(fy * (cym - h3 / 2) / zn, fy * (cym - h3 / 2) / zf) + cy AS ry1, greatest(fy * (cym + h3 / 2) / zn, fy * (cym + h3 / 2) / zf) + cy AS ry2 FROM q WHERE zn > 0.05),
    p AS (SELECT *, greatest(least(rx1, width - 1), 0) AS px1, greatest(least(rx2, width - 1), 0) AS px2, greatest(least(ry1, height - 1), 0) AS py1, greatest(least(ry2, height - 1), 0) AS py2 FROM r)"""


@_query(f"WITH {_PROJ} SELECT ann_id, round(px1 + 1e-9, 4) AS px1, round(py1 + 1e-9, 4) AS py1, round(px2 + 1e-9, 4) AS px2, round(py2 + 1e-9, 4) AS py2, round(1 - (px2 - px1) * (py2 - py1) / ((rx2 - rx1) * (ry2 - ry1)) + 1e-9, 5) AS truncated FROM p WHERE px2 > px1 AND py2 > py1")
def projected_boxes(spark, sf_dir):
    rows = _cuboids(spark, sf_dir)
    rows = rows.withColumn("p", geometry.project_box(F.col("corners"), *_camera(), F.col("width"), F.col("height"), near=0.05)["clipped"]).where("p IS NOT NULL")
    cut = geometry.truncation(F.col("corners"), *_camera(), F.col("width"), F.col("height"))
    return rows.select("ann_id", *(F.round(F.get("p", i) + 1e-9, 4).alias(n) for i, n in enumerate(("px1", "py1", "px2", "py2"))), F.round(cut + 1e-9, 5).alias("truncated"))


@_query(f"""WITH {_PROJ}, m AS (SELECT ann_id, greatest(least(px2, x2) - greatest(px1, x1), 0) * greatest(least(py2, y2) - greatest(py1, y1), 0) AS i, (px2 - px1) * (py2 - py1) AS pa, (x2 - x1) * (y2 - y1) AS ta, sqrt(power((px1 + px2) / 2 - (x1 + x2) / 2, 2) + power((py1 + py2) / 2 - (y1 + y2) / 2, 2)) / sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS o FROM p WHERE px2 > px1 AND py2 > py1)
    SELECT ann_id, round(i / (pa + ta - i) + 1e-9, 5) AS iou, round(o + 1e-9, 5) AS centre_offset, round(pa / ta + 1e-9, 5) AS area_ratio, (i / (pa + ta - i) >= 0.15 AND o <= 0.5 AND pa / ta BETWEEN 0.2 AND 5) AS ok FROM m""")
def projection_gate(spark, sf_dir):
    rows = _cuboids(spark, sf_dir).withColumn("p", geometry.project_box(F.col("corners"), *_camera(), F.col("width"), F.col("height"), near=0.05)["clipped"]).where("p IS NOT NULL")
    rows = rows.withColumn("m", boxes.alignment_metrics(F.col("p"), F.col("box")))
    return rows.select("ann_id", *(F.round(F.col(f"m.{c}") + 1e-9, 5).alias(c) for c in ("iou", "centre_offset", "area_ratio")), gates.gate_projection(F.col("m")).alias("ok"))


@_query("""WITH c AS (SELECT g.*, xs * (gx + sx * gl / 2) AS x, gy + sy * gh / 2 AS y, gz + sz * gw / 2 AS z FROM fx_gated g, (VALUES (-1), (1)) a(sx), (VALUES (-1), (1)) b(sy), (VALUES (-1), (1)) d(sz)),
    u AS (SELECT *, CASE WHEN z <> 0 THEN fx * x / z + cx END AS u, CASE WHEN z <> 0 THEN fy * y / z + cy END AS v FROM c),
    e AS (SELECT ann_id, any_value(m) AS m, any_value(ncor) AS ncor, any_value(gx) AS gx, any_value(gz) AS gz, any_value(gw) AS gw, any_value(gh) AS gh, any_value(gl) AS gl, min(z) AS zn, bool_and(isfinite(x)) AS sound, bool_and(isfinite(u) AND isfinite(v)) AS fin, max(greatest(abs(u), abs(v))) AS far,
        greatest(least(min(u), any_value(width) - 1), 0) AS px1, greatest(least(max(u), any_value(width) - 1), 0) AS px2, greatest(least(min(v), any_value(height) - 1), 0) AS py1, greatest(least(max(v), any_value(height) - 1), 0) AS py2 FROM u GROUP BY 1),
    s AS (SELECT *, px2 - px1 AS w, py2 - py1 AS h, (px1 + px2) / 2 AS mx, (py1 + py2) / 2 AS my FROM e),
    t AS (SELECT *, CASE m WHEN 10 THEN -900 WHEN 12 THEN mx - 2.5 * w WHEN 13 THEN mx - 0.095 * w ELSE px1 END AS tx1, CASE m WHEN 10 THEN -900 WHEN 12 THEN my - 2.5 * h WHEN 13 THEN my - 0.095 * h ELSE py1 END AS ty1,
        CASE m WHEN 10 THEN -800 WHEN 11 THEN px1 + 0.2 * w WHEN 12 THEN mx + 2.5 * w WHEN 13 THEN mx + 0.095 * w ELSE px2 END AS tx2, CASE m WHEN 10 THEN -800 WHEN 11 THEN py1 + 0.2 * h WHEN 12 THEN my + 2.5 * h WHEN 13 THEN my + 0.095 * h ELSE py2 END AS ty2 FROM s),
    i AS (SELECT *, w * h AS pa, (tx2 - tx1) * (ty2 - ty1) AS ta, greatest(least(px2, tx2) - greatest(px1, tx1), 0) * greatest(least(py2, ty2) - greatest(py1, ty1), 0) AS ia,
        sqrt(power(mx - (tx1 + tx2) / 2, 2) + power(my - (ty1 + ty2) / 2, 2)) / sqrt(power(tx2 - tx1, 2) + power(ty2 - ty1, 2)) AS away FROM t)
    SELECT ann_id, CASE WHEN ncor <> 8 THEN 'bad_bbox3d_shape' WHEN NOT sound THEN 'nonfinite_3d' WHEN gz <= 0 OR least(gw, gh, gl) <= 0 THEN 'bad_center_or_dim' WHEN zn <= 0.5 THEN 'corner_too_close' WHEN greatest(gw, gh, gl) > 8 THEN 'dim_abs_too_large'
        WHEN NOT fin THEN 'project_nonfinite' WHEN far > 5000 THEN 'project_too_large' WHEN w <= 0 OR h <= 0 THEN 'project_clipped_bad' WHEN ia / (pa + ta - ia) < 0.03 THEN 'project_iou' WHEN away > 1 THEN 'project_center'
        WHEN pa / ta < 0.05 THEN 'project_area_small' WHEN pa / ta > 20 THEN 'project_area_large' WHEN m = 14 THEN 'axis_prior_ratio' WHEN m = 15 THEN 'volume_prior_ratio' END AS reason FROM i""")
def geometry_gate(spark, sf_dir):
    """The first reason against each box of a table in which boxes break one rule each. A depth of zero is always too close first."""
    rows = view(spark, sf_dir, "fx_gated").withColumn("center", geometry.vec(F.col("gx"), F.col("gy"), F.col("gz"))).withColumn("dims", geometry.vec(F.col("gw"), F.col("gh"), F.col("gl")))
    rows = rows.withColumn("corners", F.slice(F.transform(geometry.box_corners(F.col("center"), F.col("dims")), lambda p: F.array(p[0] * F.col("xs"), p[1], p[2])), F.lit(1), F.col("ncor")))
    rows = rows.withColumn("p", geometry.project_box(F.col("corners"), *_camera(), F.col("width"), F.col("height"))["clipped"])
    x1, y1, x2, y2 = boxes.parts(F.col("p"))
    w, h, (mx, my) = x2 - x1, y2 - y1, boxes.centre(F.col("p"))
    around = lambda k: boxes.box(mx - k * w, my - k * h, mx + k * w, my + k * h)
    target = F.when(F.col("m") == 10, boxes.box(-900.0, -900.0, -800.0, -800.0)).when(F.col("m") == 11, boxes.box(x1, y1, x1 + 0.2 * w, y1 + 0.2 * h)).when(F.col("m") == 12, around(2.5)).when(F.col("m") == 13, around(0.095)).otherwise(F.col("p"))
    part = F.when(F.col("m") == 14, 10.0).when(F.col("m") == 15, 4.0).otherwise(1.0)
    prior = F.array(*(F.col(c) / part for c in ("gl", "gh", "gw")))
    return gates.gate_geometry(rows.withColumn("target", target), prior).select("ann_id", "reason")


@_query("""WITH v AS (SELECT ann_id, greatest(0.35 / (w3 / 1.2), w3 / 1.2 / 3, 0.35 / h3, h3 / 3, 0.35 / (l3 / 1.6), l3 / 1.6 / 3) AS a, greatest(0.35 / (w3 / 1.6), w3 / 1.6 / 3, 0.35 / h3, h3 / 3, 0.35 / (l3 / 1.2), l3 / 1.2 / 3) AS b,
    w3 / 1.2 BETWEEN 0.35 AND 3 AND h3 BETWEEN 0.35 AND 3 AND l3 / 1.6 BETWEEN 0.35 AND 3 AS oa, w3 / 1.6 BETWEEN 0.35 AND 3 AND h3 BETWEEN 0.35 AND 3 AND l3 / 1.2 BETWEEN 0.35 AND 3 AS ob FROM fx_annotations)
    SELECT ann_id, round(least(a, b) + 1e-9, 6) AS violation, CASE WHEN a <= b THEN oa ELSE ob END AS ok FROM v""")
def prior_gate(spark, sf_dir):
    rows = _cuboids(spark, sf_dir).withColumn("g", gates.gate_prior(F.col("dims"), boxes.box(1.2, 1.0, 1.6)))
    return rows.select("ann_id", _r(F.col("g.violation")).alias("violation"), F.col("g.ok").alias("ok"))


@_query("""WITH d AS (SELECT ann_id, cym, greatest(h3, CASE WHEN h3 < 0.5 * 1.8 THEN 1.8 ELSE h3 END) AS h, abs(cym + h3 / 2 - 1.5) AS lo1, abs(cym - h3 / 2 - 1.5) AS lo2 FROM fx_annotations)
    SELECT ann_id, least(lo1, lo2) <= 0.55 AS ground_ok, h AS new_h, abs(1.5 - (cym + h / 2)) <= 0.55 AS snapped, round(CASE WHEN abs(1.5 - (cym + h / 2)) <= 0.55 THEN 1.5 - h / 2 ELSE cym END + 1e-9, 6) AS y FROM d""")
def ground_gate_and_repair(spark, sf_dir):
    """Every box as a chair on the plane y = 1.5 (up is -y), with a prior height of 1.8."""
    plane, rows = F.array(*(F.lit(v) for v in (0.0, -1.0, 0.0, 1.5))), _cuboids(spark, sf_dir)
    rows = rows.withColumn("ground_ok", gates.gate_ground(F.lit("chair"), F.col("corners"), plane)).withColumn("label", F.lit("chair"))
    rows = gates.repair_box(rows, boxes.box(0.1, 1.8, 0.1), plane)
    return rows.select("ann_id", "ground_ok", F.get("dims", 1).alias("new_h"), "snapped", _r(F.get("center", 1)).alias("y"))


@_query("""WITH t AS (SELECT ann_id, least(greatest(0.35 * visibility + 0.25 * least(truncation / 0.2, 1) + 0.25 * least(w3, 1) + 0.15 * (1 - least(h3 / 0.5, 1)) - 0.1 * least(greatest(l3 - 1, 0), 2) - 0.15 * CASE WHEN NOT valid3d THEN 0.5 ELSE 0 END, 0), 1) AS q FROM fx_annotations)
    SELECT ann_id, round(q + 1e-9, 6) AS quality, q >= 0.4 AS ok FROM t""")
def quality_of_boxes(spark, sf_dir):
    q = gates.quality_score(F.col("visibility"), F.col("truncation"), F.col("w3"), F.col("h3"), F.col("l3"), ~F.col("valid3d"))
    return _anns(spark, sf_dir).select("ann_id", _r(q).alias("quality"), (q >= gates.quality_threshold(F.col("category_name"))).alias("ok"))


@_query("""SELECT ann_id, round(CASE WHEN abs(s) < 1e-3 THEN 0 ELSE s END + 1e-9, 6) AS shift, round(CASE WHEN w3 / h3 BETWEEN 0.4 AND 2.5 AND abs(ln(w3 / h3)) >= 0.03 THEN w3 / h3 END + 1e-9, 6) AS rescale, round(greatest(4 * l3, 0.25) + 1e-9, 6) AS most_l,
        round(CASE WHEN sqrt(w3 / h3) BETWEEN 0.6 AND 2 AND abs(ln(sqrt(w3 / h3))) >= 0.03 THEN sqrt(w3 / h3) END + 1e-9, 6) AS silhouette, round(CASE WHEN abs(h3 + 1) >= 0.03 AND (w3 + 1) / (h3 + 1) BETWEEN 0.5 AND 2 AND abs(ln((w3 + 1) / (h3 + 1))) >= 0.03 THEN (w3 + 1) / (h3 + 1) END + 1e-9, 6) AS refined
    FROM (SELECT *, greatest(least(w3 + w3 / 2 - 1, 0.25 * czm), -0.25 * czm) AS s FROM fx_annotations) a""")
def depth_refinement(spark, sf_dir):
    """A median depth of centre plus width less one, front offset half the width."""
    shift = gates.refine_depth(F.col("czm"), F.col("czm") - F.col("w3") / 2, F.col("czm") + F.col("w3") - 1)
    return _anns(spark, sf_dir).select("ann_id", _r(shift).alias("shift"), _r(gates.depth_rescale("median", F.col("w3"), F.col("h3"))).alias("rescale"), _r(F.get(gates.category_bounds(F.array("w3", "h3", "l3"))["most"], 2)).alias("most_l"),
        _r(gates.depth_rescale("silhouette", F.col("w3"), F.col("h3"))).alias("silhouette"), _r(gates.depth_rescale("refined", F.col("w3") + 1, F.col("h3") + 1, F.lit(0.0))).alias("refined"))


@_query("""SELECT det_id, CASE WHEN w3 - 1 >= 0.15 THEN round((score + w3 - 1) / 2 + 1e-9, 6) END AS fused, round(sqrt(score * exp(-w3)) + 1e-9, 6) AS uncertain FROM fx_detections""")
def fused_scores(spark, sf_dir):
    return view(spark, sf_dir, "fx_detections").select("det_id", _r(boxes.fuse_scores(F.col("score"), F.col("w3") - 1)).alias("fused"), _r(boxes.fuse_scores(F.col("score"), F.col("w3"), "uncertainty")).alias("uncertain"))


@_query("""SELECT ann_id, round(czm * 512 * fy / (512 * height) + 1e-9, 6) AS vdepth, round(least(512.0 / least(width, height), 4096.0 / greatest(width, height)) + 1e-9, 6) AS scale, fx * 0.5 AS sfx, cy * 0.25 AS scy, width - x2 AS mx1, -cxm AS mcx FROM fx_annotations JOIN fx_images USING (image_id)""")
def camera_columns(spark, sf_dir):
    """Virtual depth, resize factor, scaled intrinsics and mirrored boxes."""
    k = geometry.scale_intrinsics(*_camera(), F.lit(0.5), F.lit(0.25))
    rows = _cuboids(spark, sf_dir)
    return rows.select("ann_id", _r(geometry.virtual_depth(F.col("czm"), F.col("fy"), F.col("height"))).alias("vdepth"), _r(geometry.eval_scale(F.col("width"), F.col("height"))).alias("scale"), k["fx"].alias("sfx"), k["cy"].alias("scy"), F.get(boxes.mirror_box(F.col("box"), F.col("width").cast("double")), 0).alias("mx1"), F.get(geometry.mirror_center(F.col("center")), 0).alias("mcx"))


@_query("""WITH a AS (SELECT ann_id, (pk * 0.1) AS t, cxm, cym, czm FROM fx_annotations JOIN (SELECT image_id * 64 + seq AS ann_id, pk FROM fx_base) b USING (ann_id))
    SELECT ann_id, round(cos(t) * cxm - sin(t) * (czm - 1) + 1e-9, 5) AS x, round(sin(t) * cxm + cos(t) * (czm - 1) + 1e-9, 5) AS z, round(t - floor(t / pi()) * pi() + 1e-9, 5) AS yaw, true AS valid, round(acos(greatest(least((1 + 2 * cos(t) - 1) / 2, 1), -1)) + 1e-9, 5) AS angle FROM a""")
def rotated_frames(spark, sf_dir):
    """World to camera by a pose turned about y, with the rotation's yaw, validity and angle."""
    key = view(spark, sf_dir, "fx_base").select((F.col("image_id") * 64 + F.col("seq")).alias("ann_id"), (F.col("pk") * 0.1).alias("t"))
    rows = _cuboids(spark, sf_dir).join(key, "ann_id").withColumn("r", geometry.rotate_y(F.col("t")))
    p = geometry.world_to_camera(F.col("center"), F.col("r"), geometry.vec(0, 0, 1))
    return rows.select("ann_id", F.round(F.get(p, 0) + 1e-9, 5).alias("x"), F.round(F.get(p, 2) + 1e-9, 5).alias("z"), F.round(geometry.yaw_mod_pi(F.col("t")) + 1e-9, 5).alias("yaw"), geometry.rotation_valid(F.col("r")).alias("valid"), F.round(geometry.rotation_angle(F.col("r"), geometry.identity()) + 1e-9, 5).alias("angle"))


_PATHS = "'/data/' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '_val' WHEN 1 THEN '_train' ELSE '' END || '.json'"
_SCALARS = "CASE p_partkey % 4 WHEN 0 THEN '[[0.' || p_size || ']]' WHEN 1 THEN '[' || p_size || ']' WHEN 2 THEN '[]' ELSE '-1.5e1' END"


@_query(f"""WITH p AS (SELECT *, {_PATHS} AS path, string_split(p_name, ' ')[-1] || '_' || p_size || '.ply' AS file FROM part)
    SELECT p_partkey, lower(trim(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END)) AS label, CASE p_partkey % 4 WHEN 0 THEN ('0.' || p_size)::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN 0 ELSE -15 END AS scalar,
           CASE p_partkey % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'train' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'test' ELSE 'train' END END AS split, replace(p_brand, '#', '_') AS safe, replace(replace(path, '/data/', ''), '.json', '') AS stem, '.json' AS ext,
           string_split(p_name, ' ')[-1] AS word, p_size::INT AS idx, lower(p_type) IN ('economy', 'small') AS in_prompt FROM p""")
def label_records(spark, sf_dir):
    """Labels, wrapped scalars, splits, parts of paths and file names of raw records."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("path", F.expr(_PATHS)).withColumn("file", F.expr("element_at(split(p_name, ' '), -1) || '_' || p_size || '.ply'"))
    named = labels.label_and_index(F.col("file"))
    return p.select(
        "p_partkey", labels.resolve_label(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name")), F.col("p_type")).alias("label"), labels.unwrap_scalar(F.expr(_SCALARS)).alias("scalar"),
        labels.infer_split(F.col("path"), F.when(F.col("p_partkey") % 2 == 0, "test")).alias("split"), labels.safe_name(F.col("p_brand")).alias("safe"), labels.path_stem(F.col("path")).alias("stem"), labels.path_extension(F.col("path")).alias("ext"),
        named["label"].alias("word"), named["idx"].alias("idx"), labels.in_prompt(F.col("p_type"), "Economy. small.").alias("in_prompt"),
    )


@_query("""SELECT ann_id, cxm <> -1 AS corner, valid3d AS dimension, valid3d AND czm - 3 > 0 AND tx_ok AS geometry FROM (SELECT *, truncation < 0.4 AS tx_ok FROM fx_annotations) a""")
def valid_policies(spark, sf_dir):
    """The three policies of a valid 3D box."""
    rows = _anns(spark, sf_dir).withColumn("dims", F.when(F.col("valid3d"), F.array("w3", "h3", "l3")).otherwise(F.array(F.lit(-1.0), F.col("h3"), F.col("l3"))))
    reason = F.when(F.col("truncation") < 0.4, "valid_render_back").otherwise("render_failed")
    return rows.select("ann_id", *(sets.valid3d(p, F.col("dims"), F.col("czm") - 3, F.col("cxm"), reason).alias(p) for p in ("corner", "dimension", "geometry")))


@_query("""SELECT ann_id, (truncation >= 0.08 OR visibility >= 0.15) AND CASE WHEN x2 - x1 >= 24 THEN w3 - 0.5 <= 0.35 ELSE truncation >= 0.16 END AS ok, visibility >= 0.25 AND truncation >= 0.18 AND h3 >= 0.25 AND x2 - x1 >= 24 AND w3 - 0.5 <= 0.2 AS strict FROM fx_annotations""")
def alignment_gates(spark, sf_dir):
    rows, err, px = _anns(spark, sf_dir), F.col("w3") - 0.5, F.col("x2") - F.col("x1")
    return rows.select("ann_id", gates.gate_alignment(F.col("truncation"), F.col("visibility"), err, px).alias("ok"), gates.gate_alignment_strict(F.col("truncation"), err, px, F.col("visibility"), F.col("h3")).alias("strict"))


@_query("""WITH p AS (SELECT p_type, avg(p_size) AS w FROM part WHERE p_type <> 'SMALL' GROUP BY 1), d AS (SELECT DISTINCT image_id FROM fx_detections)
    SELECT ann_id, round(coalesce(w, 0.5) + 1e-9, 6) AS pw FROM fx_annotations a LEFT JOIN p ON p_type = category_name WHERE category_name IN ('ECONOMY', 'SMALL') AND image_id IN (SELECT image_id FROM d)""")
def vocabulary_with_priors(spark, sf_dir):
    """Annotations of a vocabulary, on images that have pseudo labels, with their category's prior."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_type <> 'SMALL'").groupBy(F.lower("p_type").alias("category_name")).agg(F.avg("p_size").alias("w"))
    p = p.select("category_name", "w", F.lit(1.0).alias("h"), F.lit(1.0).alias("l"))
    names = _anns(spark, sf_dir).select(F.col("category_name").alias("name")).where("name IN ('ECONOMY', 'SMALL')").distinct()
    images = sets.with_pseudo_labels(view(spark, sf_dir, "fx_images"), view(spark, sf_dir, "fx_detections"))
    rows = sets.vocabulary_filter(_anns(spark, sf_dir), names).join(images.select("image_id"), "image_id")
    return sets.with_prior(rows, p).select("ann_id", _r(F.col("pw")).alias("pw"))


_FILE = "CASE p_partkey % 4 WHEN 0 THEN w || '_' || i || '.ply' WHEN 1 THEN w || '.ply' WHEN 2 THEN w || '_' || i || '.glb' ELSE 'object_' || i || '.ply' END"


@_query(f"""WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[-1] AS w, p_size % 9 AS i FROM part), l AS (SELECT DISTINCT {_FILE} AS name FROM p WHERE p_partkey % 10 = 0)
    SELECT p_partkey AS image_id, '/m/' || coalesce((SELECT name FROM l WHERE name = w || '_' || i || '.ply'), (SELECT name FROM l WHERE name = w || '.ply'), (SELECT name FROM l WHERE name = w || '_' || i || '.glb'), (SELECT name FROM l WHERE name = 'object_' || i || '.ply')) AS path FROM p""")
def matched_files(spark, sf_dir):
    """Mesh files of objects by the priority of their names; the listing comes from a tenth of the parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("element_at(split(p_name, ' '), -1)").alias("w"), (F.col("p_size") % 9).alias("i"))
    listing = p.where("p_partkey % 10 = 0").select(F.expr(_FILE).alias("name")).distinct().withColumn("path", F.concat(F.lit("/m/"), "name"))
    return sets.match_files(p.select(F.col("p_partkey").alias("image_id"), F.col("w").alias("phrase"), F.col("i").alias("idx")), listing).select("image_id", "path")


@_query("""SELECT count(*) AS n, count(*) FILTER (category_name IN ('ECONOMY', 'SMALL')) AS in_vocabulary, max(score) AS best, round(sum(score) + 1e-9, 4) AS csv_sum, round(sum(x1) + 1e-9, 4) AS json_sum FROM fx_detections""")
def stored_detections(spark, sf_dir):
    """Detections through every sink and back: Parquet with a vocabulary, CSV, JSON lines, and a record of statistics."""
    det, at = view(spark, sf_dir, "fx_detections"), shared_path(spark, "stored")
    names = det.select(F.col("category_name").alias("name")).where("name IN ('ECONOMY', 'SMALL')").distinct()
    documents.write_predictions(det, f"{at}/own", names)
    documents.write_flat(det.select("det_id", "score"), f"{at}/csv")
    documents.write_flat(det.select("det_id", "x1"), f"{at}/json", "json")
    documents.write_stats(stats.stats_record(det, {"n": F.count("*"), "best": F.max("score")}), f"{at}/stats")
    csv = spark.read.schema("det_id long, score double").option("header", True).csv(f"{at}/csv").agg(F.round(F.sum("score") + 1e-9, 4).alias("csv_sum"))
    lines = spark.read.schema("det_id long, x1 double").json(f"{at}/json").agg(F.round(F.sum("x1") + 1e-9, 4).alias("json_sum"))
    own = spark.read.parquet(f"{at}/own").agg(F.count("*").alias("in_vocabulary"))
    return documents.read_stats(spark, f"{at}/stats", "n long, best double").crossJoin(own).crossJoin(csv).crossJoin(lines)  # one row each


@_query("""SELECT ann_id, width - x2 AS mx1, width - x1 AS mx2, y1 AS my1, round(width - (fx * cxm / czm + cx) + 1e-9, 6) AS mu, -cxm AS mcx, czm AS mcz, round(-(cxm - l3 / 2) + 1e-9, 6) AS corner_x, width - cx AS mcx0,
    round(-cos(czm) + 1e-9, 6) AS m00, round(sin(czm) + 1e-9, 6) AS m02, 1.0::DOUBLE AS m11, round(-sin(czm) + 1e-9, 6) AS m20, round(-cos(czm) + 1e-9, 6) AS m22 FROM fx_annotations JOIN fx_images USING (image_id)""")
def mirrored_annotations(spark, sf_dir):
    """A flipped set: boxes, projected centre, centre, the smallest corner, pose, and the images' principal point."""
    images = view(spark, sf_dir, "fx_images")
    rows = _cuboids(spark, sf_dir)
    centre = F.array(F.col("fx") * F.col("cxm") / F.col("czm") + F.col("cx"), F.col("fy") * F.col("cym") / F.col("czm") + F.col("cy"))
    anns = rows.select("ann_id", "image_id", "box", centre.alias("center_proj"), F.col("center").alias("center_cam"), F.col("corners").alias("bbox3D_cam"), geometry.rotate_y(F.col("czm")).alias("R_cam"))
    out = sets.mirror_annotations(anns, images).join(sets.mirror_images(images).select("image_id", F.col("cx").alias("mcx0")), "image_id")
    pose = {f"m{i}{j}": _r(F.get(F.get("R_cam", i), j)) for i, j in ((0, 0), (0, 2), (1, 1), (2, 0), (2, 2))}
    low = F.array_max(F.transform("bbox3D_cam", lambda p: F.get(p, 0)))
    return out.select("ann_id", F.get("box", 0).alias("mx1"), F.get("box", 2).alias("mx2"), F.get("box", 1).alias("my1"), _r(F.get("center_proj", 0)).alias("mu"), F.get("center_cam", 0).alias("mcx"), F.get("center_cam", 2).alias("mcz"), _r(low).alias("corner_x"), "mcx0", *(v.alias(k) for k, v in pose.items()))


@_query("""SELECT ann_id, ann_id % 3 = 0 AS valid FROM fx_annotations""")
def valid_boxes(spark, sf_dir):
    """Whether a box has eight corners with flat faces: one in three has a corner moved, one in three no width."""
    rows = _cuboids(spark, sf_dir).withColumn("kind", F.col("ann_id") % 3)
    flat = geometry.box_corners(F.col("center"), F.array(F.lit(0.0), F.col("h3"), F.col("l3")))
    moved = F.transform("corners", lambda p, i: F.when(i == 6, F.array(p[0], p[1] + 0.5, p[2])).otherwise(p))
    rows = rows.select("ann_id", F.when(F.col("kind") == 1, moved).when(F.col("kind") == 2, flat).otherwise(F.col("corners")).alias("c"))
    return rows.select("ann_id", geometry.box3d_valid(F.col("c")).alias("valid"))


@_query("""WITH d AS (SELECT ann_id, ((x1 + x2) / 2 - cx) / fx AS x, ((y1 + y2) / 2 - cy) / fy AS y FROM fx_annotations JOIN fx_images USING (image_id)), n AS (SELECT ann_id, x / sqrt(x * x + y * y + 1) AS x, y / sqrt(x * x + y * y + 1) AS y, 1 / sqrt(x * x + y * y + 1) AS z FROM d)
    SELECT ann_id, round(1 - x * x / (1 + z) + 1e-9, 5) AS m00, round(-x * y / (1 + z) + 1e-9, 5) AS m10, round(x + 1e-9, 5) AS m20, round(y + 1e-9, 5) AS m21, round(z + 1e-9, 5) AS m22, 0.0::DOUBLE AS back FROM n""")
def allocentric_poses(spark, sf_dir):
    """The pose of a box that faces the camera's axis, seen along the ray through its 2D box, and how far there and back again is from it."""
    u, v = boxes.centre(F.col("box"))
    one = geometry.rotate_y(F.lit(0.0))
    rows = _cuboids(spark, sf_dir).withColumn("m", geometry.to_allocentric(one, u, v, *_camera())).withColumn("b", geometry.from_allocentric(F.col("m"), u, v, *_camera()))
    far = F.greatest(F.lit(0.0), *(F.abs(geometry.at(F.col("b"), i, j) - geometry.at(one, i, j)) for i in range(3) for j in range(3)))
    return rows.select("ann_id", *(F.round(F.get(F.get("m", i), j) + 1e-9, 5).alias(f"m{i}{j}") for i, j in ((0, 0), (1, 0), (2, 0), (2, 1), (2, 2))), F.round(far, 9).alias("back"))
