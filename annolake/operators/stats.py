"""Statistics, anomalies, drift and sampling weights of annotation sets."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.sources.shared import settled


def field_stats(df: DataFrame, fields: list[str], by: list[str] | None = None, median: bool = True) -> DataFrame:
    """(by, field, n, min, max, mean, std, median): std over the population, the median exact. Nulls are not counted; NaN is the largest value. The median, the only one that needs an order, can be left out."""
    by = by or []
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    long = df.select(*by, F.expr(f"stack({len(fields)}, {pairs}) AS (field, value)")).where("value IS NOT NULL")
    own = long.groupBy(*by, "field").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return _joined(own, medians(long, [*by, "field"], "value"), [*by, "field"]) if median else own


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined by keys of which null equals null; the keys are kept once."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = functools.reduce(operator.and_, (left[k].eqNullSafe(right[f"_{k}"]) for k in keys))
    return left.join(right, same, how).drop(*(f"_{k}" for k in keys))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) of the values that are not null, exact; the mean of the middle two where their number is even.

    Values are counted and range-partitioned, so that many tasks share a group of any size. A table with a row
    for each group and range tells which ranges hold the middle ranks; only these are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = settled(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "values")
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_here"))
    ranges = ranges.select(*keys, "_range", "_here", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(group).alias("_n"))
    ranges = ranges.withColumn("_lo", F.expr("(_n - 1) DIV 2")).withColumn("_hi", F.expr("_n DIV 2"))
    ranges = ranges.where((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_here") > F.col("_lo"))).drop("_here", "_n")
    rows = _joined(ranged, ranges, [*keys, "_range"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    middle = rows.withColumn("_upto", upto).where((F.col("_upto") > F.col("_lo")) & (F.col("_upto") - F.col("_c") <= F.col("_hi")))
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def anomaly_report(df: DataFrame, rules: dict[str, Column], key: str, samples: int = 3) -> DataFrame:
    """(rule, n, samples): rows that each named rule catches, with the first keys."""
    caught = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    rows = df.select(F.col(key).alias("key"), F.explode(caught).alias("rule"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).where(F.col("r") <= samples)
    return rows.groupBy("rule").agg(F.count("*").alias("n")).join(first.groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("samples")), "rule")


def usual_rules(x: str, y: str, z: str, w: str, h: str, length: str, score: str | None = None) -> dict[str, Column]:
    """The named rules on centres and dimensions."""
    c, d = [F.col(v) for v in (x, y, z)], [F.col(v) for v in (w, h, length)]
    far = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
    rules = {
        "center_far": F.greatest(*(F.abs(v) for v in c)) > 20,
        "distance": far > 15,
        "dim_range": (F.least(*d) < 0.01) | (F.greatest(*d) > 10),
        "dim_large": F.greatest(*d) > 5,
        "dim_not_positive": F.least(*d) <= 0,
        "depth_negative": c[2] < 0,
        "missing_mark": F.array_contains(F.array(*c, *d), F.lit(-1.0)),
    }
    if score:
        rules["score_range"] = ~F.col(score).between(0, 1)
    return rules


def category_histogram(df: DataFrame, column: str = "category_name", top: int | None = None) -> DataFrame:
    """(category, n, share), most frequent first, names breaking ties."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    out = counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select("category", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row
    return out.orderBy(F.desc("n"), "category").limit(top) if top else out


def repeat_factors(records: DataFrame, images: DataFrame, threshold: float) -> DataFrame:
    """(image_id, factor): the largest factor of an image's categories, at least 1. records: image_id, category_id; negative ids are skipped."""
    pairs = records.where("category_id >= 0").select("image_id", "category_id").distinct()
    n = F.broadcast(images.agg(F.count("*").alias("_n")))
    freq = pairs.groupBy("category_id").agg(F.count("*").alias("c")).crossJoin(n)
    factor = freq.select("category_id", F.greatest(F.lit(1.0), F.sqrt(threshold / (F.col("c") / F.col("_n")))).alias("f"))
    best = pairs.join(F.broadcast(factor), "category_id").groupBy("image_id").agg(F.max("f").alias("f"))
    return images.select("image_id").join(best, "image_id", "left").select("image_id", F.coalesce("f", F.lit(1.0)).alias("factor"))


def source_weights(images: DataFrame, source_col: str = "dataset_id") -> DataFrame:
    """(source, weight): 1 - n / N over the smallest; 1 where there is one source."""
    counts = images.groupBy(source_col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    raw = counts.crossJoin(F.broadcast(total)).withColumn("w", F.when(F.col("_k") == 1, 1.0).otherwise(1 - F.col("n") / F.col("_all")))
    least = raw.agg(F.min("w").alias("_least"))
    return raw.crossJoin(F.broadcast(least)).select(source_col, (F.col("w") / F.col("_least")).alias("weight"))


def sampling_weights(images: DataFrame, factors: DataFrame, weights: DataFrame, source_col: str = "dataset_id") -> DataFrame:
    """(image_id, weight): repeat factor times source weight over the smallest product."""
    both = images.select("image_id", source_col).join(factors, "image_id").join(F.broadcast(weights), source_col).select("image_id", (F.col("factor") * F.col("weight")).alias("w"))
    return both.crossJoin(F.broadcast(both.agg(F.min("w").alias("_least")))).select("image_id", (F.col("w") / F.col("_least")).alias("weight"))


def compare_versions(a: DataFrame, b: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, a, b, delta, ratio, side): metrics of two versions side by side."""
    x, y = a.select(*key, F.col(value).alias("a")), b.select(*key, F.col(value).alias("b"))
    out = x.join(y, key, "full")
    side = F.when(F.col("a").isNull(), "b").when(F.col("b").isNull(), "a").otherwise("both")
    return out.select(*key, "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.when(F.col("a") != 0, F.col("b") / F.col("a")).alias("ratio"), side.alias("side"))


def dimension_order_check(df: DataFrame, d0: str, d1: str, d2: str) -> DataFrame:
    """One row: the axis means and whether the first dimension is the long one."""
    m = df.agg(F.avg(d0).alias("m0"), F.avg(d1).alias("m1"), F.avg(d2).alias("m2"))
    return m.withColumn("first_is_longest", (F.col("m0") >= F.col("m1")) & (F.col("m0") >= F.col("m2"))).withColumn("last_is_longest", (F.col("m2") >= F.col("m0")) & (F.col("m2") >= F.col("m1")))


def drift_findings(compared: DataFrame) -> DataFrame:
    """Rows of compare_versions over (field, stat) with the findings that apply."""
    ratio = F.col("ratio")
    center, mean = F.col("field").isin("cxm", "cym", "czm"), F.col("stat") == "mean"
    found = F.array_compact(
        F.array(
            F.when((ratio > 2) | (ratio < 0.5), "ratio"),
            F.when(F.abs(ratio - 1) > 0.5, "ratio_off"),
            F.when(center & mean & (F.abs(F.col("delta")) > 1), "center_moved"),
            F.when(center & mean & (F.abs(F.col("delta")) > 5), "center_far_moved"),
            F.when(mean & (F.abs(F.col("b")) > 10), "mean_large"),
            F.when((F.col("field") == "czm") & (F.col("stat") == "min") & (F.col("b") < 0), "depth_negative"),
        )
    )
    return compared.withColumn("findings", found)


def sample_first(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def weighted_subsample(df: DataFrame, n: int, fg_share: float, weight: Column, by: str = "image_id", key: str = "det_id", seed: int = 0) -> DataFrame:
    """Up to n rows per `by`, at most fg_share of them foreground (label 1) and the rest background (label 0), without
    replacement in proportion to weight: the smallest -ln(u) / weight win, u being a hash of the key."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 10), 16, 10).cast("long")
    u = (drawn + 0.5) / float(1 << 40)
    keyed = df.where("label >= 0").withColumn("_k", -F.log(u) / F.greatest(weight, F.lit(1e-9)))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(by, "label").orderBy("_k", key)))
    fg = ranked.where((F.col("label") == 1) & (F.col("_r") <= int(n * fg_share)))
    taken = fg.groupBy(by).agg(F.count("*").alias("_fg"))
    bg = ranked.where("label = 0").join(taken, by, "left").where(F.col("_r") <= n - F.coalesce("_fg", F.lit(0))).drop("_fg")
    return fg.unionByName(bg).drop("_k", "_r")


def stats_record(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of named counters, to be written as JSON."""
    return df.agg(*(c.alias(n) for n, c in counters.items()))
