"""Open-vocabulary assignment and fuzzy labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_vocab_assign(vectors: DataFrame, classes: DataFrame, none_score: float | None = None) -> DataFrame:
    """(vec_id, name, score): the class whose vector has the largest dot product, by softmax over all classes.

    classes: name, e; one row per class of a vocabulary, so it is small by its nature. none_score: the logit of no class.
    """
    lists = classes.agg(F.sort_array(F.collect_list(F.struct("name", "e"))).alias("cs"))
    scored = vectors.crossJoin(F.broadcast(lists)).select("vec_id", F.expr("transform(cs, c -> named_struct('s', aggregate(zip_with(v, c.e, (a, b) -> a * b), 0D, (p, q) -> p + q), 'name', c.name))").alias("ss"))
    if none_score is not None:
        scored = scored.withColumn("ss", F.concat("ss", F.array(F.struct(F.lit(float(none_score)).alias("s"), F.lit("None").alias("name")))))
    best = F.expr("array_sort(ss, (x, y) -> CASE WHEN x.s > y.s THEN -1 WHEN x.s < y.s THEN 1 WHEN x.name < y.name THEN -1 WHEN x.name > y.name THEN 1 ELSE 0 END)[0]")
    total = F.expr("aggregate(ss, 0D, (p, x) -> p + exp(x.s - array_max(transform(ss, y -> y.s))))")
    return scored.select("vec_id", best["name"].alias("name"), (1 / total).alias("score"))


def fuzzy_label(labels: DataFrame, vocabulary: list[str], least: float = 0.6) -> DataFrame:
    """(label, match, ratio): the vocabulary's closest entry by 1 - edit distance / longer length, the first of equals; null below least."""
    entries = F.array(*map(F.lit, sorted(vocabulary)))
    ratio = lambda v: 1 - F.levenshtein(F.col("label"), v) / F.greatest(F.length("label"), F.length(v), F.lit(1))
    scored = labels.select("label").distinct().select("label", F.transform(entries, lambda v: F.struct(ratio(v).alias("r"), v.alias("v"))).alias("rs"))
    best = F.expr("aggregate(rs, rs[0], (b, x) -> CASE WHEN x.r > b.r THEN x ELSE b END)")
    return scored.select("label", F.when(best["r"] >= least, best["v"]).alias("match"), best["r"].alias("ratio"))


def standard_categories(df: DataFrame, vocabulary: DataFrame, mapping: DataFrame, label_col: str = "label") -> DataFrame:
    """df with `category` of its normalised label: the mapping's entry, else the label if the vocabulary has it, else its first
    word in the vocabulary, else the longest (then first) entry that it contains, else its first word.

    vocabulary: name; mapping: phrase, name. Both are joined by value, on distinct labels, so neither passes the driver;
    the parts of a label are spelled out only where nothing simpler fits.
    """
    own = df.select(F.col(label_col).alias("l")).where("l IS NOT NULL").distinct()
    names, mapped = vocabulary.select(F.col("name").alias("w")).distinct(), mapping.groupBy(F.col("phrase").alias("l")).agg(F.min("name").alias("mapped"))
    words = own.select("l", F.posexplode(F.split("l", " ")).alias("at", "w")).join(names, "w").groupBy("l").agg(F.min_by("w", "at").alias("word"))
    found = own.join(mapped, "l", "left").join(names.select(F.col("w").alias("l"), F.lit(True).alias("exact")), "l", "left").join(words, "l", "left")
    found = found.select("l", F.coalesce("mapped", F.when(F.col("exact"), F.col("l")), "word").alias("category"))
    parts = F.expr("flatten(transform(sequence(1, length(l)), i -> transform(sequence(1, length(l) - i + 1), n -> substr(l, i, n))))")
    rest = found.where("category IS NULL AND length(l) > 0").select("l", F.explode(F.array_distinct(parts)).alias("w")).join(names, "w")
    inside = rest.groupBy("l").agg(F.min_by("w", F.struct(-F.length("w"), "w")).alias("part"))
    found = found.join(inside, "l", "left").select(F.col("l").alias(label_col), F.coalesce("category", "part", F.get(F.split("l", " "), 0)).alias("category"))
    return df.join(found, label_col, "left")
