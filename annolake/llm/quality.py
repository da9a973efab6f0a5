"""Quality classifier: interpolated modified Kneser-Ney n-grams over the bytes of the text.

The model is trained on trusted text: all rows labelled as good. Every byte is a symbol of its own: nothing is folded, left out or hashed,
and the model holds an entry for each distinct n-gram of the trusted text. Counts, continuation counts and
discounts are DataFrame aggregates, and the interpolation terms come from joins of the count tables,
sharded by context. A text is kept when its perplexity is within its language's quantile of trusted text,
which is exact.

Defined results: a null or empty text has no perplexity and is not kept; rows with a null or unseen
language use the quantile over all languages; a perplexity equal to the threshold is kept; without trusted text everything has a null threshold and
every non-empty text is kept; repeated rows and null ids are scored like any other; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.llm.common import settled, small_batches
from annolake.llm.words import segment_sums

ORDER, CLASS_BITS = 4, 8
CLASSES = 1 << CLASS_BITS
#: Positions that are looked up at once, grams that are held back before they are counted together, and rows of a batch of counts.
AT_ONCE, PENDING, COUNT_ROWS = 1 << 20, 1 << 20, 1 << 18
#: Natural logarithm of the least probability.
FLOOR = math.log(1e-12)


def class_table() -> np.ndarray:
    """The symbol of each byte: itself, so that no two bytes count as one."""
    return np.arange(CLASSES, dtype=np.uint32)


def text_grams(texts: list[str | None], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ORDER bytes that end at each byte, the texts end to end (spaces before each), and the bytes of each text."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    pad = b" " * (ORDER - 1)
    codes = of[np.frombuffer(b"".join(pad + r for r in raw), np.uint8)]
    gram = codes.copy()
    for back in range(1, ORDER):
        gram |= np.roll(codes, back) << np.uint32(back * CLASS_BITS)
    own = np.ones(len(codes), bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for i in range(ORDER - 1):
        own[starts + i] = False
    return gram[own], lengths


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the lists, in order, with their counts added up."""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return found, total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, keys, counts = class_table(), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for batch in batches:
        found, n = np.unique(text_grams(batch.column("text").to_pylist(), of)[0], return_counts=True)
        keys.append(found)
        counts.append(n)
        if sum(map(len, keys[1:])) > max(PENDING, len(keys[0])):
            keys, counts = ([x] for x in _summed(keys, counts))
    found, total = _summed(keys, counts)
    for at in range(0, len(found), COUNT_ROWS):
        yield pa.RecordBatch.from_pydict({"gram": pa.array(found[at : at + COUNT_ROWS], pa.int64()), "k": pa.array(total[at : at + COUNT_ROWS])})


def modified_kneser_ney(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, gram, alpha) and (n, context, gamma) for all orders, from the counts of the longest grams."""
    level, grams = counted, counted.withColumn("n", F.lit(ORDER))
    for n in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.expr(f"gram & {CLASSES**n - 1}").alias("gram")).agg(F.count("*").alias("k"))
        grams = grams.unionByName(level.withColumn("n", F.lit(n)))
    grams = grams.withColumn("context", F.shiftright("gram", CLASS_BITS))
    n1, n2, n3, n4 = (f"count_if(k = {i})" for i in (1, 2, 3, 4))
    y = f"{n1} / ({n1} + 2 * {n2})"
    discount = grams.groupBy("n").agg(
        *(F.expr(f"least(greatest(coalesce({i} - {i + 1} * ({y}) * {b} / nullif({a}, 0), {i} * 0.5), 0.05), {i} - 0.05)").alias(f"d{i}") for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    )
    contexts = grams.groupBy("n", "context").agg(F.sum("k").alias("total"), F.expr("count_if(k = 1)").alias("t1"), F.expr("count_if(k = 2)").alias("t2"), F.expr("count_if(k > 2)").alias("t3"))
    taken = F.expr("CASE WHEN k = 1 THEN d1 WHEN k = 2 THEN d2 ELSE d3 END")
    alpha = grams.join(contexts, ["n", "context"]).join(F.broadcast(discount), "n").select("n", "gram", (F.greatest(F.col("k") - taken, F.lit(0.0)) / F.col("total")).alias("alpha"))
    gamma = contexts.join(F.broadcast(discount), "n").select("n", "context", F.expr("(d1 * t1 + d2 * t2 + d3 * t3) / total").alias("gamma"))
    return alpha, gamma


class GramModel:
    """Natural log-probability of a gram's last byte. Each order has its grams in order of their codes, with the probability that they come to, and its
    contexts with the weight of the next lower order, which answers for grams that were not seen."""

    def __init__(self, alpha, gamma):
        self.levels: list[tuple[np.ndarray, ...]] = []
        for n in range(1, ORDER + 1):
            a, g = alpha[alpha.n == n].sort_values("gram"), gamma[gamma.n == n].sort_values("context")
            grams, contexts, weights = a.gram.to_numpy(np.uint32), g.context.to_numpy(np.uint32), np.log(g.gamma.to_numpy(float))
            self.levels.append((grams, np.zeros(len(grams)), contexts, weights))
            p = a.alpha.to_numpy(float) + np.exp(self._lower(grams, n))
            self.levels[-1] = grams, np.log(np.maximum(p, 1e-12)), contexts, weights

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _lower(self, grams: np.ndarray, n: int) -> np.ndarray:
        """What the order below gives these grams of n bytes."""
        _, _, contexts, weights = self.levels[n - 1]
        at, hit = self._found(contexts, grams >> np.uint32(CLASS_BITS))
        out = self._of(grams & np.uint32(CLASSES ** (n - 1) - 1), n - 1)
        out[hit] += weights[at[hit]]
        return out

    def _of(self, grams: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(grams), -math.log(CLASSES))
        keys, values, *_ = self.levels[n - 1]
        at, hit = self._found(keys, grams)
        out = np.empty(len(grams))
        out[hit] = values[at[hit]]
        unseen = np.flatnonzero(~hit)
        if len(unseen):
            out[unseen] = self._lower(grams[unseen], n)
        return out

    def __getitem__(self, grams: np.ndarray | int) -> np.ndarray:
        """Of grams of ORDER bytes; a piece at a time, so that long texts need little memory."""
        wanted = np.atleast_1d(np.asarray(grams, np.uint32))
        out = np.empty(len(wanted), np.float32)
        for at in range(0, len(wanted), AT_ONCE):
            out[at : at + AT_ONCE] = np.maximum(self._of(wanted[at : at + AT_ONCE], ORDER), FLOOR)
        return out if np.ndim(grams) else out[0]


def dense_model(alpha, gamma) -> GramModel:
    """The model from the terms of all orders; its arrays are as dense as the grams are many."""
    return GramModel(alpha, gamma)


def _scorer(shared, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = shared.value, class_table()
        for batch in batches:
            grams, n = text_grams(batch.column("text").to_pylist(), of)
            total = segment_sums(model[grams], n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)], names=[*keep, "perplexity"])

    return score


def exact_quantile(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, at): the least value of a group that at least this share of its values does not exceed; nulls do not count.

    Equal values are counted first; the distinct ones are cut into ranges, counted within them, and what lies below a range is added
    from a table with a row for each group and range.
    """
    same = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    cut = settled(same.repartitionByRange(*by, value).withColumn("band", F.spark_partition_id()), "quantile")
    bands = cut.groupBy(*by, "band").agg(F.sum("k").alias("held"))
    all_of_it, below = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("band").alias("_band"), F.coalesce(F.sum("held").over(below), F.lit(0)).alias("before"), F.sum("held").over(all_of_it).alias("n"))
    on = F.col("band") == F.col("_band")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    so_far = F.sum("k").over(Window.partitionBy(*by, "band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn("up_to", so_far).join(bands, on).where(F.col("up_to") + F.col("before") >= F.greatest(F.ceil(F.lit(share) * F.col("n")), F.lit(1)))
    return placed.groupBy(*by).agg(F.min(value).alias("at"))


def trusted_texts(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts of rows whose id is in trusted. Only this join moves texts, each once and unsorted, at every size: the ids are never broadcast."""
    return rows.join(trusted.hint("shuffle_hash"), "id", "left_semi").select("text")


def quality(df: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", good_col: str = "quality", quantile: float = 0.999) -> DataFrame:
    """id_col, lang, perplexity, threshold, kept. Trusted: all rows with good_col = 1."""
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    trusted = labels.where(F.col(good_col) == 1).select(F.col(id_col).alias("id")).distinct()
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = settled(trusted_texts(rows, trusted).mapInArrow(_count, "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k")), "quality-counts")
    alpha, gamma = modified_kneser_ney(counted)
    shared = spark.sparkContext.broadcast(dense_model(alpha.toArrow().to_pandas(), gamma.toArrow().to_pandas()))
    # Every text is scored once; trusted rows are then found by their ids alone.
    scored = settled(rows.mapInArrow(_scorer(shared, ["id", "lang"]), f"id {id_type}, lang string, perplexity double"), "quality-scores")
    seen = scored.join(trusted, "id", "left_semi")
    each = seen.where("lang IS NOT NULL").select(F.lit(False).alias("whole"), "lang", "perplexity").unionByName(seen.select(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), "perplexity"))
    thresholds = settled(exact_quantile(each, ["whole", "lang"], "perplexity", quantile), "quality-thresholds")
    by_lang = thresholds.where("NOT whole").select("lang", F.col("at").alias("own"))
    top = thresholds.where("whole").select("at").first()
    overall = top["at"] if top else None
    # As many rows as there are languages.
    out = scored.join(F.broadcast(by_lang), "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "perplexity", "threshold", kept.alias("kept"))
