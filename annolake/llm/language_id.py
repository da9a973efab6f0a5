"""Language ID by interpolated Kneser-Ney character models, one per language.

Training counts character n-grams (orders 1 to 4, word-bounded, letters only) of a bounded sample of
the labelled rows in Spark, turns them into Kneser-Ney terms with DataFrame joins, and stores the
terms in sorted arrays of 64-bit hashes, salted until no two stored n-grams of an array share a key (the
arrays hold an entry for each distinct n-gram of the sample, so the sample's bound is theirs).
A text gets the language of lowest cross-entropy per character; a text whose best cross-entropy lies
beyond what that language's own training texts show is marked as rejected.

Defined results: a null text, or one without a letter, is "und" with score 0; rows without a language
are never learnt from; with nothing to learn from every text is "und"; equal cross-entropies go to the
first language in order; repeated rows are scored alike; further input columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.llm.common import settled, small_batches
from annolake.llm.words import TokenRows

ORDER = 4
START, END = "\x02", "\x03"
#: The alphabet's size for characters never seen, and the sharpness of the score.
UNSEEN, SHARPNESS = 4096, 8.0
#: Standard deviations above the training mean from which a best cross-entropy is rejected.
REJECT_SD = 6.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(codes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """64-bit key of the n characters that end at each position (the first n - 1 positions wrap and are not used)."""
    h = np.full(len(codes), salt, np.uint64)
    for back in range(n - 1, -1, -1):
        h = (h + np.roll(codes, back) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what the models start from: the longest n-grams, and the shorter ones at a word's start."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(map(_letters, text.lower().split()))
    for lang, found in words.items():
        grams: Counter = Counter()
        for word, n in found.items():
            if word:
                w = START + word + END
                for i in range(2, min(ORDER, len(w) + 1)):
                    grams[w[:i]] += n
                for i in range(len(w) - ORDER + 1):
                    grams[w[i : i + ORDER]] += n
        if grams:
            yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(grams)), "gram": list(grams), "k": pa.array(grams.values(), pa.int64())})


def kneser_ney_terms(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n, gram, alpha) and (lang, n, context, gamma): p(c | h) = alpha(hc) + gamma(h) * p(c | shorter h).

    Below the longest order a gram's count is the number of characters seen before it; grams at a word's start keep theirs.
    """
    levels = [counted.where(F.length("gram") == ORDER)]
    for n in range(ORDER - 1, 0, -1):
        before = levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("k"))
        at_start = counted.where((F.length("gram") == n) & (F.length("gram") > 1))
        levels.append(before.unionByName(at_start).groupBy("lang", "gram").agg(F.sum("k").alias("k")))
    grams = levels[0].withColumn("n", F.lit(ORDER))
    for n, level in zip(range(ORDER - 1, 0, -1), levels[1:], strict=True):
        grams = grams.unionByName(level.withColumn("n", F.lit(n)))
    grams = grams.withColumn("context", F.expr("substring(gram, 1, n - 1)"))
    discount = grams.groupBy("lang", "n").agg(F.expr("coalesce(count_if(k = 1) / nullif(count_if(k = 1) + 2 * count_if(k = 2), 0), 0.5)").alias("d"))
    discount = discount.withColumn("d", F.greatest(F.least("d", F.lit(0.95)), F.lit(0.1)))
    contexts = grams.groupBy("lang", "n", "context").agg(F.sum("k").alias("total"), F.count("*").alias("types"))
    joined = grams.join(contexts, ["lang", "n", "context"]).join(F.broadcast(discount), ["lang", "n"])
    gamma = contexts.join(F.broadcast(discount), ["lang", "n"]).select("lang", "n", "context", (F.col("d") * F.col("types") / F.col("total")).alias("gamma"))
    return joined.select("lang", "n", "gram", (F.greatest(F.col("k") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("alpha")), gamma


def _sorted_array(rows, langs: list[str], text: str, value: str, missing: float) -> tuple[int, np.ndarray, np.ndarray]:
    """The first salt under which the n-grams' keys differ, the sorted keys, and a row of values per language."""
    if not len(rows):
        return 0, np.zeros(1, np.uint64), np.full((1, len(langs)), missing, np.float32)
    n = len(rows[text].iloc[0])
    codes = np.frombuffer("".join(rows[text]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    distinct = rows[text].nunique()
    for salt in itertools.count():
        keys = gram_keys(codes, n, salt)[n - 1 :: n] if n else np.zeros(len(rows), np.uint64)
        uniq, place = np.unique(keys, return_inverse=True)
        if len(uniq) == distinct:
            break
    out = np.full((len(uniq), len(langs)), missing, np.float32)
    out[place, rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = rows[value].to_numpy()
    return salt, uniq, out


class CharModels:
    """The models of all languages as sorted hash arrays."""

    def __init__(self, langs: list[str], alpha, gamma):
        self.langs = langs
        self.alpha = {n: _sorted_array(alpha[alpha.n == n], langs, "gram", "alpha", 0.0) for n in range(1, ORDER + 1)}
        self.gamma = {n: _sorted_array(gamma[gamma.n == n], langs, "context", "gamma", 1.0) for n in range(1, ORDER + 1)}
        self.cutoff = np.full(len(langs), np.inf)

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """For each token the log-probability under each language, then the characters predicted."""
        words = [_letters(t) for t in tokens]
        full = [i for i, w in enumerate(words) if w]
        out = np.zeros((len(tokens), len(self.langs) + 1), np.float32)
        if not full:
            return out
        lengths = np.array([len(words[i]) + 2 for i in full])
        codes = np.frombuffer("".join(START + words[i] + END for i in full).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths)
        depth = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        p = np.full((len(codes), len(self.langs)), 1.0 / UNSEEN, np.float32)
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(depth >= max(1, n - 1))
            salt, keys, values = self.gamma[n]
            if n == 1:
                p[at] *= values[0]
            else:
                context = gram_keys(codes, n - 1, salt)[at - 1]
                found = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                hit = keys[found] == context
                p[at[hit]] *= values[found[hit]]
            salt, keys, values = self.alpha[n]
            gram = gram_keys(codes, n, salt)[at]
            found = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[found] == gram
            p[at[hit]] += values[found[hit]]
        logs = np.log(np.maximum(p, 1e-30))
        logs[depth == 0] = 0
        out[full, :-1] = np.add.reduceat(logs, ends - lengths, axis=0)
        out[full, -1] = lengths - 1
        return out


def train_language_models(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_lang: int = 1500) -> CharModels:
    """Models from at most rows_per_lang rows of each language (the documented bound), chosen by a hash of the id."""
    spark = df.sparkSession
    small_batches(spark)
    base = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # Ranked within slices of a language first, so that no task ranks all rows of a frequent one.
    slices = Window.partitionBy("lang", F.pmod("h", F.lit(256))).orderBy("h", "id")
    first = Window.partitionBy("lang").orderBy("h", "id")
    sample = base.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.lit(7), F.col(id_col)).alias("h"))
    sample = sample.withColumn("r", F.row_number().over(slices)).where(F.col("r") <= rows_per_lang)
    sample = sample.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows_per_lang).select("id").distinct()
    docs = settled(base.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id"), "language-sample")
    counted = settled(docs.select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, k long").groupBy("lang", "gram").agg(F.sum("k").alias("k")), "language-grams")
    alpha, gamma = kneser_ney_terms(counted)
    alpha, gamma = alpha.toPandas(), gamma.toPandas()
    langs = sorted(alpha["lang"].unique())
    models = CharModels(langs, alpha, gamma)
    if langs:
        seen = docs.select(F.col("lang").alias("own"), "text").mapInArrow(_predictor(spark.sparkContext.broadcast(models), ["own"]), "own string, lang_pred string, score double, cross_entropy double, rejected boolean")
        stats = {r.own: r for r in seen.where("own = lang_pred").groupBy("own").agg(F.avg("cross_entropy").alias("m"), F.coalesce(F.stddev_pop("cross_entropy"), F.lit(0.0)).alias("s")).collect()}
        models.cutoff = np.array([stats[x].m + REJECT_SD * max(stats[x].s, 0.05) if x in stats else np.inf for x in langs])
    return models


def _predictor(shared, keep: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: CharModels = shared.value
        rows, width = TokenRows(models.token_rows), len(models.langs) + 1
        for batch in batches:
            sums = rows.sums([(t or "").lower().split() for t in batch.column("text").to_pylist()], width)
            n = sums[:, -1]
            some = (n > 0) & bool(models.langs)
            entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None] if models.langs else np.full((len(n), 1), np.inf)
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(n)), best]
            share = 1 / np.exp(np.minimum(SHARPNESS * (least[:, None] - entropy), 0)).sum(axis=1) if models.langs else np.zeros(len(n))
            names = np.array([*models.langs, "und"], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keep),
                    pa.array(names[np.where(some, best, -1)], pa.string()),
                    pa.array(np.where(some, share, 0.0)),
                    pa.array(np.where(some, least, np.nan), mask=~some),
                    pa.array(some & (least > np.append(models.cutoff, 0)[np.where(some, best, -1)])),
                ],
                names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return predict


def identify_language(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_lang: int = 1500) -> DataFrame:
    """id_col, held_out (not learnt from), lang_pred, score (share of the best language, 0 to 1), cross_entropy, rejected."""
    models = train_language_models(df, learn, text_col, lang_col, id_col, rows_per_lang)
    shared = df.sparkSession.sparkContext.broadcast(models)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(~learn, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_predictor(shared, ["id", "held_out"]), f"id {df.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
