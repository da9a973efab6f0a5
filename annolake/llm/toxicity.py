"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps homoglyphs, accented letters and digit substitutions to plain letters and everything that
is no letter to a space. The lexicon holds whole words and word beginnings; each one's weight is a lower
bound of its log-odds in the labelled training rows. Words that begin like a lexicon entry but are clean
in training become exception phrases; more can be given. A text's score sets its matched weight against
its length. Labels are learnt from a bounded sample of the labelled rows (max_labelled), which bounds the lexicon
and the exception phrases too: their entries come from that sample alone.

Defined results: a null or empty text scores 0; null labels are never learnt from; without a toxic
training row every score is 0; repeated rows are scored alike; an id with several labels counts as
toxic if one of them is; a row with a null id is scored and counts as not held out, and is never learnt from; a
text whose score is just the threshold is toxic; an empty table gives an empty result; further input columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import settled, small_batches

# Characters that stand for another letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "ı": "i",
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ø": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "s",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: A lexicon entry is a word beginning of at least this many letters, or a whole word.
SHORTEST = 4
#: The longest beginning that is tried.
LONGEST = 8


class _Folding(dict):
    """Translation table: unlisted characters fold on first sight."""

    def __missing__(self, code: int):
        c = chr(code).lower()
        out = HOMOGLYPHS.get(c, c if c.isalpha() else " ")
        self[code] = out
        return out


def _fold_tables() -> tuple[_Folding, _Folding]:
    """Plain folding, and folding that also reads digits and signs as letters."""
    plain, loose = _Folding(), _Folding()
    loose.update({ord(k): v for k, v in SUBSTITUTIONS.items()})
    # Full-width letters stand for the ASCII ones.
    for code in range(0xFF21, 0xFF5B):
        c = chr(code - 0xFEE0).lower()
        if c.isalpha():
            plain[code] = loose[code] = c
    # Invisible characters inside a word vanish.
    for code in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        plain[code] = loose[code] = None
    return plain, loose


def fold(text: str, tables: tuple[_Folding, _Folding]) -> str:
    """Plain folding; a word with a digit or sign between letters is read with the substitutions.

    Signs that trail a word ("word!!") are punctuation: only those with a letter on both sides count.
    """
    plain, loose = tables
    if not _HAS_SUBSTITUTE(text):
        return text.translate(plain)
    return _INSIDE.sub(lambda m: m[0].translate(loose), text).translate(plain)


_HAS_SUBSTITUTE = regex.compile(r"\p{L}[013457@$8!]+\p{L}|(?<![\w])[013457@$8]+\p{L}").search
_INSIDE = regex.compile(r"(?:(?<![\w])[013457@$8]+)?\p{L}+(?:[013457@$8!]+\p{L}+)*")


def _labelled_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents of each whole word and word beginning."""
    tables, found = _fold_tables(), (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = set(fold(text, tables).split())
            found[toxic].update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)})
    for toxic, entries in enumerate(found):
        if entries:
            n = pa.array(entries.values(), pa.int64())
            zero = pa.array(np.zeros(len(entries), np.int64))
            yield pa.RecordBatch.from_pydict({"entry": list(entries), "bad": n if toxic else zero, "good": zero if toxic else n})


class Lexicon:
    """Weights of entries (" word " or " beginning"), and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = (), theta: float = 0.5):
        self.weights, self.exceptions, self.theta = dict(weights), list(exceptions), theta

    def automaton(self):
        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                a.add_word(phrase, (len(phrase), -1.0))
        a.make_automaton()
        return a


def matched_weight(folded: str, automaton) -> tuple[float, int]:
    """Weight of the best entry at each matched place outside exception phrases, and the number of words."""
    words = folded.split()
    if not len(automaton):
        return 0.0, len(words)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(" " + " ".join(words) + " "):
        start = end - n + 1
        if w < 0:
            spared.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    if spared and best:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
    return sum(best.values()), len(words)


def density(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weight against length: one match in a long text counts for less than in a short one."""
    return weight / np.log2(4.0 + words)


def learn_lexicon(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", toxic_col: str = "toxic", max_labelled: int = 40_000, exceptions: Sequence[str] = ()) -> Lexicon:
    """Learn from at most max_labelled labelled rows for which learn holds (chosen by a hash of the id)."""
    spark = df.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(toxic_col).isNotNull()).select(F.col(id_col), F.col(toxic_col)).where(learn).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic"))
    marked = marked.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(max_labelled)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(marked), "id")
    docs = settled(docs.select("id", "toxic", "text"), "toxicity-sample")
    n = docs.agg(F.expr("count_if(toxic = 1)").alias("bad"), F.expr("count_if(toxic = 0)").alias("good")).first()
    lexicon = Lexicon({}, [])
    if not n.bad:
        return lexicon
    entries = settled(docs.select("toxic", "text").mapInArrow(_labelled_entries, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity-entries")
    # An entry needs so many toxic documents that, among all entries tried, not even one would get there by chance.
    tried, share = entries.count(), n.bad / (n.bad + n.good)
    least = 3 if share >= 0.9 else max(3, math.ceil((math.log(max(tried, 2)) + 3) / math.log(1 / share)))
    a, c = F.col("bad") + 0.5, F.col("good") + 0.5
    weight = F.log(a / (n.bad + 1)) - F.log(c / (n.good + 1)) - 2 * F.sqrt(1 / a + 1 / c)
    toxic_entries = entries.withColumn("w", weight).where((F.col("w") > 0.7) & (F.col("bad") >= least) & (F.col("bad") >= 20 * F.col("good")))
    weights = {r.entry: float(r.w) for r in toxic_entries.select("entry", "w").collect()}
    beginnings = spark.createDataFrame([(e,) for e in weights if not e.endswith(" ")], "entry string")
    clean = entries.where(f"good >= 2 AND bad = 0 AND endswith(entry, ' ') AND length(entry) >= {SHORTEST} + 2")
    clean = clean.select(F.col("entry").alias("word"), "good", F.explode(F.expr(f"transform(sequence({SHORTEST}, least(length(entry) - 2, {LONGEST})), i -> substring(entry, 1, i + 1))")).alias("entry"))
    spared = clean.join(F.broadcast(beginnings), "entry", "left_semi").select("word").distinct()
    tables = _fold_tables()
    given = [" " + " ".join(fold(x, tables).split()) + " " for x in exceptions]
    lexicon = Lexicon(weights, [*(r.word for r in spared.collect()), *given])
    # The threshold comes from the labelled sample: the point with the fewest errors, between the densities on its two sides.
    seen = docs.mapInArrow(_weigher(spark.sparkContext.broadcast(lexicon), ["toxic"]), "toxic int, weight double, n_words long").toPandas()
    x, y = density(seen.weight.to_numpy(), seen.n_words.to_numpy()), seen.toxic.to_numpy()
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    errors = np.cumsum(y) + (y == 0).sum() - np.cumsum(y == 0)  # if all up to here are clean
    distinct = np.append(x[1:] > x[:-1], True)
    at = np.flatnonzero(distinct)[errors[distinct].argmin()]
    lexicon.theta = float((x[at] + (x[at + 1] if at + 1 < len(x) else x[at] + 1)) / 2) or 0.05
    return lexicon


def _weigher(shared, keep: list[str]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, tables = shared.value.automaton(), _fold_tables()
        for batch in batches:
            got = [matched_weight(fold(t or "", tables), automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=[*keep, "weight", "n_words"])

    return weigh


def score_toxicity(df: DataFrame, lexicon: Lexicon, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, weight, n_words, score (0 to 1; at least .5 from the learnt threshold on)."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_weigher(spark.sparkContext.broadcast(lexicon), ["id"]), f"id {df.schema[id_col].dataType.simpleString()}, weight double, n_words long")
    dense = F.col("weight") / F.log2(F.lit(4.0) + F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "weight", "n_words", (dense / (dense + F.lit(lexicon.theta))).alias("score"))


def toxicity(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, held_out (not learnt from), score, predicted (score >= .5)."""
    lexicon = learn_lexicon(df, labels, learn, text_col, id_col, **options)
    scored = score_toxicity(df, lexicon, text_col, id_col)
    return scored.select(id_col, F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
