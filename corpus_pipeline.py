"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing to targets, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of documents; the last one returns the encoded documents. run() writes each stage's result to the
shared folder and reads it back as the next one's input. A stage decides on each row by a row key that is
written with the rows, so repeated rows, ids that several texts share and null ids are decided on like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.common import id_bucket, settled, table
from annolake.llm.exact_dedup import exact_dedup
from annolake.llm.mixing import mix_to_targets, quality_domains
from annolake.llm.ngram_join import jaccard_components
from annolake.llm.queries import PIECE_MODEL
from annolake.llm.sentencepiece import encode_pieces
from annolake.llm.toxicity import learn_lexicon, score_toxicity

#: Share of tokens that low-quality text may keep; the languages keep their proportions.
LOW_SHARE = 0.02


#: The row key's column.
ROW = "pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the row key, written so that a lost task does not change it."""
    return settled(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def _staying(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of docs whose key is in rows, without the key."""
    return docs.join(rows.select(ROW), ROW, "left_semi").drop(ROW)


def _first_of_each(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Of each group of rows the one with the smallest doc_id, null ones last, and of those the smallest key."""
    known = rows.join(docs.select(ROW, "doc_id"), ROW)
    return known.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("first")).select(f"first.{ROW}")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity lexicon scores below .5. Null and empty texts score 0 and stay; repeated rows are judged alike,
    rows with a null id by their text; without a toxic label everything stays; an empty table stays empty."""
    rows = _keyed(docs)
    lexicon = learn_lexicon(rows, table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0, "text", "doc_id")
    return _staying(rows, score_toxicity(rows, lexicon, id_col=ROW).where("score < 0.5"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (null counts as empty): the one with the smallest id, a null id only where no other is there, and
    of rows that repeat an id the first written. An empty table stays empty."""
    rows = _keyed(docs)
    return _staying(rows, _first_of_each(rows, exact_dedup(rows, id_col=ROW, keep="min"), "keep_id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share at least 80 % of their five-word shingles, chosen like a text's row in
    remove_copies. A text without words is linked with nothing and stays. An empty table stays empty."""
    rows = _keyed(docs)
    return _staying(rows, _first_of_each(rows, jaccard_components(rows, n=5, percent=80, id_col=ROW), "component_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mixture keeps: low-quality text down to LOW_SHARE of the tokens, the languages in their own proportions. A
    row is kept or not by its rate and a hash of its id, or of its text where that is null. Null and empty texts are rated
    like any other; without labels everything stays; an empty table stays empty."""
    rows = _keyed(docs)
    domains = quality_domains(table(spark, sf_dir, "labels"), rows)
    targets = {d.domain: None for d in domains.where("domain IS NOT NULL").select("domain").distinct().collect()} | {"low": LOW_SHARE}
    mixed = mix_to_targets(rows, domains, targets, max_rate=1.0, row_col=ROW)
    return _staying(rows, mixed.where("copies > 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's id with the pieces of its text, their number, and whether they decode to the text. A null text has null
    pieces, an empty one none."""
    return encode_pieces(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The stages learn models and encode, which SQL cannot express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
