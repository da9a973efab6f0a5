"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.sources.shared import settled, shared_dir, shared_path

__all__ = ["BATCH_ROWS", "id_bucket", "partitions", "settled", "shared_dir", "shared_path", "small_batches", "table", "text_or_empty"]

#: Rows an Arrow batch holds; with whole texts in the rows this bounds what a Python worker holds at once.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, since a row here may hold a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str) -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_bucket(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod: the folds of held-out rows."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
