"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over (leading bytes, digest, id), sorted inside each
partition (Spark's external sort, which spills), and neighbours are compared in full. The id is part
of the splitters, so a text that a third of all rows share is dealt over many partitions; runs that
touch a partition's edge are stitched afterwards by their full text (at most two per partition).

Defined results: a null text counts as empty; null ids sort before all others, so they stay only in
groups without another id; of repeated rows (same id, same text) exactly one is kept; an empty table
gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import partitions, settled, small_batches, text_or_empty

#: Leading characters that the splitters carry; the digest after them keeps sampled keys short for any text.
LEAD = 48


def content_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per input row: id, digest, and the run of equal texts it lies in within its sorted partition.

    Columns: _id, sha, pid, run, run_keep, run_size, run_last (the row that would stay), edge_text (once for each
    run that touches the partition's first or last row).
    """
    spark = df.sparkSession
    small_batches(spark)
    order = F.col("_id").asc_nulls_first() if keep == "max" else F.col("_id").desc_nulls_first()
    rows = df.select(F.col(id_col).alias("_id"), normalise(text_or_empty(text_col)).alias("_text"))
    rows = rows.withColumn("sha", F.sha2(F.encode("_text", "UTF-8"), 256)).withColumn("_lead", F.substring("_text", 1, LEAD))
    keys = [F.col("_lead"), F.col("sha"), order]
    ordered = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select("_id", "_text", "sha")
    id_type = df.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(_mark_runs, f"_id {id_type}, sha string, pid int, run long, run_keep {id_type}, run_size long, run_last boolean, edge_text string")


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours in full. Holds only the ids of the run that is still open."""
    pid, run = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    text, sha = None, None

    def close(last: bool) -> pa.RecordBatch:
        held = pa.concat_arrays(ids)
        n = len(held)
        edge = run == 0 or last
        return pa.RecordBatch.from_pydict(
            {
                "_id": held,
                "sha": pa.repeat(sha, n),
                "pid": pa.repeat(pa.scalar(pid, pa.int32()), n),
                "run": pa.repeat(run, n),
                "run_keep": pa.repeat(held[n - 1], n),
                "run_size": pa.repeat(n, n),
                "run_last": pa.array([False] * (n - 1) + [True]),
                "edge_text": pa.array([None] * (n - 1) + [text if edge else None], pa.string()),
            }
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, shas, keys = batch.column("_text"), batch.column("sha"), batch.column("_id")
        same = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist()
        starts = [i + 1 for i, s in enumerate(same) if not s]
        first = texts[0].as_py()
        if ids and first != text:
            yield close(False)
            ids, run = [], run + 1
        cuts = [0, *starts, n]
        done: list[pa.RecordBatch] = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k:
                done.append(close(False))
                ids, run = [], run + 1
            ids.append(keys.slice(a, b - a))
            text, sha = texts[a].as_py(), shas[a].as_py()
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield close(True)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. keep: "min" or "max" id of each group stays."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep}")
    rows = settled(content_runs(df, id_col, text_col, keep, normalise), "content-runs")
    # At most two rows per partition: their number follows the partitions, not the data.
    edges = rows.where("edge_text IS NOT NULL").select("pid", "run", "run_keep", "run_size", "edge_text")
    groups = edges.groupBy("edge_text").agg(F.sum("run_size").alias("all_size"), F.max("pid").alias("last_pid"), F.max_by("run_keep", "pid").alias("all_keep"))
    stitched = edges.join(groups, "edge_text").select("pid", "run", "all_size", "last_pid", "all_keep")
    joined = rows.drop("edge_text").join(F.broadcast(stitched), ["pid", "run"], "left")
    whole = F.col("all_size").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(whole, F.col("all_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("run_last") & (~whole | (F.col("pid") == F.col("last_pid")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
