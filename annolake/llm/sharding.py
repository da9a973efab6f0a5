"""Sharding by Karmarkar-Karp differencing.

Items are indivisible groups (equal texts), weighed by bytes. Each partition of the group table runs
multiway differencing on its own groups: the two partial partitions with the largest spread are
combined, one's largest sums onto the other's smallest. That leaves a few dozen near-equal bins per
partition. The driver then differences the bin sums (their number follows the partitions, not the
rows) together with the few groups that are too large to hide in a bin, which gives the shard of each.

Defined results: a null text weighs one byte and is the same group as the empty text; repeated rows
are rows of the same group; an empty table gives an empty result; shards may stay empty when there are
fewer groups than shards; further input columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import partitions, settled, text_or_empty

#: Bins that one partition's groups are packed into, and the share of one shard above which a group is placed by itself.
BINS, LARGE_SHARE = 32, 1 / 64


def differencing(weights: list[int], ways: int) -> np.ndarray:
    """Multiway Karmarkar-Karp: the way of each weight. Ties go by position, so the result is reproducible."""
    way = np.zeros(len(weights), dtype=np.int32)
    if not weights:
        return way
    # A partial partition: its sums in descending order, each with the tree of its members (nested pairs, flattened at the end).
    heap: list = [(-w, i, ((w, i),) + ((0, None),) * (ways - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    order = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x[0] + y[0], x[1] if y[1] is None else y[1] if x[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], order, tuple(both)))
        order += 1
    for k, (_, tree) in enumerate(heap[0][2]):
        stack = [] if tree is None else [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                way[node] = k
    return way


def _local_bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pid = TaskContext.get().partitionId()
    whole = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"_key": [], "bytes": []})])
    if len(whole):
        whole["pid"], whole["bin"] = pid, differencing(whole["bytes"].astype("int64").tolist(), BINS)
        for at in range(0, len(whole), 50_000):
            yield whole.iloc[at : at + 50_000][["_key", "bytes", "pid", "bin"]]


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's number and each row's place among the task's rows of its shard."""
    pid, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        place = np.zeros(len(shards), dtype=np.int64)
        for s in np.unique(shards):
            at = np.flatnonzero(shards == s)
            place[at] = np.arange(len(at)) + seen.get(s, 0)
            seen[s] = seen.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shards), pid, np.int32)), pa.array(place)], names=[*batch.schema.names, "pid", "place"])


def balanced_shards(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into n_shards of near-equal bytes, equal texts together: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    text = text_or_empty(text_col)
    utf8 = F.encode(text, "UTF-8")
    rows = df.select(F.col(id_col).alias("_id"), (F.length(utf8).cast("long") + 1).alias("size"), F.crc32(utf8).alias("text_crc32"), F.unhex(F.sha2(utf8, 256)).alias("_key"))
    rows = settled(rows, "shard-rows")
    groups = rows.groupBy("_key").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # No more than n_shards / LARGE_SHARE groups can reach this size.
    large_at = max(1, int(total * LARGE_SHARE / n_shards))
    groups = settled(groups.repartition(partitions(spark), "_key").sortWithinPartitions(F.desc("bytes"), "_key"), "shard-groups")
    large = groups.where(F.col("bytes") >= large_at)
    small = groups.where(F.col("bytes") < large_at).repartition(partitions(spark), "_key").sortWithinPartitions(F.desc("bytes"), "_key")
    binned = settled(small.mapInPandas(_local_bins, "_key binary, bytes long, pid int, bin int"), "shard-bins")
    items = [((r.pid, r.bin), None, r.bytes) for r in binned.groupBy("pid", "bin").agg(F.sum("bytes").alias("bytes")).orderBy("pid", "bin").collect()]
    items += [(None, bytes(r._key), r.bytes) for r in large.orderBy("_key").collect()]
    way = differencing([w for *_, w in items], n_shards).tolist()
    bins = spark.createDataFrame([(*b, s) for (b, _, _), s in zip(items, way, strict=True) if b], "pid int, bin int, shard int")
    alone = spark.createDataFrame([(k, s) for (_, k, _), s in zip(items, way, strict=True) if k], "_key binary, shard int")
    of_key = binned.join(F.broadcast(bins), ["pid", "bin"]).select("_key", "shard").unionByName(alone)
    placed = rows.join(of_key, "_key").select("_id", "size", "text_crc32", "shard")
    placed = settled(placed.mapInArrow(_number_rows, f"_id {df.schema[id_col].dataType.simpleString()}, size long, text_crc32 long, shard int, pid int, place long"), "shard-placed")
    counts = placed.groupBy("shard", "pid").agg(F.count("*").alias("n"))  # as many rows as tasks and shards
    offsets = counts.selectExpr("shard", "pid", "sum(n) OVER (PARTITION BY shard ORDER BY pid) - n AS before")
    return placed.join(F.broadcast(offsets), ["shard", "pid"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
