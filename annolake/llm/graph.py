"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import settled


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. Loops and repeated edges do no harm.

    Each round every node points to its smallest neighbour, pointers are followed once more, and edges move to
    where their ends point; nodes that are left shrink at least by half where they have an edge.
    """
    live = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    label = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settled(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p")), "hooks")
        up = to.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = settled(to.join(up, "p").select("v", F.col("pp").alias("m")), "jumps")
        label = settled(label.join(jump.withColumnRenamed("v", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component")), "labels")
        moved = live.join(jump.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a").join(jump.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
        live = settled(moved.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
    return label
