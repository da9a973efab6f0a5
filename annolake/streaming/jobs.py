"""Incremental jobs: conversion of raw records, divergence monitor, throughput meter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_convert(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, retry: str, checkpoint: str, time_col: str = "modified", late: str = "1 hour") -> StreamingQuery:
    """Convert each image once, write what is fine and keep what failed, with its input, for retry_failed.

    convert gives rows with `reason`, null where the row is fine. The checkpoint makes a restart go on where it ended, and a
    batch writes to folders named after it, so that a batch which runs again replaces what it wrote.
    """
    once = stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["image_id"])

    def write(batch: DataFrame, number: int) -> None:
        _convert_to(batch.persist(), convert, f"{out}/batch={number}", f"{retry}/batch={number}").unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _convert_to(batch: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, retry: str) -> DataFrame:
    """An image of which any row failed is not done: all of it is kept for a retry. `streaming.retries` retries single objects instead."""
    done = convert(batch).persist()
    failed = done.where("reason IS NOT NULL").groupBy("image_id").agg(F.min("reason").alias("reason"))
    done.where("reason IS NULL").drop("reason").join(failed, "image_id", "left_anti").write.mode("overwrite").parquet(out)
    batch.join(failed, "image_id").write.mode("overwrite").parquet(retry)
    done.unpersist()
    return batch


def retry_failed(spark: SparkSession, convert: Callable[[DataFrame], DataFrame], out: str, retry: str, attempt: int) -> DataFrame:
    """Try the images that failed and have no result yet once more: what is fine joins the results, what fails again stays to be retried. Gives the images that are still open."""
    failed = spark.read.option("mergeSchema", True).parquet(retry).drop("reason", "batch").distinct()
    done = spark.read.option("mergeSchema", True).parquet(out).select("image_id").distinct()
    open_ones = failed.join(done, "image_id", "left_anti").persist()
    _convert_to(open_ones, convert, f"{out}/batch=retry-{attempt}", f"{retry}/batch=retry-{attempt}").unpersist()
    return failed.join(spark.read.option("mergeSchema", True).parquet(out).select("image_id").distinct(), "image_id", "left_anti").select("image_id").distinct()


def write_updates(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An aggregated stream in update mode: each batch's changed groups go to a folder of their own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("written", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Of each group the row of the last batch that changed it."""
    rows = spark.read.parquet(out).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "written").alias("r")).select(*keys, "r.*").drop("written")


#: A step diverges above this many times the running mean, whose weight for a new step this is.
TOLERANCE, GAMMA = 4.0, 0.02


def divergence(steps: DataFrame, tolerance: float = TOLERANCE, gamma: float = GAMMA) -> DataFrame:
    """(run_id, iteration, loss, ema, diverging): the mean starts at twice the first loss and skips diverging steps. Batch form."""
    schema = "run_id long, iteration long, loss double, ema double, diverging boolean"
    rows = steps.select(F.col("run_id").cast("long").alias("run_id"), F.col("iteration").cast("long").alias("iteration"), F.col("loss").cast("double").alias("loss"))
    # A run comes in order, batch by batch; only its running mean is carried from one batch to the next. The fold of a run is one task's work, inherently; runs spread.
    return rows.repartition("run_id").sortWithinPartitions("run_id", "iteration").mapInPandas(_carry(tolerance, gamma), schema)


def _carry(tolerance: float, gamma: float):
    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, ema = None, None
        for frame in frames:
            means, marks = [], []
            for own, loss in zip(frame["run_id"].tolist(), frame["loss"].tolist(), strict=True):
                ema, bad = _step(None if own != run else ema, loss, tolerance, gamma)
                run = own
                means.append(ema), marks.append(bad)
            yield frame.assign(ema=means, diverging=marks)

    return carry


def _step(ema: float | None, loss: float | None, tolerance: float, gamma: float) -> tuple[float, bool]:
    """The running mean after a step, and whether the step diverges."""
    bad_number = loss is None or loss != loss or abs(loss) == float("inf")
    if ema is None:
        ema = float("inf") if bad_number else 2 * loss
    if bad_number or loss > tolerance * ema:
        return ema, True
    return (2 * loss if ema == float("inf") else ema * (1 - gamma) + loss * gamma), False


def restart_signal(marked: DataFrame, period: int, share: float = 0.25) -> DataFrame:
    """(run_id, diverging_share, restart): whether so many steps diverged after half a checkpoint period."""
    s = marked.groupBy("run_id").agg(F.avg(F.col("diverging").cast("double")).alias("diverging_share"), F.count("*").alias("n"))
    return s.select("run_id", "diverging_share", ((F.col("n") >= period / 2) & (F.col("diverging_share") >= share)).alias("restart"))


def _watch(tolerance: float, gamma: float):
    def watch(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "iteration"])
        out = []
        for it, loss in zip(rows["iteration"], rows["loss"], strict=True):
            ema, bad = _step(ema, loss, tolerance, gamma)
            out.append((key[0], it, loss, ema, bad))
        state.update((ema,))
        yield pd.DataFrame(out, columns=["run_id", "iteration", "loss", "ema", "diverging"])

    return watch


def divergence_stream(steps: DataFrame, tolerance: float = TOLERANCE, gamma: float = GAMMA, late: str = "10 minutes") -> DataFrame:
    """The same over a stream (ts, run_id, iteration, loss), at once and in the order of arrival: rows are sorted within a batch only. `divergence_in_order` waits for late steps."""
    return steps.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(_watch(tolerance, gamma), "run_id long, iteration long, loss double, ema double, diverging boolean", "ema double", "append", "NoTimeout")


def throughput(steps: DataFrame, warmup: int = 5) -> DataFrame:
    """(run_id, n, data_s, compute_s, eval_s, total_s): mean seconds per iteration after the warm-up, which is at most all but one.

    A run's totals are combined by tasks before the shuffle, and of its iterations only the first few travel (Spark limits
    such a ranking before the shuffle too); their share is taken off the totals. So no task sorts a run.
    """
    names = ("data_s", "compute_s", "eval_s", "total_s")
    rows = steps.select("run_id", "iteration", *(F.col(c).cast("double").alias(c) for c in names[:3])).withColumn("total_s", F.col("data_s") + F.col("compute_s") + F.col("eval_s"))
    sums = lambda mark: [x for c in names for x in (F.sum(c).alias(f"{c}{mark}"), F.count(c).alias(f"n_{c}{mark}"))]
    whole = rows.groupBy("run_id").agg(F.count("*").alias("all"), *sums(""))
    first = rows.withColumn("_i", F.row_number().over(Window.partitionBy("run_id").orderBy("iteration"))).where(F.col("_i") <= warmup)
    first = first.join(whole.select("run_id", "all"), "run_id").where(F.col("_i") < F.col("all")).groupBy("run_id").agg(F.count("*").alias("early"), *sums("_early"))
    both = whole.join(first, "run_id", "left").na.fill(0)
    mean = lambda c: F.try_divide(F.col(c) - F.col(f"{c}_early"), F.col(f"n_{c}") - F.col(f"n_{c}_early")).alias(c)
    return both.select("run_id", (F.col("all") - F.col("early")).alias("n"), *(mean(c) for c in names))


def throughput_stream(steps: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean seconds by run and tumbling window."""
    total = F.col("data_s") + F.col("compute_s") + F.col("eval_s")
    return steps.withWatermark("ts", late).groupBy("run_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg(total).alias("total_s")).select("run_id", F.col("w.start").alias("start"), "n", "total_s")
