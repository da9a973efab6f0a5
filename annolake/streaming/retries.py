"""Keyed state for streams: conversion with retries of single objects, and the divergence monitor in event-time order.

Both keep their state in transformWithState, whose timers and state are in the checkpoint: a restart goes on with the
attempts and the buffered steps that were open. It needs the RocksDB state store, which the functions set for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructField, StructType

from annolake.streaming.jobs import GAMMA, TOLERANCE, _step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that a converted row gets besides its own.
OUTCOME = "status string, attempt int, reason string"


def _use_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Retry(StatefulProcessor):
    """State of an object: whether it has come, and the rows that failed with their attempt and when they are due."""

    def __init__(self, convert: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], attempts: int, wait_ms: int, keep_ms: int):
        self.convert, self.columns, self.attempts, self.wait_ms, self.keep_ms = convert, columns, attempts, wait_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long", self.keep_ms)
        self.open = handle.getListState("open", "attempt int, due long, rows binary")

    def _try(self, rows: pd.DataFrame, attempt: int, now: int) -> tuple[pd.DataFrame, tuple | None]:
        """What comes out of an attempt, and what stays open."""
        try:
            done = self.convert(rows.copy()).reset_index(drop=True)
            if len(done) != len(rows):
                raise ValueError("convert must give a row for each row")
        except Exception as error:  # an object that breaks the conversion must not stop the stream; the reason is kept
            done = rows.reset_index(drop=True).assign(reason=f"{type(error).__name__}: {error}")
        failed = done["reason"].notna().to_numpy()
        last = attempt >= self.attempts
        out = done[~failed].assign(status="done")
        if last and failed.any():
            out = pd.concat([out, done[failed].assign(status="dead")])
        out = out.assign(attempt=attempt).reindex(columns=self.columns)
        if last or not failed.any():
            return out, None
        return out, (attempt + 1, now + self.wait_ms * 2 ** (attempt - 1), _packed(rows.reset_index(drop=True)[failed]))

    def _keep(self, still: list[tuple]) -> None:
        if still:
            self.open.put(still)
            self.handle.registerTimer(min(due for _, due, _ in still))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, come = timerValues.getCurrentProcessingTimeInMs(), pd.concat(list(rows))
        if self.seen.exists():
            return
        self.seen.update((now,))
        out, left = self._try(come, 1, now)
        self._keep([left] if left else [])
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, still = timerValues.getCurrentProcessingTimeInMs(), []
        for attempt, due, data in list(self.open.get()):
            if due > now:
                still.append((attempt, due, data))
                continue
            out, left = self._try(_unpacked(data), attempt, now)
            still += [left] if left else []
            if len(out):
                yield out
        self._keep(still)

    def close(self) -> None:
        pass


def convert_with_retries(stream: DataFrame, convert: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, keys: tuple[str, ...] = ("image_id", "object_id"), attempts: int = 3, wait_ms: int = 60_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """Rows of `schema` with status (done or dead), attempt and reason: every object is converted once, and what fails again later.

    convert: from an object's rows to as many rows in their order, with the columns of `schema` and `reason`, null where the row
    is fine; an exception fails all rows it was given. Rows that are fine come out at once, also of an object that fails in
    part; the others are tried again after wait_ms, then after twice as long and so on. What fails `attempts` times comes out as a
    dead letter with the last reason. An object that comes again within keep_ms is passed over. An object's rows must come in one
    batch. Objects spread by key, and each holds only its failed rows.
    """
    spark = stream.sparkSession
    _use_state(spark)
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = StructType([StructField(f.name, f.dataType, True) for f in own.fields if f.name not in ("status", "attempt", "reason")] + StructType.fromDDL(OUTCOME).fields)
    processor = _Retry(convert, fields.fieldNames(), attempts, wait_ms, keep_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, fields, "append", "ProcessingTime")


def write_converted(converted: DataFrame, out: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """out/status=done and out/status=dead, exactly once. The trigger must keep running for retries to come due."""
    return converted.writeStream.format("parquet").partitionBy("status").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def open_objects(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, attempt, due): the retries that a stream's last committed batch holds."""
    rows = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return rows.select("key.*", F.explode("list_value").alias("o")).select("*", "o.attempt", F.timestamp_millis("o.due").alias("due")).drop("o") if "list_value" in rows.columns else rows.select("key.*", "list_element.attempt", F.timestamp_millis("list_element.due").alias("due"))


class _Ordered(StatefulProcessor):
    """State of a run: its running mean, and the steps that the watermark has not passed."""

    def __init__(self, tolerance: float, gamma: float):
        self.tolerance, self.gamma = tolerance, gamma

    def init(self, handle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "ema double")
        self.waiting = handle.getListState("waiting", "us long, iteration long, loss double")

    def _wake(self, first_us: int, mark_ms: int) -> None:
        """A timer for when the watermark has passed the first step that waits."""
        self.handle.registerTimer(max(-(-first_us // 1000), mark_ms) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows))
        us = come["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        loss = [None if x != x else float(x) for x in come["loss"].astype(float).tolist()]  # a missing loss and NaN diverge alike
        self.waiting.appendList(list(zip(us, come["iteration"].astype(int).tolist(), loss, strict=True)))
        self._wake(min(us), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(((u, i, x) for u, i, x in self.waiting.get()), key=lambda r: r[:2])
        n = sum(u <= mark * 1000 for u, _, _ in waiting)
        if n < len(waiting):
            self.waiting.put(waiting[n:])
            self._wake(waiting[n][0], mark)
        else:
            self.waiting.clear()
        ema, out = (self.mean.get()[0] if self.mean.exists() else None), []
        for _, iteration, loss in waiting[:n]:
            ema, bad = _step(ema, loss, self.tolerance, self.gamma)
            out.append((key[0], iteration, float("nan") if loss is None else loss, ema, bad))
        if out:
            self.mean.update((ema,))
            yield pd.DataFrame(out, columns=["run_id", "iteration", "loss", "ema", "diverging"])

    def close(self) -> None:
        pass


def divergence_in_order(steps: DataFrame, tolerance: float = TOLERANCE, gamma: float = GAMMA, late: str = "10 minutes") -> DataFrame:
    """`divergence` over a stream (ts, run_id, iteration, loss) in the order of ts and iteration, however steps are dealt over batches.

    A step waits in its run's state until the watermark has passed it; steps later than `late` are dropped, as everywhere in Spark.
    A run holds the steps of the last `late` only.
    """
    _use_state(steps.sparkSession)
    rows = steps.select("ts", F.col("run_id").cast("long").alias("run_id"), F.col("iteration").cast("long").alias("iteration"), F.col("loss").cast("double").alias("loss"))
    return rows.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(_Ordered(tolerance, gamma), "run_id long, iteration long, loss double, ema double, diverging boolean", "append", "EventTime")
