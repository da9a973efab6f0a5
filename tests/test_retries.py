"""Streams with keyed state: retries of objects over a restart, and steps that come in any order."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from annolake.streaming import jobs, retries


@pytest.fixture
def provider(spark):
    """Other tests go on with the state store that they had."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def converter(folder):
    """Fails by what a file counts, so that a restart goes on counting: object 2 twice, 3 for its second row once, 4 always, 5 by an exception once."""

    def convert(rows: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/{rows['image_id'].iloc[0]}-{rows['object_id'].iloc[0]}"
        with open(name, "a+") as f:
            f.write("x")
            f.seek(0)
            n = len(f.read())
        kind = int(rows["object_id"].iloc[0])
        if kind == 5 and n == 1:
            raise RuntimeError("broken")
        bad = {2: n <= 2, 4: True}.get(kind, False)
        reason = [f"bad {n}" if bad or (kind == 3 and n == 1 and part == 1) else None for part in rows["part"]]
        return rows.assign(area=rows["part"] * 10.0, reason=reason)

    return convert


def wait_for(query, check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        assert query.exception() is None, query.exception()
        if check():
            return
        time.sleep(0.3)
    raise AssertionError("the stream did not get there")


def test_objects_are_retried_over_a_restart(spark, tmp_path, provider):
    rows = [(7, k, part, None if part else "text") for k in range(1, 6) for part in range(2 if k == 3 else 1)]
    df = spark.createDataFrame(rows, "image_id long, object_id long, part int, note string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "count").mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(wait_ms):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        done = retries.convert_with_retries(stream, converter(str(tmp_path / "count")), "image_id long, object_id long, part int, note string, area double", attempts=3, wait_ms=wait_ms)
        return retries.write_converted(done, out, cp, "200 milliseconds")

    def found():
        try:
            return sorted((r.status, r.object_id, r.part, r.attempt, r.reason) for r in spark.read.parquet(out).collect())
        except Exception:
            return []

    first = [("done", 1, 0, 1, None), ("done", 3, 0, 1, None)]
    query = start(2_000)
    wait_for(query, lambda: len(found()) >= 2)
    query.stop()
    assert [r for r in found() if r[3] == 1] == first
    assert {r.object_id for r in retries.open_objects(spark, cp).collect()} == {2, 3, 4, 5} - {r[1] for r in found() if r[3] > 1}
    query = start(2_000)  # another session of the same stream: attempts go on from the state
    df.where("object_id = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # comes again, is passed over
    wait_for(query, lambda: len(found()) >= 6)
    query.stop()
    assert found() == sorted([*first, ("done", 2, 0, 3, None), ("done", 3, 1, 2, None), ("done", 5, 0, 2, None), ("dead", 4, 0, 3, "bad 3")])
    assert {r.area for r in spark.read.parquet(out).where("status = 'done'").collect()} == {0.0, 10.0}
    assert len((tmp_path / "count/7-1").read_text()) == 1 and len((tmp_path / "count/7-2").read_text()) == 3


def test_image_that_fails_in_part_stays_open(spark, tmp_path):
    """The batch form: an image is done when all of its rows are fine."""
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "image_id long, part int")
    out, retry = str(tmp_path / "out"), str(tmp_path / "retry")
    convert = lambda b: b.select("image_id", "part", F.when((F.col("image_id") == 1) & (F.col("part") == 1), "bad").alias("reason"))
    jobs._convert_to(df, convert, f"{out}/batch=0", f"{retry}/batch=0")
    assert [r.image_id for r in spark.read.parquet(out).collect()] == [2]
    assert [r.image_id for r in jobs.retry_failed(spark, convert, out, retry, 1).collect()] == [1]
    fixed = lambda b: b.select("image_id", "part", F.lit(None).cast("string").alias("reason"))
    assert jobs.retry_failed(spark, fixed, out, retry, 2).count() == 0
    assert sorted((r.image_id, r.part) for r in spark.read.parquet(out).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_divergence_in_order(spark, tmp_path, provider):
    """Steps of three runs, shuffled over files that come one by one, and a run far later that moves the watermark: the same as the batch form."""
    rng = random.Random(6)
    losses = [1.0, 2.0, 9.0, float("nan"), 1.5, 30.0, None, 1.0, 3.0, 2.5, 40.0, 1.2]
    rows = [(i * 20, r, i, None if x is None else x * (r + 1)) for r in range(3) for i, x in enumerate(losses)]
    schema = "s long, run_id long, iteration long, loss double"
    select = lambda data: spark.createDataFrame(data, schema).select(F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "run_id", "iteration", "loss")
    batch = jobs.divergence(select(rows))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    at = str(tmp_path / "in")
    for i in range(0, len(shuffled), 9):
        select(shuffled[i : i + 9]).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.05)
    select([(10_000, 9, 0, 1.0)]).coalesce(1).write.mode("append").parquet(at)
    select([(10_001, 9, 1, 1.0)]).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(batch.sparkSession.read.parquet(at).schema).option("maxFilesPerTrigger", 1).parquet(at)
    out = str(tmp_path / "out")
    writer = retries.divergence_in_order(stream, late="10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.run_id, r.iteration, round(r.ema, 9), r.diverging)
    assert sorted(key(r) for r in spark.read.parquet(out).where("run_id < 9").collect()) == sorted(key(r) for r in batch.collect())


def test_throughput_without_windows_over_runs(spark):
    rng = random.Random(2)
    rows = [(r, i, rng.random(), None if i % 7 == 3 else rng.random(), rng.random()) for r, n in ((1, 1), (2, 4), (3, 6), (4, 40)) for i in rng.sample(range(n * 3), n)]
    got = {r.run_id: r for r in jobs.throughput(spark.createDataFrame(rows, "run_id int, iteration int, data_s double, compute_s double, eval_s double"), warmup=5).collect()}
    for run in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == run), key=lambda r: r[1])
        own = own[min(5, len(own) - 1) :]
        mean = lambda xs: sum(x for x in xs if x is not None) / n if (n := sum(x is not None for x in xs)) else None
        want = [mean([r[k] for r in own]) for k in (2, 3, 4)] + [mean([None if None in r[2:] else sum(r[2:]) for r in own])]
        assert got[run].n == len(own)
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(want, (got[run].data_s, got[run].compute_s, got[run].eval_s, got[run].total_s), strict=True))
