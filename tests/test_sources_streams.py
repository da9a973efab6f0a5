"""Round trips of files, and streams against their batch forms."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from annolake.sources import documents, rasters
from annolake.streaming import jobs

DOC = {
    "info": [{"id": 3, "source": "s", "name": "set", "split": "val"}],
    "images": [{"id": 1, "width": 640, "height": 480, "file_path": "a.png", "K": [[1, 0, 2], [0, 1, 2], [0, 0, 1]], "dataset_id": 3}],
    "categories": [{"id": 5, "name": "chair", "supercategory": "object"}],
    "annotations": [{"id": 9, "image_id": 1, "dataset_id": 3, "category_id": 5, "category_name": "chair", "valid3D": True, "bbox2D_tight": [-1, -1, -1, -1], "bbox2D_trunc": [1, 2, 3, 4], "dimensions": [1, 1, 1], "truncation": -1, "visibility": 0.5, "lidar_pts": -1}],
}


def test_document_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(DOC))
    tables = documents.read_annotation_sets(spark, [str(tmp_path / "in/a.json")])
    a = tables["annotations"].first()
    assert a.bbox2D_tight is None and a.truncation is None and a.lidar_pts is None and a.visibility == 0.5 and tables["info"].first().split == "val"
    documents.write_annotation_set(tables, str(tmp_path / "out"))
    back = documents.read_annotation_sets(spark, [str(tmp_path / "out")])
    assert back["annotations"].first().asDict() == a.asDict() and back["images"].first() == tables["images"].first()


def test_rasters_and_points(spark, tmp_path):
    depth = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "d").mkdir()
    np.save(tmp_path / "d/7.npy", depth)
    got = rasters.read_depth(spark, str(tmp_path / "d")).orderBy("v").collect()
    assert [list(r.depth) for r in got] == depth.tolist() and got[0].image == "7"
    mask = np.zeros((2, 1, 3, 5), bool)
    mask[0, 0, 1, 1:3] = mask[1, 0, 2, 4] = mask[0, 0, 0, 0] = True
    (tmp_path / "m").mkdir()
    np.save(tmp_path / "m/7.npy", mask)
    assert sorted((r.inst_id, r.v, r.u0, r.u1) for r in rasters.read_masks(spark, str(tmp_path / "m")).collect()) == [(0, 0, 0, 0), (0, 1, 1, 2), (1, 2, 4, 4)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/chair_12.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    rows = rasters.read_points(spark, str(tmp_path / "p")).orderBy("pt_id").collect()
    assert [(r.label, r.idx, r.x, r.z) for r in rows] == [("chair", 12, 1, 3), ("chair", 12, 4, 6)]


def test_divergence_stream_equals_batch(spark, tmp_path):
    losses = [1.0, 2.0, 9.0, float("nan"), 1.5, 30.0, 1.0]
    rows = [(i * 60, r, i, x * (r + 1)) for r in range(3) for i, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "s long, run_id long, iteration long, loss double").select(F.timestamp_seconds("s").alias("ts"), "run_id", "iteration", "loss")
    batch = jobs.divergence(df)
    marks = {(r.run_id, r.iteration): r.diverging for r in batch.collect()}
    assert marks[(0, 2)] and marks[(0, 3)] and marks[(0, 5)] and not marks[(0, 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.divergence_stream(stream).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.run_id, r.iteration): (round(r.ema, 9), r.diverging) for r in spark.table("watched").collect()}
    assert got == {(r.run_id, r.iteration): (round(r.ema, 9), r.diverging) for r in batch.collect()}
    assert all(not math.isinf(e) for e, _ in got.values())


def test_convert_stream_once(spark, tmp_path):
    df = spark.range(10).select(F.timestamp_seconds(F.lit(1_700_000_000)).alias("modified"), (F.col("id") % 5).alias("image_id"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    convert = lambda b: b.select("image_id", F.when(F.col("image_id") == 3, "bad").alias("reason"))
    args = (convert, str(tmp_path / "out"), str(tmp_path / "retry"), str(tmp_path / "cp"))
    for _ in range(2):
        jobs.stream_convert(stream, *args).awaitTermination()
    assert sorted(r.image_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 4]
    assert [r.image_id for r in spark.read.parquet(str(tmp_path / "retry")).collect()] == [3]
    fixed = lambda b: b.select("image_id", F.lit(None).cast("string").alias("reason"))
    left = [sorted(r.image_id for r in jobs.retry_failed(spark, f, *args[1:3], k).collect()) for k, f in enumerate((convert, fixed, fixed))]
    assert left == [[3], [], []] and sorted(r.image_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
