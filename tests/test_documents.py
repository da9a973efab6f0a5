"""Documents by byte ranges: cuts at every byte against Python's parser, round trips of many tasks, and what is refused."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.sources import documents, json_ranges
from annolake.sources.json_ranges import Document, Structure, between, compose, records_of, summarize

NASTY = ['{"a": [', "}]", '\\', '\\\\', '"', '\\"', '"images": [{', "é ", "", '\\"annotations\\":', "x" * 40]


def tricky(seed, indent):
    """Braces, quotes and backslashes in strings, nested and unknown keys, names of sections inside records and as values, sections in any order."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))
    record = lambda i: {"id": i, "name": text(), text() or "k": {"annotations": [{"id": -1}], "images": text()}, "K": [[1, 2], [3]]}
    parts = [("info", [{"id": 3, "source": text()}, {"id": 4}] if seed % 2 else {"id": 3, "images": [{"id": 99}], "name": text()}), ("images", [record(i) for i in range(3)]), ("categories", []), ("licenses", [record(70)]), ("annotations", [record(i) for i in range(4)]), ("version", "annotations"), ("note", {"annotations": [{"id": 71}]})]
    rng.shuffle(parts)
    doc = dict(parts)
    return doc, json.dumps(doc, indent=indent, ensure_ascii=bool(seed % 3))


def wanted_of(doc):
    out = []
    for section in json_ranges.SECTIONS:
        value = doc.get(section, [])
        out += [(section, v) for v in ([value] if isinstance(value, dict) else value)]
    return sorted(out, key=repr)


def by_ranges(doc, size):
    plan = compose({(doc.name, a): json.loads(json.dumps(summarize(doc, a, min(a + size, doc.size)))) for a in range(0, doc.size, size)}, [doc], size)
    got = []
    for r in plan:
        part = json_ranges._Range(doc, r["start"], min(r["start"] + size, doc.size), r["depth"], r["in_string"], r["section"], r["bracket"])
        own = [(s, json.loads(t)) for s, _, t in records_of(part, set(json_ranges.SECTIONS))]
        assert {s for s, _ in own} <= set(r["names"])
        got += own
    return sorted(got, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_at_every_byte(tmp_path, seed, monkeypatch):
    monkeypatch.setattr(json_ranges, "AHEAD", 3)
    want, text = tricky(seed, [None, 1, "\t"][seed % 3])
    data = text.encode()
    (tmp_path / "d.json").write_bytes(data)
    doc = Document("d", str(tmp_path / "d.json"), [(str(tmp_path / "d.json"), len(data))])
    for size in [*range(1, 24), 64, 301, len(data)]:
        assert by_ranges(doc, size) == wanted_of(want), size
    # The same text over three files.
    cuts = sorted(random.Random(seed).sample(range(1, len(data)), 2))
    files = []
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
        (tmp_path / f"p{i}").write_bytes(data[a:b])
        files.append((str(tmp_path / f"p{i}"), b - a))
    assert by_ranges(Document("d", str(tmp_path), files), 50) == wanted_of(want)


def test_structure_by_a_state_machine():
    rng = random.Random(1)
    for _ in range(300):
        chars = [rng.choice('"\\{}[]a') for _ in range(rng.randrange(30))]
        for inside in (False, True):
            for escaped in (False, True) if inside else (False,):
                state, esc, depth, got, text = inside, escaped, 0, [], ""
                for c in chars:
                    if c == "\\" and not state:
                        continue  # JSON has backslashes in strings only
                    i, text = len(text), text + c
                    if esc:
                        esc = False
                    elif c == "\\":
                        esc = True
                    elif c == '"':
                        state = not state
                    elif c in "{[" and not state:
                        depth += 1
                        got.append((i, depth))
                    elif c in "}]" and not state:
                        depth -= 1
                        got.append((i, depth))
                s = Structure(text.encode(), inside, escaped)
                assert (s.in_string_after, s.escaped_after) == (state, esc)
                assert list(zip(s.at.tolist(), s.depth.tolist(), strict=True)) == got


def test_text_between_records():
    for sections in ([0, 1, 1, 2, 3, 3], [3], [1, 3], [], [0], [2, 2]):
        out, last = "", -1
        for i, k in enumerate(sections):
            out, last = out + between(last, k) + json.dumps({"i": i}), k
        doc = json.loads(out + between(last, 4))
        assert list(doc) == list(json_ranges.SECTIONS)
        assert [len(doc[s]) for s in json_ranges.SECTIONS[1:]] == [sections.count(k) for k in (1, 2, 3)] and (doc["info"] is None) == (0 not in sections)


def sets(spark, n):
    one = F.array(*(F.lit(0.5) for _ in range(4)))
    images = spark.range(n).select(F.col("id").alias("image_id"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.concat(F.lit('a"{['), "id").alias("file_path"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("k"), (F.col("id") % 3).cast("int").alias("dataset_id"))
    anns = spark.range(3 * n).select(F.col("id").alias("ann_id"), (F.col("id") % n).alias("image_id"), (F.col("id") % n % 3).cast("int").alias("dataset_id"), F.lit(1).alias("category_id"), F.lit("chair}").alias("category_name"))
    anns = anns.withColumns({"valid3D": F.lit(True), "bbox2D_tight": F.when(F.col("ann_id") % 2 == 0, one), "bbox2D_trunc": one, "bbox2D_proj": F.lit(None).cast("array<double>"), "bbox3D_cam": F.lit(None).cast("array<array<double>>"), "center_cam": F.lit(None).cast("array<double>"), "dimensions": F.lit(None).cast("array<double>"), "R_cam": F.lit(None).cast("array<array<double>>"), "behind_camera": F.lit(False)})
    anns = anns.withColumns({"visibility": F.lit(None).cast("double"), "truncation": F.lit(0.25), "segmentation_pts": F.lit(None).cast("int"), "lidar_pts": F.lit(4), "depth_error": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
    cats = spark.createDataFrame([(1, "chair}", "object"), (2, None, "object")], "category_id int, name string, supercategory string")
    info = spark.createDataFrame([(0, "s", "zero", "val"), (1, "s", "one", "val"), (2, None, "two", None)], "id int, source string, name string, split string")
    return {"info": info, "images": images, "categories": cats, "annotations": anns}


@pytest.mark.parametrize("single", [False, True])
def test_sets_of_many_tasks_round_trip(spark, tmp_path, single):
    tables = sets(spark, 200)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        for _ in range(2):  # writing again replaces
            documents.write_annotation_set(tables, str(tmp_path / "out"), single)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in range(3):
        at = tmp_path / f"out/dataset_id={k}.json"
        doc = json.loads(at.read_text() if single else "".join(f.read_text() for f in sorted(at.glob("part-*"))))
        assert list(doc) == list(json_ranges.SECTIONS) and [a["id"] for a in doc["annotations"]] == sorted(a["id"] for a in doc["annotations"]) and len(doc["categories"]) == 2
        assert doc["info"]["id"] == k and (doc["annotations"][0]["visibility"], doc["annotations"][0]["bbox2D_proj"]) == (-1, [-1] * 4)
    assert not list((tmp_path / "out").glob("_*"))
    back = documents.read_annotation_sets(spark, [str(tmp_path / "out")], range_bytes=2048)
    for name in ("images", "annotations", "info"):
        want = sorted(map(repr, (r.asDict() for r in tables[name].collect())))
        assert sorted(map(repr, (r.asDict() for r in back[name].select(*tables[name].columns).collect()))) == want, name
    assert back["categories"].count() == 6 and back["categories"].distinct().count() == 2


def test_same_as_one_row_for_a_document(spark, tmp_path):
    """The tables equal those of Spark's own reader, which holds a document in one row."""
    rng = np.random.default_rng(0)
    doc = {"annotations": [{"id": i, "image_id": i % 5, "bbox2D_tight": rng.random(4).tolist(), "category_name": rng.choice(NASTY)} for i in range(300)], "images": [{"id": i, "file_path": rng.choice(NASTY)} for i in range(5)], "info": {"id": 1, "name": "n"}, "categories": [{"id": 1, "name": "c"}]}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps(doc))
    raw = spark.read.schema(f"images array<{documents.IMAGE}>, annotations array<{documents.ANNOTATION}>").option("multiLine", True).json(str(tmp_path / "d/a.json"))
    got = documents.read_annotation_sets(spark, [str(tmp_path / "d")], range_bytes=500)
    want = raw.select(F.explode("annotations").alias("a")).select("a.*").withColumnRenamed("id", "ann_id")
    assert got["annotations"].rdd.getNumPartitions() > 20
    assert sorted(map(repr, got["annotations"].collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, got["images"].collect())) == sorted(map(repr, raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height", "i.file_path", F.col("i.K").alias("k"), "i.dataset_id").collect()))
    (tmp_path / "d/a.json").write_text(json.dumps(doc)[:-30])
    with pytest.raises(ValueError, match="no whole JSON"):
        documents.read_annotation_sets(spark, [str(tmp_path / "d")])
    with pytest.raises(FileNotFoundError):
        documents.read_annotation_sets(spark, [str(tmp_path / "none")])


def test_lenient_records_of_every_shape(spark):
    """Lists, containers, maps of images, odd fields and broken text."""
    rows = [
        (1, '[{"image_id": 3, "bbox": [1, 2, 3, 4], "label": "a", "score": 0.5}, 7, {"image_id": "4", "bbox": [], "box": "[5, 6.5, 7, 8]", "name": "b", "conf": "0.25"}]'),
        (2, '{"results": [{"image_id": 5, "label": "", "category": " c ", "score": "high", "confidence": 0.9}], "count": 1}'),
        (3, '{"12": [{"image_id": 99, "bbox": [0, 0, 1, 1], "label": 8}], "11": [], "x": [{"phrase": "d{\\"}", "bbox_xyxy": null, "bbox": "wide"}], "n": 4}'),
        (4, '[{"image_id": 1'), (5, ""), (6, None), (7, "[]"), (8, "3"), (9, '{"annotations": [], "detections": [{"image_id": 1}]}'),
    ]
    got = documents.normalize_records(spark.createDataFrame(rows, "doc int, json string"))
    assert got.columns == ["doc", "record_no", "image_id", "box", "label", "score"]
    assert sorted(map(tuple, got.collect())) == [
        (1, 0, 3, [1.0, 2.0, 3.0, 4.0], "a", 0.5), (1, 2, 4, [5.0, 6.5, 7.0, 8.0], "b", 0.25), (2, 0, 5, None, " c ", None),
        (3, 0, 12, [0.0, 0.0, 1.0, 1.0], "8", None), (3, 1, None, None, 'd{"}', None),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and "from_json" not in plan
