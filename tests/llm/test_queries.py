"""The registered queries with SQL against it; the pipeline's stages keep what they should."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annolake.llm import queries
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    check(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLE[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).persist()
        assert after.columns == first.columns and after.join(docs, "doc_id", "left_anti").count() == 0, name
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() > 0.5 * first.count() and out.where("NOT round_trip").count() == 0
    assert docs.select("text").distinct().count() == docs.count()


def test_pipeline_decides_on_rows(spark):
    """Repeated rows, two texts of one id, and null ids."""
    larger = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{larger}/{x}.parquet") for x in ("documents", "labels"))
    clean = corpus_pipeline.remove_toxic(spark, docs, larger).persist()
    toxic = docs.where("doc_id IS NOT NULL").join(clean, "doc_id", "left_anti").orderBy("doc_id").first()
    plain = clean.join(labels, "doc_id", "left_anti").where("size(split(text, ' ')) > 50").orderBy("doc_id").select(*docs.columns).first()
    near = plain.text + " changed"
    odd = [(i, t, plain.lang, plain.source, plain.n_chars) for i, t in ((plain.doc_id, toxic.text), (None, toxic.text), (plain.doc_id, plain.text), (None, plain.text), (None, near), (None, near))]
    left = corpus_pipeline.remove_toxic(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), larger)
    left = left.where(left.text.isin(toxic.text, plain.text, near)).persist()
    assert left.where(left.text == toxic.text).count() == 0 and left.count() >= 5
    for stage, wanted in ((corpus_pipeline.remove_copies, [plain.text, near]), (corpus_pipeline.one_of_each_group, [plain.text])):
        left = stage(spark, left, larger).persist()
        assert sorted(r.text for r in left.collect()) == sorted(wanted) and left.where(left.doc_id == plain.doc_id).count() == 1


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, empty texts, repeated rows, and further columns with names that the operators use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (5_000_001, None, "en", "s", 0), (5_000_002, "", "en", "s", 0), (5_000_002, "", "en", "s", 0), (5_000_003, "a b", None, None, 3), (5_000_003, "a b", None, None, 3)]
    extra = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"id": F.lit(1), "n": F.lit(2), "component_id": F.lit(3), "score": F.lit("x"), "r": F.lit(None).cast("double")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, extra, SF).persist()
        if name == "sentencepiece":
            assert out.count() == extra.count() and out.where("doc_id = 5000002 AND n_pieces = 0").count() == 2 and out.where("doc_id = 5000001 AND pieces IS NULL").count() == 1
            continue
        assert out.columns == extra.columns and out.where("score = 'x'").count() == out.count() > 0.5 * docs.count()
        n = out.where("doc_id >= 5000000 OR doc_id IS NULL").count()
        # Null and empty texts are one text; the two short rows another. To the join, texts without words are no copies of one another.
        assert n == {"toxicity": 6, "exact_dedup": 2, "ngram_jaccard_join": 5}.get(name, n), name


def test_no_links_of_ids_are_needed(spark):
    """The SQL and brute-force tests hold single stages; here the stages' decisions add up: what a stage drops never comes back."""
    docs = corpus_pipeline.table(spark, SF, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF).persist()
    texts = [r.text for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts))
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) or frozenset([tuple(w)]) for w in ((t or "").lower().split() for t in texts) if w]
    from collections import defaultdict

    by_token = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by_token[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by_token[x] if j > i}:
            assert 100 * len(s & sets[j]) < 80 * len(s | sets[j])
