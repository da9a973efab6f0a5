"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annolake.llm.common import id_bucket, shared_path, table
from annolake.llm.embedding_dedup import near_duplicate_vectors
from annolake.llm.exact_dedup import exact_dedup
from annolake.llm.language_id import identify_language
from annolake.llm.lm_scoring import lm_scores
from annolake.llm.mixing import mix_to_targets, quality_domains
from annolake.llm.ngram_join import jaccard_components
from annolake.llm.quality import quality
from annolake.llm.sentencepiece import encode_pieces
from annolake.llm.sharding import balanced_shards
from annolake.llm.toxicity import toxicity
from annolake.llm.vector_codes import vector_codes
from annolake.llm.warc import captures, read_warc, warc_records, write_warc
from annolake.llm.whitening import whiten

#: Model file of the public tokenizer that the encoding query uses.
PIECE_MODEL = os.environ.get("ANNOLAKE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), id_bucket("doc_id", 7) != 2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mix_to_targets(docs, quality_domains(labels, docs), {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, "low": 0.05})


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), 8)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"), id_bucket("doc_id", 3) != 1)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256.0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives hold UTF-8 text only, in which the gzip magic is not valid, so no record can lie inside another."""
    archives = shared_path(spark, "warc")
    write_warc(warc_records(table(spark, sf_dir, "pages"), "page_id", "url", "html", min_bytes=100), archives)
    return captures(read_warc(spark, archives, nested=False), "page_id", "long")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Codebooks and codes of vectors whose length is a multiple of parts."""
    book = "b0"
    steps = [f"""
        v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS MATERIALIZED (SELECT vec_id, label, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) r(p)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}),
        b0 AS MATERIALIZED (SELECT p, e, x FROM s JOIN f USING (vec_id))"""]
    for i in range(1, rounds + 2):
        steps.append(f"""
        a{i} AS MATERIALIZED (SELECT vec_id, label, s.p, min({{'d': list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS n
              FROM s JOIN {book} b ON s.p = b.p GROUP BY vec_id, label, s.p)""")
        if i <= rounds:
            steps.append(f"""
        m{i} AS (SELECT p, e, j, sum(c)::BIGINT AS t, count(*) AS n FROM (SELECT a.p, a.n.e AS e, unnest(s.x) AS c, unnest(range(len(s.x))) AS j FROM a{i} a JOIN s ON s.vec_id = a.vec_id AND s.p = a.p) GROUP BY p, e, j),
        b{i} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT p, e, list(((t - ((t % n + n) % n)) // n)::BIGINT ORDER BY j) AS x FROM m{i} GROUP BY p, e) u ON u.p = b.p AND u.e = b.e)""")
            book = f"b{i}"
    return "WITH " + ",".join(steps) + f""",
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {book}),
        o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM a{rounds + 1} GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h
    """


ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)
    """,
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                     ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS s FROM w),
        t AS (SELECT doc_id, unnest(s) AS token FROM g),
        n AS (SELECT doc_id, len(s) AS n_shingles FROM g),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared_n FROM t x JOIN t y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared_n >= 80 * (p.n_shingles + q.n_shingles - shared_n)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.v WHERE r.c < e.b)
        SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id FROM n JOIN (SELECT v AS doc_id, min(c) AS component_id FROM reach GROUP BY 1) USING (doc_id)
    """,
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             k AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM k
    """,
    "op13_vector_codes": _codes_sql(16, 64, 2),
}
