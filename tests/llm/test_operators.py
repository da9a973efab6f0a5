"""Each operator on small tables against brute force, with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolake.llm import embedding_dedup, lm_scoring, mixing, ngram_join
from annolake.llm import language_id
from annolake.llm import quality as quality_module
from annolake.llm import toxicity as toxicity_module
from annolake.llm.common import id_bucket
from annolake.llm.embedding_dedup import near_duplicate_vectors
from annolake.llm.exact_dedup import exact_dedup
from annolake.llm.graph import connected_components
from annolake.llm.language_id import identify_language
from annolake.llm.lm_scoring import lm_scores
from annolake.llm.mixing import _wanted, mix_to_targets
from annolake.llm.ngram_join import jaccard_components
from annolake.llm.quality import quality
from annolake.llm.queries import PIECE_MODEL
from annolake.llm.sentencepiece import Encoder, decode_pieces, encode_pieces, load_model
from annolake.llm.sharding import balanced_shards, differencing
from annolake.llm.toxicity import toxicity

#: Extra columns carry names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, pid int, sha string, n long, shard int, r double"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or".split(), "de": "sch ein ung ver der ich keit ß ä ö".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows_of(texts, lang="en"):
    return [(i, t, lang if isinstance(lang, str) else lang[i], "s", len(t or ""), 7, 1, "x", 2, 3, 0.5) for i, t in enumerate(texts)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Two languages, junk, toxic words, copies, near copies, a null, empties and a long text."""
    rng = random.Random(5)
    texts, langs, toxic, good = [], [], [], []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        t = sentence(rng, lang, rng.randrange(30, 90))
        bad = i % 5 == 1
        if bad:
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice(["1d1ot", "idiot", "IDIOT", "ｉｄｉｏｔ", "idiоt"]) + rng.choice(["", ".", "!"])
            t = " ".join(words)
        junk = i % 8 == 3
        if junk:
            t = " ".join(w.upper() + "%%" for w in t.split())
        texts.append(t), langs.append(lang), toxic.append(int(bad)), good.append(int(not junk))
    base = texts[0].split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (0, len(base) - 1)]
    extra = [texts[0], texts[0], *near, None, "", "  \n", "12 34 %%", "one two", sentence(rng, "en", 6000)]
    texts += extra
    langs += ["de", "de", "de", "de", None, "en", "en", "en", "en", "en"]
    toxic += [0] * len(extra)
    good += [1] * len(extra)
    return texts, langs, toxic, good


def test_exact_dedup(spark, corpus):
    texts = corpus[0]
    rows = rows_of(texts) + rows_of(texts)[:1] + [(None, "alone", None, None, 0, 7, 1, "x", 2, 3, 0.5)]
    for keep in ("min", "max"):
        got = exact_dedup(table(spark, rows), keep=keep).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[r[1] or ""].append(r[0])
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        pick = {t: (min if keep == "min" else max)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        for r in got:
            t = by_sha[r.text_sha256]
            assert r.keep_id == pick[t] and r.group_size == len(groups[t]) and (not r.kept or r.doc_id == pick[t])
    assert exact_dedup(table(spark, [])).count() == 0


def test_hot_group_over_partitions(spark):
    got = exact_dedup(table(spark, rows_of(["same"] * 3000 + [f"t{i}" for i in range(50)])), keep="max").where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.expr("count_if(kept)")).first()
    assert tuple(got) == (3000, 2999, 2999, 1)


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(n, links):
    up = list(range(n))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def test_jaccard_components(spark, corpus):
    rng = random.Random(9)
    texts = list(corpus[0])
    for _ in range(12):  # families at all distances around the threshold
        base = sentence(rng, "en", 150).split()
        for edits in (1, 1, 2, 3, 5):
            w = list(base)
            for k in rng.sample(range(150), edits):
                w[k] = "x" + w[k]
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows_of(texts))).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))} and len(links) > 20
    named = table(spark, rows_of(texts)).withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    assert {r.doc_id: r.component_id for r in jaccard_components(named).collect()} == {f"d{i:05d}": f"d{want[i]:05d}" for i in range(len(texts))}
    assert jaccard_components(table(spark, [])).count() == 0


def test_jaccard_wide_rows_and_large_groups(spark, monkeypatch):
    """A group of near copies, sets on either side of the threshold to it, and many sets around one passage, with rows paired in tiles."""
    for name, value in {"SHORT_ROW": 3, "WIDE_ROW": 8, "WIDE_TILE": 4, "TILE": 5, "FIRST_QUERIES": 1, "BUCKET": 20}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11)
    base, other = sentence(rng, "en", 140).split(), sentence(rng, "de", 100).split()
    texts = [" ".join([*base[:k], f"w{i}", *base[k + 1 :]]) for i, k in enumerate(rng.choices(range(140), k=40))]
    texts += [" ".join(w if k not in at else f"v{i}" for k, w in enumerate(base)) for i in range(30) for at in [set(rng.sample(range(140), rng.randrange(2, 7)))]]
    texts += [" ".join([*other, *sentence(rng, "en", rng.randrange(5, 40)).split()]) for _ in range(40)]
    rows = rows_of([*texts, *texts[:20]])
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(rows), links)
    assert {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows)).collect()} == dict(enumerate(want)) and len(set(want)) > 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 55), (60, 60), (50, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 55: 50, 60: 50}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(12, 16))
    for i in range(360):
        v = centre[i % 12] + rng.normal(size=16) * (0.08 if i % 3 else 1.5)
        rows.append([i, v.tolist(), i % 12 % 3])
    rows += [[360, rows[1][1], 1], [361, rows[1][1], 1], [362, None, 1], [363, [0.0] * 16, 1], [364, [float("nan")] * 16, 1], [365, rows[1][1], None], [366, [None] * 16, 1], [367, [], 1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).withColumn("component", F.lit(1))
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    sound = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = [(a[0], b[0]) for a, b in itertools.combinations(sound, 2) if a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    degree = Counter(x for pair in links for x in pair)
    want = components(len(rows), links)
    found = sum(min(got[i].n_links, degree[i]) for i in got)
    assert len(got) == len(rows) and all(got[i].n_links <= degree[i] for i in got) and found >= 0.9 * sum(degree.values())
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.97 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("constants", [{}, {"RECALL": 1.01, "TRIES": 1}])
def test_rare_links(spark, monkeypatch, constants):
    """Isolated pairs just above the threshold among many vectors without links; also where the search never finds enough."""
    for name, value in constants.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 48))
    v /= np.linalg.norm(v, axis=1)[:, None]
    other = rng.normal(size=(60, 48))
    other -= (other * v[:60]).sum(axis=1)[:, None] * v[:60]
    v[60:120] = 0.935 * v[:60] + math.sqrt(1 - 0.935**2) * other / np.linalg.norm(other, axis=1)[:, None]
    got = near_duplicate_vectors(spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.where("n_links > 0").collect()} == {i: (1, i % 60) for i in range(120)}


def test_differencing():
    rng = random.Random(1)
    w = [rng.randrange(1, 1000) for _ in range(2000)]
    sums = np.bincount(differencing(w, 8), weights=w, minlength=8)
    assert sums.max() - sums.min() <= 5 and differencing([], 3).tolist() == [] and sorted(differencing([5, 5, 5], 3)) == [0, 1, 2]


def test_shards(spark, corpus):
    texts = corpus[0] * 3 + ["hot copy"] * 200
    got = balanced_shards(table(spark, rows_of(texts)), 4).collect()
    size, shard_of, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes"
        size[r.shard] += r.size
        shard_of[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(3 * (len((t or "").encode()) + 1) for t in corpus[0])
    assert max(size.values()) - min(size.values()) <= max(0, largest - min(size.values())) + 200
    assert balanced_shards(table(spark, [])).count() == 0


def test_language(spark, corpus):
    texts, langs, *_ = corpus
    got = {r.doc_id: r for r in identify_language(table(spark, rows_of(texts, langs)), id_bucket("doc_id", 3) != 1).collect()}
    lettered = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].lang_pred == "und") == (i not in set(lettered)) for i in got)
    held = [i for i in lettered if got[i].held_out and len(texts[i].split()) > 5]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.95
    none = identify_language(table(spark, rows_of(texts, [None] * len(texts))), F.lit(True))
    assert [r.lang_pred for r in none.select("lang_pred").distinct().collect()] == ["und"]


def test_toxicity(spark, corpus):
    texts, _, toxic, good = corpus
    docs = table(spark, rows_of(texts))
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))] + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels, id_bucket("doc_id", 5) != 0, exceptions=["village idiot"]).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    plain = [i for i in got if not (texts[i] or "").isupper()]
    assert np.mean([got[i].predicted == toxic[i] for i in plain]) > 0.95
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity(docs, empty, F.lit(True)).agg(F.max("score")).first()[0] == 0


def test_quality(spark, corpus):
    texts, langs, _, good = corpus
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good[:160])], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(table(spark, rows_of(texts, langs)), labels).collect()}
    real = [i for i, t in enumerate(texts) if t and len(t.split()) > 20]
    assert len(got) == len(texts) and np.mean([got[i].kept == bool(good[i]) for i in real]) > 0.95
    assert not got[texts.index("")].kept and got[texts.index("")].perplexity is None


def test_lm_scores(spark, corpus):
    texts = corpus[0]
    got = {r.doc_id: r for r in lm_scores(table(spark, rows_of(texts, corpus[1])), id_bucket("doc_id", 7) != 2).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(t in c for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) and r.score < 0 and math.isfinite(r.score)
    # So small a corpus leaves most tokens unseen, and the base pays next to nothing for those.
    assert sum(r.score for r in got.values()) > 1.05 * sum(r.base_score for r in got.values())
    assert lm_scores(table(spark, rows_of(["a b"])), F.lit(False)).first().train_tokens == 0


def test_weights_learn_from_all_pairs():
    tokens = [np.base_repr(i, 36).lower().encode() for i in range(130_000)]
    batch = pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.binary()), "t0": pa.array([1] * len(tokens), pa.int64()), "t1": pa.array([i % 2 for i in range(len(tokens))], pa.int64())})
    counts = SimpleNamespace(value=[np.zeros((1 << s, 2), np.float32) for s in lm_scoring.SLOTS])
    (learnt,) = lm_scoring._train(counts, [130_000, 65_000])(iter(batch.slice(i, 10_000) for i in range(0, len(tokens), 10_000)))
    assert learnt.column("seen").to_pylist() == [195_000]
    # The same from batches cut elsewhere; streams that share a task learn as they would alone.
    (again,) = lm_scoring._train(counts, [130_000, 65_000])(iter(batch.slice(i, 777) for i in range(0, len(tokens), 777)))
    assert again.equals(learnt)
    own = lambda i, part: part.append_column("stream", pa.array([i] * part.num_rows, pa.int64()))
    both = [own(0, batch.slice(0, 30_000)), own(1, batch.slice(30_000, 100_000))]
    together = list(lm_scoring._train(counts, [130_000, 65_000])(iter([x.slice(i, 5_000) for x in both for i in range(0, x.num_rows, 5_000)])))
    alone = [r for x in both for r in lm_scoring._train(counts, [130_000, 65_000])(iter([x]))]
    assert [r.column("stream").to_pylist() for r in together] == [[0], [1]] and all(a.equals(b) for a, b in zip(together, alone, strict=True))


def test_scores_do_not_depend_on_partitions(spark, corpus, monkeypatch):
    """Several streams, rows dealt otherwise, and another number of partitions."""
    monkeypatch.setattr(lm_scoring, "STREAM_TOKENS", 40)
    docs = table(spark, rows_of(corpus[0], corpus[1]))
    learn, before = id_bucket("doc_id", 7) != 2, spark.conf.get("spark.sql.shuffle.partitions")
    one = {r.doc_id: r for r in lm_scores(docs.repartition(3, "doc_id"), learn).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        other = {r.doc_id: r for r in lm_scores(docs.repartition(11), learn).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one.keys() == other.keys() and all(one[i].score == pytest.approx(other[i].score, rel=1e-6) for i in one)


def test_counts_beyond_single_precision():
    batch = pa.RecordBatch.from_pydict({"token": pa.array([b"a", b"a"], pa.binary()), "t0": pa.array([1 << 25, 1], pa.int64())})
    top = max(np.frombuffer(r["counts"], np.float64).max() for b in lm_scoring._count_bits(1)(iter([batch])) for r in b.to_pylist())
    assert top == (1 << 25) + 1


def test_pieces(spark, corpus):
    import sentencepiece

    texts = [*corpus[0], "a\tbé \U0001f600 日本", "  lead  and  trail  ", "x" * 500, "mark ▁ here"]
    got = encode_pieces(table(spark, rows_of(texts)), PIECE_MODEL)
    m = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].pieces is None and rows[i].n_pieces is None
        else:
            assert list(rows[i].pieces) == m.encode(t) and rows[i].round_trip == ("▁" not in t)
    back = {r.doc_id: r.text for r in decode_pieces(got, PIECE_MODEL).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if t is None or "▁" not in t)


def test_unigram_viterbi():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -2.5, "ba": -2.9, "▁ab": -6.0, "aba": -9.0}
    model = {"pieces": ["<unk>", *scores], "scores": [0.0, *scores.values()], "plain": [False] + [True] * len(scores), "bytes": {}, "unknown": 0}
    enc = Encoder(model, "unigram")
    words = [" " + "".join(w) for k in range(1, 6) for w in itertools.product("ab", repeat=k)]
    flat, n = enc.words(words)
    ends = np.cumsum(n)
    def best(w):
        return max((scores[w[:k]] + (best(w[k:]) if w[k:] else 0) for k in range(1, len(w) + 1) if w[:k] in scores), default=-1e9)
    for w, a, b in zip(words, ends - n, ends, strict=True):
        assert sum(model["scores"][p] for p in flat[a:b]) == pytest.approx(best(w.replace(" ", "▁")))
    assert load_model(PIECE_MODEL)["unknown"] == 0


def test_mixing(spark, corpus):
    texts, langs, _, good = corpus
    docs = table(spark, rows_of(texts, langs))
    labelled = spark.createDataFrame([(i, "low" if not good[i] else langs[i]) for i in range(150)], "id long, domain string")
    got = mix_to_targets(docs, labelled, {"en": 0.5, "de": 0.4, "low": 0.1, "xx": 0.3}).collect()
    total = Counter()
    for r in got:
        assert r.n_tokens == len((texts[r.doc_id] or "").split()) and r.rate >= 0 and abs(sum(r.posterior.values()) - 1) < 1e-6 and abs(r.copies - r.rate) < 1
        for d, p in r.posterior.items():
            total[d] += p * r.n_tokens * r.rate
    share = {d: t / sum(total.values()) for d, t in total.items()}
    assert share["en"] == pytest.approx(0.5, abs=0.01) and share["de"] == pytest.approx(0.4, abs=0.01) and share["low"] == pytest.approx(0.1, abs=0.01)
    capped = mix_to_targets(docs, labelled, {"en": None, "de": None, "low": 0.01}, max_rate=1.0).collect()
    clean = [r for r in capped if r.doc_id < 150 and good[r.doc_id]]
    assert all(r.rate <= 1 for r in capped) and np.mean([r.copies for r in clean]) > 0.95
    assert {r.rate for r in mix_to_targets(docs, labelled.limit(0), {"en": 1.0}).collect()} == {1.0}


def test_bounded_domain_below_its_limit(spark):
    there, names = np.array([700.0, 295.0, 5.0]), ["de", "en", "low"]
    assert _wanted(there, names, {"de": None, "en": None, "low": 0.02}, 1.0) == pytest.approx(there)
    assert _wanted(np.array([500.0, 400.0, 100.0]), names, {"de": None, "en": None, "low": 0.02}, 1.0) == pytest.approx([500, 400, 900 * 0.02 / 0.98])
    # Binding de lifts low's share; low stays below its limit and whole.
    assert _wanted(there, names, {"de": 0.5, "en": None, "low": 0.02}, 1.0) == pytest.approx([300, 295, 5])
    rng = random.Random(6)
    texts = [" ".join(["%%|$"] * 60) if i == 0 else sentence(rng, "en", 60) for i in range(200)]
    labelled = spark.createDataFrame([(i, "low" if i == 0 else "en") for i in range(100)], "id long, domain string")
    got = mix_to_targets(table(spark, rows_of(texts)), labelled, {"en": None, "low": 0.02}, max_rate=1.0).collect()
    assert all(r.copies == 1 for r in got if r.doc_id)


def test_domain_posteriors_by_hand(spark, corpus):
    """Posteriors, rates and totals recomputed from the hashed counts."""
    texts, langs, _, good = corpus
    labelled = spark.createDataFrame([(i, "low" if not good[i] else langs[i]) for i in range(150)], "id long, domain string")
    docs = table(spark, rows_of(texts, langs))
    buckets = {r.doc_id: r.x for r in docs.select("doc_id", mixing._features(F.coalesce("text", F.lit(""))).alias("x")).collect()}
    count, n = defaultdict(Counter), Counter()
    for r in labelled.collect():
        n[r.domain] += 1
        count[r.domain].update(buckets[r.id])
    def log_p(d, b):
        same = [c for x, c in count[d].items() if (x < mixing.BUCKETS) == (b < mixing.BUCKETS)]
        return math.log((count[d][b] + mixing.ALPHA) / (sum(same) + mixing.ALPHA * mixing.BUCKETS))
    result = mix_to_targets(docs, labelled, {"en": 0.5, "de": 0.4, "low": 0.1})
    got = {r.doc_id: r for r in result.collect()}
    for i in (0, 1, 3, 161, 165, 168):
        x = buckets[i]
        tempered = mixing.HALF_EVIDENCE / (len(x) / 2 + mixing.HALF_EVIDENCE)
        logs = {d: math.log(n[d] / 150) + sum(log_p(d, b) for b in x) * tempered for d in n}
        top = max(logs.values())
        total = sum(math.exp(v - top) for v in logs.values())
        assert all(got[i].posterior[d] == pytest.approx(math.exp(v - top) / total, abs=1e-9) for d, v in logs.items()) and len(x) == 2 * got[i].n_tokens
    share = {r.domain: r.share for r in mixing.mixed_totals(result).collect()}
    assert share == pytest.approx({"en": 0.5, "de": 0.4, "low": 0.1}, abs=1e-3)


def test_kneser_ney_by_hand(spark):
    """The dense model against the recursion of interpolated modified Kneser-Ney over Python counts."""
    rng = random.Random(2)
    texts = [sentence(rng, "en", 40) for _ in range(30)]
    of = quality_module.class_table()
    grams = Counter(quality_module.text_grams(texts, of)[0].tolist())
    counted = spark.createDataFrame([(int(g), int(k)) for g, k in grams.items()], "gram long, k long")
    alpha, gamma = quality_module.modified_kneser_ney(counted)
    model = quality_module.dense_model(alpha.toPandas(), gamma.toPandas())
    levels, c = {quality_module.ORDER: grams}, quality_module.CLASSES
    for n in range(quality_module.ORDER - 1, 0, -1):
        levels[n] = Counter(g % c**n for g in levels[n + 1])
    def discounts(n):
        t = [0, *(sum(k == i for k in levels[n].values()) for i in (1, 2, 3, 4))]
        y = t[1] / (t[1] + 2 * t[2])
        return [0, *(min(max(i - (i + 1) * y * t[i + 1] / t[i] if t[i] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3))]
    d = {n: discounts(n) for n in levels}
    after = {n: defaultdict(list) for n in levels}
    for n, level in levels.items():
        for g, k in level.items():
            after[n][g // c].append(k)
    def p(n, gram):
        if n == 0:
            return 1 / c
        gram %= c**n
        own = after[n].get(gram // c)
        lower = p(n - 1, gram)
        if not own:
            return lower
        k = levels[n].get(gram, 0)
        return max(k - d[n][min(k, 3)], 0) / sum(own) + sum(d[n][min(x, 3)] for x in own) / sum(own) * lower
    for gram in [*list(grams)[:200], *(rng.randrange(c**quality_module.ORDER) for _ in range(200))]:
        assert math.exp(model[gram]) == pytest.approx(p(quality_module.ORDER, gram), rel=1e-4)


def test_language_models_by_hand(spark):
    """The language whose characters a text shares wins; equal models tie to the first by name."""
    rng = random.Random(4)
    texts = [sentence(rng, "en" if i % 2 else "de", 30) for i in range(40)]
    docs = table(spark, rows_of([*texts, texts[0], texts[1]], ["en" if i % 2 else "de" for i in range(40)] + [None, None]))
    got = {r.doc_id: r for r in identify_language(docs, F.col("doc_id") < 40).collect()}
    assert (got[40].lang_pred, got[41].lang_pred) == ("de", "en") and got[40].held_out and not got[0].held_out


def test_document_scores_by_hand():
    """Match states and a text's probability against a walk over its tokens."""
    rng = random.Random(9)
    docs = [[rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(20)]
    flat, lengths = np.concatenate([np.array(d) for d in docs]), np.array([len(d) for d in docs])
    state, hit = lm_scoring.matches(flat, lengths)
    p = np.random.default_rng(1).dirichlet(np.ones(6), 3).T  # by token, then class
    prior, trust, c = np.array([0.5, 0.3, 0.2]), np.array([0.0, 0.2, 0.5, 0.4, 0.9]), np.array([3, 0, 1, 4, 0, 2])
    tokens = pa.table({"place": pa.array(range(6), pa.int32()), "c": c, "lp": pa.array([r.tobytes() for r in np.log(p).astype(np.float32)], pa.binary())})
    whole = pa.table({"ids": [list(range(20))], "held": [[False] * 20], "lengths": [lengths.tolist()], "sizes": [(lengths * 5).tolist()], "blob": pa.array([lm_scoring._packed(flat, state, hit)], pa.binary())})
    got = lm_scoring._sum_docs(10, 4, prior, trust)(whole, tokens).to_pylist()
    at = 0
    for d, r in zip(docs, got, strict=True):
        named, total = {1: [False] * len(d), 2: [False] * len(d)}, prior.copy()
        for i, t in enumerate(d):
            s, h = 0, False
            for order in (1, 2):
                before = [j for j in range(order, i) if d[j - order : j] == d[i - order : i]] if i >= order else []
                if before:
                    s, h = 2 * order - 1 + named[order][i - 1], d[before[-1]] == t
                    named[order][i] = h
            assert (state[at], hit[at]) == (s, h)
            total *= (1 - trust[s]) * p[t] + trust[s] * h
            at += 1
        assert r["score"] == pytest.approx(math.log10(total.sum()), rel=1e-5)
        assert r["bits_per_byte"] == pytest.approx(-math.log2(total.sum()) / (5 * len(d) + 1), rel=1e-5)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / 15) for t in d)) and r["n_known"] == sum(c[t] > 0 for t in d)


def test_bit_counts_by_hand():
    """Counts of the predictors whose contexts are not hashed, and probabilities of a byte's values that add up to 1."""
    words, n = [b"abc", b"abd", b"b", b""], np.array([[2, 1], [0, 3], [1, 0], [4, 4]])
    batch = pa.RecordBatch.from_pydict({"token": pa.array(words, pa.binary()), "t0": n[:, 0], "t1": n[:, 1]})
    got = {k: np.zeros((1 << lm_scoring.SLOTS[k], 2)) for k in (0, 1)}
    for b in lm_scoring._count_bits(2)(iter([batch])):
        for r in b.to_pylist():
            if r["k"] in got:
                part = np.frombuffer(r["counts"], np.float64).reshape(-1, 2)
                got[r["k"]][r["piece"] * len(part) : (r["piece"] + 1) * len(part)] = part
    want = {k: np.zeros_like(v) for k, v in got.items()}
    for w, row in zip(words, n, strict=True):
        coded = w + b" " if w else b"\n"
        for cls, k in enumerate(row):
            for depth, byte in enumerate(coded):
                node = 1
                for shift in range(7, -1, -1):
                    bit = byte >> shift & 1
                    last = coded[depth - 1] if depth else 0
                    want[0][depth << 8 | node, bit] += k
                    want[1][cls << 16 | last << 8 | node, bit] += k
                    node = node << 1 | bit
    assert all((got[k] == want[k]).all() for k in got)
    mixer = lm_scoring.Mixer()
    mixer.remember(np.linspace(-9, 9, 50), np.arange(50) % 16, np.arange(50) % 3 == 0, np.ones(50))
    s, depth = np.linspace(-15, 15, 64), np.arange(64) % 16
    both = [np.exp(lm_scoring.refined_log(s, depth, np.full(64, b), mixer.refinement())) for b in (False, True)]
    assert np.allclose(both[0] + both[1], 1)


def test_language_entropies_by_hand(spark):
    """Cross-entropy and score against the recursion of interpolated Kneser-Ney over Python counts."""
    rng = random.Random(8)
    texts = [sentence(rng, "en" if i % 2 else "de", 12) for i in range(24)]
    langs = ["en" if i % 2 else "de" for i in range(24)]
    extra = ["the thor q", "schein", "zzz", "a Ver2der!"]
    got = {r.doc_id: r for r in identify_language(table(spark, rows_of([*texts, *extra], [*langs, *[None] * 4])), F.col("doc_id") < 24).collect()}

    def words(text):
        return [w for w in ("".join(filter(str.isalpha, t)) for t in text.lower().split()) if w]

    order, logs = language_id.ORDER, {}
    for lang in ("de", "en"):
        levels = {n: Counter() for n in range(1, order + 1)}
        for text, own in zip(texts, langs, strict=True):
            for w in (f"\x02{w}\x03" for w in words(text) if own == lang):
                levels[order].update(w[i : i + order] for i in range(len(w) - order + 1))
                for n in range(2, order):
                    levels[n][w[:n]] += 1
        for n in range(order - 1, 0, -1):
            for gram in levels[n + 1]:
                levels[n][gram[1:]] += 1
        d, after = {}, {}
        for n, level in levels.items():
            one, two = (sum(k == i for k in level.values()) for i in (1, 2))
            d[n] = min(max(one / (one + 2 * two), 0.1), 0.95) if one else (0.1 if two else 0.5)
            after[n] = defaultdict(list)
            for gram, k in level.items():
                after[n][gram[:-1]].append(k)

        def p(history, c, d=d, after=after, levels=levels):
            value = 1 / language_id.UNSEEN
            for n in range(1, min(order, len(history) + 1) + 1):
                context = history[len(history) - n + 1 :]
                follow = after[n].get(context)
                if follow:
                    value = value * d[n] * len(follow) / sum(follow) + max(levels[n].get(context + c, 0) - d[n], 0) / sum(follow)
            return value

        logs[lang] = lambda text, p=p: sum(math.log(p(w[:i], w[i])) for w in (f"\x02{w}\x03" for w in words(text)) for i in range(1, len(w)))
    for i, text in enumerate([*texts, *extra]):
        n = sum(len(w) + 1 for w in words(text))
        entropy = {lang: -log(text) / n for lang, log in logs.items()}
        best = min(entropy, key=entropy.get)
        assert got[i].lang_pred == best and got[i].cross_entropy == pytest.approx(entropy[best], rel=1e-3)
        assert got[i].score == pytest.approx(1 / sum(math.exp(language_id.SHARPNESS * (entropy[best] - h)) for h in entropy.values()), rel=2e-2)


def test_stored_grams_share_no_key(monkeypatch):
    """Every n-gram keeps its own values, also where the first salt makes two of them collide."""
    import pandas as pd

    rng = np.random.default_rng(3)
    letters = [chr(c) for c in (*range(97, 123), *range(0x430, 0x450), *range(0x4E00, 0x4E80), 0x10400)]
    grams = sorted({"".join(g) for g in rng.choice(letters, (200_000, 4))})
    rows = pd.DataFrame({"lang": ["de" if i % 2 else "en" for i in range(len(grams))], "gram": grams, "alpha": np.arange(len(grams)) / len(grams)})

    def kept(rows):
        salt, keys, values = language_id._sorted_array(rows, ["de", "en"], "gram", "alpha", 0.0)
        codes = np.frombuffer("".join(rows.gram).encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = np.searchsorted(keys, language_id.gram_keys(codes, 4, salt)[3::4])
        own = values[at, np.where(rows.lang == "de", 0, 1)]
        return salt, len(keys) == len(rows) and np.array_equal(own, rows.alpha.to_numpy(np.float32))

    assert kept(rows) == (0, True)
    whole = language_id.gram_keys
    monkeypatch.setattr(language_id, "gram_keys", lambda codes, n, salt=0: whole(codes, n, salt) >> np.uint64(0 if salt else 42))
    assert kept(rows) == (1, True)


def test_lexicon_by_hand(spark, corpus):
    """Weights recounted from the labelled texts, and every text's score from a search of each entry at each place."""
    texts, _, toxic, _ = corpus
    marked = range(len(toxic))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    docs = table(spark, rows_of(texts))
    lexicon = toxicity_module.learn_lexicon(docs, labels, F.lit(True))
    tables = toxicity_module._fold_tables()
    folded = [" " + " ".join(toxicity_module.fold(t or "", tables).split()) + " " for t in texts]
    sample = [i for i in marked if texts[i] is not None]
    bad, good = (sum(toxic[i] == v for i in sample) for v in (1, 0))
    assert lexicon.weights
    for entry, w in lexicon.weights.items():
        a, c = (sum(toxic[i] == v and entry in folded[i] for i in sample) + 0.5 for v in (1, 0))
        assert w == pytest.approx(math.log(a / (bad + 1)) - math.log(c / (good + 1)) - 2 * math.sqrt(1 / a + 1 / c))
    got = {r.doc_id: r for r in toxicity_module.score_toxicity(docs, lexicon).collect()}
    for i, text in enumerate(folded):
        spans = [(s, s + len(e)) for e in lexicon.exceptions for s in range(len(text)) if text.startswith(e, s)]
        best = [max((w for e, w in lexicon.weights.items() if text.startswith(e, s)), default=0) for s in range(len(text)) if not any(a <= s < b - 1 for a, b in spans)]
        dense = sum(best) / math.log2(4 + len(text.split()))
        assert got[i].score == pytest.approx(dense / (dense + lexicon.theta))
    # No other threshold makes fewer errors on the labelled texts.
    dense = {i: got[i].weight / math.log2(4 + got[i].n_words) for i in sample}
    assert sum((got[i].score >= 0.5) != toxic[i] for i in sample) == min(sum((x >= at) != toxic[i] for i, x in dense.items()) for at in [*dense.values(), math.inf])


OPERATORS = {
    "op1": lambda docs, labels: exact_dedup(docs, keep="max").select("doc_id", "group_size", "text_sha256"),
    "op2": lambda docs, labels: quality(docs, labels).select("doc_id", "perplexity", "kept"),
    "op3": lambda docs, labels: encode_pieces(docs, PIECE_MODEL).select("doc_id", "pieces"),
    "op4": lambda docs, labels: lm_scores(docs, id_bucket("doc_id", 7) != 2).select("doc_id", "n_tokens", "held_out", "base_score", "bits_per_byte"),
    "op5": lambda docs, labels: mix_to_targets(docs, labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "low").otherwise("en").alias("domain")), {"en": 0.9, "low": 0.1}).select("doc_id", "n_tokens", "rate"),
    "op6": lambda docs, labels: jaccard_components(docs).select("doc_id", "n_shingles", "component_id"),
    "op8": lambda docs, labels: toxicity(docs, labels, id_bucket("doc_id", 5) != 0).select("doc_id", "held_out", "score", "predicted"),
    "op9": lambda docs, labels: balanced_shards(docs, 4).select("doc_id", "size", "shard"),
    "op10": lambda docs, labels: identify_language(docs, id_bucket("doc_id", 3) != 1).select("doc_id", "held_out", "lang_pred"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_and_repeated_rows(spark, corpus, name):
    """An empty table gives an empty result. Rows that repeat and null ids keep a row each, repeated rows alike."""
    texts, langs, toxic, good = corpus
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](table(spark, []), labels).count() == 0
    rows = rows_of(texts[:60], langs[:60])
    rows += rows[:3] + [(None, *rows[5][1:]), (None, *rows[5][1:])]
    got = OPERATORS[name](table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for i in (0, 1, 2, None):
        own = [tuple(r)[1:] for r in got if r.doc_id == i]
        assert len(own) == 2 and own[0] == own[1]
    if "held_out" in got[0]:
        assert all(r.held_out is not None for r in got)


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicate_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0)], schema)).collect()
    assert len(got) == 4 and {(r.vec_id, r.component_id) for r in got} == {(1, 1), (2, 1), (None, None)}
