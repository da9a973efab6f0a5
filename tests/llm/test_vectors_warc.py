"""Whitening, WARC and vector codes against brute force, on odd tables and at their borders."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import embedding_dedup
from annolake.llm import vector_codes as vc
from annolake.llm import warc as warc_module
from annolake.llm import whitening
from annolake.llm.embedding_dedup import near_duplicate_vectors, tables_for
from annolake.llm.vector_codes import vector_codes
from annolake.llm.warc import MAGIC, captures, parse_header, read_warc, warc_records, write_warc
from annolake.llm.whitening import fit_whitening, shifted_cholesky, whiten

VECTORS = "vec_id long, embedding array<double>, label int, x int, n long, id string, component string, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "id", "c", "d") for i, v, label in rows], VECTORS).repartition(5)


# ---- whitening


def check_whitening(rows, got, scale=256.0):
    """Everything recomputed with numpy's eigenvectors of the covariance, up to sign; degenerate eigenvalues are not compared."""
    kept = [(i, tuple(int(np.floor(scale * c)) for c in v)) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    u = np.array(sorted({x for _, x in kept}), float)
    n, sums = len(u), [sum(int(r[j]) for r in u) for j in range(u.shape[1])]
    a = u - np.array(sums) / n
    e, w = np.linalg.eigh(a.T @ a / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(4, u.shape[1])
    assert len(got) == len(kept) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component - 1, []).append(r)
    want_dev = sorted((i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in kept)
    for c in range(k):
        assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in by[c]) == want_dev
        if e[c] <= 1e-9 * max(e[0], 1e-30):
            assert all(r.whitened is None for r in by[c])
            continue
        assert all(abs(r.explained - e[c] / e.sum()) <= 1e-12 * (e[c] / e.sum()) + 1e-14 and r.identity_error < 1e-9 for r in by[c])
        z = sorted((i is None, i or 0, float((np.array(x) - np.array(sums) / n) @ w[:, c] / np.sqrt(e[c]))) for i, x in kept)
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in by[c])
        sign = np.sign(sum(p[2] * q[2] for p, q in zip(z, mine, strict=True))) if len({t[:2] for t in z}) == len(z) else None
        if sign:
            assert max(abs(p[2] - sign * q[2]) for p, q in zip(z, mine, strict=True)) < 1e-9


@pytest.mark.parametrize("case", ["plain", "deficient", "few", "far", "narrow"])
def test_whitening_by_brute_force(spark, case):
    rng = np.random.default_rng(3)
    n, d = {"few": (3, 6), "narrow": (40, 2)}.get(case, (300, 6))
    m = rng.standard_normal((n, d)) * np.array([3, 2, 1.2, 0.8, 0.5, 0.3])[:d]
    if case == "deficient":  # one component is constant, one the sum of two others
        m = np.floor(256 * m) / 256
        m[:, 4], m[:, 5] = 0.5, m[:, 0] + m[:, 1]
    if case == "far":  # a mean a million times the spread
        m = m + 1e6
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(m)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)]  # copies count once
    check_whitening(rows, whiten(vectors(spark, rows)).collect())


def test_whitening_odd_tables(spark):
    assert whiten(vectors(spark, [(0, [1.0], 1)]).limit(0)).count() == 0
    rows = [(1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [], 1), (None, [1.0, 2.0], 1), (6, [0.0, 1.0], None), (6, [0.0, 1.0], None), (7, [2.5, -1.0], 2)]
    got = whiten(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (6, 1), (6, 1), (6, 2), (6, 2), (7, 1), (7, 2)] and {r.n for r in got} == {3}
    one = whiten(vectors(spark, [(1, [3.0, 4.0], 1), (2, [3.0, 4.0], 1)])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    mixed = whiten(vectors(spark, [(i, [float(i), float(i * i)][: 1 + i % 2], 1) for i in range(12)])).collect()
    assert {(r.vec_id % 2, r.component, r.n) for r in mixed} == {(0, 1, 6), (1, 1, 6), (1, 2, 6)}
    huge = whiten(vectors(spark, [(1, [1e12, 0.0], 1), (2, [-1e12, 1.0], 1)])).collect()
    assert all(r.deviation is None for r in huge)


def test_whitening_passes(spark, monkeypatch):
    """A nearly singular list takes the shifted factor and further passes; the factors compose to the list's own R."""
    rng = np.random.default_rng(5)
    base = rng.integers(-100_000, 100_000, (400, 3))
    x = np.hstack([base, base[:, :1] * 3 + rng.integers(-1, 2, (400, 1))])
    shifts, plain = [], whitening.shifted_cholesky
    monkeypatch.setattr(whitening, "shifted_cholesky", lambda g, n, shift: shifts.append(shift) or plain(g, n, shift))
    fit = spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "x array<long>").repartition(7)
    own = fit_whitening(fit)[4]
    assert shifts[0] is True and len(shifts) >= 2
    u = np.unique(x, axis=0)
    a = u - u.mean(0)
    e = np.linalg.svd(a, compute_uv=False) ** 2 / len(u)
    assert np.allclose(own["values"], e, rtol=1e-8)
    r = shifted_cholesky(a.T @ a, len(u), False)
    assert np.allclose(r.T @ r, a.T @ a) and np.allclose(np.tril(r, -1), 0)


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "t", "p") for i, u, h in rows], "page_id long, url string, html string, id int, type string, payload string").repartition(4)


def expected(rows, least=100):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == body]
        first = min((j for j in same if j is not None), default=None)
        again = len(body) >= least and len(same) > 1
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), again, first if again else None))
    return out


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh <>é") for _ in range(400_000))
    texts = [None, "", "x" * 99, "x" * 100, "é" * 50, "WARC/1.1\r\n\r\n" * 20, "a\r\nb\x00c" * 40, long]
    rows = [(i, f"http://e/{i}", t) for i, t in enumerate(texts * 3)] + [(100, None, "n" * 200), (None, "http://e/\r\nX: y", "n" * 200), (None, None, "m" * 300)]
    path = f"file://{tmp_path}/w"
    write_warc(warc_records(pages(spark, rows), "page_id", "url", "html"), path)
    for nested, size in ((False, 1 << 25), (True, 700)):
        got = captures(read_warc(spark, path, range_bytes=size, nested=nested), "page_id", "long").collect()
        want = expected(rows)
        assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted((w[0] is None, w[0] or 0, *w[1:3]) for w in want)
        for r in got:
            again, first = next((w[3], w[4]) for w in want if w[0] == r.page_id and w[2] == r.payload_digest)
            assert (r.record_type, r.refers_to) == (("revisit", first) if again and r.page_id != first else ("response", None)), r
    assert all(parse_header(r.split(b"\r\n\r\n", 1)[0]) for f in (tmp_path / "w").glob("*.warc.gz") for r in [gzip.open(f).read()])
    assert not list((tmp_path / "w").glob("_*"))
    write_warc(warc_records(pages(spark, rows[:2]), "page_id", "url", "html"), path, mode="overwrite")
    assert read_warc(spark, path).count() == 2


def test_warc_repeats_and_odd_tables(spark, tmp_path):
    body = "b" * 150
    rows = [(5, "u", body)] * 4 + [(5, "a", body), (9, "z", body), (3, "s", "short"), (3, "s", "short")]
    path = str(tmp_path / "w")
    write_warc(warc_records(pages(spark, rows), "page_id", "url", "html"), path)
    got = read_warc(spark, path).collect()
    assert len(got) == 8 and [r.target_uri for r in got if r.type == "response" and r.payload_length == 150] == ["a"]
    assert sum(r.type == "response" for r in got) == 3 and all(r.refers_to == "urn:x-record:5" for r in got if r.type == "revisit")
    (tmp_path / "none").mkdir()
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
    write_warc(warc_records(pages(spark, rows).limit(0), "page_id", "url", "html"), str(tmp_path / "empty"))
    assert captures(read_warc(spark, str(tmp_path / "empty"))).count() == 0


def record(n, payload, kind="response"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-record:{n}>\r\nContent-Type: text/plain\r\nX-Long:\r\n folded\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def member(data, level=6):
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def test_warc_ranges_and_nested_archives(spark, tmp_path):
    """Every cut of a small archive gives the same records: with bare magic bytes, other gzip members, an archive stored inside a record, a damaged member and rubbish between members."""
    inner = b"".join(member(record(900 + i, b"inner" * 5), 0) for i in range(3))
    inner_broken = member(record(950, b"never" * 200), 9)[:-20]
    parts = [member(record(1, b"one")), member(record(2, MAGIC * 20 + b"\x00" + inner + b"tail", "resource"), 0), member(b"no record"), member(record(3, inner_broken + MAGIC), 0), b"rubbish" + MAGIC, member(record(4, b"cut" * 100))[:-9], member(record(5, b"last"))]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc.gz").write_bytes(b"".join(parts))
    total = sum(map(len, parts))
    for size in (total, 37, 61, 100, 177):
        rows = read_warc(spark, str(tmp_path / "a"), range_bytes=size).orderBy("offset").collect()
        assert [(r.record_id[-1], r.type) for r in rows] == [("1", "response"), ("2", "resource"), ("3", "response"), ("4", "damaged"), ("5", "response")], size
        assert rows[1].payload.startswith(MAGIC * 20) and rows[3].payload is None and rows[0].headers["x-long"] == "folded"
    assert read_warc(spark, str(tmp_path / "a"), range_bytes=61, nested=False).count() > 5


def test_warc_archives_are_cut_and_attempts_dropped(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", "".join(random.Random(i).choices("abcdefghij", k=3000))) for i in range(40)]
    warc_records(pages(spark, rows), "page_id", "url", "html").coalesce(1).write.format("warc").mode("append").option("archive_bytes", 5000).save(str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 5 and read_warc(spark, str(tmp_path / "w")).count() == 40
    writer = warc_module.WarcWriter({"path": str(tmp_path / "v")}, False)
    name, stream = writer.staged.open(".warc.gz")
    stream.write(b"lost")
    stream.close()
    writer.abort([])
    assert not list((tmp_path / "v").glob("**/*.warc.gz"))


# ---- vector codes


def brute_codes(rows, parts, entries, rounds, scale=256.0):
    kept = [(i, [int(np.floor(scale * c)) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    x = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    book = [[cut(r[1])[p] for r in first] for p in range(parts)]
    away = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda p, a: min((away(a, b), e) for e, b in enumerate(book[p]))
    for _ in range(rounds):
        got = [[near(p, cut(r[1])[p])[1] for r in x] for p in range(parts)]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [cut(r[1])[p] for r, g in zip(x, got[p], strict=True) if g == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, total = [], {}
    for i, v, label in x:
        best = [near(p, cut(v)[p]) for p in range(parts)]
        error = sum(b[0] for b in best)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{b[1]:02x}" for b in best), error, label))
    digest = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    return sorted(((i is None, i or 0, code, error, total[label], digest) for i, code, error, label in out))


def codes(df, **args):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes(df, **args).collect())


@pytest.mark.parametrize("case", ["plain", "ties", "short", "few", "wide"])
def test_codes_by_brute_force(spark, case):
    rng = np.random.default_rng(11)
    n, d = (5, 8) if case == "few" else (260, 8)
    m = rng.integers(-3, 4, (n, d)) / 256 if case == "ties" else rng.standard_normal((n, d))
    rows = [(i, (v * (1e9 if case == "wide" else 1)).tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(m)]
    if case == "short":
        rows = [(i, v[: 3 + i % 6], label) for i, v, label in rows]
    rows += [(i, rows[0][1], 7) for i in range(300, 340)] + [(None, rows[1][1], 7), (2, rows[3][1], 1), (400, None, 1), (401, [None] * d, 1), (402, [float("nan")] * d, 1)]
    args = {"parts": 4, "entries": 12, "rounds": 2}
    want = brute_codes(rows, *args.values())
    got = codes(vectors(spark, rows), **args)
    if case == "wide":
        want = [(*w[:3], w[3] if w[3] < 2**63 else None, *w[4:]) for w in want]
        assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in want]
    else:
        assert got == want


def test_codes_odd_tables(spark):
    assert vector_codes(vectors(spark, [(0, [1.0], 1)]).limit(0)).count() == 0
    assert codes(vectors(spark, [(1, [], None), (2, [], None)]), parts=2) == brute_codes([(1, [], None), (2, [], None)], 2, 64, 2)


def test_trees_prune_and_hold_all_points(monkeypatch):
    """Dual trees give the nearest entries, with most pairs never looked at, over several blocks of one part."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-4000, 4000, (2, 3000, 3)), np.repeat(rng.integers(-50, 50, (2, 1, 3)), 1000, axis=1)], axis=1)
    book = rng.integers(-4000, 4000, (2, 50, 3))
    order = vc.tree_order(points)
    assert all(sorted(o.tolist()) == list(range(order.shape[1])) for o in order)
    got = np.full(points.shape[:2], -1)
    counts, sums = vc.assign(points, order, vc.EntryTrees(book), got)
    away = ((points[:, :, None] - book[:, None]) ** 2).sum(-1)
    want = away.argmin(-1)
    assert (got == want).all()
    for p in range(2):
        assert counts[p].tolist() == np.bincount(want[p], minlength=50).tolist()
        assert all((sums[p, e] == points[p][want[p] == e].sum(0)).all() for e in range(50))
    wide = np.zeros_like(got)
    n, s = vc._assign_wide(points[:, :60], book, wide[:, :60])
    assert (wide[:, :60] == want[:, :60]).all() and n.sum() == 120


# ---- NN-descent


def linked(n, dim, groups, isolated, seed):
    """Unit vectors: `groups` clusters of many links, `isolated` pairs just above .93, the rest without links; two labels."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    at = 0
    for g in range(groups):
        size = 3 + 4 * g
        v[at : at + size] = v[at] / np.linalg.norm(v[at]) + 0.15 * rng.normal(size=(size, dim)) / np.sqrt(dim)
        at += size
    for _ in range(isolated):
        a = v[at] / np.linalg.norm(v[at])
        b = rng.normal(size=dim)
        b -= b @ a * a
        v[at + 1] = 0.94 * a + np.sqrt(1 - 0.94**2) * b / np.linalg.norm(b)
        at += 2
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v, np.where(np.arange(n) < n - n // 5, 1, 2)


@pytest.mark.parametrize("groups,isolated", [(9, 40), (0, 15), (0, 0)])
def test_search_decides_the_links(spark, monkeypatch, groups, isolated):
    """Many, few and no links: every link comes from the search, the audit compares an eighth of the classes at most, and nothing is compared in full."""
    v, label = linked(1500, 24, groups, isolated, 5)
    calls, search, true = [], embedding_dedup._search, embedding_dedup._true_links
    monkeypatch.setattr(embedding_dedup, "_search", lambda *a: calls.append("search") or search(*a))

    def compared(asked, classes, threshold):
        calls.append(("compared", asked.count(), classes.count()))
        return true(asked, classes, threshold)

    monkeypatch.setattr(embedding_dedup, "_true_links", compared)
    df = spark.createDataFrame([(int(i), x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_duplicate_vectors(df, 0.93).collect()}
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    degree = near.sum(1)
    assert calls.count("search") >= 1
    compared_with = [c for c in calls if c != "search"]
    assert len(compared_with) == 1 and compared_with[0][1] <= 1500 / 8 * 1.3 and compared_with[0][2] == 1500
    assert all(got[i].n_links <= degree[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.95 * degree.sum()
    recall = {r.audited_recall for r in got.values()}
    assert len(recall) == 1 and (recall == {None} or min(recall) >= 0.97)


def test_vectors_with_ids_of_other_types(spark):
    rows = [("b", [1.0, 0.0], 1), ("a", [1.0, 0.01], 1), ("c", [0.0, 1.0], 1), (None, [1.0, 0.0], 1), ("d", None, 1)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or "", r.n_links, r.component_id, r.kept) for r in got) == [("", 0, None, True), ("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("d", 0, "d", True)]


def test_number_of_tables():
    assert tables_for(0, 0.93) == 1 and tables_for(24, 0.93) > tables_for(10, 0.93) > tables_for(5, 0.93) > 1
    for bits in (3, 8, 14):
        together = (1 - np.arccos(0.93) / np.pi) ** bits
        n = tables_for(bits, 0.93)
        assert (1 - together) ** n <= embedding_dedup.MISS < (1 - together) ** (n - 1)
