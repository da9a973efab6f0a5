"""Embedding whitening by shifted CholeskyQR.

The distinct vectors, as integers, are the fit list A (centred by exact sums). A first distributed pass gives the
Gram matrix of A, whose Cholesky factor is taken after a shift that rounding can't exceed; each further pass solves
the rows by all factors so far, in turn, and adds the factor of the new Gram matrix, until the rows are orthonormal
on their range. With the factors composed to R and the last Gram matrix G, the singular values and right vectors of
G^(1/2) R are those of A to double precision; a list of deficient rank has zeros there instead of a failed factor.

A task keeps one d x d matrix and a batch of rows; matrices are added up by row in the executors, so that the
driver gets one d x d matrix for each length of vector, however many tasks there are.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped, empty vectors give
no rows; vectors of different lengths are spaces of their own, each with its own list and components. Repeated
vectors count once in the fit and are all returned; ids may repeat or be null. Components whose eigenvalue is zero
(rank below the component's number: up to rounding, e <= d * 2^-52 * the largest) have a null `whitened` and no part
in `identity_error`; a list of no variance has a null `explained` too. `deviation` is null where it is beyond a long.
An empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import settled, small_batches

#: Rows of an Arrow batch; orthogonalising passes at most; how near to 0 or 1 the spectrum of the last Gram matrix is.
ROWS, PASSES, NEAR = 4096, 8, 1e-10


def floored(vec_col: str, scale: float) -> Column:
    """floor(scale * c) of every component as long; null where the vector is null or holds a null or non-finite one."""
    v = F.col(vec_col).cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(sound, F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, places in the batch, rows as int64), for each length of a batch."""
    for batch in batches:
        x = batch.column("x")
        width = np.diff(x.offsets.to_numpy())
        for d in np.unique(width):
            at = np.flatnonzero(width == d)
            yield int(d), at, x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and the sums of each component's upper and lower 32 bits, which cannot overflow."""
    n, high, low = {}, {}, {}
    for d, _, x in _vectors(batches):
        n[d] = n.get(d, 0) + len(x)
        high[d] = high.get(d, 0) + (x >> 32).sum(0)
        low[d] = low.get(d, 0) + (x & 0xFFFFFFFF).sum(0)
    for d in n:
        yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "n": [n[d]] * d, "high": high[d].tolist(), "low": low[d].tolist()}, schema=pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ..., by one triangular system after the other."""
    y = rows.T
    for r in factors:
        y = np.linalg.solve(r.T, y)
    return y.T


def _gram(model: dict):
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The Gram matrix of a task's solved rows, row by row. model: by length the means, factors and a last matrix to multiply with."""
        own: dict[int, np.ndarray] = {}
        for d, _, x in _vectors(batches):
            mean, factors, last = model[d]
            q = _solved(x - mean, factors)
            q = q if last is None else q @ last
            own[d] = own.get(d, 0) + q.T @ q
        part = TaskContext.get().partitionId()
        for d, g in own.items():
            k = len(g)
            yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["d", "i", "part", "row"])

    return gram


def _added(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in rows:
        if batch.num_rows:
            own = batch.column("row").flatten().to_numpy().reshape(batch.num_rows, -1).sum(0)
            total = own if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["d", "i", "row"])


def _gram_pass(fit: DataFrame, model: dict) -> dict[int, np.ndarray]:
    """By length the Gram matrix of all rows: partial matrices meet by row, d rows come to the driver."""
    parts = fit.where(F.size("x").isin(list(model))).mapInArrow(_gram(model), "d int, i int, part int, row array<double>")
    rows = parts.groupBy("d", "i").applyInArrow(_added, "d int, i int, row array<double>").collect()
    out: dict[int, np.ndarray] = {}
    for d in model:
        g = np.array([list(r.row) for r in sorted((r for r in rows if r.d == d), key=lambda r: r.i)])
        out[d] = (g + g.T) / 2
    return out


def shifted_cholesky(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """R with R'R = g, or g plus a shift above the rounding of g where shift is set or g has no factor without."""
    d = len(g)
    if not shift:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    s = 11 * (n * d + d * (d + 1)) * 2.0**-53 * float(np.linalg.norm(g, 2))
    return np.linalg.cholesky(g + max(s, np.finfo(float).tiny) * np.eye(d)).T


def fit_whitening(fit: DataFrame) -> dict[int, dict]:
    """By length of vector: n, sums, eigenvalues (divisor n, falling) and unit eigenvectors (columns) of the covariance of x. fit: each vector once."""
    rows = fit.where(F.size("x") > 0).mapInArrow(_sums, "d int, i int, n long, high long, low long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    found: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r.d, r.i)):
        own = found.setdefault(r.d, {"n": int(r.n), "sums": [], "factors": [], "done": False})
        own["sums"].append(int(r.high) * 2**32 + int(r.low))
    for own in found.values():
        own["mean"] = np.array([s / own["n"] for s in own["sums"]])
    for step in range(PASSES):
        going = {d: (own["mean"], own["factors"], None) for d, own in found.items() if not own["done"]}
        if not going:
            break
        for d, g in _gram_pass(fit, going).items():
            own = found[d]
            if not g.any():  # no variance at all
                own.update(gram=g, done=True)
                continue
            spectrum = np.linalg.eigvalsh(g)
            own.update(gram=g, done=step > 0 and bool(np.all((np.abs(spectrum - 1) < NEAR) | (spectrum < NEAR))))
            if not own["done"] and step < PASSES - 1:
                own["factors"] = [*own["factors"], shifted_cholesky(g, own["n"], step == 0)]
    for d, own in found.items():
        r = np.eye(d)
        for factor in own["factors"]:
            r = factor @ r
        w, u = np.linalg.eigh(own["gram"])
        _, sigma, right = np.linalg.svd((u * np.sqrt(np.maximum(w, 0))) @ u.T @ r)
        vectors = right.T * np.sign(right.T[np.abs(right.T).argmax(0), range(d)])
        own.update(values=sigma**2 / own["n"], vectors=vectors)
    return found


def _apply(model: dict, id_col: str, identity: dict):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _vectors(iter([batch])):
                n, sums, mean, to, rank, explained = model[d]
                k = to.shape[1]
                z = (x - mean) @ to
                rough = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(1)
                # Exact modulo 2^64, which is the value wherever it fits a long.
                low = np.array([s % 2**64 for s in sums], np.uint64)
                away = x.astype(np.uint64) * np.uint64(n % 2**64) - low
                deviation = pa.array((away * away).sum(1, dtype=np.uint64).astype(np.int64), mask=rough >= 2.0**63 * (1 - 1e-9))
                each = np.repeat(np.arange(len(at)), k)
                component = np.tile(np.arange(k), len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).take(pa.array(at[each])),
                        pa.array((component + 1).astype(np.int32)),
                        pa.repeat(pa.scalar(n, pa.int64()), len(each)),
                        deviation.take(pa.array(each)),
                        pa.array(z.ravel(), mask=component >= rank),
                        pa.array(np.tile(explained, len(at)), mask=np.isnan(np.tile(explained, len(at)))),
                        pa.repeat(pa.scalar(identity.get(d), pa.float64()), len(each)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whiten


def whiten(df: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = df.sparkSession
    small_batches(spark, ROWS)
    rows = df.select(F.col(id_col), floored(vec_col, scale).alias("x")).where("size(x) > 0")
    # Repeated vectors meet partly before the shuffle; small integers compress well.
    fit = settled(rows.select("x").distinct(), "whitening-fit")
    found = fit_whitening(fit)
    model, passes = {}, {}
    for d, own in found.items():
        e, k = own["values"], min(components, d)
        rank = int(np.sum(e[:k] > d * 2.0**-52 * e[0]))
        to = own["vectors"][:, :k] / np.where(np.arange(k) < rank, np.sqrt(np.maximum(e[:k], np.finfo(float).tiny)), 1.0)
        trace = e.sum()
        model[d] = (own["n"], own["sums"], own["mean"], to, rank, e[:k] / trace if trace > 0 else np.full(k, np.nan))
        if rank:
            passes[d] = (own["mean"], [], to[:, :rank])
    identity = {d: float(np.abs(g / found[d]["n"] - np.eye(len(g))).max()) for d, g in _gram_pass(fit, passes).items()} if passes else {}
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_apply(model, id_col, identity), f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
