"""Vector code compression: product quantisation whose codebooks come from Lloyd rounds by dual trees.

Vectors are gathered into blocks of bounded size. In a block a balanced tree over the rows stands for each part
position; its permutations are made once and kept with the block, so that all rounds read the same trees. A round
walks such a tree and a tree over the position's entries together: a pair of nodes goes when its least distance is
above some other pair's greatest, and of single entries those go that another entry beats everywhere in the node's
box. A node with one entry left is assigned whole, by its count and sums; in the leaves that stay uncertain the
distances are taken point by point. All bounds, distances and sums are integers, so nothing hangs on rounding or on
how rows are dealt. A task returns a count and sums for each part, entry and place, which are added up before the
shuffle; the codebooks (parts x entries) are all that the driver holds.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. Vectors are filled up
with zeros to the next multiple of `parts` that holds the longest, so empty ones are all zeros. Ids may repeat or be
null: among equal ids the smaller vector comes first into the codebook, nulls come last. With fewer rows than entries
the codebook has as many entries as rows. Equal distances go to the lower index, also between equal entries. Labels
that are null count as one label. `error` and `label_error` are null where they are beyond a long. An empty table gives
an empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import settled, small_batches
from annolake.llm.whitening import floored

#: Rows of a block and points of a leaf; pairs of leaves and entries that are worked on at once.
BLOCK, LEAF, PAIRS = 4096, 16, 16384


def tree_order(points: np.ndarray) -> np.ndarray:
    """(positions, slots): for each part position the rows in the order of a balanced tree's leaves. points: (positions, rows, width).

    The slots are filled up to LEAF * 2^levels; a slot from the number of rows on is a filler. Each node is halved along its widest side.
    """
    parts, m, _ = points.shape
    levels = max(0, int(np.ceil(np.log2(max(1, m) / LEAF))))
    slots = LEAF << levels
    order = np.broadcast_to(np.arange(slots), (parts, slots)).copy()
    at = np.arange(parts)[:, None, None]
    for level in range(levels):
        nodes = order.reshape(parts, 1 << level, -1)
        own = points[at, np.where(nodes < m, nodes, nodes % m)]
        side = (own.max(2) - own.min(2)).argmax(-1)
        key = np.take_along_axis(own, side[..., None, None], axis=-1)[..., 0]
        half = nodes.shape[-1] // 2
        order = np.take_along_axis(nodes, np.argpartition(key, half, axis=-1), axis=-1).reshape(parts, slots)
    return order


def _boxes(points: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(low, high) of the nodes of each level, the root first. points: (positions, slots, width) in a tree's order, size slots to a leaf."""
    low = points.reshape(len(points), -1, size, points.shape[-1]).min(2)
    high = points.reshape(len(points), -1, size, points.shape[-1]).max(2)
    out = [(low, high)]
    while low.shape[1] > 1:
        low, high = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])
        out.append((low, high))
    return out[::-1]


class EntryTrees:
    """For each part position a balanced tree with one entry to a leaf. book: (positions, entries, width), integers."""

    def __init__(self, book: np.ndarray):
        parts, k, _ = book.shape
        self.book, self.levels = book, max(0, int(np.ceil(np.log2(k))))
        slots = 1 << self.levels
        order = np.broadcast_to(np.arange(slots), (parts, slots)).copy()
        at = np.arange(parts)[:, None, None]
        for level in range(self.levels):
            nodes = order.reshape(parts, 1 << level, -1)
            own = book[at, nodes % k]
            side = (own.max(2) - own.min(2)).argmax(-1)
            key = np.take_along_axis(own, side[..., None, None], axis=-1)[..., 0]
            order = np.take_along_axis(nodes, np.argsort(key, axis=-1, kind="stable"), axis=-1).reshape(parts, slots)
        self.entry = np.where(order < k, order, -1)
        self.boxes = _boxes(book[at[..., 0], order % k], 1)


def assign(points: np.ndarray, order: np.ndarray, trees: EntryTrees, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts (positions, entries) and sums (positions, entries, width) of the points by nearest entry; with `codes` (positions, rows) also each row's entry.

    points: (positions, rows, width) as int64, whose distances to the entries must stay below 2^56.
    """
    parts, m, width = points.shape
    k = trees.book.shape[1]
    at = np.arange(parts)[:, None]
    real = order < m
    placed = points[at, np.where(real, order, order % m)]
    boxes = _boxes(placed, LEAF)
    levels = len(boxes) - 1
    weighed = np.where(real[..., None], placed, 0).reshape(parts, -1, LEAF, width)
    held = [(real.reshape(parts, -1, LEAF).sum(2), weighed.sum(2))]  # each node's count and sums, made once
    while held[-1][0].shape[1] > 1:
        n, s = held[-1]
        held.append((n[:, ::2] + n[:, 1::2], s[:, ::2] + s[:, 1::2]))
    held.reverse()
    counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)

    def settle(p: np.ndarray, node: np.ndarray, level: int, e: np.ndarray) -> None:
        """Whole nodes go to their entries."""
        np.add.at(counts, (p, e), held[level][0][p, node])
        np.add.at(sums, (p, e), held[level][1][p, node])
        if codes is not None:
            size = order.shape[1] >> level
            slot = node[:, None] * size + np.arange(size)
            row = order[p[:, None], slot]
            ok = row < m
            codes[np.broadcast_to(p[:, None], row.shape)[ok], row[ok]] = np.broadcast_to(e[:, None], row.shape)[ok]

    p, node, pair = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    for step in range(max(levels, trees.levels) + 1):
        level, depth = min(step, levels), min(step, trees.levels)
        if step:
            if levels >= step:
                p, node, pair = np.repeat(p, 2), (2 * node[:, None] + [0, 1]).ravel(), np.repeat(pair, 2)
            if trees.levels >= step:
                p, node, pair = np.repeat(p, 2), np.repeat(node, 2), (2 * pair[:, None] + [0, 1]).ravel()
        if depth == trees.levels:
            ok = trees.entry[p, pair] >= 0
            p, node, pair = p[ok], node[ok], pair[ok]
        by = np.lexsort((pair, node, p))
        p, node, pair = p[by], node[by], pair[by]
        low, high = boxes[level][0][p, node], boxes[level][1][p, node]
        left, right = trees.boxes[depth][0][p, pair], trees.boxes[depth][1][p, pair]
        apart = np.maximum(np.maximum(left - high, low - right), 0)
        reach = np.maximum(high - left, right - low)
        least, most = (apart * apart).sum(1), (reach * reach).sum(1)
        starts, group = _groups(p, node)
        ok = least <= np.minimum.reduceat(most, starts)[group]
        p, node, pair, low, high, most = p[ok], node[ok], pair[ok], low[ok], high[ok], most[ok]
        if depth < trees.levels:
            continue
        starts, group = _groups(p, node)
        # The entry nearest to the box's middle; it beats another everywhere in the box if it does at the corner towards that one.
        e = trees.entry[p, pair]
        own = trees.book[p, e]
        middle = np.abs(low + high - 2 * own).sum(1)
        best = np.minimum.reduceat(middle * (2 * k) + e, starts)[group] % (2 * k)
        top = trees.book[p, best]
        worst = (top * top - own * own + 2 * np.where(own > top, high, low) * (own - top)).sum(1)
        ok = (worst > 0) | ((worst == 0) & (e <= best)) | (e == best)
        p, node, pair, e = p[ok], node[ok], pair[ok], e[ok]
        starts, group = _groups(p, node)
        alone = np.diff(np.append(starts, len(p)))[group] == 1
        settle(p[alone], node[alone], level, e[alone])
        p, node, pair, e = p[~alone], node[~alone], pair[~alone], e[~alone]
        if not len(p):
            return counts, sums
    leaves = placed.reshape(parts, -1, LEAF, width)
    slots, whole = order.reshape(parts, -1, LEAF), real.reshape(parts, -1, LEAF)
    starts, _ = _groups(p, node)
    cut = 0
    while cut < len(starts):  # leaves with all their pairs, a bounded number at once
        end = max(cut + 1, int(np.searchsorted(starts, starts[cut] + PAIRS)))
        lo, hi = starts[cut], starts[end] if end < len(starts) else len(p)
        q, own, entry = p[lo:hi], node[lo:hi], e[lo:hi]
        away = leaves[q, own] - trees.book[q, entry][:, None]
        key = (away * away).sum(2) * (2 * k) + entry[:, None]
        first = starts[cut:end] - lo
        code = np.minimum.reduceat(key, first, axis=0) % (2 * k)
        pp, nn = q[first], own[first]
        ok = whole[pp, nn]
        pq = np.broadcast_to(pp[:, None], ok.shape)[ok]
        np.add.at(counts, (pq, code[ok]), 1)
        np.add.at(sums, (pq, code[ok]), leaves[pp, nn][ok])
        if codes is not None:
            codes[pq, slots[pp, nn][ok]] = code[ok]
        cut = end
    return counts, sums


def _groups(p: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal (position, node) start, and each pair's run."""
    new = np.append(True, (p[1:] != p[:-1]) | (node[1:] != node[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def _assign_wide(points: np.ndarray, book: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for values whose distances could leave 64 bits, in Python's integers."""
    parts, m, width = points.shape
    k = book.shape[1]
    counts, sums = np.zeros((parts, k), object), np.zeros((parts, k, width), object)
    for p in range(parts):
        entries = book[p].astype(object)
        for row in range(m):
            x = points[p, row].astype(object)
            away = ((entries - x) ** 2).sum(1)
            e = min(range(k), key=lambda i: (away[i], i))
            counts[p, e] += 1
            sums[p, e] += x
            codes[p, row] = e
    return counts, sums


def _fits(points: np.ndarray, book: np.ndarray, limit: int = 1 << 56) -> bool:
    most = max(int(points.max(initial=0)), -int(points.min(initial=0)), int(book.max()), -int(book.min()))
    return points.shape[-1] * (2 * most) ** 2 < limit


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """(positions, rows, width) of rows."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def _to_blocks(parts: int, width: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("x").combine_chunks() if isinstance(t.column("x"), pa.ChunkedArray) else t.column("x")
            sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((rows, parts * width), np.int64)
            x[np.arange(parts * width) < sizes[:, None]] = values
            kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
            order = tree_order(_split(x, parts))
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), t.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([rows], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([order.astype(np.int32 if order.shape[1] > 1 << 15 else np.int16).tobytes()], pa.binary()), whole("id"), whole("label")],
                names=["n", "bytes", "x", "tree", "id", "label"],
            )

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == BLOCK:
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    return blocks


def _read(batch: pa.RecordBatch, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's points (positions, rows, width) and trees."""
    n, size = batch.column("n")[i].as_py(), batch.column("bytes")[i].as_py()
    x = np.frombuffer(batch.column("x")[i].as_buffer(), f"i{size}").reshape(n, -1).astype(np.int64)
    order = np.frombuffer(batch.column("tree")[i].as_buffer(), np.int16 if BLOCK <= 1 << 14 else np.int32).reshape(parts, -1)
    return _split(x, parts), order.astype(np.int64)


def _round(book: np.ndarray):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's counts and sums, once: a row for each part, entry and place that got anything."""
        trees = EntryTrees(book)
        counts = sums = None
        for batch in batches:
            for i in range(batch.num_rows):
                points, order = _read(batch, i, len(book))
                n, s = assign(points, order, trees, None) if _fits(points, book) else _assign_wide(points, book, np.zeros(points.shape[:2], np.int64))
                counts, sums = (n.astype(object), s.astype(object)) if counts is None else (counts + n, sums + s)
        if counts is None:
            return
        p, e = np.nonzero(counts)
        width = book.shape[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()), pa.array(np.tile(np.arange(width), len(p)), pa.int32()), pa.array(np.repeat(counts[p, e], width).tolist(), pa.int64()), pa.array([str(v) for v in sums[p, e].ravel()], pa.string())],
            names=["p", "e", "j", "n", "s"],
        )

    return gather


def _encode(book: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = EntryTrees(book)
        at = np.arange(len(book))[:, None]
        for batch in batches:
            for i in range(batch.num_rows):
                points, order = _read(batch, i, len(book))
                codes, fits = np.zeros(points.shape[:2], np.int64), _fits(points, book)
                assign(points, order, trees, codes) if fits else _assign_wide(points, book, codes)
                away = points - book[at, codes] if fits and _fits(points, book, (1 << 62) // len(book)) else points.astype(object) - book[at, codes].astype(object)
                error = [int(v) for v in (away * away).sum((0, 2))]
                text = codes.T.astype(np.uint8).tobytes().hex()
                step = 2 * len(book)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, 1).flatten(), batch.column("label").slice(i, 1).flatten(), pa.array([text[a : a + step] for a in range(0, len(text), step)], pa.string()), pa.array([v if v < 2**63 else None for v in error], pa.int64())],
                    names=["id", "label", "code", "error"],
                )

    return encode


def train_codebooks(blocks: DataFrame, book: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (positions, entries, width) after Lloyd rounds over all blocks; entries without parts stay."""
    for _ in range(rounds):
        got = blocks.mapInArrow(_round(book), "p int, e int, j int, n long, s string").groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        book = book.copy()
        for r in got.collect():  # parts x entries x width at most
            book[r.p, r.e, r.j] = int(r.s) // int(r.n)
    return book


def codebook_text(book: np.ndarray) -> str:
    """All entries' components by part, entry and place, as decimal integers with commas."""
    return ",".join(str(int(v)) for v in book.ravel())


def vector_codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256: a row for each vector. entries: at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds two hexadecimal digits a part: entries must be 1 to 256")
    spark = df.sparkSession
    small_batches(spark, BLOCK)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), floored(vec_col, scale).alias("x")).where("x IS NOT NULL")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    kinds = dict(rows.dtypes)
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    book = np.array([[*r.x, *[0] * (parts * width - len(r.x))] for r in first], np.int64)
    blocks = settled(rows.mapInArrow(_to_blocks(parts, width), f"n int, bytes int, x binary, tree binary, id array<{kinds['id']}>, label array<{kinds['label']}>"), "code-blocks")
    small_batches(spark, 8)  # rows are blocks now
    book = train_codebooks(blocks, _split(book, parts), rounds)
    coded = settled(blocks.mapInArrow(_encode(book), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    small_batches(spark)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), total).alias("sum"))
    by_label = by_label.select(F.col("label").alias("of"), F.col("sum").try_cast("long").alias("label_error"))
    # A frequent label's rows are split by adaptive execution; they are short.
    out = coded.join(by_label, coded.label.eqNullSafe(by_label.of), "left")
    digest = hashlib.sha256(codebook_text(book).encode()).hexdigest()
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
