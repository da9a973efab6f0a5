"""Embedding near-dedup by NN-descent.

Equal vectors of a group are one class. Every class starts with the neighbours that random hyperplanes put into its
blocks of bounded size; there are as many tables as it takes to bring a pair at the threshold together at least once with
a probability of 1 - MISS, whatever the group's size. Rounds of NN-descent then join the neighbours of each class with one
another, lists that end at or above the threshold counting as saturated. Lists are not cut off there: what the lists
connect is gathered into components, and a component's members are compared in full, in tiles of bounded size, which
enlarges every saturated list to all its links. The result comes from this search for every size of table.

A sample of classes, bounded in number and at most an eighth of them, is audited: it is compared with all others, and
`audited_recall` gives the share of its links that the search found (null where it has none). While the share is below RECALL
the search goes on with more tables and longer lists; groups that stay below after TRIES are compared in full. Only
pairs whose cosine in double precision reaches the threshold are links.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows whose
group is null, link with nothing; so do vectors of different lengths, and rows whose id is null, which are kept; rows
that repeat a vector link with each other; of neighbours with equal cosines the smaller id comes first; ids of other
types than whole numbers are numbered in their order; an empty table gives an empty result; further input columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from annolake.llm.common import partitions, settled, small_batches
from annolake.llm.graph import connected_components

#: Rows of a block or tile; neighbours kept in a list at first; tables made at once; chance that a pair at the threshold shares no block.
BLOCK, LIST, STEP, MISS = 192, 8, 4, 0.002
#: Classes audited at most, and at most this part of all; the share of their links that must be found, and tries before groups are compared in full.
AUDITED, AUDIT_PART, RECALL, TRIES = 2048, 8, 0.97, 3
#: Rows of either side of a tile where classes are compared with all others.
TILE = 1024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length from a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _halves(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows from packed half-precision vectors of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).astype(np.float32).reshape(len(column), dim)


def _hyperplane_codes(first: int, tables: int):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class once for every table, with the signs of its first `bits` projections."""
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            width = batch.column("dim").to_numpy()
            out = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                v = _halves(batch.column("q").take(pa.array(at)), int(d))
                for t in range(tables):
                    sign = v @ np.random.default_rng([first + t, int(d)]).standard_normal((int(d), 24)) > 0
                    sign &= np.arange(24) < bits[at][:, None]
                    out[at, t] = sign @ (1 << np.arange(24))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(first + t, pa.int32()), batch.num_rows), pa.array(out[:, t]), batch.column("grp"), batch.column("dim"), batch.column("id"), batch.column("q")], names=["tab", "code", "grp", "dim", "id", "q"])

    return codes


def _best_of(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, cosine) of each row's k best others."""
    n = len(ids)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, axis=1).ravel()


def _block_neighbours(k: int):
    def neighbours(block: pa.Table) -> pa.Table:
        a, b, s = _best_of(block.column("id").to_numpy(), _halves(block.column("q"), block.column("dim")[0].as_py()), k)
        return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "sim": pa.array(s.astype(np.float32), pa.float32())})

    return neighbours


def _descend(k: int):
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (hub, part): the neighbours of a hub meet one another. Only what betters a list comes out."""
        held: list[pa.RecordBatch] = []

        def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
            hub, part = t.column("hub").to_numpy(), t.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1]))), len(hub))
            ids, worst = t.column("id").to_numpy(), t.column("worst").to_numpy()
            v = np.frombuffer(b"".join(t.column("q").to_pylist()), np.float16).astype(np.float32)
            widths = t.column("dim").to_numpy()
            offset = np.append(0, np.cumsum(widths))
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    a, b, s = _best_of(ids[lo:hi], v[offset[lo] : offset[hi]].reshape(hi - lo, -1), k)
                    better = s > np.repeat(worst[lo:hi], min(k, hi - lo - 1))
                    found.append((a[better], b[better], s[better]))
            if found:
                yield pa.RecordBatch.from_pydict({"id": np.concatenate([f[0] for f in found]), "other": np.concatenate([f[1] for f in found]), "sim": np.concatenate([f[2] for f in found]).astype(np.float32)})

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                t = pa.Table.from_batches(held).combine_chunks()
                hub = t.column("hub").to_numpy()
                cut = int(np.searchsorted(hub, hub[-1]))
                if cut:
                    yield from joined(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = len(hub) - cut
        if held and rows:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    return descend


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(id, near): the k best others of each, best first."""
    return pairs.groupBy("id").agg(F.collect_set(F.struct("sim", "other")).alias("all")).select("id", F.expr("array_sort(all, (x, y) -> CASE WHEN x.sim > y.sim THEN -1 WHEN x.sim < y.sim THEN 1 WHEN x.other < y.other THEN -1 WHEN x.other > y.other THEN 1 ELSE 0 END)").alias("near")).select(
        "id", F.expr(f"slice(filter(near, (x, i) -> i = 0 OR x.other <> near[i - 1].other), 1, {k})").alias("near")
    )


def _sized_parts(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows with `part`: each key's rows dealt by id into parts of about `size`."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return rows.join(many, keys).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("_n") / size))).drop("_n")


def _bits(n: Column) -> Column:
    """Hyperplanes that cut a group of n into blocks of about half a BLOCK."""
    return F.least(F.greatest(F.ceil(F.log2(n / F.lit(BLOCK / 2))), F.lit(0)), F.lit(24)).cast("int")


def tables_for(bits: int, threshold: float, miss: float | None = None) -> int:
    """Tables after which a pair at the threshold has met in a block with a probability of 1 - miss: a hyperplane leaves it together with 1 - angle / pi."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if together >= 1 else max(1, math.ceil(math.log(miss or MISS) / math.log(1 - together)))


def _search(classes: DataFrame, sizes: DataFrame, first: int, tables: int, k: int, rounds: int, before: DataFrame | None) -> DataFrame:
    """Neighbour lists (id, near) after new tables and rounds of descent; before: lists of an earlier search."""
    bits = sizes.select("grp", "dim", _bits(F.col("n")).alias("bits"))
    rows = classes.select("grp", "dim", "id", "q").join(bits, ["grp", "dim"])
    keys, lists = ["tab", "code", "grp", "dim"], before
    for done in range(0, tables, STEP):  # few tables at once, so that little is written for each
        coded = settled(rows.mapInArrow(_hyperplane_codes(first + done, min(STEP, tables - done)), "tab int, code long, grp string, dim int, id long, q binary"), "nn-coded")
        pairs = _sized_parts(coded, keys, BLOCK).groupBy(*keys, "part").applyInArrow(_block_neighbours(k), "id long, other long, sim float")
        if lists is not None:
            pairs = pairs.unionByName(lists.select("id", F.explode("near").alias("x")).select("id", "x.other", "x.sim"))
        lists = settled(_lists(pairs, k), "nn-lists")
    half = classes.select("id", "dim", "q")
    for _ in range(rounds):
        own = lists.select(F.col("id").alias("hub"), F.explode("near.other").alias("id"))
        both = own.unionByName(own.select(F.col("id").alias("hub"), F.col("hub").alias("id"))).distinct()
        met = _sized_parts(both, ["hub"], 4 * k)
        worst = lists.select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        met = met.join(half.join(worst, "id"), "id").select("hub", "part", "id", "dim", "q", "worst")
        met = met.repartition(partitions(classes.sparkSession), "hub").sortWithinPartitions("hub", "part", "id")
        new = met.mapInArrow(_descend(k), "id long, other long, sim float")
        lists = settled(_lists(lists.select("id", F.explode("near").alias("x")).select("id", "x.sim", "x.other").unionByName(new.select("id", "sim", "other")), k), "nn-lists")
    return lists


def _cosine(x: str, y: str):
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, p) -> s + p)")


def _links_of_lists(lists: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of the lists whose cosine reaches the threshold. Lists hold rounded cosines, so a margin is checked too."""
    near = lists.select("id", F.explode("near").alias("x")).where(F.col("x.sim") >= threshold - 0.005)
    near = near.select(F.least("id", "x.other").alias("a"), F.greatest("id", "x.other").alias("b")).distinct()
    full = near.join(classes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(classes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return full.where(_cosine("va", "vb") >= threshold).select("a", "b")


def _tile_links(threshold: float):
    def links(tile: pa.Table) -> pa.Table:
        """Links of each member with the other part of the tile, or within it; `times` weighs copies."""
        side = tile.column("side").to_numpy()
        v, ids, times = _matrix(tile.column("v")), tile.column("id").to_numpy(), tile.column("times").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(y):
            near = v[x] @ v[y].T >= threshold
            n = np.concatenate([near @ times[y], times[x] @ near])
            at = np.concatenate([x, y])
        else:
            near = v[x] @ v[x].T >= threshold
            np.fill_diagonal(near, False)
            n, at = near @ times[x], x
        return pa.table({"id": ids[at], "n": n.astype(np.int64)})

    return links


def _cross_links(threshold: float):
    def links(tile: pa.Table) -> pa.Table:
        """(a, b), a < b: links between the two sides of a tile."""
        side, ids, v = tile.column("side").to_numpy(), tile.column("id").to_numpy(), _matrix(tile.column("v"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(v[x] @ v[y].T >= threshold)
        p, q = ids[x[i]], ids[y[j]]
        return pa.table({"a": np.minimum(p, q)[p != q], "b": np.maximum(p, q)[p != q], "grp": pa.repeat(tile.column("grp")[0], int((p != q).sum())), "dim": pa.repeat(tile.column("dim")[0], int((p != q).sum()))})

    return links


def _true_links(asked: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, grp, dim), a < b: all links between the classes asked for and all classes, compared in tiles."""
    keys = ["grp", "dim"]
    parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).alias("m")).join(classes.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).alias("n")), keys)

    def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("id", F.lit(31)), F.col(own)).alias(own)
        return rows.join(parts, keys).select(*keys, at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), F.lit(side).alias("side"), "id", "v")

    tiles = dealt(asked, 0, "m", "n").unionByName(dealt(classes, 1, "n", "m"))
    return tiles.groupBy(*keys, "m", "n").applyInArrow(_cross_links(threshold), "a long, b long, grp string, dim int").distinct()


def _audit(classes: DataFrame, threshold: float) -> DataFrame:
    """All true links of a bounded number of classes drawn by a hash."""
    total, slots = classes.count(), 1 << 30
    limit = slots * min(AUDITED, -(-total // AUDIT_PART)) // max(total, 1)
    return settled(_true_links(classes.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(slots)) < limit), classes, threshold), "nn-audit")


def _recall(true: DataFrame, component: DataFrame) -> list:
    """For each group: true links, and how many of them lie inside components."""
    ca, cb = component.select(F.col("node").alias("a"), F.col("component").alias("ca")), component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return true.join(ca, "a", "left").join(cb, "b", "left").groupBy("grp", "dim").agg(F.count("*").alias("n"), F.expr("count_if(ca = cb)").alias("found")).collect()


def _all_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, float | None]:
    """(a, b): the links that are searched for, and the audited recall."""
    true = _audit(classes, threshold)
    sizes = classes.groupBy("grp", "dim").agg(F.count("*").alias("n"))
    bits = sizes.agg(F.max(_bits(F.col("n")))).first()[0] or 0
    lists, k, first, tables = None, LIST, 0, tables_for(bits, threshold)
    for tries in range(TRIES):
        lists = _search(classes, sizes, first, tables, k, 1 + tries, lists)
        links = settled(_links_of_lists(lists, classes, threshold), "nn-links")
        found = _recall(true, connected_components(links))
        known, hit = sum(r.n for r in found), sum(r.found for r in found)
        if hit >= RECALL * known:
            return links, hit / known if known else None
        first, tables, k = first + tables, 2 * tables, 2 * k
    below = [r for r in found if r.found < RECALL * r.n]
    rest = classes.join(F.broadcast(classes.sparkSession.createDataFrame([(r.grp, r.dim) for r in below], "grp string, dim int")), ["grp", "dim"], "left_semi")
    return links.unionByName(_true_links(rest, rest, threshold).select("a", "b")), (hit + sum(r.n - r.found for r in below)) / known


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """id_col, n_links (other vectors linked directly), component_id (smallest id reachable by links), kept (id = component_id), audited_recall."""
    spark = df.sparkSession
    small_batches(spark, 4096)
    if not isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        numbers = settled(df.select(F.col(id_col).alias("own")).where("own IS NOT NULL").distinct().orderBy("own").withColumn("number", F.monotonically_increasing_id()), "nn-numbers")
        numbered = df.select(F.col(id_col).alias("own"), F.col(vec_col).alias("vector"), F.col(group_col).alias("grp")).join(numbers, "own", "left")
        out = near_duplicate_vectors(numbered, threshold, "number", "vector", "grp")
        name = lambda as_, number: numbers.select(F.col("own").alias(as_), F.col("number").alias(number))
        out = out.join(name(id_col, "number"), "number", "left").join(name("smallest", "component_id"), "component_id", "left")
        return out.select(id_col, "n_links", F.col("smallest").alias("component_id"), "kept", "audited_recall")
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), v.alias("raw"))
    norm = F.sqrt(F.expr("aggregate(raw, 0D, (s, p) -> s + p * p)"))
    sound = F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size("raw") > 0) & F.expr("NOT exists(raw, p -> p IS NULL OR isnan(p) OR abs(p) = double('infinity'))") & (norm > 0) & (norm < float("inf"))
    rows = rows.withColumn("norm", norm).withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("v", F.expr("CASE WHEN sound THEN transform(raw, p -> p / norm) END"))
    rows = settled(rows.select("id", "grp", "sound", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "nn-rows")
    copies = rows.where("sound").groupBy("grp", "dim", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    classes = copies.join(rows.where("sound").select("id", "v"), "id").dropDuplicates(["id"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [x.values.to_numpy(zero_copy_only=False).astype(np.float16).tobytes() for x in batch.column("v")]
            yield batch.append_column("q", pa.array(q, pa.binary()))

    classes = settled(classes.select("id", "grp", "dim", "h1", "h2", "times", "v").mapInArrow(halves, "id long, grp string, dim int, h1 long, h2 long, times long, v array<double>, q binary"), "nn-classes")
    links, recall = _all_links(classes, threshold)
    links = settled(links.distinct(), "nn-links")
    component = settled(connected_components(links), "nn-components")
    # Lists of a pair are complete; larger components are compared in full.
    many = component.groupBy("component").agg(F.count("*").alias("size"))
    members = component.join(many, "component").withColumnRenamed("node", "id")
    weights = classes.select("id", "times")
    pairs = links.join(members.where("size = 2").select(F.col("id").alias("a")), "a").join(weights.select(F.col("id").alias("a"), F.col("times").alias("ta")), "a").join(weights.select(F.col("id").alias("b"), F.col("times").alias("tb")), "b")
    n_pairs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("tb").alias("n")), F.struct(F.col("b").alias("id"), F.col("ta").alias("n")))).alias("x")).select("x.*")
    parts = members.where("size > 2").withColumn("parts", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id", F.lit(29)), F.col("parts")))
    tiles = parts.select("component", "id", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("component", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    tiles = tiles.join(classes.select("id", "times", "v"), "id").select("component", "i", "j", "side", "id", "times", "v")
    n_tiles = tiles.groupBy("component", "i", "j").applyInArrow(_tile_links(threshold), "id long, n long")
    n_links = n_pairs.unionByName(n_tiles).groupBy("id").agg(F.sum("n").alias("n"))
    of_class = classes.select("id", "grp", "dim", "h1", "h2", "times").join(n_links, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("grp", "dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("sound").select("id", "grp", "dim", "h1", "h2").join(of_class, ["grp", "dim", "h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
