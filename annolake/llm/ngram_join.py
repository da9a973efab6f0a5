"""N-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct word n-grams; documents of one normalised word sequence
are one set. Similar sets are first partitioned into groups: sets that share a smallest hash meet in
bounded blocks, where those that reach the threshold with a block's leader join its group; every other set
is a group of its own. The matrix has a row for each token and one entry for each group whose union holds
it. Of a union it keeps its members' first tokens (in an order by frequency, rarest first, of which a set
needs only as many as it may miss), with the least slack (what a member has already lost before the token)
and the range of the members' sizes. A row with one group stays closed. Rows that groups share give pairs of
groups; one aggregate on the pair bounds their overlap: in some row the least slacks must leave room for the
threshold, and the unions must share as many first tokens as members of these sizes share at least. Only
groups that qualify are opened: the members of the smaller one are queries, each held against the tokens'
union of a tile of the larger one and, if that may be enough, counted exactly against all its members. Groups
only save work: all pairs of sets in different groups that may reach the threshold are among what is opened, so no
link between components is lost.

A row of very many groups is paired in tiles by other tasks; no task holds a whole group.

Frequencies come from a sketch of fixed size; they decide the order and nothing else.

Defined results: null and empty texts have an empty set and link with nothing; a text of fewer than n words
is one n-gram as a whole; ids should be unique (rows that repeat an id are rows of that id); null ids are
components of their own, with a null component; ids of any type that has an order do (those that are no integers
are numbered in their order first); ties (several smallest hashes, equal frequencies) change nothing in the result;
an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from annolake.llm.common import partitions, settled, small_batches
from annolake.llm.graph import connected_components

#: Sets compared with leaders in one block; bounds a task's group whatever a hash is shared by.
BLOCK = 64
#: Counters of the frequency sketch and bits of an id filter, as powers of two; pieces in which they travel.
SKETCH_BITS, FILTER_BITS, PIECE = 20, 24, 1 << 13
#: Matrix rows of up to so many groups are paired all at once; above the second width in tiles of the third one.
SHORT_ROW, WIDE_ROW, WIDE_TILE = 48, 8_192, 1_024
#: Members in a tile of an opened group, and queries in a block; rows in a task's bucket of such tiles; queries of a pair of groups that go first.
TILE, BUCKET, FIRST_QUERIES = 256, 1_000, 8
_B = 0x5851F42D4C957F2D
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Shingler:
    """Sorted distinct n-gram hashes of texts; the powers it needs grow with the longest text."""

    def __init__(self, n: int = 5):
        self.n = n
        self.of_byte = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        up, down = np.full(size, _U(_B)), np.full(size, _U(pow(_B, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        text = b" ".join(words)
        if len(text) + 1 > len(self.up):
            self._grow(2 * len(text) + 2)
        codes = np.frombuffer(text, np.uint8)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.of_byte[codes] * self.up[: len(codes)], out=sums[1:])
        gaps = np.flatnonzero(codes == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(codes))
        if len(starts) >= self.n:
            starts, ends = starts[: len(starts) - self.n + 1], ends[self.n - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        return np.unique(_mixed((sums[ends] - sums[starts]) * self.down[starts]))


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split() parts at the white space of ASCII and at nothing else."""
    return (text or b"").lower().split()


def _survey(n: int):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text: digest of its word sequence, size of its set, two smallest hashes. Then the task's frequency sketch."""
        shingles, sketch = Shingler(n), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                w = words_of(t)
                s = shingles(w)
                sketch[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)] += 1
                k1, k2 = ((s.min(), (_mixed(s * _U(0x9E3779B97F4A7C15 | 1))).min()) if len(s) else (0, 0))
                rows.append((hashlib.blake2b(b" ".join(w), digest_size=16).digest(), len(s), int(k1) >> 1, int(k2) >> 1))
            d = len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))), pa.nulls(d, pa.int32()), pa.nulls(d, pa.binary())],
                names=["id", "digest", "n", "k1", "k2", "piece", "counts"],
            )
        for piece, part in enumerate(sketch.reshape(-1, PIECE)):
            if part.any():
                id_type = batch.column("id").type
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([piece], pa.int32()), pa.array([part.tobytes()])], names=["id", "digest", "n", "k1", "k2", "piece", "counts"])

    return survey


def _add_sketches(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in rows.column("counts").to_pylist())
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _filter_piece(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    bits = np.zeros(PIECE * 8, np.uint8)
    bits[rows.column("slot").to_numpy() % (PIECE * 8)] = 1
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits).tobytes()]})


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of a fixed number of slots: set where an id may lie. Saturation only lets more rows through."""
    slots = ids.select((F.xxhash64("id").bitwiseAND((1 << FILTER_BITS) - 1)).alias("slot")).distinct()
    pieces = slots.withColumn("piece", F.expr(f"int(slot div {PIECE * 8})")).groupBy("piece").applyInArrow(_filter_piece, "piece int, bits binary")
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def through_filter(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of docs (id, text) that may be in ids; or, not inside, those that certainly are not."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            there = (shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(there.astype(bool) == inside)).select(["id", "text"])

    slots = docs.select("id", "text", F.xxhash64("id").bitwiseAND((1 << FILTER_BITS) - 1).alias("slot"))
    return slots.mapInArrow(passing, docs.select("id", "text").schema)


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted distinct hashes."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    common = int((long[np.minimum(at, len(long) - 1)] == short).sum()) if len(long) else 0
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _lead(n: int, percent: int):
    def lead(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        """Each set of the block with the first leader it reaches, or as a leader itself, then with its text."""
        shingles = Shingler(n)
        order = np.argsort(np.array(block.column("id").to_pylist()), kind="stable")
        block = block.take(pa.array(order))
        ids, texts = block.column("id").to_pylist(), block.column("text").to_pylist()
        leaders: list[tuple[int, np.ndarray]] = []
        out_leader, out_text = [], []
        for i, t in zip(ids, texts, strict=True):
            s = shingles(words_of(t))
            of = next((j for j, other in leaders if reaches(s, other, percent)), None)
            if of is None:
                leaders.append((i, s))
            out_leader.append(i if of is None else of)
            out_text.append(t if of is None else None)
        return pa.table({"tag": block.column("tag"), "id": block.column("id"), "leader": pa.array(out_leader, block.column("id").type), "text": pa.array(out_text, pa.binary())})

    return lead


def similar_groups(docs: DataFrame, sets: DataFrame, n: int, percent: int, rounds: int = 3) -> DataFrame:
    """Links (a, b), all verified, that gather similar sets. docs: id, text of all rows; sets: id, n, k1, k2 of each distinct set."""
    id_type = docs.schema["id"].dataType.simpleString()
    keyed = sets.where("n > 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("w"), F.col("k1").alias("k")), F.struct(F.lit(2).alias("w"), F.col("k2").alias("k")))).alias("tag"))
    shared = keyed.groupBy("tag").agg(F.count("*").alias("size")).where("size > 1")
    need = settled(keyed.join(shared, "tag").select("id", "tag", "size"), "join-keyed")
    members = through_filter(docs, need.select("id").distinct()).join(need, "id")
    links = None
    for _ in range(rounds):
        dealt = members.select("tag", "id", "text", F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("size") / BLOCK)).alias("part"))
        led = settled(dealt.groupBy("tag", "part").applyInArrow(_lead(n, percent), f"tag struct<w int, k long>, id {id_type}, leader {id_type}, text binary"), "join-led")
        found = led.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
        links = found if links is None else links.unionByName(found)
        # Leaders of a key that took several blocks meet again.
        left = led.where("id = leader").select("tag", "id", "text")
        again = settled(left.groupBy("tag").agg(F.count("*").alias("size")).join(shared.where(f"size > {BLOCK}").select("tag"), "tag", "left_semi").where("size > 1"), "join-again")
        if again.isEmpty():
            break
        members = left.join(again, "tag")
    return links


def _first_tokens(n: int, percent: int, shared):
    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set's share of its group's union: its rarest tokens, as many as it may miss and one, with its slack at each and its size.

        Members of one group that meet in a batch are united here, so a large group sends a few rows for each of its tokens.
        """
        shingles = Shingler(n)
        level = shared.value
        for batch in batches:
            token, row, slack, size = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                s = shingles(words_of(t))
                if len(s):
                    take = len(s) - (-(-percent * len(s) // 100)) + 1
                    rare = level[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                    first = s[np.lexsort((s, rare))[:take]] if rare.any() else s[:take]
                    token.append(first)
                    row.append(np.full(take, i))
                    # What two sets of sizes p and q may differ in is (p + q) * (100 - percent) / (100 + percent).
                    slack.append(np.arange(take) - len(s) * (100 - percent) / (100 + percent))
                    size.append(np.full(take, len(s)))
            if token:
                at = np.concatenate(row)
                grp, ids = batch.column("grp").to_numpy(), batch.column("id").to_numpy()
                tokens, slacks, sizes = np.concatenate(token).astype(np.int64), np.concatenate(slack).astype(np.float32), np.concatenate(size).astype(np.int32)
                alone = (grp == ids)[at]
                united = _united(tokens[~alone], grp[at[~alone]], slacks[~alone], sizes[~alone], sizes[~alone])
                yield _entries(*(np.concatenate(x) for x in zip((tokens[alone], grp[at[alone]], slacks[alone], sizes[alone], sizes[alone]), united, strict=True)))

    return first_tokens


def _entries(token: np.ndarray, grp: np.ndarray, slack: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(grp), pa.array(slack), pa.array(lo), pa.array(hi)], names=["token", "grp", "slack", "lo", "hi"])


def _united(token: np.ndarray, grp: np.ndarray, slack: np.ndarray, lo: np.ndarray, hi: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, ...]:
    """One entry for each (token, group): the least slack and the range of sizes. ordered: they come by token and group."""
    if not len(token):
        return token, grp, slack, lo, hi
    if not ordered:
        by = np.lexsort((grp, token))
        token, grp, slack, lo, hi = (x[by] for x in (token, grp, slack, lo, hi))
    at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])))
    if len(at) == len(token):
        return token, grp, slack, lo, hi
    return token[at], grp[at], np.minimum.reduceat(slack, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def least_common(n_a: str, n_b: str, percent: int) -> str:
    """SQL for the first tokens that two sets of these sizes share at least if they reach the threshold.

    They have at least o = percent * (n_a + n_b) / (100 + percent) tokens in common, so a has at most n_a - o others. Its
    first tokens are as many as it may miss and one; the k-th common token comes after at most k - 1 common and n_a - o
    other ones, in b likewise, so the first common ones lie among the first tokens of both.
    """
    common = f"ceil({percent} * ({n_a} + {n_b}) / {100 + percent}.0 - 1e-9)"
    first = [f"({n} - ceil({percent} * {n} / 100.0 - 1e-9) + 1)" for n in (n_a, n_b)]
    return f"greatest(1, least({first[0]} - ({n_a} - {common}), {first[1]} - ({n_b} - {common})))"


def least_common_of_groups(percent: int) -> str:
    """least_common of any two members of groups with sizes from la to ha and lb to hb; exact where each has one size.

    Without rounding it rises with the smaller size and falls with the larger one, so it is least at two corners.
    """
    loose = [f"ceil({percent} * ({x} + {y}) / {100 + percent}.0 - {percent} / 100.0 * greatest({x}, {y}) - 1e-9)" for x, y in (("la", "hb"), ("lb", "ha"))]
    return f"CASE WHEN la = ha AND lb = hb THEN {least_common('la', 'lb', percent)} ELSE greatest(1, least({loose[0]}, {loose[1]})) END"


#: What a matrix row gives: pairs of groups (a, b) with the size ranges of either and whether the slacks leave room; or, of a wide row, its entries (a, tok, slack, la, ha).
MET = "a long, b long, la int, ha int, lb int, hb int, room boolean, tok long, slack float"


def _pair_batch(i: np.ndarray, j: np.ndarray, grp: np.ndarray, slack: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    swap = grp[i] > grp[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    none = pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.float32())
    return pa.RecordBatch.from_arrays([pa.array(grp[i]), pa.array(grp[j]), pa.array(lo[i]), pa.array(hi[i]), pa.array(lo[j]), pa.array(hi[j]), pa.array(slack[i] + slack[j] <= 1e-3), *none], names=["a", "b", "la", "ha", "lb", "hb", "room", "tok", "slack"])


def _fitting(i: np.ndarray, j: np.ndarray, grp: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different groups of which two members' sizes may reach the threshold."""
    fit = (grp[i] != grp[j]) & (100 * hi[i].astype(np.int64) >= percent * lo[j]) & (100 * hi[j].astype(np.int64) >= percent * lo[i])
    return i[fit], j[fit]


def _meet(percent: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries come sorted by token and group. Of each matrix row the pairs of groups that fit; a wide row goes on as its
        entries, to be paired in tiles. A row in which only one group has an entry stays closed."""
        wide_token = None

        def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            token, grp, slack, lo, hi = _united(*(t.column(c).to_numpy() for c in ("token", "grp", "slack", "lo", "hi")), ordered=True)
            cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
            width = np.diff(cuts)
            of = np.repeat(width, width)
            wide = (of > WIDE_ROW) | (token == wide_token)
            if wide.any():
                k, none = int(wide.sum()), pa.nulls(int(wide.sum()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(grp[wide]), pa.nulls(k, pa.int64()), pa.array(lo[wide]), pa.array(hi[wide]), none, none, pa.nulls(k, pa.bool_()), pa.array(token[wide]), pa.array(slack[wide])], names=["a", "b", "la", "ha", "lb", "hb", "room", "tok", "slack"])
            short = (of <= SHORT_ROW) & ~wide
            for step in range(1, int(min(width.max(initial=1), SHORT_ROW))):
                i = np.flatnonzero((token[:-step] == token[step:]) & short[:-step])
                if not len(i):
                    break
                i, j = _fitting(i, i + step, grp, lo, hi, percent)
                if len(i):
                    yield _pair_batch(i, j, grp, slack, lo, hi)
            for k in np.flatnonzero((width > SHORT_ROW) & ~wide[cuts[:-1]]):
                yield from _row_pairs(np.arange(cuts[k], cuts[k + 1]), grp, slack, lo, hi, percent)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < 100_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            token = t.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1]))  # the last row may go on
            if not cut:
                cut, wide_token = len(token), token[-1]
            yield from rows(t.slice(0, cut).combine_chunks())
            held, count = t.slice(cut).to_batches(), len(token) - cut
        if count:
            yield from rows(pa.Table.from_batches(held).combine_chunks())

    return meet


def _row_pairs(row: np.ndarray, grp: np.ndarray, slack: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int, other: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The fitting pairs of one row, or of one tile with another, some hundred thousand at a time."""
    by = 1 + 200_000 // max(len(row) if other is None else len(other), 1)
    for at in range(0, len(row), by):
        part = row[at : at + by]
        if other is None:
            i, j = np.nonzero(np.arange(len(row))[None, :] > np.arange(at, at + len(part))[:, None])
            i, j = part[i], row[j]
        else:
            i, j = np.repeat(part, len(other)), np.tile(other, len(part))
        i, j = _fitting(i, j, grp, lo, hi, percent)
        if len(i):
            yield _pair_batch(i, j, grp, slack, lo, hi)


def _tile_pairs(percent: int):
    def tile_pairs(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Pairs between two tiles of a wide row, or within one."""
        grp, slack, lo, hi = (t.column(c).to_numpy() for c in ("a", "slack", "la", "ha"))
        own = t.column("tile").to_numpy() == key[1].as_py()
        one, two = np.flatnonzero(own), np.flatnonzero(~own)
        found = list(_row_pairs(one, grp, slack, lo, hi, percent, None if key[1].as_py() == key[2].as_py() else two))
        return pa.Table.from_batches(found or [_pair_batch(one[:0], one[:0], grp, slack, lo, hi)])

    return tile_pairs


def qualifying_groups(matrix: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (a, b) that may hold a link: matrix rows give pairs, one aggregate bounds each pair's overlap."""
    spark = matrix.sparkSession
    ordered = matrix.repartition(partitions(spark), "token").sortWithinPartitions("token", "grp")
    ranges = [F.min("la").alias("la"), F.max("ha").alias("ha"), F.min("lb").alias("lb"), F.max("hb").alias("hb"), F.max("room").alias("room")]
    met = settled(ordered.mapInArrow(_meet(percent), MET).groupBy("a", "b", "tok").agg(F.count("*").alias("common"), F.min("slack").alias("slack"), *ranges), "join-met")
    pairs, wide = met.where("b IS NOT NULL").drop("tok", "slack"), met.where("b IS NULL")
    if not wide.isEmpty():
        tiles = wide.groupBy("tok").agg(F.ceil(F.count("*") / WIDE_TILE).cast("int").alias("tiles"))
        dealt = wide.join(tiles, "tok").withColumn("tile", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int"))
        dealt = dealt.select("tok", "a", "slack", "la", "ha", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
        dealt = dealt.withColumn("t1", F.least("tile", "with")).withColumn("t2", F.greatest("tile", "with"))
        more = dealt.groupBy("tok", "t1", "t2").applyInArrow(_tile_pairs(percent), MET).drop("tok", "slack").withColumn("common", F.lit(1).cast("long"))
        pairs = pairs.unionByName(more).groupBy("a", "b").agg(F.sum("common").alias("common"), *ranges)
    return settled(pairs.where(f"room AND common >= {least_common_of_groups(percent)}").select("a", "b"), "join-pairs")


def _open(n: int, percent: int):
    def opened(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Queries against a tile of an opened group: the tile stays closed to a query that shares too few tokens with its union,
        else the query's overlap with every member is counted at once. One link of a query with a tile is enough."""
        shingles = Shingler(n)
        sets: dict[int, np.ndarray] = {}
        large, tile, block, ids = (t.column(c).to_numpy() for c in ("large", "tile", "block", "id"))
        small, texts = t.column("small").to_pylist(), t.column("text").to_pylist()
        order = np.lexsort((block, tile, large))
        keys = np.stack([large, tile, block])[:, order]
        cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), len(order))
        out: list[tuple[int, int, int, int]] = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[begin:end].tolist()
            for i in at:
                if ids[i] not in sets:
                    sets[ids[i]] = shingles(words_of(texts[i]))
            members = [i for i in at if small[i] is None]
            if not members:
                continue
            sizes = np.array([len(sets[ids[i]]) for i in members])
            union = np.concatenate([sets[ids[i]] for i in members])
            owner = np.repeat(np.arange(len(members)), sizes)
            by = np.argsort(union, kind="stable")
            union, owner = union[by], owner[by]
            for q in at:
                if small[q] is None:
                    continue
                s = sets[ids[q]]
                low, high = np.searchsorted(union, s), np.searchsorted(union, s, "right")
                shared = high > low
                fewest = -(-percent * (len(s) + max(int(sizes.min()), -(-percent * len(s) // 100))) // (100 + percent))
                if int(shared.sum()) < fewest:
                    continue
                low, each = low[shared], (high - low)[shared]
                hits = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                common = np.bincount(owner[hits], minlength=len(members))
                linked = np.flatnonzero((common > 0) & (100 * common >= percent * (len(s) + sizes - common)))
                if len(linked):
                    out.append((int(ids[q]), int(ids[members[linked[0]]]), small[q], int(large[q])))
        return pa.table({c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate(("q", "m", "small", "large"))})

    return opened


def links_of_opened(docs: DataFrame, sets: DataFrame, groups: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): the pairs of groups that a verified link joins, as many as it takes to connect what is linked.

    The smaller group's members are queries against the larger one, which is opened in tiles: its members travel once for
    each block of queries, a query once for each tile. A few queries of each pair go first; the rest of them only where the
    groups are not connected by then.
    """
    member = groups.select(F.col("component").alias("grp"), F.col("node").alias("id"))
    size = settled(groups.groupBy(F.col("component").alias("grp")).agg(F.count("*").alias("size")), "join-sizes")
    of = [size.select(F.col("grp").alias(g), F.col("size").alias(f"s{g}")) for g in "ab"]
    sized = pairs.join(of[0], "a", "left").join(of[1], "b", "left").na.fill(1, ["sa", "sb"])
    swap = F.col("sa") > F.col("sb")
    turned = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("large"), F.least("sa", "sb").alias("queries"), F.greatest("sa", "sb").alias("size"))
    asked = turned.join(member.select(F.col("grp").alias("small"), F.col("id").alias("q")), "small", "left").withColumn("q", F.coalesce("q", "small"))
    place = F.row_number().over(Window.partitionBy("small", "large").orderBy(F.xxhash64("q"), "q"))
    asked = settled(asked.withColumn("place", F.when(F.col("queries") > 1, place).otherwise(1)), "join-queries")
    linked = pairs.limit(0)
    for before, last in ((0, FIRST_QUERIES), (FIRST_QUERIES, None)):
        now = asked.where(F.col("place") > before)
        if last:
            now = now.where(F.col("place") <= last)
        elif now.isEmpty():
            break
        else:
            merged = connected_components(linked).withColumnRenamed("component", "to")
            for g in ("small", "large"):
                now = now.join(merged.select(F.col("node").alias(g), F.col("to").alias(f"{g}_to")), g, "left").withColumn(f"{g}_to", F.coalesce(f"{g}_to", g))
            now = settled(now.where("small_to <> large_to").drop("small_to", "large_to"), "join-queries")
            if now.isEmpty():
                break
        opened = settled(now.groupBy("large").agg(F.ceil(F.count("*") / TILE).alias("blocks"), F.ceil(F.first("size") / TILE).alias("tiles")), "join-opened")
        queries = now.join(opened, "large").select("small", "large", F.col("q").alias("id"), F.expr("sequence(0L, tiles - 1)").alias("at"), F.array(F.pmod(F.xxhash64("q"), "blocks")).alias("blocks"))
        members = opened.join(member.withColumnRenamed("grp", "large"), "large", "left").withColumn("id", F.coalesce("id", "large"))
        members = members.select(F.lit(None).cast("long").alias("small"), "large", "id", F.array(F.pmod(F.xxhash64("id", F.lit(11)), "tiles")).alias("at"), F.expr("sequence(0L, blocks - 1)").alias("blocks"))
        rows = settled(queries.unionByName(members), "join-rows")
        texts = through_filter(docs, rows.select("id").distinct()).join(sets.select("id"), "id", "left_semi").dropDuplicates(["id"])
        full = rows.join(texts, "id").select("*", F.explode("at").alias("tile")).select("small", "large", "id", "text", "tile", F.explode("blocks").alias("block"))
        # Many small groups share a bucket; a tile with its block of queries is bounded.
        buckets = max(partitions(docs.sparkSession), rows.count() // BUCKET)
        full = full.withColumn("bucket", F.pmod(F.xxhash64("large", "tile", "block", F.lit(3)), F.lit(buckets)))
        found = settled(full.groupBy("bucket").applyInArrow(_open(n, percent), "q long, m long, small long, large long"), "join-linked")
        linked = linked.unionByName(found.select(F.col("small").alias("a"), F.col("large").alias("b")).distinct())
    return linked


def jaccard_components(df: DataFrame, n: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable by links of at least percent / 100)."""
    if not isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        # Sorted partitions are numbered in their order, so the smallest number is the smallest id.
        numbers = settled(df.select(F.col(id_col).alias("own")).where("own IS NOT NULL").distinct().orderBy("own").withColumn("number", F.monotonically_increasing_id()), "join-numbers")
        found = jaccard_components(df.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).join(numbers, "own", "left"), n, percent, "text", "number")
        named = found.join(numbers, "number", "left").withColumnRenamed("own", id_col)
        return named.join(numbers.select(F.col("number").alias("component_id"), F.col("own").alias("component")), "component_id", "left").select(id_col, "n_shingles", F.col("component").alias("component_id"))
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    surveyed = settled(docs.mapInArrow(_survey(n), "id long, digest binary, n long, k1 long, k2 long, piece int, counts binary"), "join-survey")
    rows = surveyed.where("digest IS NOT NULL").select("id", "digest", "n", "k1", "k2")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in surveyed.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(_add_sketches, "piece int, counts binary").toLocalIterator():
        sketch[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(bytes(r.counts), np.uint32)
    level = np.maximum(np.log2(np.maximum(sketch, 1) / max(2 * sketch.mean(), 2)), -0.5).astype(np.int8) + 1  # 0 for what is not frequent
    sets = settled(rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2")), "join-sets")
    links = similar_groups(docs, sets, n, percent)
    groups = settled(connected_components(links), "join-groups")
    # Rows that need more than their own text: members of groups, and copies of another row's set (these drop out).
    copies = rows.where("n > 0").join(sets.select("digest", F.col("id").alias("own")), "digest").where("id <> own").select("id", F.lit(None).cast("long").alias("grp"), F.lit(True).alias("copy"))
    special = settled(groups.select(F.col("node").alias("id"), F.col("component").alias("grp"), F.lit(False).alias("copy")).unionByName(copies.distinct()), "join-special")
    plain = through_filter(docs.where("id IS NOT NULL"), special, inside=False).select("id", F.col("id").alias("grp"), "text")
    other = through_filter(docs.where("id IS NOT NULL"), special).join(special, "id", "left").where("copy IS NULL OR NOT copy").select("id", F.coalesce("grp", "id").alias("grp"), "text")
    matrix = plain.unionByName(other).mapInArrow(_first_tokens(n, percent, spark.sparkContext.broadcast(level)), "token long, grp long, slack float, lo int, hi int")
    verified = links_of_opened(docs, sets, groups, qualifying_groups(matrix, percent), n, percent)
    merged = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified))
    of_set = sets.join(merged.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return rows.join(of_set, "digest").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )
