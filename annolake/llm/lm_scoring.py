"""LM scoring by online logistic context mixing over bits.

A text is its lower-cased tokens, then one end. A token is coded byte by byte (a space closes it, a line
feed is the end token), each byte bit by bit. Several predictors keep zero/one counts in hashed contexts
inside the token (its depth, the last one to four bytes, all bytes so far; depth and the last one to
three bytes by the text's class); a gate, the longest context that has been seen, picks the weights that mix them in the
logistic domain. The weights are learnt online, batch by batch, each bit predicted with its own occurrence
left out, and an adaptive table refines the mixed probability. The token's probability under a class is
interpolated with its share of that class's training tokens. The training tokens form streams by a hash of
the token, each read in the order of a second hash; how many there are follows from the number of tokens
alone and their weights are averaged, so that scores do not depend on how Spark partitions the work.
Counts are summed as doubles, exact up to 2**53.

Classes are the most frequent values of a column of the training texts (none is read when scoring). A text
is scored under all of them, and what it has shown so far weighs them: its probability is the sum over the
classes of prior times likelihood. Inside a text, a match predictor adds the token that followed the last
occurrence of the one or two tokens before; how far it is trusted depends on its last success.

Contexts of bits stay inside a token, so a token's probability under a class depends on the token alone:
the distinct tokens of all texts form one sharded table that is counted, trained on and scored once, and
the blocks of texts fetch the values of their distinct tokens by a join. That table grows with the corpus;
the hashed counts have a fixed size (SLOTS) whatever the corpus, so they can be broadcast.

Defined results: a null or empty text is the end token alone; with no training row every count is zero
and the models are uniform; repeated rows count as often as they occur; a row whose fold is null is learnt
from; further input columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import partitions, settled, small_batches
from annolake.llm.words import segment_sums

#: Bytes of text that one block holds, and texts in one of its rows; bound what one task holds of texts and distinct tokens.
BLOCK_BYTES, ROW_TEXTS = 32_000_000, 256
#: Slots of each predictor's table, as a power of two: depth, last byte by class, two, three by class, four, all so far, depth by class, two by class.
SLOTS = (12, 19, 18, 20, 18, 20, 15, 19)
#: Predictors whose context holds the class, with the slots of one class.
BY_CLASS = {1: 16, 3: 17, 6: 12, 7: 16}
#: Predictors whose context is the slot itself; those of the others are hashed.
DIRECT = (0, 1, 6)
K, GATES, BUCKETS = len(SLOTS), len(SLOTS) + 1, 33
#: The most classes, as many as the class tables have room for; class 0 takes all values that are not among the frequent ones.
CLASSES = 8
#: Distinct training tokens that make up one stream of the online learning, and the most streams: beyond these they grow longer.
STREAM_TOKENS, STREAMS = 50_000, 1024
#: (token, class) pairs handled at once, and the prior count of either bit.
CHUNK, PRIOR = 12_000, 0.05
MIXES = tuple(i / 20 for i in range(20))
END = b""
#: States of the match predictor: no match; a match of one token, or of two, that failed or succeeded last time.
MATCHES = 5


def matches(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of the texts (end to end): the match predictor's state, and whether it names this token.

    A match is the last place in the text after the same two tokens, or else after the same token.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide = ids.astype(np.uint64)
    state, hit = np.zeros(n, np.int8), np.zeros(n, bool)
    for order in (1, 2):
        key = (text + np.roll(wide, 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        if order == 2:
            key ^= np.roll(wide, 2) * np.uint64(0x165667B19E3779F9)
        place = np.flatnonzero(inside >= order)
        by = place[np.argsort(key[place], kind="stable")]
        same = np.zeros(len(by), bool)
        same[1:] = key[by[1:]] == key[by[:-1]]
        at, before = by[same], by[np.flatnonzero(same) - 1]
        there, named = np.zeros(n, bool), np.zeros(n, bool)
        there[at] = True
        named[at] = ids[at] == ids[before]
        state[there] = 2 * order - 1 + np.roll(named, 1)[there]
        hit[there] = named[there]
    return state, hit


def _packed(ids: np.ndarray, state: np.ndarray, hit: np.ndarray) -> bytes:
    """Token numbers and match states as compressed planes of bytes."""
    ids = ids.astype(np.uint32)
    planes = [(ids >> np.uint32(8 * i)).astype(np.uint8) for i in range(4)] + [(state * 2 + hit).astype(np.uint8)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(5, -1)
    ids = sum(planes[i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    return ids, planes[4] >> 1, (planes[4] & 1).astype(bool)


def blocks_of_texts(classes: int):
    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts (their tokens as numbers within the block), of the block's distinct tokens, and of its match counts."""
        task, blocks = TaskContext.get().partitionId(), 0
        fields: list[pa.Field] = []

        def fresh() -> defaultdict:
            found: defaultdict = defaultdict()
            found.default_factory = found.__len__
            found[END]
            return found

        def rows(n: int, **own: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat((task << 24) + blocks, n), *(own[f.name] if f.name in own else pa.nulls(n, f.type) for f in fields)], names=["block", *(f.name for f in fields)])

        def flush() -> Iterator[pa.RecordBatch]:
            lengths, sizes = np.array([len(x[3]) for x in docs]), np.array([x[4] for x in docs])
            flat, held = np.concatenate([x[3] for x in docs]), np.array([bool(x[1]) for x in docs])
            cls = np.array([x[2] for x in docs])
            train = [np.bincount(flat[np.repeat(~held & (cls == c), lengths)], minlength=len(index)) for c in range(classes)]
            state, hit = matches(flat, lengths)
            own = np.repeat(~held, lengths)
            seen, hits = np.bincount(state[own], minlength=MATCHES), np.bincount(state[own & hit], minlength=MATCHES)
            ends = np.append(0, np.cumsum(lengths))
            for i in range(0, len(docs), ROW_TEXTS):
                j = min(i + ROW_TEXTS, len(docs))
                part = slice(ends[i], ends[j])
                ids = pa.concat_arrays([x[0] for x in docs[i:j]])
                yield rows(1, ids=pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids), held=pa.array([held[i:j].tolist()]), lengths=pa.array([lengths[i:j].tolist()], pa.list_(pa.int64())), sizes=pa.array([sizes[i:j].tolist()], pa.list_(pa.int64())), blob=pa.array([_packed(flat[part], state[part], hit[part])]))
            tokens = list(index)
            for i in range(0, len(tokens), 50_000):
                part = tokens[i : i + 50_000]
                yield rows(len(part), token=pa.array(part, pa.binary()), place=pa.array(np.arange(i, i + len(part), dtype=np.int32)), **{f"t{c}": pa.array(train[c][i : i + 50_000], pa.int64()) for c in range(classes)})
            yield rows(1, seen=pa.array([seen.tolist()]), hits=pa.array([hits.tolist()]))

        index, docs, size = fresh(), [], 0
        for batch in batches:
            keys = batch.column("id")
            fields = fields or [
                pa.field("ids", pa.list_(keys.type)), pa.field("held", pa.list_(pa.bool_())), pa.field("lengths", pa.list_(pa.int64())), pa.field("sizes", pa.list_(pa.int64())), pa.field("blob", pa.binary()),
                pa.field("token", pa.binary()), pa.field("place", pa.int32()), *(pa.field(f"t{c}", pa.int64()) for c in range(classes)), pa.field("seen", pa.list_(pa.int64())), pa.field("hits", pa.list_(pa.int64())),
            ]
            for i, (held, cls, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("held_out", "cls", "text")), strict=True)):
                tokens = (text or b"").lower().split()
                tokens.append(END)
                docs.append((keys.slice(i, 1), held, cls, np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)), len(text or b"")))
                size += len(text or b"")
                if size >= BLOCK_BYTES:
                    yield from flush()
                    index, docs, size, blocks = fresh(), [], 0, blocks + 1
        if docs:
            yield from flush()

    return blocks_of


class Bits:
    """The bits of a batch of tokens and the slot of each under each predictor."""

    def __init__(self, tokens: list[bytes], classes: np.ndarray):
        coded = [t + b" " if t else b"\n" for t in tokens]
        lengths = np.array([len(c) for c in coded])
        codes = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
        self.starts = np.cumsum(lengths) - lengths
        depth = np.arange(len(codes)) - np.repeat(self.starts, lengths)
        last = []
        for back in range(1, 5):
            c = np.roll(codes, back)
            c[depth < back] = 0
            last.append(c)
        prefix = np.zeros(len(codes), np.uint32)
        # All bytes so far: step by step over the depth, all tokens at once.
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0, 0]
        for d in range(1, len(bounds) - 1):
            at = order[bounds[d] : bounds[d + 1]]
            prefix[at] = (prefix[at - 1] + codes[at - 1] + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = last[0] | (last[1] << np.uint32(8))
        three = two | (last[2] << np.uint32(16))
        four = three | (last[3] << np.uint32(24))
        depths = np.minimum(depth, 15).astype(np.uint32)
        cls = np.repeat(classes.astype(np.uint32), lengths)
        contexts = (depths, last[0], two, three, four, prefix, depths, two)
        shift = np.arange(8, dtype=np.uint32)
        node = (np.uint32(256) | codes[:, None]) >> (np.uint32(8) - shift)  # 1, then the bits so far
        self.bit = ((codes[:, None] >> (np.uint32(7) - shift)) & np.uint32(1)).ravel().astype(bool)
        self.depth = np.repeat(depths, 8)
        self.slots = []
        for k, c in enumerate(contexts):
            if k in DIRECT:
                s = (c[:, None] << np.uint32(8)) | node
            else:
                h = (c * np.uint32(0x85EBCA6B))[:, None] ^ (node * np.uint32(0xC2B2AE35))
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                s = (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BY_CLASS.get(k, SLOTS[k]))
            if k in BY_CLASS:
                s = s | (cls << np.uint32(BY_CLASS[k]))[:, None]
            self.slots.append(s.ravel())
        self.per_token = lengths * 8
        self.first = np.cumsum(self.per_token) - self.per_token

    def gate(self, seen) -> np.ndarray:
        """The longest context without the class that has been seen; seen gives it for a predictor."""
        gate = np.zeros(len(self.bit), np.int8)
        for k in range(2, K):
            if k not in BY_CLASS:
                gate[seen(k)] = k
        return gate

    def inputs(self, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Stretched prediction of each predictor, its bit's own occurrence left out, then a constant, for each bit; and the gate."""
        x = np.ones((len(self.bit), K + 1), np.float32)
        total: dict[int, np.ndarray] = {}
        ones = self.bit.astype(np.float32)
        for k, slot in enumerate(self.slots):
            zero, one = counts[k][:, 0][slot] - (1 - ones), counts[k][:, 1][slot] - ones
            np.maximum(zero, 0, out=zero)
            np.maximum(one, 0, out=one)
            x[:, k] = np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR)))
            total[k] = zero + one
        return x, self.gate(lambda k: total[k] >= 2)


def _chunks(batches: Iterator[pa.RecordBatch], classes: int, at_once: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Stream (0 where there is no such column), tokens and their training counts by class; at_once tokens of a stream, the last time fewer."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        of = t.column("stream").to_numpy() if "stream" in t.column_names else np.zeros(t.num_rows, np.int64)
        bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        rest = len(of)
        for i, j in itertools.pairwise(bounds):
            for at in range(i, j, at_once):
                end = min(at + at_once, j)
                if end - at < at_once and j == len(of) and not last:
                    rest = at
                    break
                part = t.slice(at, end - at)
                yield int(of[at]), part.column("token").to_pylist(), np.stack([part.column(f"t{c}").to_numpy() for c in range(classes)], axis=1)
        held = t.slice(rest).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= at_once:
            yield from cut(False)
    if sum(b.num_rows for b in held):
        yield from cut(True)


def _pairs(tokens: list[bytes], n: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The (token, class) pairs that occur, and how often."""
    at, cls = np.nonzero(n)
    return [tokens[i] for i in at.tolist()], cls, n[at, cls]


def _count_bits(classes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Zero/one counts of this task's tokens, as pieces of the predictors' tables."""
        counts = [np.zeros((1 << s, 2)) for s in SLOTS]
        for _, tokens, n in _chunks(batches, classes, CHUNK):
            tokens, cls, n = _pairs(tokens, n)
            bits = Bits(tokens, cls)
            w = np.repeat(n, bits.per_token).astype(np.float64)
            for table, slot in zip(counts, bits.slots, strict=True):
                np.add.at(table.reshape(-1), slot.astype(np.int64) * 2 + bits.bit, w)
        for k, table in enumerate(counts):
            for piece, part in enumerate(table.reshape(-1, min(len(table), 8192) * 2)):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "piece": pa.array([piece], pa.int32()), "counts": [part.tobytes()]})

    return count


def _add_pieces(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, np.float64) for p in pieces.column("counts").to_pylist())
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()), "counts": [total.astype(np.float32).tobytes()]})  # rounded once


def _bucket(stretched: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(stretched * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


class Mixer:
    """Gated weights with the curvature gathered so far, and the adaptive refinement table."""

    def __init__(self):
        self.w = np.zeros((GATES, K + 1))
        for g in range(GATES - 1):
            self.w[g, g] = 0.7
        self.h = np.tile(np.eye(K + 1) * 50.0, (GATES, 1, 1))
        self.hits = np.zeros((16, BUCKETS, 2))  # by depth
        self.seen = 0.0

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Stretched mixed prediction."""
        return np.clip(np.einsum("ij,ij->i", x, self.w.astype(np.float32)[gate]), -15, 15)

    def learn(self, x: np.ndarray, gate: np.ndarray, y: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        """One online second-order step for each gate."""
        for g in np.unique(gate):
            at = gate == g
            xs, r, c = x[at], (y[at] - p[at]) * n[at], n[at] * np.maximum(p[at] * (1 - p[at]), 1e-4)
            self.h[g] += (xs * c[:, None]).T @ xs
            step = np.linalg.solve(self.h[g], (xs.T @ r).astype(np.float64))
            self.w[g] += np.clip(step, -0.5, 0.5)

    def refinement(self) -> tuple[np.ndarray, np.ndarray]:
        """a and b by depth and bucket: the refined probability is a + b * p."""
        total = self.hits.sum(axis=2)
        return (0.5 * self.hits[:, :, 1] / (total + 8)).astype(np.float32), (0.5 + 4 / (total + 8)).astype(np.float32)

    def remember(self, stretched: np.ndarray, depth: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.hits, (depth, _bucket(stretched), y.astype(np.int64)), n)


def refined_log(stretched: np.ndarray, depth: np.ndarray, bit: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural log of the refined probability of the bits that came."""
    a, b = table
    at = depth.astype(np.int64) * BUCKETS + _bucket(stretched)
    p = a.ravel()[at] + b.ravel()[at] / (1 + np.exp(-stretched))
    p = np.clip(p, np.float32(1e-7), np.float32(1 - 1e-7))  # so that both values of a bit add up to 1
    return np.log(np.where(bit, p, 1 - p))


def _train(shared, by_class: list[int]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each stream; the rows of a stream follow one another."""
        counts, total = shared.value, np.maximum(np.array(by_class) - 1, 1)
        for stream, chunks in itertools.groupby(_chunks(batches, len(by_class), CHUNK), key=lambda x: x[0]):
            mixer, shares = Mixer(), np.zeros(len(MIXES))
            for _, tokens, n in chunks:
                tokens, cls, n = _pairs(tokens, n)
                bits = Bits(tokens, cls)
                x, gate = bits.inputs(counts)
                # A frequent token teaches by the order of its frequency, so that it does not rule a step.
                w = np.repeat(1 + np.log(n), bits.per_token).astype(np.float32)
                s = mixer.mixed(x, gate)
                if mixer.seen:  # predicted before it is learnt from
                    p = np.exp(np.add.reduceat(refined_log(s, bits.depth, bits.bit, mixer.refinement()), bits.first))
                    share = (n - 1) / total[cls]
                    shares += [(n * np.log(np.maximum(m * share + (1 - m) * p, 1e-300))).sum() for m in MIXES]
                mixer.learn(x, gate, bits.bit, w, 1 / (1 + np.exp(-s)))
                mixer.remember(mixer.mixed(x, gate), bits.depth, bits.bit, w)
                mixer.seen += float(n.sum())
            yield pa.RecordBatch.from_pydict({"stream": [stream], "seen": [mixer.seen], "w": [mixer.w.ravel()], "hits": [mixer.hits.ravel()], "shares": [shares]})

    return train


def _score(shared, by_class: list[int]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sure, mixer, mix = shared.value
        classes = len(by_class)
        total, refinement, weights = np.maximum(np.array(by_class), 1), mixer.refinement(), mixer.w.astype(np.float32)
        for tokens, n, places in _chunks_with_places(batches, classes, CHUNK // 2):
            bits = Bits(tokens, np.zeros(len(tokens), np.int64))
            gate = bits.gate(lambda k, bits=bits: sure[k][bits.slots[k]])
            # What the classes share is mixed once.
            common = weights[:, K][gate]
            for k in range(K):
                if k not in BY_CLASS:
                    common += weights[:, k][gate] * tables[k][bits.slots[k]]
            logp = np.empty((len(tokens), classes))
            for c in range(classes):
                s = common.copy()
                for k, size in BY_CLASS.items():
                    s += weights[:, k][gate] * tables[k][bits.slots[k] | np.uint32(c << size)]
                logp[:, c] = np.add.reduceat(refined_log(np.clip(s, -15, 15), bits.depth, bits.bit, refinement), bits.first)
            both = np.log(np.maximum(mix * n / total + (1 - mix) * np.exp(logp), 1e-300))
            # Below the range of doubles the mixed bits alone count.
            both = np.where(logp < -600, np.maximum(both, logp + np.log(1 - mix)), both).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"c": pa.array(n.sum(axis=1)), "lp": pa.array([r.tobytes() for r in both], pa.binary()), "places": places})

    return score


def _chunks_with_places(batches: Iterator[pa.RecordBatch], classes: int, at_once: int) -> Iterator[tuple[list[bytes], np.ndarray, pa.Array]]:
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[list[bytes], np.ndarray, pa.Array]:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.column("token").to_pylist(), np.stack([t.column(f"t{c}").to_numpy() for c in range(classes)], axis=1), t.column("places").combine_chunks()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= at_once:
            yield whole()
            held = []
    if held:
        yield whole()


def _sum_docs(n_all: int, v: int, prior: np.ndarray, trust: np.ndarray):
    def sums(docs: pa.Table, tokens: pa.Table) -> pa.Table:
        place = tokens.column("place").to_numpy()
        c, lp = np.zeros(len(place)), np.zeros((len(place), len(prior)), np.float32)
        c[place], lp[place] = tokens.column("c").to_numpy(), np.frombuffer(b"".join(tokens.column("lp").to_pylist()), np.float32).reshape(-1, len(prior))
        base = np.log10((c + 1) / (n_all + v + 1))
        out: list[pa.Table] = []
        miss, sure = np.log1p(-trust), np.log(np.maximum(trust, 1e-12))
        for r in range(docs.num_rows):
            ids, state, hit = _unpacked(docs.column("blob")[r].as_py())
            lengths = np.array(docs.column("lengths")[r].as_py())
            total = np.empty((len(lengths), len(prior)))
            for i in range(len(prior)):
                own = lp[:, i][ids] + miss[state]
                own[hit] = np.logaddexp(sure[state[hit]], own[hit])
                total[:, i] = segment_sums(own, lengths)
            total += np.log(prior)
            top = total.max(axis=1)
            score = (top + np.log(np.exp(total - top[:, None]).sum(axis=1))) / np.log(10)
            known = segment_sums((c > 0)[ids].astype(np.float64), lengths)
            out.append(pa.table({"id": docs.column("ids")[r].values, "held_out": docs.column("held")[r].values, "n_tokens": pa.array(lengths, pa.int64()), "n_known": known.astype(np.int64), "base_score": segment_sums(base[ids], lengths), "score": score, "bits_per_byte": -score / np.log10(2) / (np.array(docs.column("sizes")[r].as_py()) + 1)}))
        return pa.concat_tables(out)

    return sums


def lm_scores(df: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", class_col: str | None = "lang") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (log10 probability), bits_per_byte (over the text's bytes and its end)."""
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    cls = F.lit(0)
    if class_col:
        common = df.where(learn & F.col(class_col).isNotNull()).groupBy(F.col(class_col).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(CLASSES - 1).collect()
        for i, r in enumerate(common, 1):
            cls = F.when(F.col(class_col).cast("string").eqNullSafe(r.v), i).otherwise(cls)
    classes = len(common) + 1 if class_col else 1
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(~learn, F.lit(False)).alias("held_out"), cls.alias("cls"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    ts = [f"t{c}" for c in range(classes)]
    schema = f"block long, ids array<{id_type}>, held array<boolean>, lengths array<long>, sizes array<long>, blob binary, token binary, place int, {', '.join(f'{t} long' for t in ts)}, seen array<long>, hits array<long>"
    blocks = settled(rows.mapInArrow(blocks_of_texts(classes), schema), "lm-blocks")
    own = blocks.where("place IS NOT NULL")
    # A token's list has as many entries as there are blocks: 12 bytes for each 32 MB of text, 40 MB at 100 TB.
    tokens = settled(own.groupBy("token").agg(*(F.sum(t).alias(t) for t in ts), F.collect_list(F.struct("block", "place")).alias("places")), "lm-tokens")
    any_train = " + ".join(ts)
    *by_class, v = tokens.agg(*(F.coalesce(F.sum(t), F.lit(0)) for t in ts), F.expr(f"count_if({any_train} > 0)")).first()
    n_all = sum(by_class)
    prior = (np.array(by_class) + 0.5) / (n_all + 0.5 * classes)
    found = blocks.where("seen IS NOT NULL").agg(*(F.coalesce(F.sum(F.col(c)[i]), F.lit(0)).alias(f"{c}{i}") for c in ("hits", "seen") for i in range(MATCHES))).first()
    trust = np.array([(found[i] + 0.05) / (found[MATCHES + i] + 1.0) if i else 0.0 for i in range(MATCHES)]) * 0.98
    trained = tokens.where(f"{any_train} > 0").select("token", *ts)
    pieces = trained.repartition(max(4, partitions(spark) // 8)).mapInArrow(_count_bits(classes), "k int, piece int, counts binary").groupBy("k", "piece").applyInArrow(_add_pieces, "k int, piece int, counts binary")
    counts = [np.zeros((1 << s, 2), np.float32) for s in SLOTS]
    for r in pieces.toLocalIterator():
        part = np.frombuffer(bytes(r.counts), np.float32).reshape(-1, 2)
        counts[r.k][r.piece * len(part) : (r.piece + 1) * len(part)] = part
    mixer, mix = Mixer(), 0.0
    shared = spark.sparkContext.broadcast(counts)
    streams = min(max(v // STREAM_TOKENS, 1), STREAMS)
    ordered = trained.select(F.pmod(F.xxhash64("token"), F.lit(streams)).alias("stream"), F.hash("token").alias("h"), "token", *ts).repartition(streams, "stream").sortWithinPartitions("stream", "h", "token")
    learnt = ordered.mapInArrow(_train(shared, by_class), "stream long, seen double, w array<double>, hits array<double>, shares array<double>").collect()
    learnt.sort(key=lambda r: r.stream)
    if learnt:
        seen = np.array([r.seen for r in learnt])
        mixer.w = (np.array([r.w for r in learnt]) * seen[:, None]).sum(axis=0).reshape(mixer.w.shape) / seen.sum()
        mixer.hits = np.array([r.hits for r in learnt]).sum(axis=0).reshape(mixer.hits.shape)
        mix = MIXES[int(np.array([r.shares for r in learnt]).sum(axis=0).argmax())]
    tables = [np.log((t[:, 1] + np.float32(PRIOR)) / (t[:, 0] + np.float32(PRIOR))) for t in counts]
    sure = [t.sum(axis=1) >= 2 for t in counts]
    del counts
    scored = tokens.mapInArrow(_score(spark.sparkContext.broadcast((tables, sure, mixer, mix)), by_class), "c long, lp binary, places array<struct<block:long,place:int>>")
    values = scored.select(F.explode("places").alias("at"), "c", "lp").select(F.col("at.block").alias("of_block"), "at.place", "c", "lp")
    docs = blocks.where("ids IS NOT NULL").select("block", "ids", "held", "lengths", "sizes", "blob")
    out = docs.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(_sum_docs(n_all, v, prior, trust), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
