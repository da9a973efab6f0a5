"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is marked (a space before it, every space its own mark) and cut into marked words, across which no
piece reaches. The distinct words that a task has not met yet are sorted, which lays them out as a trie in
depth-first order: a word keeps the forward states of the prefix it shares with the word before and
computes only the rest. A forward state is the best score of a prefix and the piece it ends with.

For a unigram model the score is the sum of the pieces' scores. A BPE model's encoding of a prefix ends
with the one piece whose left neighbour would not have merged with it, so a step scores 0 where merging
the two pieces' characters gives just these two pieces, and is ruled out otherwise; that gives exactly the
encoding by merges (so the search for a best score is reduced to the search for an admissible path, exactly).
Characters outside the vocabulary become byte pieces.

The round trip is judged once for each distinct word: a text's pieces are its words' pieces end to end, so the
text comes back exactly if all its words do.

Defined results: a null text has null pieces; an empty one has none; a text that holds the mark itself
(U+2581) decodes to spaces there, as the model's format has it, so its round trip is false; unigram paths of
equal score: the one whose last piece is longer; ids may be null or repeat, each row is encoded for itself; an
empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.common import small_batches
from annolake.llm.words import segment_sums

MARK = "▁"
#: Characters by which the lengths of pieces are looked up.
TAIL = 3
#: Marked words a task remembers before it starts anew, and their pieces; bounds its memory.
REMEMBERED, REMEMBERED_PIECES = 400_000, 4_000_000
_WORDS = re.compile(r" *[^ \n]+| +|\n").findall


def load_model(path: str) -> dict:
    """Pieces, scores and special ids of a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
    return {
        "pieces": [m.id_to_piece(i) for i in range(n)],
        "scores": [m.get_score(i) for i in range(n)],
        "plain": plain,
        "bytes": {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)},
        "unknown": m.unk_id(),
    }


class Encoder:
    """Forward states of sorted words over one model. kind: "bpe" or "unigram"."""

    def __init__(self, model: dict, kind: str = "bpe"):
        self.kind, self.scores = kind, model["scores"]
        self.ids = {p.replace(MARK, " "): i for i, (p, ok) in enumerate(zip(model["pieces"], model["plain"], strict=True)) if ok}
        self.text = {i: p for p, i in self.ids.items()}
        # Lengths of the longer pieces by their last characters; of all pieces that may end with such, filled as they are met.
        self.longer: dict[str, set[int]] = defaultdict(set)
        for p in self.ids:
            if len(p) > TAIL:
                self.longer[p[-TAIL:]].add(len(p))
        self.lengths: dict[str, tuple[int, ...]] = {}
        self.byte, self.unknown = model["bytes"], model["unknown"]
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.out = [b""] * len(model["pieces"])
        for i, p in self.text.items():
            self.out[i] = p.encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        if self.unknown >= 0:
            self.out[self.unknown] = " ⁇ ".encode()

    def _lengths(self, tail: str) -> tuple[int, ...]:
        """Lengths of the pieces that end with the tail (of TAIL characters) or are an end of it, longest first."""
        if len(self.lengths) > REMEMBERED:
            self.lengths.clear()
        found = {n for n in range(1, len(tail) + 1) if tail[-n:] in self.ids} | self.longer.get(tail, set())
        return self.lengths.setdefault(tail, tuple(sorted(found, reverse=True)))

    def merged(self, text: str) -> list[str]:
        """The text's characters after all merges, best score first, leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _step(self, left: int, right: int) -> bool:
        """Whether piece right may follow piece left (-1: nothing, or a character outside the vocabulary)."""
        ok = self.whole.get(right)
        if ok is None:
            ok = self.whole[right] = self.merged(self.text[right]) == [self.text[right]]
        if left >= 0 and ok:
            a, b = self.text[left], self.text[right]
            ok = self.merged(a + b) == [a, b]
        self.fits[(left + 1) << 20 | right] = ok
        return ok

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words end to end, in the order given, and how many each has."""
        found: list[list[int]] = [[]] * len(words)
        forward = self._forward_bpe if self.kind == "bpe" else self._forward_unigram
        last, scores, ends, begins = "", [0.0], [-1], [0]  # of each prefix: score, piece it ends with (-1: none, -2: no way there), where that begins
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del scores[shared + 1 :], ends[shared + 1 :], begins[shared + 1 :]
            forward(word, shared, scores, ends, begins)
            last = word
            pieces, end = [], len(word)
            while end:
                piece, begin = ends[end], begins[end]
                if piece >= 0:
                    pieces.append(piece)
                else:
                    pieces += [self.byte.get(b, self.unknown) for b in reversed(word[begin:end].encode())]
                end = begin
            pieces.reverse()
            found[at] = pieces
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((p for f in found for p in f), np.int32, int(lengths.sum())), lengths

    def _forward_bpe(self, word: str, shared: int, scores: list[float], ends: list[int], begins: list[int]) -> None:
        """States of the prefixes longer than shared. All admissible paths score 0, so the first one found is a best one."""
        ids, lengths, fits = self.ids.get, self.lengths.get, self.fits.get
        for end in range(shared + 1, len(word) + 1):
            state, start = -2, end - 1
            tail = word[end - TAIL : end] if end > TAIL else word[:end]
            for length in lengths(tail) or self._lengths(tail):
                begin = end - length
                if begin < 0:
                    continue
                piece = ids(word[begin:end])
                if piece is None:
                    continue
                before = ends[begin]
                if before == -2:
                    continue
                ok = fits((before + 1) << 20 | piece)
                if self._step(before, piece) if ok is None else ok:
                    state, start = piece, begin
                    break
            if state == -2 and word[end - 1] not in self.ids:
                state = -1  # a character of its own, outside the vocabulary
            ends.append(state)
            begins.append(start)

    def _forward_unigram(self, word: str, shared: int, scores: list[float], ends: list[int], begins: list[int]) -> None:
        """States of the prefixes longer than shared: the best sum of scores."""
        for end in range(shared + 1, len(word) + 1):
            best, state, start = float("-inf"), -1, end - 1
            tail = word[end - TAIL : end] if end > TAIL else word[:end]
            for length in self.lengths.get(tail) or self._lengths(tail):
                begin = end - length
                piece = self.ids.get(word[begin:end]) if begin >= 0 else None
                if piece is not None and scores[begin] + self.scores[piece] > best:
                    best, state, start = scores[begin] + self.scores[piece], piece, begin
            scores.append(best if state >= 0 else scores[end - 1] - 100.0)
            ends.append(state)
            begins.append(start)

    def sound(self, words: list[str], pieces: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether decoding each word's pieces gives the word."""
        parts = [self.out[p] for p in pieces.tolist()]
        ends = np.cumsum(counts).tolist()
        return np.fromiter((b"".join(parts[e - n : e]) == w.encode() for w, e, n in zip(words, ends, counts.tolist(), strict=True)), bool, len(words))

    def decode(self, pieces: list[int]) -> bytes:
        """The text of the pieces, without the mark before it."""
        return b"".join(map(self.out.__getitem__, pieces))[1:]


@lru_cache(maxsize=1)
def _encoder(model: tuple[str, str], shared) -> Encoder:
    """The worker's encoder, kept from task to task with the steps it has judged."""
    return Encoder(shared.value, model[1])


def _encoding(shared, model_path: str, kind: str, check: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder((model_path, kind), shared)
        index: defaultdict[str, int] = defaultdict()
        pieces, starts, counts, sound = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        used = 0
        for batch in batches:
            if not index or len(index) > REMEMBERED or used > REMEMBERED_PIECES:
                index = defaultdict()
                index.default_factory = index.__len__
                starts, counts, sound, used = starts[:0], counts[:0], sound[:0], 0
            texts, known, rows, marked = batch.column("text").to_pylist(), len(index), [], []
            for t in texts:
                marked.append(t is not None and MARK in t)
                words = _WORDS(" " + (t.replace(MARK, " ") if marked[-1] else t)) if t else []
                rows.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            if len(index) > known:
                fresh = list(islice(index, known, None))
                new, n = encoder.words(fresh)
                while used + len(new) > len(pieces):
                    pieces = np.append(pieces, np.zeros_like(pieces))
                pieces[used : used + len(new)] = new
                starts, counts = np.append(starts, used + np.cumsum(n) - n), np.append(counts, n)
                used += len(new)
                if check:
                    sound = np.append(sound, encoder.sound(fresh, new, n))
            flat, lengths = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows], np.int64)
            n = counts[flat]
            out = pieces[np.repeat(starts[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            sizes = segment_sums(n, lengths).astype(np.int64)
            null = np.array([t is None for t in texts])
            column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(out), mask=pa.array(null))
            own = []
            if check:  # a text comes back if all its words do and it holds no mark of its own
                own = [pa.array((segment_sums(~sound[flat], lengths) == 0) & ~np.array(marked), mask=null)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(sizes, mask=null), *own], names=["id", "pieces", "n_pieces", *(["round_trip"] if check else [])])

    return encode


def encode_pieces(df: DataFrame, model_path: str, kind: str = "bpe", text_col: str = "text", id_col: str = "doc_id", check: bool = True) -> DataFrame:
    """id_col, pieces, n_pieces and, with check, round_trip (whether decoding the pieces gives the text)."""
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_model(model_path))  # as large as the model file
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {df.schema[id_col].dataType.simpleString()}, pieces array<int>, n_pieces long" + ", round_trip boolean" * check
    return rows.mapInArrow(_encoding(shared, model_path, kind, check), schema).withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, model_path: str, pieces_col: str = "pieces", id_col: str = "doc_id") -> DataFrame:
    """id_col, text: the texts that the pieces stand for."""
    shared = df.sparkSession.sparkContext.broadcast(load_model(model_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if p is None else encoder.decode(p).decode("utf-8", "replace") for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(decode, f"id {df.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
