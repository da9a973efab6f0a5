"""Distinct tokens of a batch: scores that depend on a token alone are computed once for each distinct token."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from itertools import islice

import numpy as np

#: Distinct tokens a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000


class TokenRows:
    """Rows of values, one for each distinct token seen, computed in bulk for the new tokens of a batch."""

    def __init__(self, compute: Callable[[list], np.ndarray], remembered: int = REMEMBERED):
        self.compute, self.remembered = compute, remembered
        self._reset()

    def _reset(self) -> None:
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.rows: np.ndarray | None = None

    def encode(self, docs: Iterable[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all documents' tokens, end to end, and the number of tokens of each document."""
        if len(self.index) > self.remembered:
            self._reset()
        known, get = len(self.index), self.index.__getitem__
        parts = [np.fromiter(map(get, tokens), np.int64, len(tokens)) for tokens in docs]
        if len(self.index) > known:
            new = self.compute(list(islice(self.index, known, None)))
            if self.rows is None:
                self.rows, self.used = np.zeros((max(2 * len(new), 1024), *new.shape[1:]), new.dtype), 0
            if self.used + len(new) > len(self.rows):
                grown = np.zeros((2 * (self.used + len(new)), *new.shape[1:]), new.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(new)] = new
            self.used += len(new)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array([len(p) for p in parts], np.int64)

    def sums(self, docs: Iterable[Sequence], width: int) -> np.ndarray:
        """For each document the sum of its tokens' rows."""
        ids, n = self.encode(docs)
        return segment_sums(self.rows[ids], n) if len(ids) else np.zeros((len(n), width))


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; an empty segment gives zero."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64)
    full = lengths > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out
