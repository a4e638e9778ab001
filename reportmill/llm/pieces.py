"""Encode every distinct piece of text once a worker, then look ids up in bulk.

Tokenisers never merge across white space, so a text's ids are those of its
space-delimited pieces laid end to end. Natural text repeats its words, which makes the
look-up far cheaper than encoding each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker remembers before it starts afresh (bounds its memory).
MAX_PIECES = 250_000
#: Bytes of text handled at once inside a worker.
SLICE_BYTES = 2 << 20


class PieceTable:
    """Ids of distinct pieces. ``encode(pieces)`` gives an id sequence for each piece.

    A worker keeps the pieces of one table at a time: using another one empties it.
    """

    _in_use: "PieceTable | None" = None

    def __init__(self, encode: Callable[[Sequence[str]], list[Sequence[int]]], limit: int = MAX_PIECES):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._code: dict[str, int] = {}
        self.lens = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self._n = self._m = self._chars = 0

    def _release(self) -> None:
        """Free what is remembered, as another table is used."""
        self._clear()

    def codes(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers here of the distinct pieces, and which of these each piece is.

        They hold until the next call.
        """
        if PieceTable._in_use is not self:
            if PieceTable._in_use is not None:
                PieceTable._in_use._release()
            PieceTable._in_use = self
        if self._n > self._limit or self._chars > 64 * self._limit:
            self._clear()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        rows = np.fromiter(map(self._code.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(rows < 0)):
            new, first = [distinct[i] for i in missing.tolist()], self._n
            self._add(new, self._encode(new))
            rows[missing] = np.arange(first, self._n)
        return rows, coded.indices.to_numpy(zero_copy_only=False)

    def _add(self, new: list[str], ids: list[Sequence[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
        n, m = self._n + len(new), self._m + len(flat)
        if n > len(self.lens):
            size = max(n, 2 * len(self.lens))
            self.lens, self.starts = np.resize(self.lens, size), np.resize(self.starts, size)
        if m > len(self.flat):
            self.flat = np.resize(self.flat, max(m, 2 * len(self.flat)))
        self.lens[self._n : n] = lens
        self.starts[self._n : n] = self._m + np.cumsum(lens) - lens
        self.flat[self._m : m] = flat
        self._code.update(zip(new, range(self._n, n), strict=True))
        self._n, self._m = n, m
        self._chars += sum(map(len, new))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the coded pieces, laid end to end."""
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        if not len(ends):
            return np.zeros(0, np.uint32)
        at = np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(ends[-1])
        return self.flat[at]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values, empty groups included."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def balanced(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about ``most`` bytes each (a longer text is a slice of its own)."""
    if not len(texts):
        return
    lens = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    where = (np.cumsum(lens) - lens) // most
    cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(lens)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a)


def non_empty(split: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All pieces of a split but the empty ones, and how many each text has."""
    values = split.flatten()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.greater(pc.binary_length(values), 0)
    if pc.all(there).as_py() is False:
        counts = sums(there.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        values = values.filter(there)
    return values, counts
