"""Which of millions of strings stand in texts, by windows of eight bytes over many texts at once.

Texts lie in one buffer. The eight bytes at each place are looked up in a table of the terms' first
eight, then the eight before each length's end in a table of both ends; places that are left are
looked up by all of a term's bytes, and compared. Work follows the bytes of text, not the number of
terms. An automaton takes terms that are shorter than a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reportmill.operators.automaton import places

WINDOW = 8
#: Places that are looked up at once, and bytes of text that make a buffer, about.
STEP, BUFFER = 1 << 17, 1 << 22
#: Tables have two to the power of this many slots, at most.
MOST_BITS = 24
#: Stands between texts; no UTF-8 has it.
BETWEEN = b"\xff"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, without a copy."""
    return np.ndarray((max(0, len(data) - WINDOW + 1),), np.uint64, data, strides=(1,))


def _offsets(size: int) -> list[int]:
    """Windows that cover ``size`` bytes."""
    return [*range(0, size - WINDOW, WINDOW), size - WINDOW]


def _signature(windows: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A number made of all ``size`` bytes from each place on."""
    found = np.full(len(at), size + (seed << 32), np.uint64)
    for offset in _offsets(size):
        found = (found ^ windows[at + offset]) * _ODD[1]
        found ^= found >> np.uint64(29)
    return found


class TermSearch:
    """Distinct strings, none null, to be found in texts."""

    def __init__(self, terms: pa.Array):
        sizes = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self._terms = len(terms)
        self._short, self._long = np.flatnonzero(sizes < WINDOW), np.flatnonzero(sizes >= WINDOW)
        self._shorter = places(terms.take(pa.array(self._short)).to_pylist()) if len(self._short) else None
        sizes = sizes[self._long]
        self._data = np.frombuffer(b"".join(terms.take(pa.array(self._long)).cast(pa.large_binary()).to_pylist()), np.uint8)
        self._starts = np.cumsum(sizes) - sizes
        windows = _windows(self._data)
        heads, tails = windows[self._starts], windows[self._starts + sizes - WINDOW]
        bits = min(MOST_BITS, max(10, len(sizes).bit_length() + 4))
        self._shift = np.uint64(64 - bits)
        self._sizes = np.unique(sizes)
        slots = self._slots(heads)
        self._heads, self._ends = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        self._heads[slots] = True
        self._ends[self._end_slots(heads, tails, sizes.astype(np.uint64))] = True
        # which lengths the terms of some neighbouring slots have, in 64 kinds
        self._kinds = np.zeros(1 << (bits - 3), np.uint64)
        np.bitwise_or.at(self._kinds, slots >> np.uint64(3), np.uint64(1) << (np.searchsorted(self._sizes, sizes) % 64).astype(np.uint64))
        self._seed = 0
        while True:  # until all signatures differ, which the first ones nearly always do
            signatures = np.empty(len(sizes), np.uint64)
            for size in self._sizes.tolist():
                alike = sizes == size
                signatures[alike] = _signature(windows, self._starts[alike], size, self._seed)
            self._order = np.argsort(signatures)
            self._signatures = signatures[self._order]
            if not (self._signatures[1:] == self._signatures[:-1]).any():
                break
            self._seed += 1

    def _slots(self, heads: np.ndarray) -> np.ndarray:
        return (heads * _ODD[0]) >> self._shift

    def _end_slots(self, heads: np.ndarray, tails: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        return ((heads ^ (tails * _ODD[1]) ^ (size * _ODD[2:])) * _ODD[0]) >> self._shift

    def _places(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, terms) of long terms in a buffer."""
        windows, own = _windows(data), _windows(self._data)
        for start in range(0, len(windows), STEP):
            slots = self._slots(windows[start : start + STEP])
            at = np.flatnonzero(self._heads[slots])
            kinds = self._kinds[slots[at] >> np.uint64(3)]
            at += start
            for k in np.flatnonzero([np.bitwise_or.reduce(kinds) >> np.uint64(i) & np.uint64(1) for i in range(64)]).tolist():
                some = at[(kinds >> np.uint64(k)) & np.uint64(1) > 0]
                for size in self._sizes[k::64].tolist():
                    here = some[some <= len(data) - size]
                    here = here[self._ends[self._end_slots(windows[here], windows[here + size - WINDOW], np.uint64(size))]]
                    if not len(here):
                        continue
                    signatures = _signature(windows, here, size, self._seed)
                    nth = np.minimum(np.searchsorted(self._signatures, signatures), len(self._order) - 1)
                    term = self._order[nth]
                    fits = self._signatures[nth] == signatures
                    here, term = here[fits], term[fits]
                    # another length's signature may be equal, whose bytes then differ from the separators on at the latest
                    fits = np.ones(len(here), bool)
                    for offset in _offsets(size):
                        fits &= windows[here + offset] == own[np.minimum(self._starts[term] + offset, len(own) - 1)]
                    yield here[fits], self._long[term[fits]]

    def rows(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of texts, places of the terms in them), each pair once."""
        pairs = [np.zeros(0, np.int64)]
        if len(self._long):
            coded = [t.encode() for t in texts]
            starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
            data = np.frombuffer(BETWEEN.join([*coded, b""]), np.uint8)
            for at, term in self._places(data):
                pairs.append((np.searchsorted(starts, at, "right") - 1) * self._terms + term)
        if self._shorter is not None:
            for i, text in enumerate(texts):
                if hits := self._shorter(text):
                    pairs.append(i * self._terms + self._short[hits])
        return np.divmod(np.unique(np.concatenate(pairs)), self._terms) if self._terms else (pairs[0], pairs[0])


def buffers(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of texts of :data:`BUFFER` bytes, about."""
    nth = (np.cumsum(sizes) - sizes) // BUFFER
    edges = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)
