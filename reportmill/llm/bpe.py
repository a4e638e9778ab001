"""Word-end BPE: speculate with longest matches, verify neighbours, merge what fails.

A proposal for a word is its greedy longest-match segmentation. A segmentation equals the
merge procedure's result when every token and every adjacent pair of tokens comes out of
the merges unchanged. Pair verdicts are looked up for all pairs of a batch at once, and
only words with a failing pair go through the exact merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_SPACE, bound_batches, text_or_empty
from .pieces import PieceTable, balanced, non_empty

_WIDE = 20  # bits that hold an id
_NONE = (1 << 60, -1)  # no merge
#: Characters of a word beyond which only the surroundings of failing pairs are merged.
LONG = 4096
_JOINT = 1 << 27  # bytes of text up to which decoded texts fit one Arrow array
#: Distinct words and pieces a worker remembers before it starts afresh.
MAX_WORDS, MAX_PIECES = 400_000, 500_000
_SLICE = 4 << 20  # bytes of text whose distinct pieces are looked up at once


def byte_chars() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes, as byte-level vocabularies write them."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordBpe:
    """Encoder over the vocabulary and merges of a tokenizer file with word-end tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        self._normal = Tokenizer.from_file(path).normalizer.normalize_str
        self._bytes = byte_chars()
        vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = specials
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
        self._inner = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self._last = {t[: -len(end)]: i for t, i in vocab.items() if t.endswith(end) and len(t) > len(end)}
        self._reach: dict[str, int] = {}  # the longest inner token by its first two characters
        for t in self._inner:
            self._reach[t[:2]] = max(len(t), self._reach.get(t[:2], 1))
        self._merge = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self._merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self._longest = max(map(len, self._last))
        self._symbols: dict[int, tuple[int, ...]] = {}
        for t, i in self._inner.items():
            self._symbols[i] = tuple(self._inner[c] for c in t)
        for t, i in self._last.items():
            self._symbols[i] = (*(self._inner[c] for c in t[:-1]), self._last[t[-1]])
        self._pair_ok: dict[int, bool] = {}
        self._whole = {i for i, s in self._symbols.items() if self.merged(s) == [i]}
        self._inner = {t: i for t, i in self._inner.items() if i in self._whole}
        self._last = {t: i for t, i in self._last.items() if i in self._whole}
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words; special strings stay, which no word equals."""
        self._known = {s: (i,) for s, i in self.special.items()}
        self._chars = 0

    def merged(self, symbols: Sequence[int]) -> list[int]:
        """The exact result of the merges: always the lowest rank, leftmost first."""
        if len(symbols) > 64:
            return self._merged_long(symbols)
        ids, get = list(symbols), self._merge.get
        found = [get(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is _NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], best[1]), _NONE)
            if i < len(found):
                found[i] = get((best[1], ids[i + 1]), _NONE)
        return ids

    def _merged_long(self, symbols: Sequence[int]) -> list[int]:
        """The same by a queue of candidate merges, in n log n steps."""
        n = len(symbols)
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        get = self._merge.get
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := get((new, ids[after[i]])):
                    heapq.heappush(queue, (m[0], i, new, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], new))):
                heapq.heappush(queue, (m[0], before[i], ids[before[i]], new, m[1]))
        return [i for i in ids if i >= 0]

    def _propose(self, word: str) -> list[int]:
        inner, last, reach, n, i, out = self._inner.get, self._last.get, self._reach.get, len(word), 0, []
        longest = self._longest
        while n - i > longest or (t := last(word[i:])) is None:
            for j in range(min(n - 1, i + reach(word[i : i + 2], 1)), i, -1):
                if (t := inner(word[i:j])) is not None:
                    break
            out.append(t)
            i = j
        out.append(t)
        return out

    def _exact(self, word: str, proposed: list[int]) -> list[int]:
        if len(word) > LONG:
            return self._repaired(proposed)
        return self.merged([*(self._inner[c] for c in word[:-1]), self._last[word[-1]]])

    def _repaired(self, proposed: list[int]) -> list[int]:
        """The same for a long word: merges only around pairs that fail, until all pairs hold.

        A token that doesn't go with the one before is merged with it anew, and with those before
        as far as they don't go with the result.
        """
        out: list[int] = []
        for token in proposed:
            here = [token]
            while out and not self._compatible(out[-1] << _WIDE | here[0]):
                taken = [out.pop() for _ in range(min(len(out), len(here)))][::-1]
                here = self.merged([s for i in (*taken, *here) for s in self._symbols[i]])
            out += here
        return out

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of each pre-tokenised word (written in byte stand-ins)."""
        found = [self._propose(w) for w in words]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int64, int(lens.sum()))
        word = np.repeat(np.arange(len(found)), lens)
        inside = word[1:] == word[:-1]
        pairs = (flat[:-1] << _WIDE | flat[1:])[inside]
        distinct, at = np.unique(pairs, return_inverse=True)
        ok = np.fromiter(map(self._compatible, distinct.tolist()), bool, len(distinct))
        for w in np.unique(word[1:][inside][~ok[at]]).tolist():
            found[w] = self._exact(words[w], found[w])
        return found

    def _compatible(self, pair: int) -> bool:
        known = self._pair_ok.get(pair)
        if known is None:
            a, b = pair >> _WIDE, pair & (1 << _WIDE) - 1
            if len(self._pair_ok) > 1_000_000:
                self._pair_ok.clear()
            known = self._pair_ok[pair] = self.merged(self._symbols[a] + self._symbols[b]) == [a, b]
        return known

    def _words_of(self, part: str) -> Sequence[str]:
        """Normalised words; up to Latin-1 that is lower case only, as all is composed there."""
        normal = part.lower() if part.isascii() or max(part) <= "\xff" else self._normal(part)
        return (normal,) if normal.isalpha() else self._words(normal)

    def _parts_of(self, piece: str) -> Sequence[str]:
        if "<|" not in piece:
            return self._words_of(piece)
        return [w for part in self._special.split(piece) for w in ((part,) if part in self.special else self._words_of(part))]

    def _stand_in(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._bytes)

    def encode_pieces(self, pieces: Sequence[str]) -> list[Sequence[int]]:
        """Ids of each piece of text without white space; special strings are their own ids.

        A word is encoded once, whatever pieces it comes in, until there are too many.
        """
        known = self._known
        rows = list(map(self._parts_of, pieces))
        new = list(dict.fromkeys(w for row in rows for w in row if w not in known))
        known.update(zip(new, map(tuple, self.encode_words(list(map(self._stand_in, new)))), strict=True))
        self._chars += sum(map(len, new))
        if len(known) > MAX_WORDS or self._chars > 64 * MAX_WORDS:
            self.forget()
        return [known[row[0]] if len(row) == 1 else [i for w in row for i in known[w]] for row in rows]

    def decode(self, ids: Sequence[int]) -> str:
        """As the file decodes, having no decoder: the tokens joined by single blanks."""
        return " ".join(map(self.token.__getitem__, ids))


#: What separates pieces: white space as Unicode has it. Python's own split() also takes
#: the four separators from 1C to 1F, so texts with those are split by this instead.
_SPACES = regex.compile(rf"[\x09-\x0d\x20\x85\xa0{WIDE_SPACE}]+")


def split_pieces(texts: pa.Array) -> pa.ListArray:
    if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
        return pa.array([_SPACES.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


class _Pieces(PieceTable):
    """Keeps each piece's decoded text beside its ids."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        super().__init__(bpe.encode_pieces, MAX_PIECES)

    def _clear(self) -> None:
        super()._clear()
        self.decoded: list[str] = []

    def _release(self) -> None:
        super()._release()
        self.bpe.forget()

    def _add(self, new: list[str], ids: list[Sequence[int]]) -> None:
        super()._add(new, ids)
        self.decoded.extend(map(self.bpe.decode, ids))


@lru_cache(maxsize=2)
def _table(path: str) -> _Pieces:
    return _Pieces(WordBpe(path))


#: What a worker returns of each text.
FULL = "struct<ids:array<int>,decoded:string>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def _encoded(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, str]]:
    table = _table(path)
    for part in balanced(texts, _SLICE):
        pieces, counts = non_empty(split_pieces(part))
        rows, at = table.codes(pieces)
        codes = rows[at]
        ids = table.ids(codes)
        ends = np.concatenate(([0], np.cumsum(counts)))
        shown = pa.array([table.decoded[r] for r in rows.tolist()], pa.string())
        if part.nbytes < _JOINT:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shown.take(pa.array(at)))
            decoded = pc.binary_join(lists, " ")
        else:
            decoded = [pa.scalar(" ".join(map(table.decoded.__getitem__, codes[a:b].tolist())), pa.large_string()) for a, b in zip(ends, ends[1:], strict=False)]
        upto = np.concatenate(([0], np.cumsum(table.lens[codes])))[ends]
        for k, text in enumerate(decoded):
            yield ids[upto[k] : upto[k + 1]], text.as_py()


def _digests(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    for texts in batches:
        n, ids_hex, text_hex = [], [], []
        for ids, decoded in _encoded(texts, path):
            n.append(len(ids))
            ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])


def _full(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    for texts in batches:
        got = list(_encoded(texts, path))
        ids = pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
        yield pa.StructArray.from_arrays([ids, pa.array([d for _, d in got], pa.string())], ["ids", "decoded"])


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "bpe", digests: bool = False) -> DataFrame:
    """Add ``out``: ids and decoded text of each whole ``text`` (or their SHA-256 digests).

    The same ids as the tokenizers library gives with that file and no added tokens;
    decoding keeps special tokens. Null and empty texts have no ids and decode to "".
    Repeated rows, ties and further columns pass through; an existing ``out`` is replaced.
    No shuffle; a worker encodes each distinct piece once and forgets all beyond a bound.
    """
    bound_batches(df.sparkSession)
    if digests:
        @F.arrow_udf(DIGEST)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _digests(batches, tokenizer_path)
    else:
        @F.arrow_udf(FULL)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _full(batches, tokenizer_path)

    return df.withColumn(out, run(text_or_empty(text)))
