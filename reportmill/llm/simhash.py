"""SimHash fingerprints and their near-duplicate classes, by a binary trie self-join.

Distinct fingerprints meet as pairs of trie nodes, from the root down, with a budget of differing
bits (see :mod:`.trie`); edges of a pair of blocks are reduced to those that span its classes, and
connected components join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, free_name, text_or_empty
from .components import components
from .pieces import balanced
from .trie import close

SEED = 42
#: Fingerprints of a trie block.
MOST_ROWS = 1 << 17


def shingle_hashes(text: bytes, words_each: int, seed: int = SEED) -> list[int]:
    """Unsigned XXH64 of every run of ``words_each`` words (of all words, if fewer)."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return []
    n, digest = max(len(words) - words_each + 1, 1), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n == 1:
        return [digest(joined, seed)]
    ends = list(accumulate(map(len, words), lambda a, x: a + x + 1))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words_each - 1 :], strict=True)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of (rows, words) 64-bit hashes have each bit, lowest bit of the first word first."""
    out = np.zeros(64 * hashes.shape[1], np.int64)
    for a in range(0, len(hashes), 240):  # counts of so many fit a byte
        out += np.unpackbits(hashes[a : a + 240].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return out


def _fingerprints(texts: pa.Array, words_each: int) -> Iterator[np.ndarray]:
    for part in balanced(texts):
        out = np.zeros(len(part), np.uint64)
        for k, t in enumerate(part.cast(pa.binary())):
            hashes = np.array(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words_each), np.uint64)
            if len(hashes):
                out[k] = np.packbits(2 * bit_counts(hashes[:, None]) > len(hashes), bitorder="little").view("<u8")[0]
        yield out.view(np.int64)


def fingerprint(df: DataFrame, words_each: int = 3, text: str = "text", out: str = "simhash") -> DataFrame:
    """Add ``out``: the 64-bit SimHash of each whole text as a signed integer.

    A-Z are lower-cased; shingles repeat as often as they occur. Null, empty and blank
    texts have fingerprint 0.
    """
    bound_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = list(_fingerprints(texts, words_each))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return df.withColumn(out, run(text_or_empty(text)))


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def classes(prints: DataFrame, budget: int = 2, column: str = "simhash", most_rows: int = MOST_ROWS) -> DataFrame:
    """(simhash) distinct values -> (a, b) edges that span every class of linked values."""
    return close(prints.select(F.lit(0).alias("trie"), F.col(column).alias("value")), 64, budget, most_rows=most_rows)


def near_duplicates(df: DataFrame, key: str = "doc_id", words_each: int = 3, budget: int = 2, text: str = "text") -> DataFrame:
    """(key, simhash, component_id): the smallest key that links of <= ``budget`` bits reach.

    One row per input row. Texts without words share fingerprint 0, which links as any
    other. Rows with a null key belong to classes too and never name one, unless no member
    has a key (then null). Repeated rows and keys keep their rows. Equal fingerprints are
    joined as one value with the smallest key of its rows, so copies are never paired; hot
    values are spread by the runtime's skew-join splitting. Any ``budget`` works; more of it
    prunes later. Fingerprints are written once
    to the checkpoint folder, as computing them is most of the work.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prints = cut(fingerprint(docs, words_each).select("key", "simhash"))
    values = cut(prints.groupBy("simhash").agg(F.min("key").alias("least")))
    found = components(classes(values, budget))
    rooted = values.join(found, values["simhash"] == found["node"], "left").select(
        "simhash", "least", F.coalesce("root", "simhash").alias("root")
    )
    named = cut(rooted)
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "root").select("simhash", "component_id")
    return prints.join(named, "simhash").select(F.col("key").alias(key), "simhash", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``df`` whose key names their class; all its columns, and no others.

    Rows that repeat a kept key are taken for one document and all stay; classes without any
    key are returned whole, as nothing tells their rows apart.
    """
    found = near_duplicates(df, key, **options)
    (own,) = free_name(df, "class_key")
    kept = found.filter(F.col("component_id").isNull() | (F.col(key) == F.col("component_id"))).select(F.col(key).alias(own)).distinct()
    return df.join(kept, F.col(key).eqNullSafe(F.col(own)), "left_semi")
