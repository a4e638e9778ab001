"""Near-duplicates by similarity: the SimHash trie self-join over many short fingerprints.

Texts whose five-word shingles are alike by 0.8 differ in about 15 percent of their SimHash
bits, ten of 64, which a budget of two never meets. So every text gets 640 bits, cut into 20
fingerprints of 32 bits, each joined by its own trie with a budget of two; at a likeness of 0.8
some fingerprint is that near for about 92 of 100 pairs, at 0.85 for 99. A near pair is
proposed if all 640 bits differ in at most :data:`MOST_DIFFERENT` places, by the first fingerprint
in which it is near, and is a link if the exact overlap of both texts' distinct shingles reaches
the least likeness.

Large groups of near copies would propose pairs by the square of their size. So texts that share a
whole fingerprint are first compared with a few of those that share it, which links much of such a
group by a number of pairs that follows its size; the join then leaves out pairs within a class.
What it proposes is compared in rounds, the most alike by their bits first: pairs that earlier
rounds have put in one class are not compared any more, as they would change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, cut, free_name, text_or_empty
from .components import components
from .pieces import balanced
from .simhash import bit_counts, shingle_hashes
from .trie import MOST_BROADCAST, MOST_ROWS, close

WORDS_EACH = 5
#: 64-bit words of SimHash, and bits of a fingerprint.
WORDS, BITS = 10, 32
#: Differing bits of the 640 up to which a pair is proposed. Texts alike by 0.8 differ in 97 bits, by
#: 9 more or less, but those that also meet in a fingerprint in fewer: one in 200 of such pairs of
#: large made groups is lost. Of those alike by 0.7 one in five is proposed, by 0.6 one in 1000.
MOST_DIFFERENT = 112
#: Differing bits up to which pairs are compared in each round before the last.
ROUNDS = (88, 100)
#: Rows of a block of the join; they carry all bits of a text, 100 bytes a row.
BLOCK_ROWS = MOST_ROWS // 2
#: Fingerprints by which groups are gathered first, texts of each that the others are compared
#: with, and levels of a trie that are opened at first.
GATHERED, HUBS, FIRST_LEVELS = 8, 4, 0
#: Shared share of all distinct shingles of two texts from which they are copies.
ALIKE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = np.array([0x9E3779B97F4A7C15 * (w + 1) % (1 << 64) for w in range(WORDS)], np.uint64)


def long_print(hashes: np.ndarray) -> np.ndarray:
    """640 bits, each set if more than half of the hashes, mixed anew for each word, have it."""
    ones = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        x = hashes[a : a + (1 << 14), None] ^ _STEPS
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        ones += bit_counts(x ^ x >> np.uint64(33))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def _prints(texts: pa.Array, words_each: int) -> Iterator[np.ndarray]:
    for part in balanced(texts):
        for t in part.cast(pa.binary()):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            yield long_print(np.array(shingle_hashes(raw, words_each), np.uint64))


def add_prints(df: DataFrame, words_each: int = WORDS_EACH, text: str = "text", out: str = "prints") -> DataFrame:
    """Add ``out``: the words of each whole text's SimHash, zero for texts without words."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            flat = np.concatenate([np.zeros(0, np.uint64), *_prints(texts, words_each)]).view(np.int64)
            yield pa.FixedSizeListArray.from_arrays(pa.array(flat), WORDS).cast(pa.list_(pa.int64()))

    return df.withColumn(out, run(text_or_empty(text)))


def _banded(values: DataFrame) -> DataFrame:
    """(prints, node, ...) -> (trie, value, node, c0, c1, ...): a row for each fingerprint."""
    halves = F.flatten(F.transform("prints", lambda w: F.array(w.bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftrightunsigned(w, BITS))))
    checks = [F.col("prints")[i].alias(f"c{i}") for i in range(WORDS)]
    rest = [c for c in values.columns if c != "prints"]
    return values.select(*rest, *checks, F.posexplode(halves).alias("trie", "value"))


def gathered(values: DataFrame, most: int = MOST_DIFFERENT) -> DataFrame:
    """(prints, node) rows -> (a, b): texts of one fingerprint with the first of each part of these."""
    rows = _banded(values).filter(F.col("trie") < GATHERED)
    shared = cut(rows.groupBy("trie", "value").count().filter("count > 1").select("trie", "value"))
    if shared.count() <= MOST_BROADCAST:
        shared = F.broadcast(shared)
    rows = cut(rows.join(shared, ["trie", "value"], "left_semi"))
    part = F.pmod(F.xxhash64("node"), F.lit(HUBS))
    names = ["node", *(f"c{i}" for i in range(WORDS))]
    hubs = rows.groupBy("trie", "value", part.alias("part")).agg(F.min(F.struct(*names)).alias("hub"))
    differing = sum((F.bit_count(F.col(f"c{i}").bitwiseXOR(F.col("hub")[f"c{i}"])) for i in range(WORDS)), F.lit(0))
    pairs = rows.join(hubs, ["trie", "value"]).filter((F.col("node") != F.col("hub.node")) & (differing <= most))
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def proposed(values: DataFrame, budget: int = 2, most: int = MOST_DIFFERENT, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(prints, node) rows, or with ``of`` -> (a, b): pairs near in a fingerprint and in all bits.

    A pair comes once; pairs of one class ``of`` are left out.
    """
    return close(_banded(values), BITS, budget, WORDS, most, spanning=False, most_rows=most_rows, first=FIRST_LEVELS, once=True)


def _by_bits(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, differing): the number of bits in which both texts' prints differ."""
    one, other = (values.select(F.col("node").alias(k), F.col("prints").alias(f"p{k}")) for k in ("a", "b"))
    differing = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.join(one, "a").join(other, "b").select("a", "b", differing.alias("differing"))


def _unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes."""
    classes = cut(components(edges))
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _add_shingles(df: DataFrame, words_each: int, text: str, out: str) -> DataFrame:
    """Add ``out``: the distinct shingle hashes of each text."""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = []
            for part in balanced(texts):
                for t in part.cast(pa.binary()):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    sets.append(np.unique(np.array(shingle_hashes(raw, words_each), np.uint64)).view(np.int64))
            yield pa.array(sets, pa.list_(pa.int64()))

    return df.withColumn(out, run(text_or_empty(text)))


def verified(pairs: DataFrame, texts: DataFrame, words_each: int, alike: float) -> DataFrame:
    """The (a, b) pairs whose texts share ``alike`` of their distinct shingles.

    ``texts`` has (key, same, text), ``same`` telling the texts of one key apart; one alike
    text is enough. Only texts of proposed pairs are read for shingles.
    """
    found = cut(pairs.filter("a != b").distinct())
    wanted = found.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    own = texts.join(wanted, "key").dropDuplicates(["key", "same"])
    sets = cut(_add_shingles(own, words_each, "text", "shingles").select("key", "shingles"))
    one, other = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    likeness = shared / F.greatest(F.size("sa") + F.size("sb") - shared, F.lit(1))
    none = (F.size("sa") == 0) & (F.size("sb") == 0)
    return found.join(one, "a").join(other, "b").filter(none | (likeness >= alike)).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = WORDS_EACH, alike: float = ALIKE, **options) -> DataFrame:
    """(key, component_id): the smallest key that links of alike texts reach, itself included.

    Keys are integers. One row per distinct key. Rows that repeat a key are one document; rows
    without a key are left out. Null, empty and blank texts have no shingles and are alike. Texts
    of the same words are joined as one before any pair is made. An empty table gives no rows.
    Every proposed pair is compared exactly, unless other links have put both texts in one class.
    """
    keyed = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    plain = F.trim(F.regexp_replace(F.translate(text_or_empty(), UPPER, LOWER), f"[{SPACE}]++", " "))
    keyed = keyed.withColumn("same", F.xxhash64(plain))
    prints = cut(add_prints(keyed, words_each).select("key", "prints", "same"))
    values = cut(prints.groupBy("prints", "same").agg(F.min("key").alias("node")))
    sure = cut(verified(gathered(values.select("prints", "node")), keyed, words_each, alike).unionByName(_same_key(prints, values)))
    classed = values.select("prints", "node").join(components(sure).withColumnRenamed("root", "of"), "node", "left").withColumn("of", F.coalesce("of", "node"))
    left, edges = cut(_by_bits(proposed(classed, **options), values)), sure
    for least, most in zip((-1, *ROUNDS), (*ROUNDS, 64 * WORDS), strict=True):
        now = left.filter((F.col("differing") > least) & (F.col("differing") <= most)).select("a", "b")
        edges = cut(edges.unionByName(verified(_unlinked(now, edges), keyed, words_each, alike)))
    found = components(edges)
    named = prints.join(values, ["prints", "same"]).select("key", "node")
    named = named.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return named.groupBy(F.col("key").alias(key)).agg(F.min(F.coalesce("root", "node")).alias("component_id"))


def _same_key(prints: DataFrame, values: DataFrame) -> DataFrame:
    """Links between the texts of a repeated key, so that it has one class."""
    often = prints.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    rows = prints.join(often, "key").join(values, ["prints", "same"])
    return rows.select(F.col("key").alias("a"), F.col("node").alias("b"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", alike: float = ALIKE, **options) -> DataFrame:
    """Rows of ``df`` whose key names their class, and rows without a key; no other columns."""
    (own,) = free_name(df, "class_key")
    found = near_duplicates(df, key, text, alike=alike, **options)
    first = found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias(own))
    return df.join(first, F.col(key).cast("long") == F.col(own), "left_anti")
