"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range and nothing else, so
sketches of any two texts were thinned alike: unions of sketches are sketches of unions, and
containment of a short text in a long one can be estimated, which fixed-size sketches can't do.
A text may have no hash that low; its sketch is empty then. What tells such texts apart is the
hash of all their words, which a fingerprint carries beside the sketch and merging leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, free_name, text_or_empty

WORDS_EACH = 5
#: Hashes are kept below 1 / 2**KEEP_BITS of their range.
KEEP_BITS = 3
#: Rows of a bucket of neighbouring keys and buckets, about; rows, and times what a bucket should
#: have, from which one is cut up.
BUCKET_ROWS, MOST_BUCKETS, HOT_ROWS, HOT_TIMES = 256, 400_000, 8192, 4
#: Bytes of text of a partition.
PARTITION_BYTES = 16 << 20
#: Boundary rows up to which they are broadcast (16 bytes each); beyond, they are shuffled.
MOST_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[{SPACE}]+", -1), "")


def sketch(words: Column, words_each: int = WORDS_EACH, keep_bits: int = KEEP_BITS) -> Column:
    """Sorted distinct shingle hashes of a word array that lie below the threshold.

    Fewer words than a shingle make one shingle; no words make none.
    """
    firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (words_each - 1), F.lit(1)))
    hashes = F.transform(firsts, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, words_each))))
    most = (1 << 64 - keep_bits) - 1
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: (h >= 0) & (h <= most))))


def as_text(identity: Column, sketch_column: Column) -> Column:
    """A fingerprint: the words' hash, a colon, and the sketch, as 16 lowercase hex digits a hash."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(digits(identity), F.lit(":"), F.array_join(F.transform(sketch_column, digits), "")))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of common shingles in all of both; for two empty sketches, 1 or 0 by ``same``."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(same, F.lit(1.0)).when(every == 0, F.lit(0.0)).otherwise(common / every)


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; if ``a`` has an empty sketch, 1 or 0 by ``same``."""
    known = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(same, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(known)


def add_sketch(df: DataFrame, text: str = "text", out: str = "sketch", identity: str | None = None, **options) -> DataFrame:
    """Add ``out``: the sketch of each whole text, and, where named, ``identity``: its words' hash.

    Null and blank texts have an empty sketch and the hash of no words.
    """
    (w,) = free_name(df, "sketch_words")
    done = df.withColumn(w, words_of(text_or_empty(text))).withColumn(out, sketch(F.col(w), **options))
    return (done if identity is None else done.withColumn(identity, F.xxhash64(w))).drop(w)


def merged(df: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """The sketch of all texts of each group together: the union of their sketches."""
    one = df.select(*by, F.explode(column).alias("h")).distinct()
    return one.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias(column))


def _following(buckets: DataFrame) -> DataFrame:
    """(b, sub) distinct -> (b, sub, next_b, next_sub): by descending b, then sub, in a ring.

    Ranges are sorted apart; only each range's first bucket meets the others in one task.
    """
    order = [F.desc("b"), F.asc("sub")]
    ranged = cut(buckets.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    pair = F.struct("b", "sub")
    inside = ranged.withColumn("next", F.lead(pair).over(Window.partitionBy("part").orderBy(*order)))
    first = F.min(F.struct((-1 - F.col("b")).alias("flip"), "sub"))
    firsts = ranged.groupBy("part").agg(first.alias("f")).select("part", F.struct((-1 - F.col("f.flip")).alias("b"), F.col("f.sub").alias("sub")).alias("first"))
    everywhere = Window.orderBy("part")
    ring = F.coalesce(F.lead("first").over(everywhere), F.first("first").over(everywhere))
    ended = inside.join(firsts.select("part", ring.alias("wrap")), "part")
    after = F.coalesce("next", "wrap")
    return ended.select("b", "sub", after["b"].alias("next_b"), after["sub"].alias("next_sub"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what a count shows to be small; the rest is shuffled."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _cut_up(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of crowded buckets, equal rows as one with their number, dealt into smaller buckets.

    Distinct rows go by ranges of their order, so that neither a key nor a text is a bucket's bound.
    """
    inside = rows.drop("sub", "copies").join(hot, "b")
    single = inside.groupBy("b", "rank", "th").agg(F.first("key").alias("key"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    order = [F.desc("b"), F.desc("rank"), F.asc("th")]
    ranged = single.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    # the upper half of the id is the range, the lower one counts its rows
    sub = F.shiftright("id", 33) * (1 << 33) + F.floor(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) / BUCKET_ROWS)
    return cut(ranged.withColumn("sub", sub.cast("long")).drop("id"))


def in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, rank, th, b, sub, copies, guest): rows of neighbouring keys, bucket by bucket.

    Rows go by descending key, null keys last, then by a hash of the text. The keys' span and
    number give the width of a bucket; one with many more rows than that (a hot key, or null) is
    cut up, and rows equal in key and text are one row there with their number in
    ``copies``. Every bucket also gets the first row of the next one (the first bucket follows the
    last) as its guest, so one shuffle of the texts is enough.
    """
    least = -(1 << 63)
    n, low, high = df.agg(F.count(F.lit(1)), F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long"))).first()
    each = max(BUCKET_ROWS, n // MOST_BUCKETS)
    bits = 0 if low is None else max(0, ((high - low + 1) * each // max(n, 1)).bit_length() - 1)
    rank = F.coalesce(F.col(key).cast("long"), F.lit(least))
    bucket = F.when(F.col("rank") == least, F.lit(least)).otherwise(F.shiftright("rank", min(bits, 63)))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), rank.alias("rank"), F.xxhash64(text).alias("th"))
    rows = rows.withColumn("b", bucket).withColumn("sub", F.lit(0).cast("long")).withColumn("copies", F.lit(1).cast("long"))
    first = F.max(F.struct("rank", (-1 - F.col("th")).alias("flip"))).alias("top")
    size = [F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")]
    tops = cut(rows.groupBy("b", "sub").agg(first, *size))
    hot = tops.filter(F.col("n") > max(HOT_ROWS, HOT_TIMES * each)).select("b")
    if not hot.isEmpty():
        hot = _small(hot)
        parts = _cut_up(rows, hot)
        rows = rows.join(hot, "b", "left_anti").unionByName(parts)
        tops = cut(tops.join(hot, "b", "left_anti").unionByName(parts.groupBy("b", "sub").agg(first, *size)))
    ring = _following(tops.select("b", "sub"))
    after = tops.select(F.col("b").alias("next_b"), F.col("sub").alias("next_sub"), "top")
    guests = ring.join(after, ["next_b", "next_sub"])
    guests = cut(guests.select(F.col("top.rank").alias("g_rank"), (-1 - F.col("top.flip")).alias("g_th"), F.col("b").alias("g_b"), F.col("sub").alias("g_sub")))
    copies = rows.join(_small(guests), (F.col("rank") == F.col("g_rank")) & (F.col("th") == F.col("g_th")))
    copies = copies.withColumn("b", F.col("g_b")).withColumn("sub", F.col("g_sub")).withColumn("guest", F.lit(1))
    both = rows.withColumn("guest", F.lit(0)).unionByName(copies.select(*rows.columns, "guest"))
    total = tops.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return both.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_BYTES), "b", "sub")


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Rows of :func:`in_order` with next_<c> for ``carry``: values of the row after each.

    The last of equal rows is followed by the next other one, those before it by itself.
    """
    near = Window.partitionBy("b", "sub").orderBy("guest", F.desc("rank"), "th")
    led = rows.withColumns({f"next_{c}": F.lead(c).over(near) for c in carry}).filter(F.col("guest") == 0)
    kinds = F.when(F.col("copies") > 1, F.array(F.lit(1).cast("long"), F.col("copies") - 1)).otherwise(F.array(F.lit(1).cast("long")))
    each = led.select("*", F.posexplode(kinds).alias("nth", "times"))
    itself = {f"next_{c}": F.when(F.col("nth") == 0, F.col(f"next_{c}")).otherwise(F.col(c)) for c in carry}
    return each.withColumns(itself).drop("rank", "th", "b", "sub", "copies", "guest", "nth")


def edited(text: Column, following: Column) -> Column:
    """The text whose last half of code points gives way to the start of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    Keys are integers. Null texts count as empty. Repeated keys are neighbours in the order of
    their texts' hashes; a single row follows itself; an empty table gives no rows, and further
    columns are left out. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and kept_in_edited (containment of the text in the edited one). Each
    text is sketched once, after the only shuffle of texts, and its edited text once.
    """
    docs = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    own = add_sketch(in_order(docs, "key", "text"), identity="words")
    led = with_next(own, ["text", "sketch", "words"])
    changed = led.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    both = add_sketch(changed, "changed", "changed_sketch", "changed_words")
    same = F.col("words") == F.col("changed_words")
    done = both.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("words"), F.col("sketch")).alias("fingerprint"),
        as_text(F.col("changed_words"), F.col("changed_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("changed_sketch"), same).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("words") == F.col("next_words")).alias("near_next"),
        containment(F.col("sketch"), F.col("changed_sketch"), same).alias("kept_in_edited"),
        F.sequence(F.lit(1).cast("long"), "times").alias("times"),
    )
    return done.withColumn("times", F.explode("times")).drop("times")
