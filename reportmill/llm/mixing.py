"""Mixing sources to target weights: a low-discrepancy schedule over equal-token blocks.

Golden-ratio points walk through the sources' cumulative shares, which spreads each source's
slots evenly over the whole mix: in any first part of it, every source has its share but for a
few slots. A source's slots are ranked in walking order, and rank r takes its block r modulo the
number of its blocks; its blocks are equal runs of words over its documents in a shuffled order.
A document stands in the mix where the first of its blocks does, once for each pass. SQL
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, add_sums_before, cut, free_name, n_words, parts_for, sums_before, text_or_empty

#: Slots of the whole mix, about, and words of a block at most: where the slots would have larger
#: blocks, there are more slots instead.
SLOTS, BLOCK_WORDS = 1 << 20, 1 << 22
#: Bytes of text of a partition of the taken mix, about.
PARTITION_BYTES = 64 << 20
#: A source is cut into at least so many blocks (or one a word).
LEAST_BLOCKS = 16
#: Most passes over a source.
PASSES = 3
#: Consecutive slots ranked together.
CHUNK = 4096
#: Documents of a source whose sizes are summed in one task.
ROWS = 512
#: Cells a source, at least, into which the cumulative shares are cut to look slots up.
CELLS = 4
#: Sources up to which their table is broadcast (some 100 bytes each).
MOST_BROADCAST = 100_000
_GOLDEN = (5**0.5 - 1) / 2
_BIG = "decimal(38,0)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """(source, size) rows -> a row per source: source_ix, weight, source_size, target.

    Sources by code point, null last, take the weights in turn. They share the sum of all
    sizes by weight; no target exceeds ``passes`` times its source's size, and what is over
    is shared again by weight. That is a common level times the weight, or the limit: with
    sources in the order of limit by weight, the level is what the limits before leave,
    divided by the weights that remain, at the first source whose limit it doesn't exceed.
    Orders are ranges sorted apart, so any number of sources will do.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = add_sums_before(per, [F.asc_nulls_last("source")], {"source_ix": F.lit(1)})
    turn = F.array(*map(F.lit, weights))
    per = per.withColumn("source_ix", F.col("source_ix") + 1).withColumn("weight", F.element_at(turn, ((F.col("source_ix") - 1) % len(weights) + 1).cast("int")))
    most = F.col("source_size") * passes
    per = add_sums_before(per, [F.asc(F.col("source_size") / F.col("weight")), F.asc("source_ix")], {"most_before": most, "weight_before": F.col("weight")})
    whole = per.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))
    level = (F.col("_size") - F.col("most_before")) / (F.col("_weight") - F.col("weight_before"))
    per = cut(per.join(F.broadcast(whole)).withColumn("level", level).withColumn("ratio", most / F.col("weight")))  # one row
    water = per.filter("level <= ratio").agg(F.min(F.struct("ratio", "source_ix", "level")).alias("w")).select(F.coalesce("w.level", F.lit(0.0)).alias("water"))
    target = F.least(most.cast("double"), F.col("water") * F.col("weight"))
    return per.join(F.broadcast(water)).select("source", "source_ix", F.col("weight").cast("double").alias("weight"), "source_size", target.alias("target"))  # one row


def _blocks(per: DataFrame, total: int) -> DataFrame:
    """Add each source's number of blocks, and its quota: the slots that its target takes."""
    block_words = max(1.0, min(total / SLOTS, BLOCK_WORDS))
    wanted = F.ceil(F.col("source_size") / block_words)
    n = F.greatest(wanted, F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * n / F.col("source_size")).cast("long"), n * PASSES)).otherwise(0)
    return per.withColumn("n_blocks", n).withColumn("quota", quota.cast("long"))


def schedule(per: DataFrame) -> DataFrame:
    """(source_ix, n_blocks, quota) -> (slot, source_ix, rank, block): the mix, slot by slot.

    Point n stands at frac((n + 1/2) * golden ratio) of the sum of all quotas, and belongs to the
    source whose quota, laid end to end with the others', covers it. ``slot`` is n, with gaps
    where a source has its quota already; what a source lacks after a few more points than
    quotas stands behind all points.
    """
    spark = per.sparkSession
    held = per.filter("quota > 0").select("source_ix", "n_blocks", "quota")
    n, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    cells = 1 << max(10, (CELLS * n).bit_length())
    held = cut(add_sums_before(held, [F.asc("source_ix")], {"lo": F.col("quota")}).withColumn("hi", F.col("lo") + F.col("quota")))
    cell_of = lambda x: F.floor(x / F.lit(max(total, 1)) * cells)
    spread = held.withColumn("cell", F.explode(F.sequence(cell_of(F.col("lo")), F.least(cell_of(F.col("hi")), F.lit(cells - 1)))))
    drawn = int(total * 1.02) + 64 if total else 0
    points = spark.range(drawn).withColumnRenamed("id", "slot").withColumn("u", (F.col("slot") + 0.5) * F.lit(_GOLDEN))
    points = points.withColumn("u", F.col("u") - F.floor("u")).select("slot", (F.col("u") * total).alias("x"), F.floor(F.col("u") * cells).alias("cell"))
    dealt = points.join(spread, "cell").filter("x >= lo and x < hi").select("slot", "source_ix", "n_blocks", "quota")
    dealt = cut(dealt.withColumn("chunk", F.floor(F.col("slot") / CHUNK)))
    counts = dealt.groupBy("source_ix", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sums_before(counts, ["source_ix"], "chunk", "n", "before", max(1, (drawn // CHUNK).bit_length()))
    inside = F.row_number().over(Window.partitionBy("source_ix", "chunk").orderBy("slot"))
    ranked = dealt.withColumn("inside", inside).join(before, ["source_ix", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1).filter("rank < quota").select("slot", "source_ix", "n_blocks", "rank")
    have = counts.groupBy("source_ix").agg(F.sum("n").alias("have"))
    short = held.join(have, "source_ix", "left").filter(F.coalesce("have", F.lit(0)) < F.col("quota"))
    rest = short.select("source_ix", "n_blocks", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("quota") - 1)).alias("rank"))
    rest = rest.select((F.col("rank") + drawn).alias("slot"), "source_ix", "n_blocks", "rank")
    every = ranked.unionByName(rest)
    return every.select("slot", "source_ix", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """(key, th, size, source_size, target, taken, passes, slots): what the mix takes of each row.

    ``size`` counts the text's words, ``taken`` those that the mix takes, repeats counted,
    and ``passes`` has the words of the first, second and third pass; they are the row's
    first words where a pass takes only some. ``slots`` has the slot of each pass, null for a
    pass without words. Null texts have size 0; a null source is a source. Within a source rows
    are shuffled by a hash of key, text and seed, so reruns agree; rows that repeat a key and a
    text follow each other. ``th`` is a hash of the text. An empty table gives no rows.
    """
    th = F.xxhash64(text)
    sized = cut(
        df.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            th.alias("th"),
            n_words(text_or_empty(text)).alias("size"),
            F.xxhash64(F.lit(seed), key, th).alias("h"),
        )
    )
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per = cut(_blocks(targets(sized), total))
    slot = [F.min(F.when(F.floor(F.col("rank") / F.col("n")) == p, F.col("slot"))).alias(f"s{p}") for p in range(PASSES)]
    times = schedule(per).join(per.select("source_ix", F.col("n_blocks").alias("n")), "source_ix")
    times = times.groupBy("source_ix", "block").agg(F.count(F.lit(1)).alias("times"), *slot)

    bits = max(1, (rows // ROWS).bit_length())
    named = per.withColumnRenamed("source", "of").select("of", "source_ix", "source_size", "target", "n_blocks")
    if per.count() <= MOST_BROADCAST:
        named = F.broadcast(named)
    bucketed = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    bucketed = bucketed.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    sums = bucketed.groupBy("source_ix", "bucket").agg(F.sum("size").alias("words"))
    sums = sums_before(sums, ["source_ix"], "bucket", "words", "before", bits)
    order = Window.partitionBy("source_ix", "bucket").orderBy("h", "key", "th", "size")
    placed = bucketed.withColumn("nth", F.row_number().over(order)).withColumn("own", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(sums, ["source_ix", "bucket"]).withColumn("offset", F.col("before") + F.col("own")).drop("before", "own", "h")

    # word w is in block w * n_blocks div source_size; products need more than 64 bits
    first = F.expr(f"(cast(offset as {_BIG}) * n_blocks) div cast(source_size as {_BIG})")
    last = F.expr(f"(cast(offset + size - 1 as {_BIG}) * n_blocks) div cast(source_size as {_BIG})")
    spread = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    start = F.expr(f"(cast(block as {_BIG}) * source_size + n_blocks - 1) div cast(n_blocks as {_BIG})")
    stop = F.expr(f"(cast(block + 1 as {_BIG}) * source_size + n_blocks - 1) div cast(n_blocks as {_BIG})")
    overlap = F.least(stop, F.col("offset") + F.col("size")) - F.greatest(start, F.col("offset"))
    spread = spread.withColumn("overlap", F.coalesce(overlap, F.lit(0)))
    taken = spread.join(times, ["source_ix", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    row = ["source_ix", "bucket", "nth", "key", "th", "size", "source_size", "target"]
    each = [F.sum(F.when(F.col("times") > p, F.col("overlap")).otherwise(0)).alias(f"p{p}") for p in range(PASSES)]
    each += [F.min(F.when(F.col("overlap") > 0, F.col(f"s{p}"))).alias(f"s{p}") for p in range(PASSES)]
    done = taken.groupBy(*row).agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"), *each)
    passes, slots = (F.array(*(F.col(f"{c}{p}") for p in range(PASSES))).alias(name) for c, name in (("p", "passes"), ("s", "slots")))
    return done.select(F.col("key").alias(key), "th", "size", "source_size", "target", "taken", passes, slots)


def first_words(text: Column, size: Column, n: Column) -> Column:
    """The whole text if ``n`` is all its words, else as far as the end of its ``n``-th word."""
    words = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*+[^{SPACE}]++"), F.lit(0))
    return F.when(n >= size, text).otherwise(F.array_join(F.slice(words, F.lit(1), n.cast("int")), ""))


def take(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """The mix itself: a row of ``df`` for every pass that takes words of it, in the mix's order.

    Has the columns of ``df``; a text that a pass takes in part ends with the last of those
    words, its white space as it was. Rows with one key and text are one document here, and get
    the same passes. Null and empty texts have no words and no rows; null keys and sources are
    taken like others; an empty table gives no rows. Partitions are consecutive runs of slots
    and sorted inside, so files written from them follow the schedule; their number follows the
    bytes of all texts.
    """
    k, th, size, n, slot = free_name(df, "mix_key", "mix_th", "mix_size", "mix_n", "mix_slot")
    plan = mix(df, key, source, text, seed).groupBy(F.col(key).alias(k), F.col("th").alias(th))
    plan = plan.agg(F.min_by(F.arrays_zip("passes", "slots"), "slots").alias("each"), F.first("size").alias(size))
    plan = cut(plan.select(k, th, size, F.explode(F.filter("each", lambda x: x["passes"] > 0)).alias("one")).select(k, th, size, F.col("one.passes").alias(n), F.col("one.slots").alias(slot)))
    joined = df.join(plan, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(th)))
    last = plan.agg(F.coalesce(F.max(slot), F.lit(0))).first()[0] + 1
    parts = parts_for(df, F.octet_length(text), PARTITION_BYTES)
    in_order = joined.repartitionById(parts, F.floor(F.col(slot) * parts / last).cast("int")).sortWithinPartitions(slot, k, th)
    return in_order.withColumn(text, first_words(F.col(text), F.col(size), F.col(n))).select(*df.columns)
