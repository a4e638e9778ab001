"""Line dedup: a suffix array over line ids, by distributed prefix doubling.

Lines that occur once anywhere end every repeated run, so only the others take part. Round
k ranks the line runs of length 2**k that start at each position, by the pair of ranks of
their halves; ranks follow the order of the pairs, so sorting positions by their last rank
gives the suffix array as deep as it was doubled. Positions with equal ranks are the
intervals of that array whose longest common prefix reaches the depth. Doubling stops where
every run of ``min_words`` words is covered: a run has at most ``min_words`` lines, as each
has a word, so the number of rounds is fixed and does not follow the longest repeat.

A run of lines that reaches ``min_words`` words and stands somewhere earlier as well is a
later copy and is deleted. The shortest such runs from each line do not cover a repeated
run that ends in less than ``min_words`` words after the last of them; with ``whole_runs``,
the longer runs from a line are compared too, as long as all but their first line have less
than ``min_words`` words. Any repeated run is the union of these, and they have at most
``min_words`` lines as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, cut, free_name, n_words

MIN_WORDS = 25


def _lines(docs: DataFrame) -> DataFrame:
    """(key, th, at, pos, h1, h2, words): lines with a word; ``at`` numbers them in a document."""
    each = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    with_word = F.filter(each, lambda x: x["line"].rlike(f"[^{SPACE}]"))
    rows = docs.select("key", "th", F.posexplode(with_word).alias("at", "row"))
    return rows.select(
        "key",
        "th",
        "at",
        F.col("row.pos").alias("pos"),
        F.xxhash64("row.line").alias("h1"),
        F.xxhash64(F.lit("second"), "row.line").alias("h2"),
        n_words(F.col("row.line")).cast("int").alias("words"),
    )


def _ranked(pairs: DataFrame, a: str, b: str, rank: str) -> DataFrame:
    """(a, b, rank): the pairs found twice or more, ranked in their order.

    The ids rise along a range-partitioned sort, with gaps. They are written at once, as
    sorting again need not give the same ids.
    """
    twice = pairs.groupBy(a, b).count().filter("count > 1").select(a, b)
    ordered = twice.repartitionByRange(a, b).sortWithinPartitions(a, b)
    return cut(ordered.withColumn(rank, F.monotonically_increasing_id()))


def _run_lines(before: Column, total: Column, here: Window, min_words: int) -> Column:
    """Lines that a run from here takes to reach ``min_words``; null where it can't."""
    out = F.lit(None).cast("int")
    for k in range(min_words, 0, -1):
        reached = F.lead(before, k, None).over(here)
        out = F.when(F.coalesce(reached, total) - before >= min_words, F.lit(k)).otherwise(out)
    return out


def _most_lines(before: Column, words: Column, here: Window, min_words: int) -> Column:
    """Most lines of a run from here whose lines after the first stay below ``min_words``."""
    out = F.lit(1)
    for k in range(2, min_words + 1):
        last = F.lead(before + words, k - 1, None).over(here)  # null beyond the run's end
        out = F.when(last - before - words < min_words, F.lit(k)).otherwise(out)
    return out


def later_copies(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """(key, th, gone, n_runs): positions of deleted lines of each document that has any.

    ``th`` is a hash of the text that tells documents with one key apart; rows with equal
    keys and texts are one document. "Earlier" means a smaller (key, th, line), null keys
    last. Runs compare whole lines exactly as written; lines without a word neither count
    nor break a run, and are never deleted. With ``whole_runs``, the whole common length of
    each copy is deleted, otherwise the shortest runs from each line that reach ``min_words``.
    """
    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    lines = _lines(docs)
    rank0 = _ranked(lines, "h1", "h2", "r0")
    document = Window.partitionBy("key", "th").orderBy("at")
    shared = lines.join(rank0, ["h1", "h2"]).select("key", "th", "at", "pos", "words", "r0").distinct()
    numbered = shared.withColumn("run", F.col("at") - F.row_number().over(document))
    run = Window.partitionBy("key", "th", "run").orderBy("at")
    whole = Window.partitionBy("key", "th", "run")
    sized = numbered.withColumn("before", F.sum("words").over(run) - F.col("words")).withColumn("total", F.sum("words").over(whole))
    sized = sized.withColumn("m", _run_lines(F.col("before"), F.col("total"), run, min_words))
    most = _most_lines(F.col("before"), F.col("words"), run, min_words) if whole_runs else F.lit(1)
    now = cut(sized.withColumn("most", most).select("key", "th", "run", "at", "pos", "m", "most", "r0"))
    rounds = (min_words - 1).bit_length() if min_words > 1 else 0
    for k in range(1, rounds + 1):
        if (1 << k) > min_words:
            break
        half = now.withColumn("next", F.lead(f"r{k - 1}", 1 << k - 1).over(run))
        pairs = half.select(F.col(f"r{k - 1}").alias("ra"), F.col("next").alias("rb"))
        ranks = _ranked(pairs.filter("ra is not null and rb is not null"), "ra", "rb", f"r{k}")
        joined = half.join(ranks, (half[f"r{k - 1}"] == ranks["ra"]) & (half["next"] == ranks["rb"]), "left")
        now = cut(joined.select(*now.columns, f"r{k}"))
    # two runs of one power of two, laid over each other, cover the m lines from here
    pair = {}
    for m in range(1, min_words + 1):
        k = m.bit_length() - 1
        pair[m] = (F.col(f"r{k}"), F.lead(f"r{k}", m - (1 << k)).over(run))
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "th", "at")
    placed = now.withColumn("place", place)
    interval = ["m", "left", "right"]
    if whole_runs:
        each = [
            F.when((F.col("m") <= m) & (m <= F.greatest("m", "most")), F.struct(F.lit(m).alias("m"), a.alias("left"), b.alias("right")))
            for m, (a, b) in pair.items()
        ]
        held = placed.withColumn("each", F.filter(F.array(*each), lambda x: x["left"].isNotNull() & x["right"].isNotNull()))
        rows = held.select("key", "th", "run", "at", "pos", "place", F.explode_outer("each").alias("one"))
        keyed = rows.select("key", "th", "run", "at", "pos", "place", "one.*")
    else:
        left = right = F.lit(None).cast("long")
        for m, (a, b) in pair.items():
            left, right = F.when(F.col("m") == m, a).otherwise(left), F.when(F.col("m") == m, b).otherwise(right)
        keyed = placed.withColumn("left", left).withColumn("right", right)
    firsts = (
        keyed.filter("left is not null and right is not null")
        .groupBy(*interval)
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    firsts = cut(firsts)  # apart from the rows' own shuffle, so that the join can split a hot interval
    found = keyed.join(firsts, interval, "left")
    is_copy = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("place"))
    end = F.when(is_copy, F.col("at") + F.col("m") - 1)
    if whole_runs:
        found = found.groupBy("key", "th", "run", "at", "pos").agg(F.max(end).alias("end"))
        end = F.col("end")
    reach = F.max(end).over(run)
    covered = found.withColumn("reach", reach).withColumn("gone", F.coalesce(F.col("reach") >= F.col("at"), F.lit(False)))
    starts = F.col("gone") & ~F.coalesce(F.lag("gone").over(run), F.lit(False))
    marked = covered.withColumn("start", starts).filter("gone")
    return marked.groupBy("key", "th").agg(F.collect_list("pos").alias("gone"), F.count_if("start").alias("n_runs"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """``df`` with later copies of line runs deleted from ``text``, and what was deleted.

    Adds n_lines, n_deleted_lines and n_deleted_runs (replacing such columns); every row and
    other column stays. Null texts stay null with 0 lines; an emptied text becomes "".
    """
    bound_batches(df.sparkSession)
    gone = later_copies(df, key, text, min_words, whole_runs)
    k, th = free_name(df, "gone_key", "gone_th")
    gone = gone.select(F.col("key").alias(k), F.col("th").alias(th), "gone", F.col("n_runs").alias("_runs"))
    g, r, own = free_name(df, "gone_lines", "gone_runs", "own_th")
    gone = gone.withColumnsRenamed({"gone": g, "_runs": r})
    joined = df.withColumn(own, F.xxhash64(text)).join(gone, F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(th)), "left")

    @F.arrow_udf("string")
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lines in batches:
            out = []
            for t, drop in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
                if t is not None and drop:
                    drop = set(drop)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop])
                out.append(t)
            yield pa.array(out, pa.string())

    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1)
    extra = {
        "n_lines": n_lines.cast("long"),
        "n_deleted_lines": F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long"),
        "n_deleted_runs": F.coalesce(F.col(r), F.lit(0)).cast("long"),
    }
    cleaned = joined.withColumns(extra)
    cut_text = F.when(F.col(g).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(g)))
    return cleaned.withColumn(text, cut_text).select(*df.columns, *[c for c in extra if c not in df.columns])
