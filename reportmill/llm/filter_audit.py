"""What filters remove in every order they could be applied in, by a trie of their permutations.

The trie is walked depth first. A node's survivors are a persisted DataFrame: its edges are counted
in one pass over them, and its children filter them. Prefixes of the same filters in another order
leave the same documents, so a set of filters is one node, visited once: 2^n nodes stand for n!
orders, and no more than n of them are persisted at a time. Texts are read once, for the verdicts,
which are written as a narrow table without texts; a lost executor costs a node's survivors, which
are made again from it. Only names of filters are on the driver.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, n_words, new_folder, text_or_empty

#: Counts of an edge besides the documents that reach it.
LOST = ("removed", "good_lost", "toxic_lost")


def text_filters() -> dict[str, Column]:
    """Failure conditions of a text (column ``text``, not null) on its own.

    A: less than 100 words; B: less than 80 of 100 words distinct; C: more than 10 of 100
    characters are capitals; D: any of the symbols ``#$%&*|``.
    """
    words = F.split("text", f"[{SPACE}]++")
    distinct = F.size(F.array_distinct(words)) - F.array_contains(words, "").cast("int")
    n = n_words(F.col("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]++", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}


def _written(df: DataFrame, what: str) -> DataFrame:
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def verdicts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str) -> DataFrame:
    """(part, the names of ``filters`` and ``copies``, good, toxic), a row for each document.

    Null texts are empty; ``part`` is the language, null as an empty string. ``copies`` fails where a
    smaller doc_id has the same text, anywhere in the table; a null doc_id is neither smaller nor
    larger than others. A document is good (toxic) if any label of its id says so. Rows that repeat
    a doc_id are documents of their own. More columns of either table are left out.
    """
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("text"))
    own = _written(texts.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *(c.alias(n) for n, c in filters.items())), "verdicts")
    firsts = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    said = labels.groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))))
    joined = own.join(firsts, ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    marks = (F.coalesce(n, F.lit(False)).alias(n) for n in ("good", "toxic"))
    return _written(joined.select("part", *filters, copy.alias(copies), *marks), "verdicts")


def walk(judged: DataFrame, names: str) -> DataFrame:
    """(part, state, filter, reached, removed, good_lost, toxic_lost), a row for each edge and part.

    ``state`` has the filters applied before, in order of their letters, and ``reached`` the
    documents that they leave. A part whose documents are all gone has no row.
    """
    folder = new_folder(judged.sparkSession, "edges")
    paths: dict[str, str] = {}

    def visit(state: str, survivors: DataFrame) -> None:
        paths[state] = f"{folder}/{len(paths)}"
        rest = [n for n in names if n not in state]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.count_if(F.col(f) & c).cast("long").alias(f"{f}_{lost}") for f in rest for lost, c in zip(LOST, (F.lit(True), F.col("good"), F.col("toxic")), strict=True)]
        counted = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("reached"), *counts)
        edges = F.array(*(F.struct(F.lit(f).alias("filter"), "reached", *(F.col(f"{f}_{lost}").alias(lost) for lost in LOST)) for f in rest))
        counted.select("part", F.lit(state).alias("state"), F.inline(edges)).write.parquet(paths[state])
        for f in rest:
            below = "".join(sorted(state + f))
            if len(below) < len(names) and below not in paths:
                visit(below, survivors.filter(~F.col(f)))
        survivors.unpersist()

    visit("", judged)
    return judged.sparkSession.read.parquet(*paths.values())


def orders(spark: SparkSession, names: str) -> DataFrame:
    """(filter_order, step, state, filter): every step of every order, n times n! rows."""
    rows = [("".join(p), i + 1, "".join(sorted(p[:i])), p[i]) for p in permutations(names) for i in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, state string, filter string")


def audit(judged: DataFrame, names: str) -> DataFrame:
    """A row for each part, order and step, zeros included.

    kept and removed count documents after and at a step, redundant those that fail its filter but
    are gone before, unique_fails those that fail its filter only, shapley what its filter removes
    summed over all orders. No documents, no rows.
    """
    n = len(names)
    edges = walk(judged, names)
    before = F.length("state")
    weights = F.get(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), before)
    by_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(before == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(before == n - 1, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * weights).cast("long").alias("shapley"),
    )
    steps = by_filter.join(F.broadcast(orders(judged.sparkSession, names)), "filter").join(edges, ["part", "state", "filter"], "left")
    lost = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in LOST]
    kept = (F.coalesce("reached", F.lit(0)) - F.coalesce("removed", F.lit(0))).cast("long").alias("kept")
    redundant = (F.col("fails") - F.coalesce("removed", F.lit(0))).cast("long").alias("redundant")
    return steps.select("part", "filter_order", "step", kept, lost[0], redundant, "unique_fails", *lost[1:], "shapley")
