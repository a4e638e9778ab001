"""Scoring rankings, readings and verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_relevant(text: Column, phrases: Column) -> Column:
    low = F.lower(text)
    return F.exists(phrases, lambda p: F.contains(low, F.lower(p)))


def first_relevant(hits: DataFrame, by: Sequence[str], relevant: str = "relevant", rank: str = "rank") -> DataFrame:
    return hits.groupBy(*by).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first_rank"))


def retrieval_scores(first: DataFrame, sets: Sequence[Sequence[str]], rank: str = "first_rank") -> DataFrame:
    """recall_1/3/5 and mrr of questions with their first relevant rank, per grouping set."""
    columns = sorted({c for s in sets for c in s})
    aggs = [F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 3, 5)]
    mrr = F.avg(F.when(F.col(rank) <= 5, 1.0 / F.col(rank)).otherwise(0.0)).alias("mrr")
    return first.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(F.count(F.lit(1)).alias("questions"), *aggs, mrr)


def compare_systems(systems: Mapping[str, DataFrame], questions: DataFrame, passages: DataFrame, key: Sequence[str], limit: int = 5) -> DataFrame:
    """(system, kind, questions, recall_1, recall_3, recall_5, mrr), kind null for all questions.

    ``systems`` has each one's hits (query_id, key, rank), ``questions`` (query_id, kind, relevant)
    and ``passages`` key and text, headings included. A passage with any of a question's phrases
    answers it; questions without such a hit among the first ``limit`` count as missed.
    """
    every = None
    for name, hits in systems.items():
        one = hits.select("query_id", *key, "rank", F.lit(name).alias("system"))
        every = one if every is None else every.unionByName(one)
    judged = every.filter(F.col("rank") <= limit).join(passages.select(*key, "text"), list(key)).join(questions.select("query_id", "relevant"), "query_id")
    found = first_relevant(judged.withColumn("answers", is_relevant(F.col("text"), F.col("relevant"))), ["system", "query_id"], "answers")
    names = questions.sparkSession.createDataFrame([(n,) for n in systems], "system string")
    asked = questions.select("query_id", "kind").join(F.broadcast(names))  # a row a system and question
    first = asked.join(found, ["system", "query_id"], "left")
    return retrieval_scores(first, [["system", "kind"], ["system"]])


def below_floors(scores: DataFrame, floors: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(metric, value, floor) of the rows of ``scores`` that break a floor (condition, metric, floor)."""
    broken = None
    for condition, metric, floor in floors:
        value = F.col(metric).cast("double")
        one = scores.filter(condition).filter(value.isNull() | (value < floor)).select(F.lit(metric).alias("metric"), value.alias("value"), F.lit(float(floor)).alias("floor"))
        broken = one if broken is None else broken.unionByName(one)
    return broken


def precision_recall(correct: Column, extra: Column, missed: Column) -> list[Column]:
    """precision, recall and f1 columns; an empty denominator gives 1."""
    p = F.when(correct + extra == 0, 1.0).otherwise(correct / (correct + extra))
    r = F.when(correct + missed == 0, 1.0).otherwise(correct / (correct + missed))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def multiset_match(found: DataFrame, gold: DataFrame, key: Sequence[str], status: str | None = None) -> DataFrame:
    """One-to-one matches of equal keys: (key, nth, in_found, in_gold), and with ``status`` both of them."""
    w = Window.partitionBy(*key).orderBy(*([status] if status else key))

    def nth(df: DataFrame, side: str) -> DataFrame:
        own = [F.col(status).alias(f"{status}_{side}")] if status else []
        return df.withColumn("nth", F.row_number().over(w)).select(*key, "nth", *own, F.lit(1).alias(f"in_{side}"))

    return nth(found, "found").join(nth(gold, "gold"), [*key, "nth"], "full")


def status_accuracy(matched: DataFrame, status: str = "status") -> DataFrame:
    """(right, matched, status_accuracy): matches whose statuses agree; 0 without a match."""
    both = matched.filter(F.col("in_found").isNotNull() & F.col("in_gold").isNotNull())
    right = F.count_if(F.col(f"{status}_found") == F.col(f"{status}_gold"))
    n = F.count(F.lit(1))
    return both.agg(right.alias("right"), n.alias("matched"), F.when(n == 0, 0.0).otherwise(right / n).alias("status_accuracy"))


def match_counts(matched: DataFrame) -> DataFrame:
    both = F.col("in_found").isNotNull() & F.col("in_gold").isNotNull()
    counts = matched.agg(
        F.count_if(both).alias("correct"), F.count_if(F.col("in_gold").isNull()).alias("extra"), F.count_if(F.col("in_found").isNull()).alias("missed")
    )
    return counts.select("correct", "extra", "missed", *precision_recall(F.col("correct"), F.col("extra"), F.col("missed")))


def fabricate(rows: DataFrame, other_name: str = "Ferritin", wrong_page: Column | None = None) -> DataFrame:
    """Three wrong versions of each model row: another value, a foreign name, a wrong page."""
    wrong_page = F.col("page") + 1000 if wrong_page is None else wrong_page
    value = F.col("value").try_cast("double")
    fakes = F.array(
        F.struct(F.lit("value").alias("fake"), "name", F.format_string("%.2f", value + 0.37).alias("value"), "page"),
        F.struct(F.lit("name").alias("fake"), F.lit(other_name).alias("name"), "value", "page"),
        F.struct(F.lit("page").alias("fake"), "name", "value", wrong_page.cast("int").alias("page")),
    )
    return rows.withColumn("_f", F.explode(fakes)).select(*[c for c in rows.columns if c not in ("name", "value", "page")], "_f.*")


def best_system(scores: DataFrame, system: str = "system", score: str = "mrr") -> DataFrame:
    return scores.agg(F.max_by(system, score).alias(system), F.max(score).alias(score))
