"""Judging readings against ranges, and repeat readings as series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import dims
from reportmill.functions import text as T
from reportmill.functions import values as V

#: A printed limit so many times off the typical one is taken for a misreading.
IMPLAUSIBLE = 3.0
OUTSIDE = ("low", "high", "abnormal")


def compare(value: Column, comparator: Column, low: Column, high: Column) -> Column:
    """low, normal, high or unknown; a bounded value only decides where its bound does."""
    plain = F.when(value < low, "low").when(value > high, "high").otherwise("normal")
    below = F.when(low.isNotNull(), F.when(value <= low, "low").otherwise("unknown")).when(
        high.isNotNull(), F.when(value <= high, "normal").otherwise("unknown")
    )
    above = F.when(high.isNotNull(), F.when(value >= high, "high").otherwise("unknown")).when(
        low.isNotNull(), F.when(value >= low, "normal").otherwise("unknown")
    )
    by_sign = F.when(comparator.isNull(), plain).when(comparator.isin("<", "<="), below).otherwise(above)
    return F.coalesce(by_sign, F.lit("unknown"))


def plausible(printed: Column, typical: Column) -> Column:
    off = (printed > typical * IMPLAUSIBLE) | ((printed > 0) & (printed < typical / IMPLAUSIBLE))
    return F.coalesce(~off | (typical <= 0), F.lit(True))


def assess(rows: DataFrame) -> DataFrame:
    """Add analyte, status, range_low, range_high, basis, conflict and doubtful_range.

    Rows have name, value, comparator, unit, printed_range struct(low, high),
    printed_range_text and printed_flag. The report's flag wins, then its own range, then
    the typical range in the same unit.
    """
    known = dims.add_typical(dims.add_analyte(rows))
    low, high = F.col("printed_range.low"), F.col("printed_range.high")
    has_printed = F.col("printed_range").isNotNull()
    use_printed = has_printed & plausible(low, F.col("typical_low")) & plausible(high, F.col("typical_high"))
    has_typical = F.col("has_typical").isNotNull()
    ranged = known.withColumns(
        {
            "range_low": F.when(use_printed, low).otherwise(F.col("typical_low")),
            "range_high": F.when(use_printed, high).otherwise(F.col("typical_high")),
            "basis": F.when(use_printed, "report").when(has_typical, "typical"),
            "doubtful_range": F.when(has_printed & ~use_printed, F.col("printed_range_text")),
        }
    )
    computed = F.when(F.col("basis").isNull(), "unknown").otherwise(compare(F.col("value"), F.col("comparator"), F.col("range_low"), F.col("range_high")))
    flag = F.col("printed_flag")
    status = (
        F.when(flag.isNull(), F.col("computed")).when(flag != "abnormal", flag).when(F.col("computed").isin("low", "high"), F.col("computed")).otherwise("abnormal")
    )
    conflict = flag.isin("low", "high") & (F.col("basis") == "report") & (F.col("computed") != "unknown") & (F.col("computed") != flag)
    out = ranged.withColumn("computed", computed).withColumn("status", status).withColumn("conflict", F.coalesce(conflict, F.lit(False)))
    return out.drop("computed", "typical_low", "typical_high", "has_typical")


def with_result_ids(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add result_id "source:page:index", the index counting a document's rows from 0."""
    ix = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("result_id", F.concat_ws(":", F.col("source"), F.col("page").cast("string"), ix.cast("string")))


def test_key(name: Column, unit: Column, analyte: Column) -> Column:
    """What readings of one test share: the analyte, else name and unit."""
    plain = F.concat(T.normalize_name(name), F.lit("|"), F.when(unit.isNull(), "").otherwise(V.normalize_unit(unit)))
    return F.coalesce(analyte, plain)


def merge(existing: DataFrame, incoming: DataFrame, by: Sequence[str], order: str = "row_ix") -> DataFrame:
    """All existing rows, and the first incoming row of each (page, test, value) not among them."""
    keyed = lambda df: df.withColumn("_test", test_key(F.col("name"), F.col("unit"), dims.find_analyte(F.col("name"))))
    same = [*by, "page", "_test", "value"]
    first = Window.partitionBy(*same).orderBy(order)
    new = keyed(incoming).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    new = new.join(keyed(existing).select(*same).distinct(), same, "left_anti")
    return existing.withColumn("part", F.lit(0)).unionByName(new.drop("_test").withColumn("part", F.lit(1)))


def chronological(date: Column, group: Sequence[str]) -> Column:
    """The date to sort a group by, null for all where any of its dates can't be read."""
    unread = F.count_if(date.isNull()).over(Window.partitionBy(*group))
    return F.when(unread == 0, date)


def series(results: DataFrame, by: Sequence[str], order: str, date: Column, payload: Sequence[str]) -> DataFrame:
    """One row per test of a document: its readings oldest first, and the latest.

    Adds first_ix (groups go by their first reading), n, readings, latest, out_of_range and
    trend (up or down from first to latest; null for one reading).
    """
    group = [*by, "test"]
    when = results.withColumn("_date", chronological(date, group))
    one = F.struct(F.col("_date").alias("day"), F.col(order).alias("ix"), *payload)
    out = when.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("readings"), F.min(order).alias("first_ix"))
    out = out.withColumn("n", F.size("readings")).withColumn("latest", F.element_at("readings", -1))
    first = F.element_at("readings", 1)
    trend = F.when(F.col("n") >= 2, F.when(F.col("latest.value") < first["value"], "down").otherwise("up"))
    outside = F.col("latest.status").isin(*OUTSIDE) if "status" in payload else F.lit(None).cast("boolean")
    return out.withColumn("out_of_range", outside).withColumn("trend", trend)


def flagged_first(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add position: out-of-range series first, each part in its first reading's order."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.coalesce("out_of_range", F.lit(False))), "first_ix")
    return found.withColumn("position", F.row_number().over(w))


def headline(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, flagged, total, pages): counts, and the distinct pages of all readings."""
    each = F.flatten(F.collect_list(F.transform("readings", lambda r: r["page"])))
    return found.groupBy(*by).agg(F.count_if("out_of_range").alias("flagged"), F.count(F.lit(1)).alias("total"), F.array_sort(F.array_distinct(each)).alias("pages"))


def earlier(readings: Column) -> Column:
    return F.slice(readings, F.lit(1), F.size(readings) - 1)
