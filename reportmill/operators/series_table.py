"""Series of repeat readings as figures that add up: counts, first and latest reading, pages.

A part of the results gives a row for each series, and rows of parts merge by sums, minima and
maxima, so new results never meet the old ones, only their figures. No group of readings is held
anywhere: what is kept of a series has a fixed size, but for the pages, which are rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.operators.assess import OUTSIDE
from reportmill.sources.segments import Segments

#: How each figure of two parts becomes that of both.
MERGED = {"n": F.sum, "unread": F.sum, "first_ix": F.min, "first_dated": F.min, "last_dated": F.max, "first_placed": F.min, "last_placed": F.max}


def summarize(results: DataFrame, by: Sequence[str], order: str, date: Column, payload: Sequence[str]) -> DataFrame:
    """(by, test, figures) of some results.

    ``order`` is a result's place in its document. First and last are kept by date and by place, as
    one date that can't be read makes a whole series go by place, and other parts may have it.
    """
    placed = F.struct(F.col(order).alias("ix"), *payload)
    dated = F.struct(date.alias("day"), F.col(order).alias("ix"), *payload)
    each = {"n": F.lit(1).cast("long"), "unread": date.isNull().cast("long"), "first_ix": F.col(order), "first_dated": dated, "last_dated": dated, "first_placed": placed, "last_placed": placed}
    rows = results.select(*by, "test", *(c.alias(n) for n, c in each.items()))
    return merged(rows, by)


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of :func:`summarize` of any number of parts -> one for each series."""
    return parts.groupBy(*by, "test").agg(*(f(n).alias(n) for n, f in MERGED.items()))


def finished(figures: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, test, n, first_ix, first, latest, out_of_range, trend), as :func:`assess.series` has them."""
    kept = [x for x in figures.schema["first_placed"].dataType.names]
    pick = lambda end: F.when(F.col("unread") == 0, F.struct(*(F.col(f"{end}_dated.{c}").alias(c) for c in kept))).otherwise(F.col(f"{end}_placed"))
    out = figures.select(*by, "test", "n", "first_ix", pick("first").alias("first"), pick("last").alias("latest"))
    trend = F.when(F.col("n") >= 2, F.when(F.col("latest.value") < F.col("first.value"), "down").otherwise("up"))
    outside = F.col("latest.status").isin(*OUTSIDE) if "status" in kept else F.lit(None).cast("boolean")
    return out.withColumn("out_of_range", outside).withColumn("trend", trend)


def headline(found: DataFrame, pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, flagged, total, pages) of finished series and (by, page) rows; pages are distinct before they meet."""
    counts = found.groupBy(*by).agg(F.count_if("out_of_range").alias("flagged"), F.count(F.lit(1)).alias("total"))
    listed = pages.select(*by, "page").distinct().groupBy(*by).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    same = [counts[c].eqNullSafe(listed[c]) for c in by]
    return counts.join(listed, same, "left").select(*(counts[c] for c in by), "flagged", "total", F.coalesce("pages", F.array().cast(listed.schema["pages"].dataType)).alias("pages"))


class SeriesTable(Segments):
    """Figures of all results so far, a segment for each batch; a batch that comes again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str]):
        super().__init__(spark, path)
        self.by = list(by)

    def add(self, results: DataFrame, batch: str, order: str, date: Column, payload: Sequence[str]) -> None:
        """Take a batch of results with ``test`` and ``page``. Older batches are not read."""
        segment = self.new_name()
        summarize(results, self.by, order, date, payload).write.parquet(self.folder("figures", segment))
        results.select(*self.by, "page").distinct().write.parquet(self.folder("pages", segment))
        self.commit(batch, segment, self.spark.range(1).select(F.lit(0).alias("rows")))

    def _all(self, table: str) -> DataFrame:
        return self.table(table).filter(F.col("segment").isin(self.names())).drop("segment")

    def series(self) -> DataFrame:
        return finished(merged(self._all("figures"), self.by), self.by)

    def headline(self) -> DataFrame:
        return headline(self.series(), self._all("pages"), self.by)
