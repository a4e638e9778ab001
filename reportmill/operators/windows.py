"""Windows that start at a key's first request after the last window, found by pointer doubling.

A window's start depends on the one before, so starts form a chain: each time points at the first
time of its key a window's length later, and the starts are what the key's first time reaches. The
chain is not walked. Round k knows where 2^k steps lead from every time, so it doubles the starts
found so far, and a key with n windows takes log n rounds of joins by equality, spread over all
tasks. Nothing needs a key's requests together: what is a window's length later lies in the next
stretch of time of that length, or is the first time of the next stretch that has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.shared import new_folder

#: Stands for the time of requests without one, in microseconds: before all others.
NO_TIME = -(1 << 61)


def written(df: DataFrame) -> DataFrame:
    """The rows of a table that several steps read, from the shared folder."""
    path = new_folder(df.sparkSession, "windows")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _stretch(at: str, span: int) -> Column:
    """The number of a time's stretch, in whole numbers, downwards also before 1970."""
    return F.expr(f"({at} - pmod({at}, {span}L)) div {span}L")


def _next_times(times: DataFrame, span: int) -> DataFrame:
    """(k, at) -> (k, at, to): the first time of the key at or after ``at + span``, where there is one.

    A search in the next stretch meets its times in one sorted pass over both; times are distinct,
    so a stretch has no more than its length in microseconds.
    """
    placed = times.withColumn("stretch", _stretch("at", span))
    sought = placed.select("k", (F.col("stretch") + 1).alias("stretch"), (F.col("at") + span).alias("when"), F.col("at").alias("asks"))
    there = placed.select("k", "stretch", F.col("at").alias("when"), F.lit(None).cast("long").alias("asks"))
    ahead = Window.partitionBy("k", "stretch").orderBy(F.desc("when")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = sought.unionByName(there)
    near = both.withColumn("near", F.min(F.when(F.col("asks").isNull(), F.col("when"))).over(ahead)).filter(F.col("asks").isNotNull())
    firsts = placed.groupBy("k", "stretch").agg(F.min("at").alias("first"))
    # a row for each key and stretch with requests
    later = Window.partitionBy("k").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    marks = firsts.unionByName(near.filter(F.col("near").isNull()).select("k", "stretch").distinct().withColumn("first", F.lit(None).cast("long")))
    marks = marks.groupBy("k", "stretch").agg(F.min("first").alias("first"))
    beyond = marks.select("k", "stretch", F.min("first").over(later).alias("beyond"))
    found = near.join(beyond, ["k", "stretch"], "left").withColumn("to", F.coalesce("near", "beyond"))
    return found.filter(F.col("to").isNotNull()).select("k", F.col("asks").alias("at"), "to")


def window_starts(times: DataFrame, span: int) -> DataFrame:
    """(k, at) distinct rows -> (k, at) of the times at which a window of ``span`` microseconds starts.

    Each round is written to the shared folder; one number of it reaches the driver.
    """
    times = written(times)
    starts = written(times.groupBy("k").agg(F.min("at").alias("at")))
    steps = written(_next_times(times, span))
    while not steps.isEmpty():
        reached = starts.join(steps, ["k", "at"]).select("k", F.col("to").alias("at"))
        starts = written(starts.unionByName(reached))  # no two starts lead to one: windows follow each other
        twice = steps.join(steps.select("k", F.col("at").alias("to"), F.col("to").alias("on")), ["k", "to"])
        steps = written(twice.select("k", "at", F.col("on").alias("to")))
    return starts


def fixed_windows(requests: DataFrame, key: list[str], order: list[str], cap: Column, span: int, at: str = "ts") -> DataFrame:
    """Add window_start, nth and allowed (nth up to ``cap``) to requests; ``span`` in microseconds.

    A key has one start in a stretch of time at most, so a request finds its window in its own
    stretch or the one before, by equality. Null keys are a key. Requests without a time share a
    window of their own, whose start is null. Requests of one time go by ``order``; the requests of
    one window are numbered in one sorted pass.
    """
    own = requests.withColumns({"_k": F.struct(F.lit(0).alias("_"), *key), "_at": F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NO_TIME)), "_cap": cap})
    own = own.withColumn("_stretch", _stretch("_at", span))
    starts = window_starts(own.select(F.col("_k").alias("k"), F.col("_at").alias("at")).distinct(), span)
    stretch = _stretch("at", span)
    both = starts.select("k", stretch.alias("stretch"), F.col("at").alias("here"), F.lit(None).cast("long").alias("before"))
    both = both.unionByName(starts.select("k", (stretch + 1).alias("stretch"), F.lit(None).cast("long").alias("here"), F.col("at").alias("before")))
    near = both.groupBy("k", "stretch").agg(F.max("here").alias("_here"), F.max("before").alias("_before"))
    near = near.withColumnsRenamed({"k": "_k", "stretch": "_stretch"})
    placed = own.join(near, ["_k", "_stretch"]).withColumn("_start", F.when(F.col("_here") <= F.col("_at"), F.col("_here")).otherwise(F.col("_before")))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("_k", "_start").orderBy("_at", *order)))
    start = F.when(F.col("_start") != NO_TIME, F.timestamp_micros("_start"))
    return numbered.select(*requests.columns, "nth", (F.col("nth") <= F.col("_cap")).alias("allowed"), start.alias("window_start"))
