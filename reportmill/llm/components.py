"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Tasks of a round at least, and edges of each. A round has few edges towards the end, and a task
#: for each of the session's partitions would leave more files than rows.
LEAST_TASKS, EDGES_A_TASK = 8, 200_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node beside it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of integers -> (node, root): the smallest node that each one reaches.

    Roots themselves have no row, nor have nodes without edges; null ends and loops are
    dropped. Each round is written to the shared checkpoint folder, so a lost executor
    costs one round at most; only two numbers a round reach the driver.
    """
    now = cut(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(mark).first()
    while before[0][0]:
        tasks = max(LEAST_TASKS, -(-before[0][0] // EDGES_A_TASK))
        now = cut(_small_star(_large_star(now.coalesce(tasks), tasks), tasks))
        after = now.agg(mark).first()
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
