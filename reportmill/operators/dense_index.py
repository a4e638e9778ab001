"""A stored index of vectors with exact cosine search that reads few cells.

Each vector lies in the cell of the nearest of a fixed set of centroids, and each cell knows the
largest angle between its centroid and a vector in it. Angles obey the triangle inequality, so no
vector of a cell is nearer to a query than the angle to the centroid less that radius. A search
scores each query's most promising cells first, as many as hold the wanted number of vectors; the
score of its last hit there rules out every cell with a lower bound. Cells are folders: those that
no query needs are not read.

Centroids are fitted once, on a bounded sample; every vector is indexed, and what is found does not
depend on them. Vectors come in segments, and an upsert writes those that are new or changed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.functions.vectors import norm
from reportmill.operators import retrieval as R
from reportmill.operators.leaders import nearest_in_tasks
from reportmill.shipping import ship
from reportmill.shared import new_folder
from reportmill.sources.segments import Segments

#: Cells of a new index, vectors that its centroids are fitted on, and rounds of that.
CELLS, SAMPLE, ROUNDS = 64, 4096, 8
#: Angles are computed in floating point; radii get this much on top, and so do bounds of scores.
SLACK = 1e-6
#: The cell of vectors that are zero, whose score is 0 with any other.
ZERO_CELL = -1


def fit_centroids(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means from rows spread over the sample; fewer if there are fewer rows."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors[size[:, 0] > 0] / size[size[:, 0] > 0]
    centres = np.unique(unit[:: max(1, len(unit) // cells)][:cells], axis=0)
    for _ in range(ROUNDS if len(centres) else 0):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _angles(centres: np.ndarray, vectors: pa.Array) -> np.ndarray:
    """Angles between vectors and centroids, NaN for zero vectors."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    if len(vectors) and len(flat) != len(vectors) * centres.shape[1]:
        raise ValueError("vectors differ in length")
    rows = flat.reshape(len(vectors), centres.shape[1])
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.arccos(np.clip(rows @ centres.T / length, -1, 1))


class DenseIndex(Segments):
    """See the module. Keys are distinct; vectors of one index have one length."""

    def __init__(self, spark: SparkSession, path: str, key: str, cells: int = CELLS):
        super().__init__(spark, path)
        self.key, self._cells = key, cells

    def _centres(self, rows: DataFrame | None = None) -> np.ndarray:
        """The stored centroids; with ``rows``, fitted on the :data:`SAMPLE` rows whose keys have the least hashes if there are none."""
        if rows is not None and not self.has("centroids"):
            sample = rows.orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE).select("vector").collect()
            found = fit_centroids(np.array([r[0] for r in sample], np.float64), self._cells)
            width = len(sample[0][0])
            stored = [(i, list(map(float, c))) for i, c in enumerate(found)] or [(0, [1.0] + [0.0] * (width - 1))]
            self.create("centroids", self.spark.createDataFrame(stored, "cell int, centroid array<double>"))
        return np.array([r["centroid"] for r in self.table("centroids").orderBy("cell").collect()])

    def _live(self) -> DataFrame:
        """(key, vector, size, digest, cell, segment) of every key's last version."""
        every = self.table("vectors").filter(F.col("segment").isin(self.names()))
        figures = self.manifest().select("segment", "at", "n_replaced").distinct().collect()
        if not any(r["n_replaced"] for r in figures):
            return every
        when = self.spark.createDataFrame([(r["segment"], r["at"]) for r in figures], "segment string, at bigint")
        replaced = self.table("replaced").join(F.broadcast(when), "segment").groupBy("key").agg(F.max("at").alias("since"))
        dated = every.join(F.broadcast(when), "segment").join(replaced.withColumnRenamed("key", self.key), self.key, "left")
        return dated.filter(F.col("since").isNull() | (F.col("at") >= F.col("since"))).drop("at", "since")

    def upsert(self, rows: DataFrame) -> int:
        """Take (key, vector) rows whose key is new or whose vector has changed; return their number.

        Nothing is written if there are none, so this may be repeated. Rows without a vector or a
        key are left out, and of rows that repeat a key the greatest vector stays.
        """
        ship(self.spark)
        vector = F.col("vector").cast("array<float>")
        given = rows.filter(F.col("vector").isNotNull() & F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(vector).alias("vector"))
        given = given.withColumn("digest", F.xxhash64("vector"))
        first = not self.has("manifest")
        known = None if first else self._live().select(self.key, "digest")
        path = new_folder(self.spark, "upsert")
        (given if first else given.join(known, [self.key, "digest"], "left_anti")).write.parquet(path)
        new = self.spark.read.parquet(path)
        n = new.count()
        if not n:
            return 0
        centres = self._centres(new)

        @F.arrow_udf("struct<cell:int,angle:double>")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                angles = _angles(centres, vectors)
                zero = np.isnan(angles[:, 0]) if len(angles) else np.zeros(0, bool)
                best = np.where(zero, 0, np.nan_to_num(angles, nan=9).argmin(1)) if len(angles) else np.zeros(0, int)
                at = np.where(zero, ZERO_CELL, best).astype(np.int32)
                yield pa.StructArray.from_arrays([pa.array(at), pa.array(np.where(zero, 0.0, angles[np.arange(len(best)), best]))], ["cell", "angle"])

        segment = self.new_name()
        placed = new.withColumn("size", norm(F.col("vector"))).withColumn("_at", nearest("vector"))
        placed = placed.select("*", "_at.*").drop("_at")
        placed.repartitionByRange("cell", self.key).sortWithinPartitions("cell").write.partitionBy("cell").parquet(self.folder("vectors", segment))
        replaced = new.select(F.col(self.key).alias("key")) if first else new.join(known, self.key, "left_semi").select(F.col(self.key).alias("key"))
        replaced = replaced.limit(0) if first else replaced
        replaced.write.parquet(self.folder("replaced", segment))
        n_replaced = self.spark.read.parquet(self.folder("replaced", segment)).count()
        figures = self.spark.read.parquet(self.folder("vectors", segment)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), (F.max("angle") + SLACK).alias("radius"))
        self.commit(segment, segment, figures.withColumn("n_replaced", F.lit(n_replaced)))
        return n

    def _judged(self, queries: DataFrame) -> DataFrame:
        """(query_id, cell, n, bound): the highest score that a vector of the cell may have with the query."""
        ship(self.spark)
        centres = self._centres()

        @F.arrow_udf("array<double>")
        def angles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                yield pa.array(list(_angles(centres, vectors)), pa.list_(pa.float64()))

        cells = self.manifest().groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        asked = queries.select("query_id", F.posexplode(angles(F.col("vector").cast("array<float>"))).alias("cell", "angle"))
        near = asked.join(F.broadcast(cells), "cell")  # one row for each cell
        bound = F.when(F.isnan("angle"), 0.0).otherwise(F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0))))
        zero = queries.select("query_id").join(F.broadcast(cells.filter(F.col("cell") == ZERO_CELL)), F.lit(True)).select("query_id", "cell", "n", F.lit(0.0).alias("bound"))
        return near.select("query_id", "cell", "n", bound.alias("bound")).unionByName(zero).withColumn("bound", F.col("bound") + SLACK)

    def _scored(self, queries: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
        """(query_id, key, score, rank) of the best vectors of given (query_id, cell) rows, of which the query set is a block."""
        each = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each cell
        rows = self._live().filter(F.col("cell").isin([r["cell"] for r in each]))
        sizes = {r["cell"]: r["n"] for r in self.manifest().groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        met = sum(r["n"] * sizes[r["cell"]] for r in each)  # pairs, dealt out as if all queries met as many
        return R.ranked(nearest_in_tasks(rows, queries, self.key, limit, cells=pairs, pairs=met), self.key, limit, ["query_id"])

    def _plan(self, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """Hits in each query's first cells, and all its cells with ``seed`` and ``needed``."""
        by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
        before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        judged = self._written(self._judged(queries).withColumn("seed", before < limit))
        first = self._written(self._scored(queries, judged.filter("seed"), limit))
        least = first.filter(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
        needed = ~F.col("seed") & (F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return first, judged.join(least, "query_id", "left").withColumn("needed", needed)

    def _written(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "search")
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def search(self, queries: DataFrame, limit: int = R.DEFAULT_LIMIT) -> DataFrame:
        """(query_id, key, score, rank): the same hits as :func:`retrieval.dense` over all vectors.

        The stated queries (query_id, vector) are counted and go in blocks, as there. A window over
        a query's cells has a row for each cell; hits of cells are ranked in the tasks first.
        """
        if not self.has("manifest"):
            raise ValueError("nothing is indexed yet")
        blocks = max(1, -(-queries.count() // R.QUERY_BLOCK))
        found: list[DataFrame] = []
        for i in range(blocks):
            part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            first, judged = self._plan(part, limit)
            rest = self._scored(part, judged.filter("needed"), limit)
            found.append(R.ranked(first.drop("rank").unionByName(rest.drop("rank")), self.key, limit, ["query_id"]))
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return out

    def effort(self, queries: DataFrame, limit: int = R.DEFAULT_LIMIT) -> DataFrame:
        """(query_id, vectors, scored): all vectors, and those in the cells that a query's search scores."""
        _, judged = self._plan(queries, limit)
        scored: Column = F.when(F.col("seed") | F.col("needed"), F.col("n")).otherwise(0)
        return judged.groupBy("query_id").agg(F.sum("n").alias("vectors"), F.sum(scored).alias("scored"))
