"""Tables that grow by whole segments, and a manifest that says which of them count."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Segments:
    """Folders below ``path``, one for each table and in these one for each segment.

    A segment's files are written first and its manifest rows last, in one small write: a job that
    fails before that, or is repeated, leaves files that nobody reads. Segments never change.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, table: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    @staticmethod
    def new_name() -> str:
        return uuid.uuid4().hex

    def table(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def folder(self, table: str, segment: str) -> str:
        return f"{self.path}/{table}/segment={segment}"

    def create(self, table: str, rows: DataFrame) -> None:
        """Write a table that is fixed with the first segment; an earlier one stays."""
        if not self.has(table):
            rows.coalesce(1).write.mode("ignore").parquet(f"{self.path}/{table}")

    def commit(self, batch: str, segment: str, rows: DataFrame) -> None:
        """From now on ``segment`` is what ``batch`` stands for; ``rows`` are its figures."""
        entry = rows.select(F.lit(batch).alias("batch"), F.lit(segment).alias("segment"), F.lit(time.time_ns()).alias("at"), "*")
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def manifest(self) -> DataFrame:
        """(batch, segment, at, figures) of each batch's last segment."""
        last = F.max(F.struct("at", "segment")).over(Window.partitionBy("batch"))
        return self.table("manifest").withColumn("_last", last).filter(F.col("segment") == F.col("_last.segment")).drop("_last")

    def names(self) -> list[str]:
        """Segments that count; a batch has one."""
        return [r[0] for r in self.manifest().select("segment").distinct().collect()]
