"""Tables of documents and vectors, and what is read from and written to files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import text as T

#: Largest upload in bytes, and what a report file is (fixed values).
MOST_BYTES = 25 * 1024 * 1024


def admission(path: Column, length: Column) -> Column:
    """Why a file is not taken, or null: not a PDF, empty, or too large."""
    return F.when(~F.lower(path).endswith(".pdf"), "type").when(length == 0, "empty").when(length > MOST_BYTES, "size")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, length, content, problem) of the files below a folder.

    ``doc_id`` is made of name and size. The content column is only read where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(T.document_key(name, F.col("length")).alias("doc_id"), "path", "length", "content", admission(F.col("path"), F.col("length")).alias("problem"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Text items that another tool has extracted, as Parquet or JSON lines."""
    from reportmill.operators.layout import ITEM_SCHEMA

    if path.rstrip("/").endswith((".json", ".jsonl", ".ndjson")):
        return spark.read.schema(ITEM_SCHEMA).json(path)
    return spark.read.schema(ITEM_SCHEMA).parquet(path)


class VectorStore:
    """Vectors of passages as Parquet, one partition per document key and model."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def put(self, rows: DataFrame) -> None:
        """Write (doc_key, chunk_id, vector, ...); a document's earlier rows are replaced."""
        out = rows.withColumn("vector", F.col("vector").cast("array<float>")).repartition("doc_key")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_key").parquet(self._path)

    def read(self, doc_key: str | None = None) -> DataFrame:
        rows = self._spark.read.parquet(self._path)
        return rows if doc_key is None else rows.filter(F.col("doc_key") == doc_key)

    def has(self, doc_key: str) -> bool:
        return not self.read(doc_key).limit(1).isEmpty()


def missing_texts(texts: DataFrame, cached: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of distinct texts without a cached vector."""
    keyed = texts.select(T.cache_key(F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return keyed.join(cached.select("key"), "key", "left_anti")


def absent_documents(docs: DataFrame, indexed: DataFrame, key: str = "doc_key") -> DataFrame:
    return docs.join(indexed.select(key).distinct(), key, "left_anti")


def embed(rows: DataFrame, embedder, text: str = "text", batch: int = 8) -> DataFrame:
    """Add ``vector`` by a plug-in ``embedder(list of texts) -> list of float lists``.

    The plug-in is made once a task by calling ``embedder`` without arguments if it is a
    class; texts go to it ``batch`` at a time.
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embedder() if isinstance(embedder, type) else embedder
        for texts in batches:
            every = texts.to_pylist()
            found = [v for i in range(0, len(every), batch) for v in model(every[i : i + batch])]
            yield pa.array(found, pa.list_(pa.float32()))

    return rows.withColumn("vector", run(F.col(text)))


def write_events(lines: DataFrame, path: str) -> None:
    """Event lines (column ``line``) as NDJSON text files."""
    lines.select("line").write.text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def markdown_table(df: DataFrame, most_rows: int = 200) -> str:
    """A small aggregate as a Markdown table; refuses more than ``most_rows`` rows."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("a report table is for small aggregates")
    head = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows])
