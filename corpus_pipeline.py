"""Documents to training tokens in five stages, each with one operator of ``reportmill.llm``.

Every stage is written as Parquet in the shared folder and read again, so a lost executor
costs the current stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import bpe, line_dedup, mixing, quality, simhash_bands
from reportmill.llm.common import new_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose fertility is in their script's band.

    Null, empty and short texts fail the base rules and go; repeated rows fare alike.
    """
    return quality.keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of whole line runs; n_chars is counted anew.

    Null texts stay null (n_chars null); rows equal in key and text are one document.
    """
    done = line_dedup.dedup_lines(docs, whole_runs=True).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of texts alike by 0.8 in their five-word shingles.

    Null, empty and blank texts are one class; rows without a key stay; rows that repeat a kept
    key stay together.
    """
    return simhash_bands.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, in its order: a row for each pass that takes words of a document.

    Null and empty texts have no words and go; null sources are a source.
    """
    return mixing.take(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row of the mix.

    Null and empty texts have no tokens; every row stays.
    """
    done = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return done.select("doc_id", "source", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: SQL can't run the tokenisers of the first and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
