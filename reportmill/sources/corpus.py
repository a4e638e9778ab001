"""Evaluation corpora: reports written as blocks, with their questions and known readings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

BLOCKS = "doc_id string, page int, block_ix int, kind string, level int, text string, rows array<array<string>>"


def blocks(spark: SparkSession, reports: Iterable[Mapping]) -> DataFrame:
    """Block rows of reports: each has an id and pages, lists of ("heading", level, text),
    ("paragraph", text) and ("table", rows).

    Tables have their text as extraction gives it: cells joined by " | ", rows by line ends.
    """
    rows = []
    for report in reports:
        for page, content in enumerate(report["pages"], 1):
            for ix, (kind, *what) in enumerate(content):
                level, text = (what[0], what[1]) if kind == "heading" else (None, what[0])
                table = [list(map(str, r)) for r in text] if kind == "table" else None
                shown = text if table is None else "\n".join(" | ".join(r) for r in table)
                rows.append((report["id"], page, ix, kind, level, shown, table))
    return spark.createDataFrame(rows, BLOCKS)


def questions(spark: SparkSession, reports: Iterable[Mapping]) -> DataFrame:
    """(query_id, doc_id, query, kind, relevant): each report's questions and the phrases that answer them."""
    rows = [(r["id"], *q) for r in reports for q in r["questions"]]
    return spark.createDataFrame([(i, *q) for i, q in enumerate(rows)], "query_id int, doc_id string, query string, kind string, relevant array<string>")


def known_readings(spark: SparkSession, reports: Iterable[Mapping]) -> DataFrame:
    """(doc_id, name, value, status): the results that a report prints."""
    rows = [(r["id"], name, float(value), status) for r in reports for name, value, status in r["labs"]]
    return spark.createDataFrame(rows, "doc_id string, name string, value double, status string")
