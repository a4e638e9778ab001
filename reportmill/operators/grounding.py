"""Keeping of machine-read results only what the cited page says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.functions import values as V


def page_texts(passages: DataFrame) -> DataFrame:
    """(doc_id, page, page_text): texts of the passages that cover a page, in order.

    Passages are spread over the pages they span, so the join on pages is an equality.
    """
    rows = passages.select("doc_id", F.explode(F.sequence("page", "end_page")).alias("page"), F.struct("chunk_ix", "text").alias("part"))
    parts = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"])
    return rows.groupBy("doc_id", "page").agg(T.for_matching(F.array_join(parts, " ")).alias("page_text"))


def _all_there(text: Column, printed: Column) -> Column:
    numbers = F.regexp_extract_all(printed, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.forall(numbers, lambda n: T.contains_number(text, n))


def ground(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """Every model row with ``kept`` and what the page supports of it.

    Name and value must stand on the page; a range or date that does not is stripped, a unit
    must look like one, and the flag is taken as given.
    """
    on_page = rows.join(page_texts(passages), ["doc_id", "page"], "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    text, parsed = F.col("page_text"), V.parse_value(F.col("value"))
    words = T.normalize_name(text)
    named = F.exists(T.name_forms(F.col("name")), lambda f: F.contains(words, f))
    number = F.translate(F.regexp_replace(parsed["text"], rf"^(?:[<>=\x{{2264}}\x{{2265}}]|{T.WS})+", ""), "−", "-")
    rng = V.parse_range(F.col("reference_range"))
    range_ok = rng.isNotNull() & _all_there(text, F.col("reference_range"))
    unit = F.coalesce(parsed["unit"], F.col("unit"))
    date_ok = F.contains(text, T.for_matching(T.trim_ws(F.col("date"))))
    kept = parsed.isNotNull() & named & T.contains_number(text, number)
    return on_page.select(
        "doc_id",
        "page",
        T.trim_ws(F.col("name")).alias("name"),
        parsed["value"].alias("value"),
        parsed["text"].alias("value_text"),
        parsed["comparator"].alias("comparator"),
        F.when(V.looks_like_unit(unit), unit).alias("unit"),
        F.when(date_ok, F.col("date")).alias("date"),
        F.when(range_ok, F.struct(rng["low"].alias("low"), rng["high"].alias("high"))).alias("printed_range"),
        F.when(range_ok, F.col("reference_range")).alias("printed_range_text"),
        F.coalesce(parsed["flag"], V.parse_flag(F.col("flag"))).alias("printed_flag"),
        F.lit("model").alias("source"),
        F.coalesce(kept, F.lit(False)).alias("kept"),
    )


def kept_and_discarded(grounded: DataFrame, by: list[str]) -> DataFrame:
    return grounded.groupBy(*by).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("discarded"))
