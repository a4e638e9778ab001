"""Reading test results from table rows by what their cells look like.

Every cell is judged once; a row is then a fold over its judged cells, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import dims
from reportmill.functions import text as T
from reportmill.functions import values as V

MOST_NAME = 60
_PARSED = "struct<value:double,text:string,comparator:string,flag:string,unit:string>"
_STATE = f"struct<name:string,parsed:{_PARSED},unit:string,date:string,range_text:string,flag:string>"


def judged(cells: Column) -> Column:
    """What each cell of a row may be, as an array of structs; every judgement is made once."""
    return F.transform(cells, lambda raw, ix: T.let(T.trim_ws(raw), lambda t: _judge(t, ix)))


def _judge(t: Column, ix: Column) -> Column:
    # values, ranges and dates have a digit; a whole number is nothing but a value
    digit, whole_number = t.rlike("[0-9]"), t.rlike(r"^[0-9]{1,15}\z")
    none = F.lit(None).cast("string")
    number = F.struct(t.cast("double").alias("value"), t.alias("text"), none.alias("comparator"), none.alias("flag"), none.alias("unit"))
    more = digit & ~whole_number
    looks = F.struct(
        F.when(whole_number, number).when(digit, V.parse_value(t)).alias("parsed"),
        (more & V.is_date_like(t)).alias("is_date"),
        (more & V.parse_range(t).isNotNull()).alias("is_range"),
        (~whole_number & V.looks_like_unit(t)).alias("is_unit"),
        F.when(~whole_number, V.parse_flag(t)).alias("flag"),
    )

    def named(c: Column) -> Column:
        letters = F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 2
        is_name = letters & ~(c["is_date"] | c["flag"].isNotNull() | c["is_unit"] | c["is_range"])
        both = F.when(is_name & digit & t.rlike(V.NAME_THEN_VALUE), V.split_name_and_value(t))
        return T.let(F.struct(is_name.alias("is_name"), both.alias("both")), lambda n: whole(c, n))

    def whole(c: Column, n: Column) -> Column:
        kept = [c[x].alias(x) for x in ("parsed", "is_date", "is_range", "is_unit", "flag")]
        name = F.coalesce(n["both"]["name"], V.clean_name(t))
        return F.struct(ix.alias("ix"), t.alias("text"), *kept, n["is_name"].alias("is_name"), name.alias("name"), n["both"]["parsed"].alias("split_parsed"))

    return T.let(looks, named)


def _fold(cells: Column) -> Column:
    """Walk the cells: the name, then the first value after it, then what goes with it."""
    none = F.lit(None)
    start = F.struct(*(none.cast(kind).alias(n) for n, kind in (("name", "string"), ("parsed", _PARSED), ("unit", "string"), ("date", "string"), ("range_text", "string"), ("flag", "string")))).cast(_STATE)

    def state(a: Column, **new: Column) -> Column:
        return F.struct(*(new.get(n, a[n]).alias(n) for n in ("name", "parsed", "unit", "date", "range_text", "flag"))).cast(_STATE)

    def step(a: Column, c: Column) -> Column:
        text, named = c["text"], a["name"].isNotNull()
        leading = (
            F.when(named & c["parsed"].isNotNull(), state(a, parsed=c["parsed"]))
            .when(c["is_date"], state(a, date=F.coalesce(a["date"], text)))
            .when(named & c["is_range"], state(a, range_text=F.coalesce(a["range_text"], text)))
            .when(named & c["is_unit"], state(a, unit=F.coalesce(a["unit"], text)))
            .when(c["is_name"], state(a, name=c["name"], parsed=c["split_parsed"]))
            .otherwise(a)
        )
        trailing = (
            F.when(a["unit"].isNull() & c["is_unit"], state(a, unit=text))
            .when(a["flag"].isNull() & c["flag"].isNotNull(), state(a, flag=c["flag"]))
            .when(a["range_text"].isNull() & c["is_range"], state(a, range_text=text))
            .when(a["date"].isNull() & c["is_date"], state(a, date=text))
            .otherwise(a)
        )
        return F.when(text == "", a).when(a["parsed"].isNull(), leading).otherwise(trailing)

    return F.aggregate(cells, start, step)


def _finish(read: DataFrame, keep: list[str]) -> DataFrame:
    """Results from folded rows; labels beside numbers and vital signs are none."""
    s, rng = F.col("state"), F.col("state_range")
    read = read.withColumn("state_range", F.explode(F.array(V.parse_range(s["range_text"]))))
    unit = F.coalesce(s["parsed"]["unit"], s["unit"], rng["unit"])
    rows = read.select(
        *keep,
        s["name"].alias("name"),
        s["parsed"]["value"].alias("value"),
        s["parsed"]["text"].alias("value_text"),
        s["parsed"]["comparator"].alias("comparator"),
        unit.alias("unit"),
        F.coalesce(s["date"], F.col("header_date")).alias("date"),
        F.when(rng.isNotNull(), F.struct(rng["low"].alias("low"), rng["high"].alias("high"))).alias("printed_range"),
        F.when(rng.isNotNull(), s["range_text"]).alias("printed_range_text"),
        F.coalesce(s["parsed"]["flag"], s["flag"]).alias("printed_flag"),
        F.lit("table").alias("source"),
    )
    ok = F.col("name").isNotNull() & F.col("value").isNotNull() & (F.length("name") <= MOST_NAME) & ~dims.is_vital_sign(F.col("name"))
    known = dims.find_analyte(F.col("name")).isNotNull() | F.col("unit").isNotNull() | F.col("printed_range").isNotNull()
    return rows.filter(ok & known)


def read_tables(blocks: DataFrame) -> DataFrame:
    """Results of all table blocks, one row each, in the order of row_ix and reading.

    A header row with two dates or more and no result makes columns per date: rows of its
    width below give one reading per date column, with the cells that are under no date.
    """
    keys = ["doc_id", "page", "block_ix"]
    rows = blocks.filter(F.col("kind") == "table").select(*keys, F.posexplode("rows").alias("row_ix", "raw"))
    whole = rows.select(*keys, "row_ix", F.size("raw").alias("width"), F.explode(F.array(judged(F.col("raw")))).alias("cells"))
    dates = F.transform(F.filter("cells", lambda c: c["is_date"]), lambda c: F.struct(c["ix"].alias("ix"), c["text"].alias("text")))
    may_head = ~F.exists("cells", lambda c: c["parsed"].isNotNull()) & (F.size(dates) >= 2)
    first = Window.partitionBy(*keys).orderBy("row_ix").rowsBetween(Window.unboundedPreceding, -1)
    upto = whole.withColumn("head", F.when(may_head, F.struct("row_ix", "width", dates.alias("dates"))))
    upto = upto.withColumn("above", F.first("head", ignorenulls=True).over(first))
    upto = upto.filter(F.col("above").isNotNull() | F.col("head").isNull())
    split = F.col("above").isNotNull() & (F.col("above.width") == F.col("width"))
    plain = F.array(F.struct(F.lit(-1).alias("ix"), F.lit(None).cast("string").alias("text")))
    each = upto.select(*keys, "row_ix", "cells", "above", split.alias("split"), F.posexplode(F.when(split, F.col("above.dates")).otherwise(plain)).alias("reading", "col"))
    others = F.transform("above.dates", lambda d: d["ix"])
    used = F.when(F.col("split"), F.filter("cells", lambda c: (c["ix"] == F.col("col.ix")) | ~F.array_contains(others, c["ix"]))).otherwise(F.col("cells"))
    # exploding one element keeps later filters from working the fold out again
    folded = each.withColumn("state", F.explode(F.array(_fold(used)))).withColumn("header_date", F.col("col.text"))
    return _finish(folded, [*keys, "row_ix", "reading"])
