"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.shipping import ship

#: ASCII white space as a Java character class body, and words as what lies between.
SPACE = r"\x20\x09-\x0D"
#: White space beyond ASCII and Latin-1.
WIDE_SPACE = "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Arrow batches handed to Python: at most this many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not follow text lengths."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none.

    A cluster has to name one. Only a session within one machine may do without: its folder is
    below the warehouse then.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names near ``wanted`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(column: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space, without making them."""
    marked = F.regexp_replace(column, f"[{SPACE}]*+[^{SPACE}]++", "x")
    return F.length(F.regexp_replace(marked, f"[{SPACE}]++", "")).cast("long")


def add_sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, by name, the sum of a whole number over all rows before, in a total ``order``.

    Ranges of rows are sorted and summed apart; only the ranges' totals meet in one task.
    """
    (part,) = free_name(df, "range_part")
    ranged = df.withColumns({f"_of_{n}": c.cast("long") for n, c in sums.items()})
    ranged = cut(ranged.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    parts = ranged.groupBy(part).agg(*(F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(part, *(F.coalesce(F.sum(f"_all_{n}").over(upto), F.lit(0)).alias(f"_off_{n}") for n in sums))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(inside), F.lit(0)) for n in sums}).join(offsets, part)
    return joined.withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in sums}).select(*df.columns, *sums)


def sums_before(sums: DataFrame, by: list[str], at: str, value: str, out: str, bits: int, level: int = 12) -> DataFrame:
    """(by, at, value) rows -> (by, at, out): the sum of values at smaller ``at`` of a group.

    ``at`` has ``bits`` bits and is distinct in a group. Sums go up by levels of 2**level places,
    so that no task holds more than one level of a group, however large it is.
    """
    if bits <= level:
        upto = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*by, at, F.coalesce(F.sum(value).over(upto), F.lit(0)).alias(out))
    up = f"_up{bits}"
    rows = sums.withColumn(up, F.shiftright(at, level))
    above = rows.groupBy(*by, up).agg(F.sum(value).alias("_sum"))
    above = sums_before(above, by, up, "_sum", "_above", bits - level, level)
    upto = Window.partitionBy(*by, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(upto), F.lit(0)))
    return inside.join(above, [*by, up]).select(*by, at, (F.col("_above") + F.col("_inside")).alias(out))


def parts_for(df: DataFrame, size: Column, each: int = 32 << 20) -> int:
    """How many partitions of about ``each`` bytes the rows of ``df`` fill, at least the session's number."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))
