"""Tables to readings, judging, series, merging and grounding."""

import pytest
from pyspark.sql import functions as F

from reportmill.operators import assess as A
from reportmill.operators import evaluation as E
from reportmill.operators import grounding, lab_tables

SCHEMA = "doc_id string, page int, block_ix int, kind string, rows array<array<string>>"


def table(spark, *rows):
    return lab_tables.read_tables(spark.createDataFrame([("d", 2, 0, "table", [list(r) for r in rows])], SCHEMA)).orderBy("row_ix", "reading").collect()


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (("1", "Lactate", "08 - Oct - 2015", "6.1", "mmol/L"), ("Lactate", 6.1, "mmol/L", "08 - Oct - 2015")),
        (("10 AST", "14 - Oct - 2015", "70", "IU/L"), ("AST", 70.0, "IU/L", "14 - Oct - 2015")),
        (("Sodium", "135 - 145", "mmol/L", "140"), ("Sodium", 140.0, "mmol/L", None)),
        (("Hemoglobin 13.2 g/dL", "12.0-16.0"), ("Hemoglobin", 13.2, "g/dL", None)),
        (("Potassium", "Serum", "5.9", "mmol/L"), ("Serum", 5.9, "mmol/L", None)),
    ],
)
def test_rows(spark, cells, want):
    (r,) = table(spark, cells)
    assert (r["name"], r["value"], r["unit"], r["date"]) == want


@pytest.mark.parametrize("cells", [("Visit Number:", "11186424686"), ("SpO2", "96", "%"), ("Heart rate", "80", "bpm"), ("", ""), ("Name", "Doe")])
def test_no_results(spark, cells):
    assert table(spark, cells) == []


def test_columns_by_date(spark):
    got = table(spark, ("Test", "12-Mar-2026", "19-Mar-2026", "Units"), ("ALT", "90", "70", "IU/L"), ("INR", "1.1", "", ""))
    assert [(r["name"], r["value"], r["date"]) for r in got] == [("ALT", 90.0, "12-Mar-2026"), ("ALT", 70.0, "19-Mar-2026"), ("INR", 1.1, "12-Mar-2026")]


def test_ranges_and_flags_after_the_value(spark):
    (r,) = table(spark, ("Potassium", "5.8", "H", "3.5-53", "mmol/L"))
    assert (r["printed_flag"], r["printed_range_text"], r["printed_range"]["high"]) == ("high", "3.5-53", 53.0)


RESULT = "doc_id string, row_ix int, name string, value double, comparator string, unit string, printed_range struct<low:double,high:double>, printed_range_text string, printed_flag string, page int, source string"


def results(spark, rows):
    return spark.createDataFrame([("d", i, n, v, None, u, r, t, f, 2, "table") for i, (n, v, u, r, t, f) in enumerate(rows)], RESULT)


def test_judging(spark):
    rows = [
        ("Potassium", 5.8, "mmol/L", (3.5, 53.0), "3.5-53", "high"),
        ("ALT", 30.0, "U/L", (4.0, 56.0), "4-56", "high"),
        ("ALT", 90.0, "U/L", None, None, "abnormal"),
        ("Ferritin", 12.0, "ug/L", None, None, None),
        ("CRP", 4.0, "mg/L", None, None, None),
        ("INR", 1.0, None, None, None, None),
    ]
    got = A.assess(results(spark, rows)).orderBy("row_ix").collect()
    assert [(r["status"], r["basis"], r["conflict"], r["doubtful_range"]) for r in got] == [
        ("high", "typical", False, "3.5-53"),
        ("high", "report", True, None),
        ("high", "typical", False, None),
        ("unknown", None, False, None),
        ("normal", "typical", False, None),
        ("normal", "typical", False, None),
    ]


def test_series_in_order_of_dates(spark):
    rows = spark.createDataFrame([("d", "alt", 0, "2015-10-14", 90.0, "high", 2), ("d", "alt", 1, "2015-10-08", 1001.0, "high", 2), ("d", "k", 2, None, 5.0, "normal", 3), ("d", "k", 3, "2015-10-01", 4.0, "normal", 2)], "doc_id string, test string, ix int, day string, value double, status string, page int")
    got = A.flagged_first(A.series(rows, ["doc_id"], "ix", F.to_date("day"), ["value", "status", "page"]), ["doc_id"]).orderBy("position").collect()
    assert [(r["test"], [x["value"] for x in r["readings"]], r["trend"], r["out_of_range"]) for r in got] == [("alt", [1001.0, 90.0], "down", True), ("k", [5.0, 4.0], "down", False)]
    h = A.headline(spark.createDataFrame(got), ["doc_id"]).first()
    assert (h["flagged"], h["total"], h["pages"]) == (1, 2, [2, 3])


def test_merge_keeps_existing_and_first_new(spark):
    schema = "doc_id string, row_ix int, name string, unit string, value double, page int"
    old = spark.createDataFrame([("d", 0, "ALT", "U/L", 90.0, 2), ("d", 1, "ALT", "U/L", 90.0, 2)], schema)
    new = spark.createDataFrame([("d", 0, "Alanine aminotransferase", "IU/L", 90.0, 2), ("d", 1, "Lactate", "mmol/L", 6.1, 2), ("d", 2, "Lactic acid", "mmol/L", 6.1, 2)], schema)
    got = A.merge(old, new, ["doc_id"]).collect()
    assert sorted((r["part"], r["name"]) for r in got) == [(0, "ALT"), (0, "ALT"), (1, "Lactate")]


def test_grounding(spark):
    passages = spark.createDataFrame([("d", 0, "Lactate was 6.1 mmol/L on 8 Oct 2015 (range 0.5-2.2)", 2, 2), ("d", 1, "ALT 1,001 IU/L", 2, 3)], "doc_id string, chunk_ix int, text string, page int, end_page int")
    schema = "doc_id string, page int, name string, value string, unit string, reference_range string, flag string, date string"
    rows = [
        ("d", 2, "Lactate", "6.1", "mmol/L", "0.5-2.2", "H", "8 Oct 2015"),
        ("d", 3, "ALT (SGPT)", "1001", "units", "4-56", None, "9 Oct 2015"),
        ("d", 2, "Lactate", "6.15", None, None, None, None),
        ("d", 2, "Ferritin", "6.1", None, None, None, None),
        ("d", 9, "Lactate", "6.1", None, None, None, None),
        ("d", 2, "Lactate", "high", None, None, None, None),
    ]
    got = grounding.ground(spark.createDataFrame(rows, schema), passages)
    kept = {r["name"]: r for r in got.filter("kept").collect()}
    assert set(kept) == {"Lactate", "ALT (SGPT)"}
    assert kept["Lactate"]["printed_range"]["high"] == 2.2 and kept["Lactate"]["date"] == "8 Oct 2015" and kept["Lactate"]["printed_flag"] == "high"
    assert kept["ALT (SGPT)"]["printed_range"] is None and kept["ALT (SGPT)"]["date"] is None and kept["ALT (SGPT)"]["unit"] is None
    assert grounding.kept_and_discarded(got, ["doc_id"]).first()["discarded"] == 4


def test_fabricated_rows_fall(spark):
    passages = spark.createDataFrame([("d", 0, "Lactate 6.10 and ALT 90.00", 1, 1)], "doc_id string, chunk_ix int, text string, page int, end_page int")
    none = [None] * 4
    real = spark.createDataFrame([("d", 1, "Lactate", "6.10", *none), ("d", 1, "ALT", "90.00", *none)], "doc_id string, page int, name string, value string, unit string, reference_range string, flag string, date string")
    fakes = E.fabricate(real)
    assert fakes.count() == 6
    assert grounding.ground(real, passages).filter("kept").count() == 2
    assert grounding.ground(fakes.drop("fake"), passages).filter("kept").count() == 0


def test_cells_without_doubt_are_judged_as_all_others(spark):
    """Whole numbers and cells without a digit take a short way; what all patterns say is the same, and stands behind it."""
    from pyspark.sql import functions as F

    from reportmill.functions import values as V
    from reportmill.operators import lab_tables

    texts = ["12", "007", "1234567890123456", "1,234", "12 H", "3-5", "2026-03-12", "12/03/2026", "Sodium", "mmol/L", "high", "*", "\u2191", "", "up to 5", "Na 140", "%", "12-Mar-2026", "\u0663"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.explode(lab_tables.judged(F.array("t"))).alias("c"))
    t = F.col("t")
    plain = [V.parse_value(t), V.is_date_like(t), V.parse_range(t).isNotNull(), V.looks_like_unit(t), V.parse_flag(t)]
    for r in got.select("t", *(F.struct(F.col(f"c.{n}").alias("a"), p.alias("b")).alias(n) for n, p in zip(("parsed", "is_date", "is_range", "is_unit", "flag"), plain, strict=True))).collect():
        for n in ("parsed", "is_date", "is_range", "is_unit", "flag"):
            assert r[n]["a"] == r[n]["b"], (r["t"], n)
    judge = str(lab_tables._judge(t, F.lit(0)))
    assert judge.count("[0-9]{1,15}") >= 1
