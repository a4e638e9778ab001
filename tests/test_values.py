"""Scalar readings, on printed forms and what they mean."""

import datetime

import pytest
from pyspark.sql import functions as F

from reportmill.functions import dims
from reportmill.functions import text as T
from reportmill.functions import values as V
from reportmill.operators import assess as A


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "value", "comparator", "flag", "unit"),
    [
        ("1,001", 1001.0, None, None, None),
        ("<0.5", 0.5, "<", None, None),
        ("≥ 90", 90.0, ">=", None, None),
        ("6.1 H", 6.1, None, "high", None),
        ("3.1 (L)", 3.1, None, "low", None),
        ("12*", 12.0, None, "abnormal", None),
        ("140 mmol/L", 140.0, None, None, "mmol/L"),
    ],
)
def test_result_values(spark, text, value, comparator, flag, unit):
    x = one(spark, text, V.parse_value)
    assert (x["value"], x["comparator"], x["flag"], x["unit"]) == (value, comparator, flag, unit)


@pytest.mark.parametrize("text", ["08 - Oct - 2015", "3.5-5.0", "416-555-5555", "80/40", "Lactate", "", None])
def test_rejected_values(spark, text):
    assert one(spark, text, V.parse_value) is None


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        ("3.5-5.0", 3.5, 5.0),
        ("(3.5 to 5.0 mmol/L)", 3.5, 5.0),
        ("Ref range: 135 – 145", 135.0, 145.0),
        ("<200", None, 200.0),
        ("≥ 60", 60.0, None),
        ("up to 5.6 %", None, 5.6),
    ],
)
def test_ranges(spark, text, low, high):
    x = one(spark, text, V.parse_range)
    assert (x["low"], x["high"]) == (low, high)


@pytest.mark.parametrize("text", ["14-10-2015", "10-14-2015", "08-Oct-2015", "6.1", "5-3", None])
def test_rejected_ranges(spark, text):
    assert one(spark, text, V.parse_range) is None


@pytest.mark.parametrize(
    ("text", "unit"),
    [("IU/L", "u/l"), ("µmol/L", "umol/l"), ("K/uL", "10^9/l"), ("x10^9/L", "10^9/l"), ("10*9/L", "10^9/l"), ("µIU/mL", "miu/l"), ("mL/min/1.73 m²", "ml/min/1.73m2")],
)
def test_units(spark, text, unit):
    assert one(spark, text, V.normalize_unit) == unit


def test_unit_shapes(spark):
    assert [one(spark, t, V.looks_like_unit) for t in ("mmol/L", "%", "fL", "Units", "years", "mg")] == [True, True, True, False, False, False]


def test_flags(spark):
    assert [one(spark, t, V.parse_flag) for t in ("H", "(LOW)", "↑", "*", "Hb")] == ["high", "low", "high", "abnormal", None]


def test_dates(spark):
    day = datetime.date
    assert one(spark, "08 - Oct - 2015", V.parse_date) == day(2015, 10, 8)
    assert one(spark, "14-Oct-2015 09:30", V.parse_date) == day(2015, 10, 14)
    assert one(spark, "Oct 8, 2015", V.parse_date) == day(2015, 10, 8)
    assert one(spark, "2015-10-14", V.parse_date) == day(2015, 10, 14)
    assert one(spark, "03/04/2015", V.parse_date) is None and one(spark, "03/04/2015", V.is_date_like)
    assert one(spark, "31-Feb-2015", V.parse_date) is None


def test_comparison_of_bounded_values(spark):
    def status(value, sign, low, high):
        lit = lambda x, kind="double": F.lit(x).cast(kind)
        return one(spark, "", lambda t: A.compare(lit(value), lit(sign, "string"), lit(low), lit(high)))

    assert status(0.5, "<", 1, 3) == "low"
    assert status(2.0, "<", 1, 3) == "unknown"
    assert status(0.1, "<", None, 0.04) == "unknown"
    assert status(90.0, ">", 60, None) == "normal"
    assert status(3.0, None, 1, 3) == "normal"


def test_formats(spark):
    lit = lambda x, kind="double": F.lit(x).cast(kind)
    shown = lambda lo, hi, u: one(spark, "", lambda t: V.format_range(lit(lo), lit(hi), lit(u, "string")))
    assert shown(4, 56, "U/L") == "4–56 U/L"
    assert shown(None, 5.6, "%") == "5.6% or below"
    assert shown(60, None, None) == "60 or above"
    assert one(spark, "08 - Oct - 2015", V.format_date) == "8 Oct 2015"
    assert one(spark, "03/04/2015", V.format_date) == "03/04/2015"


def test_gauge_keeps_far_values_apart(spark):
    at = lambda v: one(spark, "", lambda t: V.gauge(F.lit(v), F.lit(4.0), F.lit(56.0))["marker"])
    assert 0.7 < at(90.0) < at(1001.0) < 1.0
    assert at(30.0) == pytest.approx(0.5)


@pytest.mark.parametrize(("name", "key"), [("ALT (SGPT)", "alt"), ("Serum potassium", "potassium"), ("Hb", "hemoglobin"), ("Ferritin", None), ("Whole blood lactate", "lactate")])
def test_analytes(spark, name, key):
    assert one(spark, name, dims.find_analyte) == key


def test_dictionary_sizes(spark):
    assert dims.aliases(spark).count() == 88
    assert dims.ranges(spark).count() == 41
    assert dims.aliases(spark).select("analyte").distinct().count() == 27


def test_tokens_and_names(spark):
    assert one(spark, "The kidneys: 6.1 mmol, glass bus Étion", T.tokenize) == ["kidney", "6.1", "mmol", "glass", "bus", "tion"]
    assert one(spark, "ALT (SGPT)", T.name_forms) == ["alt sgpt", "alt"]
    assert one(spark, " Page 12 of\t30 ", T.furniture_key) == "page # of #"


def test_numbers_stand_alone(spark):
    has = lambda t, n: one(spark, t, lambda c: T.contains_number(c, F.lit(n)))
    assert has("lactate 6.1 mmol", "6.1") and has("6.1.", "6.1")
    assert not has("16.1", "6.1") and not has("6.15", "6.1") and not has("3.6.1", "6.1")


def test_citations(spark):
    assert one(spark, "see [p.3] and [P. 4-6], not [p.0] or [p]", T.cited_pages) == [3, 4]
    parts = one(spark, "see [p.3] now", T.citation_parts)
    assert [(p["kind"], p["page"]) for p in parts] == [("text", None), ("citation", 3), ("text", None)]


def test_vital_signs(spark):
    assert one(spark, "SpO2", dims.is_vital_sign) and not one(spark, "Sodium", dims.is_vital_sign)
