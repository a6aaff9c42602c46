"""Cell-level functions (F1–F19) on the fixture values."""
import datetime

import pytest
from pyspark.sql import functions as F

from tablewise.functions import parse as P


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_locale_numbers(spark):
    vals = ["3 200,00", "5,500.00", "$3,800", "(1 234,56)", "1.234,56", "1,234,567", "12%", "abc",
            "1 234,5", "1 000", "1,5", "1d", "inf", "n/a", None]
    assert _one(spark, vals, P.parse_number_locale) == [
        3200.0, 5500.0, 3800.0, -1234.56, 1234.56, 1234567.0, 12.0, None, 1234.5, 1000.0, 1.5, None, None, None, None]


def test_simple_numbers(spark):
    assert _one(spark, ["$3,800", "(12)", "12 EUR", "1 000", "x"], P.parse_number) == [3800.0, -12.0, 12.0, 1000.0, None]


@pytest.mark.parametrize("marker", ["", "nan", "None", "NULL", "n/a", "NA", "-", "--", "  N/A  "])
def test_missing_markers(spark, marker):
    assert _one(spark, [marker], P.normalise_missing) == [None]


def test_trim_unicode(spark):
    assert _one(spark, ["  abc  "], P.utrim) == ["abc"]


def test_booleans(spark):
    assert _one(spark, ["Oui", "faux", "maybe", " YES ", "0"], P.parse_boolean) == [True, False, None, True, False]


def test_categories(spark):
    assert _one(spark, ["homme", "F", "new   york", "o'neil", "3rd street", None], P.normalize_category) == [
        "Male", "Female", "New York", "O'Neil", "3Rd Street", None]


def test_dates(spark):
    vals = ["2024-01-15", "15/01/2024", "01/15/2024", "31/02/2024", "2024", "1850", "15 Jan 2024", "January 15, 2024", "not a date"]
    got = _one(spark, vals, P.parse_date)
    d = datetime.date
    assert got == [d(2024, 1, 15), d(2024, 1, 15), d(2024, 1, 15), None, d(2024, 1, 1), None, d(2024, 1, 15), d(2024, 1, 15), None]


def test_month_first_order(spark):
    got = _one(spark, ["03/04/2024"], lambda c: P.parse_date(c, day_first=False))
    assert got == [datetime.date(2024, 3, 4)]


def test_week_labels(spark):
    got = _one(spark, ["2024-12-30", "2025-01-05", "2021-01-03"], lambda c: P.iso_week_label(F.to_date(c)))
    assert got == ["2025-W01", "2025-W01", "2020-W53"]


def test_display_format(spark):
    got = _one(spark, [1234.5, None, -0.125], lambda c: P.format_display(c, "number", 2), "double")
    assert got == ["1 234,50", "—", "-0,13"]
    assert _one(spark, [0.125], lambda c: P.format_display(c, "percentage"), "double") == ["12,5 %"]


def test_display_kinds_and_compact_numbers(spark):
    shown = lambda values, kind, type_="string", **options: _one(spark, values, lambda c: P.format_display(c, kind, **options), type_)
    assert shown(["a", "", None], "text") == ["a", "—", "—"]
    assert shown(["2024-12-31", "31/12/2024", "soon", None], "date") == ["31/12/2024", "31/12/2024", "soon", "—"]
    assert shown(["12.5", "n.a."], "number") == ["13", "n.a."]
    numbers = [9999.0, 10000.0, 12345.0, -12345.0, 999949.0, 999951.0, 1.5e6, 2e9, 3e12, None]
    n, k = "\u202f", "\u00a0"
    want = [f"9{n}999", f"10{k}k", f"12,3{k}k", f"-12,3{k}k", f"999,9{k}k", f"1{k}M", f"1,5{k}M", f"2{k}Md", f"3{k}Bn", ""]
    assert shown(numbers, "number", "double", compact=True) == want
    assert shown([1234.0, 12.34], "currency", "double", compact=True) == [f"1,2{k}k{k}€", f"12,3{k}€"]
    assert shown([0.125], "percentage", "double", compact=True) == [f"12,5{k}%"]


def test_plain_numbers(spark):
    values = [0.0, 1.0, -2.5, 1e7, 123456789.5, 1e15, 1e16, 1.5e17, 0.001, 0.00012, 1e-5, -1.25e-7, 1.0e8]
    assert _one(spark, values, P.plain_number, "double") == [repr(v) for v in values]


def test_lenient_number(spark):
    assert _one(spark, ["1 234,5", "abc", None], P.lenient_number) == [1234.5, 0.0, 0.0]


def test_json_helpers(spark):
    df = spark.createDataFrame([(1, '{"k": 7}')], "id long, props string")
    row = df.select(P.json_get("props", "$.k").alias("k"), P.to_json_record("id", "props").alias("j")).collect()[0]
    assert row["k"] == "7" and row["j"].startswith('{"id":1,')
