"""Micro-fixtures for the column expressions (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from inspectra import schemas as S
from inspectra.functions import expr as E


def test_failed_label_null_and_nan_rule(spark):  # MF2
    rows = [(None, None), ("C", None), (None, 27.0), (None, 28.0), (None, float("nan")), ("A", 30.0)]
    df = spark.createDataFrame(rows, "grade string, score double")
    df = df.withColumn("score", E.nan_to_null("score"))
    got = [r[0] for r in df.select(E.failed_label()).collect()]
    assert got == [0, 1, 0, 1, 0, 1]


def test_title_case_after_any_non_letter(spark):  # MF6
    df = spark.createDataFrame([("BAKERY PRODUCTS/DESSERTS",), ("joe's (new) 3rd",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(E.title_case("s")).collect()]
    assert got == ["Bakery Products/Desserts", "Joe'S (New) 3Rd", "", None]


def test_zip_normalize(spark):  # MF7
    df = spark.createDataFrame([("10001.0",), ("501",), (None,), ("123456",)], "z string")
    assert [r[0] for r in df.select(E.zip_normalize("z")).collect()] == ["10001", "00501", None, "123456"]


def test_right_closed_bins(spark):  # MF9
    df = spark.createDataFrame([(0,), (1,), (4,), (5,), (9,)], "v int")
    got = [r[0] for r in df.select(E.right_closed_bins("v", S.VIOLATION_BINS)).collect()]
    assert got == ["0", "1", "4", "5+", "5+"]
    t = spark.createDataFrame([(-25.0,), (0.0,), (0.1,), (45.0,), (46.0,)], "t double")
    got = [r[0] for r in t.select(E.right_closed_bins("t", S.TEMP_BINS)).collect()]
    assert got == [None, "(-20, 0]", "(0, 10]", "(30, 45]", None]


def test_safe_div_zero_population(spark):  # MF10
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0)], "w double, t double")
    assert [r[0] for r in df.select(E.safe_div("w", "t")).collect()] == [None, 0.5]


def test_score_bucket_and_primary_tag(spark):
    df = spark.createDataFrame([(None, None), (13.0, "a, b"), (14.0, " x "), (28.0, "c")], "s double, c string")
    out = df.select(E.score_bucket("s"), E.primary_tag("c")).collect()
    assert [tuple(r) for r in out] == [("NA", "unknown"), ("A", "a"), ("B", "x"), ("C", "c")]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in df.select(E.weekday_mon0("d")).collect()] == [0, 6]
