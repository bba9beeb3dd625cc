"""Collapse, windows, daily aggregates and join invariants."""

import datetime as dt

from pyspark.sql import functions as F

from inspectra.operators import panel as P
from inspectra.plans import build as B
from conftest import SF_SMALL

D1, D2 = dt.date(2023, 1, 5), dt.date(2023, 2, 5)
RAW = ("camis string, dba string, boro string, zipcode string, cuisine_description string, "
       "inspection_date date, action string, violation_code string, critical_flag string, score double, "
       "grade string, ord long")


def test_collapse_first_non_null_and_counts(spark):  # MF1 + MF4
    rows = [("1", "A", "BRONX", None, "x", D1, "a", "02B", "Critical", None, None, 1),
            ("1", "B", "BRONX", "10001", "x", D1, "a", None, "Not Critical", 12.0, "A", 2),
            ("1", "A", "BRONX", "10002", "x", D1, "a", "04L", "Critical", 15.0, None, 3),
            ("1", "A", "BRONX", None, "x", D2, "b", "08A", "Not Critical", 30.0, "C", 4),
            ("1", "A", "BRONX", None, "x", D2, "b", "10F", "Critical", None, None, 5),
            (None, "Z", "BRONX", None, "x", D1, "a", "10B", "Critical", 1.0, "A", 6)]
    df = spark.createDataFrame(rows, RAW)
    out = {r["inspection_date"]: r for r in P.collapse_inspections(df).collect()}
    assert len(out) == 2
    a = out[D1]
    assert (a.dba, a.zipcode, a.score, a.grade, a.violation_count, a.critical_count, a.failed) == \
        ("A", "10001", 12.0, "A", 2, 2, 0)
    b = out[D2]
    assert (b.score, b.grade, b.violation_count, b.critical_count, b.failed) == (30.0, "C", 2, 1, 1)


def test_lag_features(spark):  # MF3 (H2: a visit after an unscored one has no history)
    rows = [("1", dt.date(2023, 1, d), s, f) for d, s, f in [(1, 10.0, 0), (2, None, 0), (3, 30.0, 1)]]
    df = spark.createDataFrame(rows, "camis string, inspection_date date, score double, failed int")
    got = [tuple(r) for r in P.lag_features(df).orderBy("inspection_date")
           .select("prev_score", "prev_failed", "inspection_count", "score_trend").collect()]
    assert got == [(None, -1, 1, None), (10.0, 0, 2, None), (None, 0, 3, None)]


def test_weather_all_missing_sum_is_zero(spark):  # MF5
    rows = [(dt.datetime(2023, 1, 1, h), 1.0 * h, None, None, None, 1.0, 2.0, 3.0) for h in range(3)]
    df = spark.createDataFrame(rows, "timestamp_local timestamp, temperature_2m double, precipitation double, "
                                     "rain double, snowfall double, wind_speed_10m double, wind_gusts_10m double, "
                                     "cloud_cover double")
    r = P.weather_daily(df).first()
    assert r.snowfall_sum == 0.0 and r.precipitation_sum == 0.0 and r.temp_mean == 1.0 and r.temp_max == 2.0


def test_panel_joins_keep_row_count(spark):
    ins = B.inspections(spark, SF_SMALL).count()
    panel = B.panel_plan(spark, SF_SMALL)
    assert panel.count() == ins
    assert panel.select("camis", "inspection_date").distinct().count() == ins


def test_inspection_count_dense(spark):
    p = B.panel(spark, SF_SMALL)
    bad = (p.groupBy("camis").agg(F.max("inspection_count").alias("m"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("m") != F.col("n")).count())
    assert bad == 0


def test_clean_removes_invalid_and_no_result(spark):
    c = B.clean(spark, SF_SMALL)
    assert c.filter(~F.col("boro").isin("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")).count() == 0
    assert len(c.columns) == 52


def test_collapse_with_hot_key(spark):
    # one (entity, day) holds a third of the rows; partial aggregation combines it map-side
    hot = [("H", "n", "BRONX", None, "x", D1, "a", f"c{i}", "Critical" if i % 3 == 0 else "Not Critical",
            None if i < 5 else 20.0, None, i) for i in range(300)]
    cold = [(f"k{i}", "n", "BRONX", None, "x", D2, "a", "c", "Not Critical", 10.0, "A", 1000 + i) for i in range(600)]
    df = spark.createDataFrame(hot + cold, RAW).repartition(8)
    out = P.collapse_inspections(df)
    h = out.filter(F.col("camis") == "H").first()
    assert (h.violation_count, h.critical_count, h.score) == (300, 100, 20.0)
    assert out.count() == 601
    assert "partial_" in out._jdf.queryExecution().executedPlan().toString()
