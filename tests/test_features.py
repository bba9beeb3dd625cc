"""Engineered features: recorded-row identities and the p75 flag."""

import math

from pyspark.sql import functions as F

from inspectra.operators import features as FE


def test_recorded_row_identities(spark):
    # a scored row as published: 2 complaints, population 1,443,229 -> density .0138578
    df = spark.createDataFrame([(2, 0, 0, 1443229.0, 1.0, 28.0, 7, 5)],
                               "food_complaints_total long, rodent_complaints long, food_safety_complaints long, "
                               "total_population double, prev_failed double, prev_score double, "
                               "inspection_month int, inspection_dow int")
    r = FE.calendar_encodings(FE.risk_flags(FE.complaint_features(df))).first()
    assert round(r.complaint_density, 7) == 0.0138578
    assert r.complaint_intensity == 2.0 and r.poor_history_flag == 1
    assert abs(r.month_sin ** 2 + r.month_cos ** 2 - 1) < 1e-12 and abs(r.dow_sin ** 2 + r.dow_cos ** 2 - 1) < 1e-12
    assert r.summer_flag == 1


def test_high_complaint_flag_strictly_above_p75(spark):
    df = spark.createDataFrame([(v, 10.0) for v in [1, 2, 3, 4, None]],
                               "food_complaints_total long, total_population double")
    got = [r.high_complaint_flag for r in FE.complaint_features(df.withColumns(
        {"rodent_complaints": F.lit(0), "food_safety_complaints": F.lit(0)})).collect()]
    # p75 of 1..4 is 3.25 (linear interpolation); NULL -> 0
    assert got == [0, 0, 0, 1, 0]


def test_time_split_boundary(spark):
    df = spark.createDataFrame([("a", "2023-12-31", 1), ("b", "2024-01-01", 0), ("c", None, 1)],
                               "camis string, d string, failed int").select(
        "camis", F.to_date("d").alias("inspection_date"), "failed")
    train, test = FE.train_test(df, "2024-01-01")
    assert [r.camis for r in train.collect()] == ["a"] and [r.camis for r in test.collect()] == ["b"]
    assert not math.isnan(0.0)


def test_no_excluded_column_is_a_model_input(spark):  # P29 check
    assert FE.leakage_violations(spark).count() == 0
