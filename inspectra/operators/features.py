"""Engineered features and the modelling frame: P15-P20, P25, P26, P28, P29, F5, F6, J8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as E


def risk_flags(df: DataFrame) -> DataFrame:
    """Poor history = previous visit failed or previous score >= 28."""
    return df.withColumn("poor_history_flag",
                         (E.is_true(F.col("prev_failed") == 1)
                          | E.is_true(F.col("prev_score") >= S.FAIL_SCORE)).cast("int"))


def complaint_features(df: DataFrame, quantile_source: DataFrame | None = None) -> DataFrame:
    """P16-P18 + J8: intensity, density per 10,000 people and the flag for a
    day above the global 75th percentile of complaints.

    The percentile is one exact aggregate value, used as a scalar subquery
    (one row by construction).  ``quantile_source`` lets the caller fit it on
    the training rows only (H4); by default all rows, as published.
    """
    src = quantile_source if quantile_source is not None else df
    q75 = src.agg(F.percentile("food_complaints_total", 0.75)).scalar()
    total = F.coalesce(F.col("food_complaints_total").cast("double"), F.lit(0.0))
    return df.withColumns({
        "complaint_intensity": total
            + F.coalesce(F.col("rodent_complaints").cast("double"), F.lit(0.0))
            + F.coalesce(F.col("food_safety_complaints").cast("double"), F.lit(0.0)),
        "complaint_density": E.safe_div(total, F.nullif(F.col("total_population"), F.lit(0.0)))
            * F.lit(10000.0),
        "high_complaint_flag": E.flag(F.col("food_complaints_total") > q75),
    })


def calendar_encodings(df: DataFrame) -> DataFrame:
    """F5 + P19: cyclic month / weekday encodings and the summer flag."""
    ms, mc = E.cyclic("inspection_month", 12)
    ds, dc = E.cyclic("inspection_dow", 7)
    return df.withColumns({"month_sin": ms, "month_cos": mc, "dow_sin": ds, "dow_cos": dc,
                           "summer_flag": F.col("inspection_month").isin(6, 7, 8).cast("int")})


def visibility_features(df: DataFrame) -> DataFrame:
    """log1p of review count."""
    return df.withColumn("log_yelp_reviews", F.log1p("yelp_reviews"))


def engineer(clean: DataFrame, quantile_source: DataFrame | None = None) -> DataFrame:
    """Stage 4/5 feature engineering, shared by both stages (one function)."""
    df = risk_flags(clean)
    df = complaint_features(df, quantile_source)
    df = calendar_encodings(df)
    return visibility_features(df)


def time_split(df: DataFrame, cutoff: str, target: str = "failed",
               date_col: str = "inspection_date") -> DataFrame:
    """P25 + P26: drop rows without target or date, label train (< cutoff) / test."""
    kept = df.dropna(subset=[target, date_col])
    return kept.withColumn("split", F.when(F.col(date_col) < F.lit(cutoff).cast("date"), "train")
                                     .otherwise("test"))


def train_test(df: DataFrame, cutoff: str, target: str = "failed", date_col: str = "inspection_date"):
    """P26 as two filters.  On a table partitioned by ``inspection_year`` a
    redundant year bound is added so each side reads only its partitions."""
    kept = df.dropna(subset=[target, date_col])
    cut = F.lit(cutoff).cast("date")
    train_pred, test_pred = F.col(date_col) < cut, F.col(date_col) >= cut
    if "inspection_year" in df.columns:
        train_pred = train_pred & (F.col("inspection_year") <= F.year(cut))
        test_pred = test_pred & (F.col("inspection_year") >= F.year(cut))
    return kept.filter(train_pred), kept.filter(test_pred)


def leakage_audit(spark: SparkSession) -> DataFrame:
    """The excluded-column table."""
    return spark.createDataFrame(S.LEAKAGE_AUDIT, "excluded_feature string, reason string")


def leakage_violations(spark: SparkSession, features=None) -> DataFrame:
    """P29 check: excluded names that appear in the feature list (must be empty)."""
    feats = features or (S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES)
    f = spark.createDataFrame([(x,) for x in feats], "excluded_feature string")
    return f.join(leakage_audit(spark), "excluded_feature", "left_semi")
