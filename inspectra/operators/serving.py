"""Dashboard and scoring tables: P24, X1-X8, S14 (J6, U1), F14, F17, F19.

A dashboard interaction is a predicate pushed into the Parquet scan followed
by small aggregates; what-if scoring is batch scoring of any number of
scenario rows joined with one-row (global) and per-region statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as E
from .panel import dedupe_first


def dashboard_filter(df: DataFrame, regions, years, categories=()) -> DataFrame:
    """Regions x years, plus categories only when some are chosen.

    An empty region or year list selects nothing (as an empty multiselect
    does); an empty category list means no restriction.
    """
    regions, years, categories = list(regions), list(years), list(categories)
    pred = F.col("boro").isin(regions) & F.col("inspection_year").isin(years) if regions and years else F.lit(False)
    if categories:
        pred = pred & F.col("cuisine_grouped").isin(categories)
    return df.filter(pred)


#: What a selection chooses among; the month serves the trend.
CUBE_KEYS = ["boro", "inspection_year", "cuisine_grouped", "year_month"]


def overview_cube(df: DataFrame) -> DataFrame:
    """Additive counts per region, year, category and month, from which every selection's rates and trend follow.

    One map-side combined aggregate; its size is the number of combinations that
    occur, whatever the number of visits.
    """
    month = F.date_format("inspection_date", "yyyy-MM").alias("year_month")
    return df.select(*CUBE_KEYS[:3], month, "failed", "score").groupBy(*CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count("failed").alias("n_outcomes"), F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("n_failed"))


def cube_rates(cube: DataFrame, keys, regions, years, categories=(), min_n: int | None = None) -> DataFrame:
    """A6 (+A9 when ``min_n``) under a selection (P24), from the cube: n and failure rate per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = dashboard_filter(cube, regions, years, categories).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("n_failed"), F.sum("n_outcomes")).alias("failure_rate"))
    return out.filter(F.col("n") >= min_n) if min_n else out


def cube_trend(cube: DataFrame, regions, years, categories=()) -> DataFrame:
    """A15 under a selection, from the cube: outcomes per month and region."""
    return dashboard_filter(cube, regions, years, categories).groupBy("year_month", "boro").agg(F.sum("n_outcomes").alias("n"))


def map_points(df: DataFrame, colour_by: str = "failed") -> DataFrame:
    """X2 + W7 + F17: one point per entity with coordinates (its first visit),
    coloured by outcome / score bucket / region, grey when unmapped."""
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    first = dedupe_first(located.select("camis", "inspection_date", "latitude", "longitude", "dba", "boro",
                                        "cuisine", "score", "failed", "score_bucket"),
                         ["camis"], "inspection_date")
    mapping, key = {"failed": (S.COLORS_BY_OUTCOME, "failed"), "score_bucket": (S.COLORS_BY_BUCKET, "score_bucket"),
                    "boro": (S.COLORS_BY_BORO, "boro")}.get(colour_by, ({}, None))
    if key is None:
        rgba = [F.lit(v) for v in S.COLOR_CONSTANT]
    else:
        rgba = E.rgba(mapping, key, S.COLOR_GREY)
    return first.withColumns({n: c for n, c in zip(["color_r", "color_g", "color_b", "color_a"], rgba)})


def whatif_features(scenarios: DataFrame, reference: DataFrame) -> DataFrame:
    """Scenario inputs -> the 34 model inputs.

    Dataset means (complaints, wind, cloud) are one aggregate (a scalar
    subquery); region means (population, income, white share) are one row per
    region, broadcast.
    Constants follow the published form (weekday encodings fixed, flags 0).
    """
    g = reference.agg(F.struct(F.avg("food_complaints_total").alias("food"), F.avg("rodent_complaints").alias("rod"),
                               F.avg("food_safety_complaints").alias("safe"), F.avg("wind_speed_mean").alias("wind"),
                               F.avg("cloud_cover_mean").alias("cloud"))).scalar()
    r = reference.groupBy("boro").agg(F.avg("total_population").alias("_b_pop"),
                                      F.avg("median_household_income").alias("_b_inc"),
                                      F.avg("white_pct").alias("_b_white"))
    j = scenarios.withColumns({"_m_food": g["food"], "_m_rod": g["rod"], "_m_safe": g["safe"],
                               "_m_wind": g["wind"], "_m_cloud": g["cloud"]}).join(F.broadcast(r), "boro", "left")
    ms, mc = E.cyclic("inspection_month", 12)
    return j.select(
        *[c for c in ("camis", "inspection_date") if c in scenarios.columns],
        F.col("prev_score").cast("double").alias("prev_score"),
        F.col("prev_failed").cast("double").alias("prev_failed"),
        F.col("inspection_count").cast("double").alias("inspection_count"),
        ((F.col("prev_failed") == 1) | (F.col("prev_score") >= S.FAIL_SCORE)).cast("int").alias("poor_history_flag"),
        (F.col("inspection_count") == 1).cast("int").alias("is_first_inspection"),
        (F.col("prev_score") != -1).cast("int").alias("has_history"),
        F.col("_m_food").alias("food_complaints_total"), F.col("_m_rod").alias("rodent_complaints"),
        F.col("_m_safe").alias("food_safety_complaints"),
        (F.col("_m_food") + F.col("_m_rod") + F.col("_m_safe")).alias("complaint_intensity"),
        (F.try_divide(F.col("_m_food"), F.col("_b_pop")) * 10000).alias("complaint_density"),
        F.lit(0).alias("high_complaint_flag"),
        F.col("temp_mean").cast("double").alias("temp_mean"),
        F.col("precipitation_sum").cast("double").alias("precipitation_sum"),
        F.col("precipitation_sum").cast("double").alias("rain_sum"),
        F.lit(0.0).alias("snowfall_sum"),
        F.col("_m_wind").alias("wind_speed_mean"), F.col("_m_cloud").alias("cloud_cover_mean"),
        ms.alias("month_sin"), mc.alias("month_cos"), F.lit(0.0).alias("dow_sin"), F.lit(1.0).alias("dow_cos"),
        F.col("inspection_month").isin(6, 7, 8).cast("int").alias("summer_flag"),
        F.col("is_weekend").cast("int").alias("is_weekend"),
        F.col("_b_inc").alias("median_household_income"), F.col("_b_pop").alias("total_population"),
        F.col("_b_white").alias("white_pct"),
        F.lit(0).alias("has_yelp"), F.lit(0).alias("has_location"), F.lit(0.0).alias("log_yelp_reviews"),
        F.lit(None).cast("double").alias("yelp_price"),
        "boro", "cuisine_grouped", F.lit("unknown").alias("yelp_category_primary"))


def whatif_fallback(df: DataFrame, threshold: float = S.FINAL_THRESHOLD) -> DataFrame:
    """X7 + F19: rule score when no model is loaded; predicted fail at the threshold."""
    p = F.least(F.lit(0.95), F.lit(0.05) + F.col("critical_count") * 0.15 + F.col("violation_count") * 0.05
                + F.when(F.col("prev_failed") == 1, 0.1).otherwise(0.0))
    return df.withColumn("prob", p).withColumn("predicted", (F.col("prob") >= threshold).cast("int"))


def risk_band(prob_col: str = "prob") -> F.Column:
    """Gauge band of a probability (percent): [0, 30) low, [30, 60) medium, else high."""
    pct = F.col(prob_col) * 100
    out = None
    for lo, hi, name in S.RISK_BANDS:
        cond = (pct >= lo) & (pct < hi) if hi < 100 else pct >= lo
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def enrichment_pending(entities: DataFrame, cache: DataFrame) -> DataFrame:
    """S14 + J6 + F14: entities not yet looked up (string keys on both sides,
    H3), with the search term (name cut to 64) and the location text."""
    todo = entities.withColumn("camis", F.col("camis").cast("string")) \
                   .join(cache.select(F.col("camis").cast("string").alias("camis")), "camis", "left_anti")
    # only the ends are stripped, as published: inner spaces stay
    loc = F.trim(F.concat_ws(" ", F.coalesce(F.col("building"), F.lit("")), F.coalesce(F.col("street"), F.lit("")),
                             F.coalesce(F.col("zipcode"), F.lit("")), F.lit("New York")))
    return todo.select("camis", F.substring("dba", 1, 64).alias("term"),
                       loc.alias("location"))


def enrichment_merge(cache: DataFrame, new_rows: DataFrame) -> DataFrame:
    """U1 + P7: cached rows plus new rows (which lack ``high_rating``), label recomputed."""
    merged = cache.unionByName(new_rows, allowMissingColumns=True)
    return merged.withColumn("high_rating", E.high_rating_label("yelp_rating"))
