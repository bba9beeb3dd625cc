"""Registered queries: dashboard tables, what-if scoring and the enrichment load."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import cleaning as C
from ..operators import serving as SV
from ..operators import summary as SM
from . import build as B
from .oracle_base import rounded
from .registry import finish, query

KEY = "camis, inspection_date"


# selections of the dashboard: regions, years and categories (none: all of them)
REGIONS, YEARS, CUISINES = ["ASIA", "EUROPE"], [1995, 1996, 1997], ["Nation_12", "Nation_13", "Nation_18", "Nation_2"]
OTHER_REGIONS, LATE_YEARS = ["AFRICA", "AMERICA", "MIDDLE EAST"], [1999, 2000]


def _where(regions, years, cuisines) -> str:
    """Direct filter of the same rows, for the SQL twins."""
    texts = lambda v: ", ".join(f"'{x}'" for x in v)
    more = f" AND cuisine_grouped IN ({texts(cuisines)})" if cuisines else ""
    return (f"(SELECT * FROM clean WHERE boro IN ({texts(regions)}) AND inspection_year IN ({', '.join(map(str, years))}){more}) s")


_SELECTED = _where(REGIONS, YEARS, CUISINES)
_LATE = _where(OTHER_REGIONS, LATE_YEARS, [])
_ONE = _where(["MIDDLE EAST"], [2000], ["Other"])


def _selected(spark, d):
    return SV.dashboard_filter(B.clean(spark, d), REGIONS, YEARS, CUISINES)


def _rates_sql(key: str, source: str, having: str = "") -> str:
    return rounded(f"SELECT {key}, CAST(count(*) AS BIGINT) AS n, avg(failed) AS failure_rate FROM {source} GROUP BY 1{having}", ["failure_rate"])


@query("dashboard_filter", _rates_sql("cuisine_grouped", _SELECTED, " HAVING count(*) >= 50"))
def dashboard_filter(spark, d):
    """P24 + X1 + A9: the overview's category rates (n >= 50) under a selection, from the cube."""
    return finish(SV.cube_rates(B.overview_cube(spark, d), "cuisine_grouped", REGIONS, YEARS, CUISINES, min_n=50))


@query("overview_categories_late", _rates_sql("cuisine_grouped", _LATE))
def overview_categories_late(spark, d):
    """P24 + X1: category rates of other regions and years, no category chosen (all of them)."""
    return finish(SV.cube_rates(B.overview_cube(spark, d), "cuisine_grouped", OTHER_REGIONS, LATE_YEARS))


@query("overview_years_one", _rates_sql("inspection_year", _ONE))
def overview_years_one(spark, d):
    """P24 + X1: one region, year and category."""
    return finish(SV.cube_rates(B.overview_cube(spark, d), "inspection_year", ["MIDDLE EAST"], [2000], ["Other"]))


@query("overview_tiles", rounded(
    "SELECT CAST(count(DISTINCT camis) AS BIGINT) AS n_entities, CAST(count(*) AS BIGINT) AS n_inspections, "
    f"avg(failed) AS failure_rate, avg(score) AS mean_score, avg(has_yelp) AS rated_share FROM {_SELECTED}",
    ["failure_rate", "mean_score", "rated_share"]))
def overview_tiles(spark, d):
    """X1 + A14: the tiles under a selection."""
    return finish(SM.tiles(_selected(spark, d)))


@query("overview_regions", _rates_sql("boro", _SELECTED))
def overview_regions(spark, d):
    """X1 + A6: region rates under a selection, from the cube."""
    return finish(SV.cube_rates(B.overview_cube(spark, d), "boro", REGIONS, YEARS, CUISINES))


@query("overview_trend", rounded(
    "SELECT strftime(inspection_date, '%Y-%m') AS year_month, boro, CAST(count(failed) AS BIGINT) AS n "
    f"FROM {_SELECTED} GROUP BY 1, 2", []))
def overview_trend(spark, d):
    """X1 + A15: the monthly trend under a selection, from the cube."""
    return SV.cube_trend(B.overview_cube(spark, d), REGIONS, YEARS, CUISINES)


_MAP_SQL = ("SELECT camis, inspection_date, latitude, longitude, dba, boro, cuisine, score, failed, score_bucket "
            "FROM (SELECT *, row_number() OVER (PARTITION BY camis ORDER BY inspection_date) AS rn FROM clean "
            "WHERE latitude IS NOT NULL AND longitude IS NOT NULL) f WHERE rn = 1")


@query("map_points", rounded(
    "SELECT *, CAST(CASE failed WHEN 1 THEN 230 WHEN 0 THEN 42 ELSE 150 END AS INTEGER) AS color_r, "
    "CAST(CASE failed WHEN 1 THEN 57 WHEN 0 THEN 157 ELSE 150 END AS INTEGER) AS color_g, "
    "CAST(CASE failed WHEN 1 THEN 70 WHEN 0 THEN 143 ELSE 150 END AS INTEGER) AS color_b, "
    f"CAST(180 AS INTEGER) AS color_a FROM ({_MAP_SQL}) m", ["latitude", "longitude", "score"]))
def map_points(spark, d):
    """X2 + W7 + F17: one coloured point per located entity (first visit)."""
    return finish(SV.map_points(B.clean(spark, d), "failed"))


def _map_sql(colours: str, source: str) -> str:
    """Points (first visit with coordinates) of a source with a colour per value; grey when unmapped."""
    return f"SELECT *, {colours}, CAST(180 AS INTEGER) AS color_a FROM ({_MAP_SQL.replace('FROM clean', f'FROM {source}')}) m"


def _colour_sql(column: str, mapping: dict) -> str:
    parts = []
    for k, name in enumerate(("color_r", "color_g", "color_b")):
        whens = " ".join(f"WHEN '{v}' THEN {rgba[k]}" for v, rgba in mapping.items())
        parts.append(f"CAST(CASE CAST({column} AS VARCHAR) {whens} ELSE {S.COLOR_GREY[k]} END AS INTEGER) AS {name}")
    return ", ".join(parts)


@query("map_points_bucket", rounded(_map_sql(_colour_sql("score_bucket", S.COLORS_BY_BUCKET), _SELECTED),
                                    ["latitude", "longitude", "score"]))
def map_points_bucket(spark, d):
    """X2 + F17: points under a selection, coloured by score bucket."""
    return finish(SV.map_points(_selected(spark, d), "score_bucket"))


@query("map_points_region", rounded(_map_sql(_colour_sql("boro", S.COLORS_BY_BORO), _SELECTED),
                                    ["latitude", "longitude", "score"]))
def map_points_region(spark, d):
    """X2 + F17: points under a selection, coloured by region (grey outside the published regions)."""
    return finish(SV.map_points(_selected(spark, d), "boro"))


@query("map_summary", rounded(
    "SELECT CAST(count(*) AS BIGINT) AS n_points, avg(failed) AS failure_rate FROM ("
    + _MAP_SQL.replace("FROM clean", f"FROM {_SELECTED}") + ") m", ["failure_rate"]))
def map_summary(spark, d):
    """Points on the map and their failure rate under a selection."""
    return finish(SV.map_points(_selected(spark, d)).agg(F.count(F.lit(1)).alias("n_points"),
                                                         F.avg("failed").alias("failure_rate")))


@query("rated_subset_region", rounded(
    "SELECT camis, inspection_date, boro, yelp_rating, score, failed FROM clean WHERE has_yelp = 1 "
    "AND boro IN ('ASIA', 'EUROPE')", ["yelp_rating", "score"]))
def rated_subset_region(spark, d):
    """The rated subset of the selected regions."""
    return finish(C.rated_subset(B.clean(spark, d)).filter(F.col("boro").isin(REGIONS))
                  .select("camis", "inspection_date", "boro", "yelp_rating", "score", "failed"))


def _scenarios(c):
    return c.select("camis", "inspection_date", "boro", "cuisine_grouped", "inspection_count", "prev_score",
                    "prev_failed", "violation_count", "critical_count", "temp_mean", "precipitation_sum",
                    "inspection_month", "is_weekend")


_WHATIF_DOUBLES = ["prev_score", "prev_failed", "inspection_count", "food_complaints_total", "rodent_complaints",
                   "food_safety_complaints", "complaint_intensity", "complaint_density", "temp_mean",
                   "precipitation_sum", "rain_sum", "snowfall_sum", "wind_speed_mean", "cloud_cover_mean",
                   "month_sin", "month_cos", "dow_sin", "dow_cos", "median_household_income", "total_population",
                   "white_pct", "log_yelp_reviews", "yelp_price"]


@query("whatif_features", rounded(
    "SELECT camis, inspection_date, CAST(prev_score AS DOUBLE) AS prev_score, CAST(prev_failed AS DOUBLE) AS prev_failed, "
    "CAST(inspection_count AS DOUBLE) AS inspection_count, "
    "CAST(prev_failed = 1 OR prev_score >= 28 AS INTEGER) AS poor_history_flag, "
    "CAST(inspection_count = 1 AS INTEGER) AS is_first_inspection, CAST(prev_score <> -1 AS INTEGER) AS has_history, "
    "g.m_food AS food_complaints_total, g.m_rod AS rodent_complaints, g.m_safe AS food_safety_complaints, "
    "g.m_food + g.m_rod + g.m_safe AS complaint_intensity, "
    "CASE WHEN b.b_pop = 0 THEN NULL ELSE g.m_food / b.b_pop END * 10000 AS complaint_density, "
    "0 AS high_complaint_flag, CAST(temp_mean AS DOUBLE) AS temp_mean, "
    "CAST(precipitation_sum AS DOUBLE) AS precipitation_sum, CAST(precipitation_sum AS DOUBLE) AS rain_sum, "
    "0.0::DOUBLE AS snowfall_sum, g.m_wind AS wind_speed_mean, g.m_cloud AS cloud_cover_mean, "
    "sin(2 * pi() * inspection_month / 12.0::DOUBLE) AS month_sin, cos(2 * pi() * inspection_month / 12.0::DOUBLE) "
    "AS month_cos, 0.0::DOUBLE AS dow_sin, 1.0::DOUBLE AS dow_cos, "
    "CAST(inspection_month IN (6, 7, 8) AS INTEGER) AS summer_flag, CAST(is_weekend AS INTEGER) AS is_weekend, "
    "b.b_inc AS median_household_income, b.b_pop AS total_population, b.b_white AS white_pct, "
    "0 AS has_yelp, 0 AS has_location, 0.0::DOUBLE AS log_yelp_reviews, CAST(NULL AS DOUBLE) AS yelp_price, "
    "c.boro, cuisine_grouped, 'unknown' AS yelp_category_primary "
    "FROM clean c, (SELECT avg(food_complaints_total) AS m_food, avg(rodent_complaints) AS m_rod, "
    "avg(food_safety_complaints) AS m_safe, avg(wind_speed_mean) AS m_wind, avg(cloud_cover_mean) AS m_cloud "
    "FROM clean) g LEFT JOIN (SELECT boro, avg(total_population) AS b_pop, avg(median_household_income) AS b_inc, "
    "avg(white_pct) AS b_white FROM clean GROUP BY boro) b ON b.boro = c.boro", _WHATIF_DOUBLES)
    .replace("0 AS high_complaint_flag", "CAST(0 AS INTEGER) AS high_complaint_flag")
    .replace("0 AS has_yelp, 0 AS has_location", "CAST(0 AS INTEGER) AS has_yelp, CAST(0 AS INTEGER) AS has_location"))
def whatif_features(spark, d):
    """Every visit's slider values as a scenario -> the 34 model inputs."""
    c = B.clean(spark, d)
    return finish(SV.whatif_features(_scenarios(c), c))


_FALLBACK = ("least(0.95::DOUBLE, 0.05::DOUBLE + critical_count * 0.15::DOUBLE + violation_count * 0.05::DOUBLE + "
             "CASE WHEN prev_failed = 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)")


@query("whatif_fallback", rounded(
    f"SELECT {KEY}, {_FALLBACK} AS prob, CAST({_FALLBACK} >= 0.47 AS INTEGER) AS predicted FROM clean", ["prob"]))
def whatif_fallback(spark, d):
    """X7 + F19: the no-model rule score of every scenario."""
    return finish(SV.whatif_fallback(B.clean(spark, d)).select("camis", "inspection_date", "prob", "predicted"))


@query("risk_band", rounded(
    "SELECT band, predicted, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p * 100 >= 0 AND p * 100 < 30 "
    "THEN 'low' WHEN p * 100 >= 30 AND p * 100 < 60 THEN 'medium' WHEN p * 100 >= 60 THEN 'high' END AS band, "
    f"CAST(p >= 0.47 AS INTEGER) AS predicted FROM (SELECT {_FALLBACK} AS p FROM clean) t) x GROUP BY 1, 2", []))
def risk_band(spark, d):
    """Gauge bands of the scenario probabilities with the threshold marker."""
    s = SV.whatif_fallback(B.clean(spark, d))
    return s.groupBy(SV.risk_band("prob").alias("band"), "predicted").agg(F.count(F.lit(1)).alias("n"))


_PENDING_SQL = ("SELECT CAST(c.c_custkey AS VARCHAR) AS camis, substr(c.c_name, 1, 64) AS term, "
                "trim('  ' || CASE WHEN c.c_custkey % 50 = 0 THEN '' ELSE CAST(c.c_custkey * 37 AS VARCHAR) || '.0' END "
                "|| ' New York') AS location FROM customer c WHERE c.c_custkey % 5 = 0 AND "
                "CAST(c.c_custkey AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)")


@query("enrichment_pending", rounded(_PENDING_SQL, []))
def enrichment_pending(spark, d):
    """S14 + J6 + F14: located entities without a cached lookup (anti join on string keys)."""
    return SV.enrichment_pending(B.master(spark, d), B.ratings(spark, d))


@query("enrichment_merge", rounded(
    "SELECT camis, yelp_rating, yelp_reviews, yelp_price, yelp_category, "
    "CAST(coalesce(yelp_rating >= 4.0, false) AS INTEGER) AS high_rating FROM ("
    "SELECT camis, yelp_rating, yelp_reviews, yelp_price, yelp_category FROM ratings UNION ALL "
    "SELECT camis, NULL, NULL, NULL, NULL FROM (" + _PENDING_SQL + ") p) u",
    ["yelp_rating", "yelp_reviews", "yelp_price"]))
def enrichment_merge(spark, d):
    """U1 + P7: cache plus one 'not found' row per pending entity, label recomputed."""
    cache = B.ratings(spark, d).select("camis", "yelp_rating", "yelp_reviews", "yelp_price", "yelp_category",
                                       "high_rating")
    pending = SV.enrichment_pending(B.master(spark, d), cache)
    new = pending.select("camis", F.lit(None).cast("double").alias("yelp_rating"),
                         F.lit(None).cast("double").alias("yelp_reviews"),
                         F.lit(None).cast("double").alias("yelp_price"),
                         F.lit(None).cast("string").alias("yelp_category"))
    return finish(SV.enrichment_merge(cache, new))
