"""Registered queries: EDA and dashboard summaries (stage 3 tables, app pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import cleaning as C
from ..operators import summary as SM
from . import build as B
from .oracle_base import rounded
from .registry import finish, query

FIXED_CLUSTER_SQL = "CASE WHEN has_yelp = 1 THEN 2 WHEN has_history = 1 THEN 0 ELSE 1 END"


def fixed_cluster():
    """Deterministic cluster column for the SQL-checked profile queries."""
    return (F.when(F.col("has_yelp") == 1, 2).when(F.col("has_history") == 1, 0).otherwise(1)).cast("int")


def _rate_sql(key_expr, key_name, where=""):
    return rounded(f"SELECT {key_expr} AS {key_name}, CAST(count(*) AS BIGINT) AS n, avg(failed) AS failure_rate "
                   f"FROM clean {where} GROUP BY 1", ["failure_rate"])


@query("value_counts", rounded(
    "SELECT coalesce(grade, 'No grade') AS grade_label, CAST(count(*) AS BIGINT) AS n FROM clean GROUP BY 1", []))
def value_counts(spark, d):
    """A5: outcome-grade counts ('No grade' for missing)."""
    c = B.clean(spark, d).withColumn("grade_label", F.coalesce(F.col("grade"), F.lit("No grade")))
    return SM.value_counts(c, "grade_label")


@query("rate_by_region", _rate_sql("boro", "boro"))
def rate_by_region(spark, d):
    """Failure rate by region."""
    return finish(SM.rate_by(B.clean(spark, d), "boro"))


@query("rate_by_category", _rate_sql("cuisine_grouped", "cuisine_grouped"))
def rate_by_category(spark, d):
    """Failure rate by pooled category."""
    return finish(SM.rate_by(B.clean(spark, d), "cuisine_grouped"))


@query("rate_by_month", rounded(
    "SELECT m.month_name, r.n, r.failure_rate FROM (VALUES "
    + ", ".join(f"('{n}', {i + 1})" for i, n in enumerate(S.MONTH_NAMES))
    + ") m(month_name, k) LEFT JOIN (SELECT inspection_month, CAST(count(*) AS BIGINT) AS n, "
      "avg(failed) AS failure_rate FROM clean GROUP BY 1) r ON r.inspection_month = m.k", ["failure_rate"]))
def rate_by_month(spark, d):
    """A6 + P21 + J11: failure rate by month name, all 12 months shown."""
    c = SM.display_labels(B.clean(spark, d))
    agg = SM.rate_by(c, "month_name")
    return finish(SM.complete_categories(agg, "month_name", S.MONTH_NAMES))


_VB = ("CASE WHEN violation_count > -0.1 AND violation_count <= 0 THEN '0' WHEN violation_count > 0 AND "
       "violation_count <= 1 THEN '1' WHEN violation_count > 1 AND violation_count <= 2 THEN '2' "
       "WHEN violation_count > 2 AND violation_count <= 3 THEN '3' WHEN violation_count > 3 AND "
       "violation_count <= 4 THEN '4' WHEN violation_count > 4 THEN '5+' END")
_CB = ("CASE WHEN critical_count > -0.1 AND critical_count <= 0 THEN '0' WHEN critical_count > 0 AND "
       "critical_count <= 1 THEN '1' WHEN critical_count > 1 AND critical_count <= 2 THEN '2' "
       "WHEN critical_count > 2 AND critical_count <= 3 THEN '3' WHEN critical_count > 3 THEN '4+' END")
_TB = ("CASE WHEN temp_mean > -20 AND temp_mean <= 0 THEN '(-20, 0]' WHEN temp_mean > 0 AND temp_mean <= 10 "
       "THEN '(0, 10]' WHEN temp_mean > 10 AND temp_mean <= 20 THEN '(10, 20]' WHEN temp_mean > 20 AND "
       "temp_mean <= 30 THEN '(20, 30]' WHEN temp_mean > 30 AND temp_mean <= 45 THEN '(30, 45]' END")


@query("fixed_bins", rounded(
    f"SELECT camis, inspection_date, {_VB} AS violation_bucket, {_CB} AS critical_bucket, "
    f"{_TB} AS temp_bin FROM clean", []))
def fixed_bins(spark, d):
    """Right-closed buckets for violations, critical violations, temperature."""
    return SM.fixed_bins(B.clean(spark, d)).select("camis", "inspection_date", "violation_bucket",
                                                   "critical_bucket", "temp_bin")


@query("rate_by_bin", rounded(
    f"SELECT 'violation' AS bin_kind, {_VB} AS bucket, CAST(count(*) AS BIGINT) AS n, avg(failed) AS failure_rate "
    "FROM clean GROUP BY 2 UNION ALL "
    f"SELECT 'critical', {_CB}, CAST(count(*) AS BIGINT), avg(failed) FROM clean GROUP BY 2 UNION ALL "
    f"SELECT 'temperature', {_TB}, CAST(count(*) AS BIGINT), avg(failed) FROM clean GROUP BY 2",
    ["failure_rate"]))
def rate_by_bin(spark, d):
    """A6 over P22 buckets: violation, critical and temperature bins (one scan each)."""
    b = SM.fixed_bins(B.clean(spark, d))
    parts = [SM.rate_by(b, col).select(F.lit(kind).alias("bin_kind"), F.col(col).alias("bucket"),
                                       "n", "failure_rate")
             for kind, col in [("violation", "violation_bucket"), ("critical", "critical_bucket"),
                               ("temperature", "temp_bin")]]
    return finish(C.union_all(parts))


@query("rate_first_repeat", _rate_sql("is_first_inspection", "is_first_inspection"))
def rate_first_repeat(spark, d):
    """Failure rate of first vs repeat visits."""
    return finish(SM.rate_by(B.clean(spark, d), "is_first_inspection"))


@query("region_summary", rounded(
    "SELECT boro, CAST(count(*) AS BIGINT) AS n, avg(failed) AS failure_rate, "
    "quantile_cont(median_household_income, 0.5) AS median_income FROM clean GROUP BY 1",
    ["failure_rate", "median_income"]))
def region_summary(spark, d):
    """Per region n, failure rate, median income."""
    return finish(SM.region_summary(B.clean(spark, d)))


@query("global_quantiles", rounded(
    "SELECT quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, "
    "quantile_cont(score, 0.75) AS p75, (SELECT quantile_cont(food_complaints_total, 0.75) FROM clean) "
    "AS complaints_p75 FROM clean", ["p25", "p50", "p75", "complaints_p75"]))
def global_quantiles(spark, d):
    """Exact score quartiles and the complaint 75th percentile."""
    c = B.clean(spark, d)
    return finish(c.agg(F.percentile("score", 0.25).alias("p25"), F.percentile("score", 0.5).alias("p50"),
                        F.percentile("score", 0.75).alias("p75"),
                        F.percentile("food_complaints_total", 0.75).alias("complaints_p75")))


@query("rate_having", rounded(
    "SELECT cuisine_grouped, CAST(count(*) AS BIGINT) AS n, avg(failed) AS failure_rate FROM clean "
    "GROUP BY 1 HAVING count(*) >= 100 ORDER BY failure_rate DESC, cuisine_grouped ASC LIMIT 15",
    ["failure_rate"]))
def rate_having(spark, d):
    """A9 + O3: categories with n >= 100, top 15 by failure rate."""
    return finish(SM.top_rates(B.clean(spark, d), "cuisine_grouped", 100, 15))


_QUART_CTE = """
iq AS (
  SELECT *,
    CAST(greatest(1, ceil(4.0 * (row_number() OVER (ORDER BY median_household_income, camis, inspection_date) - 1)
         / greatest(count(*) OVER () - 1, 1))) AS INTEGER) AS iq_k,
    CAST(greatest(1, ceil(4.0 * (row_number() OVER (ORDER BY food_complaints_total, camis, inspection_date) - 1)
         / greatest(count(*) OVER () - 1, 1))) AS INTEGER) AS cq_k
  FROM clean WHERE median_household_income IS NOT NULL AND food_complaints_total IS NOT NULL
    AND failed IS NOT NULL),
iq2 AS (
  SELECT *, ['Q1 low income', 'Q2', 'Q3', 'Q4 high income'][iq_k] AS income_quartile,
         ['Q1 low complaints', 'Q2', 'Q3', 'Q4 high complaints'][cq_k] AS complaint_quartile FROM iq)"""


def _quartiles(spark, d):
    """Both quartile columns; each labels rows by comparing their keys with three boundary rows."""
    c = B.clean(spark, d).dropna(subset=["median_household_income", "food_complaints_total", "failed"])
    keys = ["camis", "inspection_date"]
    inc = SM.rank_quartiles(c, "median_household_income", keys, "income_quartile", S.INCOME_QUARTILES)
    return SM.rank_quartiles(inc, "food_complaints_total", keys, "complaint_quartile", S.COMPLAINT_QUARTILES)


@query("rank_quartiles", rounded(
    "SELECT camis, inspection_date, income_quartile, complaint_quartile FROM iq2", [], _QUART_CTE))
def rank_quartiles(spark, d):
    """Quartile of rank(method='first') without a single-partition window."""
    return _quartiles(spark, d).select("camis", "inspection_date", "income_quartile", "complaint_quartile")


def _pivot_sql(src, row, col, values, extra=""):
    cells = ", ".join(f"avg(failed) FILTER (WHERE {col} = '{v}') AS \"{v}\"" for v in values)
    return rounded(f"SELECT {row}, {cells} FROM {src} GROUP BY {row}", [f'"{v}"' for v in values], extra)


@query("pivot_quartiles", _pivot_sql("iq2", "income_quartile", "complaint_quartile", S.COMPLAINT_QUARTILES,
                                     _QUART_CTE))
def pivot_quartiles(spark, d):
    """A10: mean failure by income quartile x complaint quartile."""
    return finish(SM.pivot_mean(_quartiles(spark, d), "income_quartile", "complaint_quartile",
                                S.COMPLAINT_QUARTILES))


@query("pivot_region_month", _pivot_sql(
    "(SELECT *, ['" + "', '".join(S.MONTH_NAMES) + "'][inspection_month] AS month_name FROM clean) t",
    "boro", "month_name", S.MONTH_NAMES))
def pivot_region_month(spark, d):
    """A10: mean failure by region x month name."""
    return finish(SM.pivot_mean(SM.display_labels(B.clean(spark, d)), "boro", "month_name", S.MONTH_NAMES))


@query("pivot_region_category", rounded(
    "SELECT boro, cuisine_grouped, avg(failed) AS failure_rate FROM clean WHERE cuisine_grouped IN "
    "(SELECT cuisine_grouped FROM clean GROUP BY 1 ORDER BY count(*) DESC, cuisine_grouped LIMIT 12) "
    "GROUP BY 1, 2", ["failure_rate"]))
def pivot_region_category(spark, d):
    """A10 + J7: mean failure by region x top-12 category, one row per cell (the
    columns of the wide form would depend on the data)."""
    c = B.clean(spark, d)
    top = C.top_k_values(c, "cuisine_grouped", 12).select("cuisine_grouped")   # 12 rows
    return finish(c.join(F.broadcast(top), "cuisine_grouped", "left_semi")
                   .groupBy("boro", "cuisine_grouped").agg(F.avg("failed").alias("failure_rate")))


@query("kpi_tiles", rounded(
    "SELECT CAST(count(DISTINCT camis) AS BIGINT) AS n_entities, CAST(count(*) AS BIGINT) AS n_inspections, "
    "avg(failed) AS failure_rate, avg(score) AS mean_score, avg(has_yelp) AS rated_share FROM clean",
    ["failure_rate", "mean_score", "rated_share"]))
def kpi_tiles(spark, d):
    """A14 + A22: dashboard tiles in one aggregate."""
    return finish(SM.tiles(B.clean(spark, d)))


@query("monthly_trend", rounded(
    "SELECT strftime(inspection_date, '%Y-%m') AS year_month, boro, CAST(count(failed) AS BIGINT) AS n "
    "FROM clean GROUP BY 1, 2", []))
def monthly_trend(spark, d):
    """A15 + F4: inspections per year-month and region."""
    return SM.monthly_trend(B.clean(spark, d))


@query("region_context", rounded(
    "SELECT boro, avg(failed) AS failure_rate, avg(median_household_income) AS mean_income, "
    "CAST(count(*) AS BIGINT) AS n, avg(food_complaints_total) AS mean_complaints FROM clean GROUP BY 1",
    ["failure_rate", "mean_income", "mean_complaints"]))
def region_context(spark, d):
    """Region failure rate with mean income and mean complaints."""
    c = B.clean(spark, d)
    return finish(c.groupBy("boro").agg(F.avg("failed").alias("failure_rate"),
                                        F.avg("median_household_income").alias("mean_income"),
                                        F.count(F.lit(1)).alias("n"),
                                        F.avg("food_complaints_total").alias("mean_complaints")))


_PROFILE_SQL = (f"SELECT {FIXED_CLUSTER_SQL} AS cluster, CAST(count(*) AS BIGINT) AS inspections, "
                "avg(failed) AS failure_rate, avg(prev_score) AS avg_prev_score, avg(has_history) AS history_rate, "
                "avg(is_first_inspection) AS first_inspection_rate, avg(food_complaints_total) AS avg_food_complaints, "
                "quantile_cont(median_household_income, 0.5) AS median_income, avg(has_yelp) AS yelp_coverage "
                "FROM clean GROUP BY 1")
PROFILE_DOUBLES = ["failure_rate", "avg_prev_score", "history_rate", "first_inspection_rate",
                   "avg_food_complaints", "median_income", "yelp_coverage"]


def cluster_profile_of(df):
    """One profile row per cluster."""
    return df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("inspections"), F.avg("failed").alias("failure_rate"),
        F.avg("prev_score").alias("avg_prev_score"), F.avg("has_history").alias("history_rate"),
        F.avg("is_first_inspection").alias("first_inspection_rate"),
        F.avg("food_complaints_total").alias("avg_food_complaints"),
        F.percentile("median_household_income", 0.5).alias("median_income"),
        F.avg("has_yelp").alias("yelp_coverage"))


@query("cluster_profile", rounded(_PROFILE_SQL, PROFILE_DOUBLES))
def cluster_profile(spark, d):
    """A17 on a fixed assignment column (the MLlib assignment is rows-only)."""
    return finish(cluster_profile_of(B.clean(spark, d).withColumn("cluster", fixed_cluster())))


@query("crosstab_share", rounded(
    f"SELECT cluster, " + ", ".join(
        f"coalesce(count(*) FILTER (WHERE boro = '{r}') / count(*), 0.0) AS \"{r}\"" for r in S.STANDIN_REGIONS)
    + f" FROM (SELECT {FIXED_CLUSTER_SQL} AS cluster, boro FROM clean) t GROUP BY cluster",
    [f'"{r}"' for r in S.STANDIN_REGIONS]))
def crosstab_share(spark, d):
    """Cluster x region shares, each row sums to 1."""
    c = B.clean(spark, d).withColumn("cluster", fixed_cluster())
    return finish(SM.crosstab_share(c, "cluster", "boro", S.STANDIN_REGIONS))


@query("crosstab_outcome", rounded(
    "SELECT cluster, coalesce(count(*) FILTER (WHERE failed = 0) / count(*), 0.0) AS \"Passed\", "
    "coalesce(count(*) FILTER (WHERE failed = 1) / count(*), 0.0) AS \"Failed\" "
    f"FROM (SELECT {FIXED_CLUSTER_SQL} AS cluster, failed FROM clean) t GROUP BY cluster", ['"Passed"', '"Failed"']))
def crosstab_outcome(spark, d):
    """Cluster x outcome shares, each row sums to 1."""
    c = SM.display_labels(B.clean(spark, d)).withColumn("cluster", fixed_cluster())
    return finish(SM.crosstab_share(c, "cluster", "failed_label", ["Passed", "Failed"]))


@query("outcome_share", rounded(
    "SELECT failed, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share "
    "FROM clean GROUP BY failed", ["share"]))
def outcome_share(spark, d):
    """Counts and shares of the outcome."""
    return finish(SM.outcome_share(B.clean(spark, d)))


_HIST_SQL = """
SELECT bin, CAST(count(*) AS BIGINT) AS n, min(lo) + bin * min(w) AS bin_lo, min(lo) + (bin + 1) * min(w) AS bin_hi
FROM (SELECT lo, w, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((score - lo) / w), 44) END AS INTEGER) AS bin
      FROM clean, (SELECT min(score) AS lo, (max(score) - min(score)) / 45.0 AS w FROM clean
                   WHERE score IS NOT NULL) mm
      WHERE score IS NOT NULL) t GROUP BY bin"""


@query("histogram_equal_width", rounded(_HIST_SQL, ["bin_lo", "bin_hi"]))
def histogram_equal_width(spark, d):
    """Score in 45 equal-width bins over [min, max]."""
    return finish(SM.histogram_equal_width(B.clean(spark, d), "score", 45))


@query("histogram_unit", rounded(
    "SELECT CAST(floor(violation_count) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n "
    "FROM clean WHERE violation_count IS NOT NULL GROUP BY 1", []))
def histogram_unit(spark, d):
    """Unit-width bins for a count column."""
    c = B.clean(spark, d).filter(F.col("violation_count").isNotNull())
    return c.groupBy(F.floor("violation_count").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("histogram_rating", rounded(
    "SELECT CAST(least(floor((yelp_rating - 1.0) / 0.25), 15) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, "
    "1.0 + least(floor((yelp_rating - 1.0) / 0.25), 15) * 0.25 AS bin_lo, "
    "1.0 + (least(floor((yelp_rating - 1.0) / 0.25), 15) + 1) * 0.25 AS bin_hi "
    "FROM clean WHERE yelp_rating >= 1.0 AND yelp_rating <= 5.0 GROUP BY 1, 3, 4", ["bin_lo", "bin_hi"]))
def histogram_rating(spark, d):
    """Ratings in fixed 0.25-wide bins over [1, 5]."""
    return finish(SM.histogram_fixed(B.clean(spark, d), "yelp_rating", 1.0, 0.25, 16))


@query("histogram_rating_half", rounded(
    "SELECT CAST(least(floor((yelp_rating - 1.0) / 0.5), 7) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, "
    "1.0 + least(floor((yelp_rating - 1.0) / 0.5), 7) * 0.5 AS bin_lo, "
    "1.0 + (least(floor((yelp_rating - 1.0) / 0.5), 7) + 1) * 0.5 AS bin_hi "
    "FROM clean WHERE yelp_rating >= 1.0 AND yelp_rating <= 5.0 GROUP BY 1, 3, 4", ["bin_lo", "bin_hi"]))
def histogram_rating_half(spark, d):
    """Ratings in 0.5-wide bins over [1, 5]."""
    return finish(SM.histogram_fixed(B.clean(spark, d), "yelp_rating", 1.0, 0.5, 8))


_DENS_SQL = """
SELECT failed, bin, CAST(count(*) AS BIGINT) AS n, min(lo) + bin * min(w) AS bin_lo, min(lo) + (bin + 1) * min(w) AS bin_hi,
       count(*) / (sum(count(*)) OVER (PARTITION BY failed) * min(w)) AS density
FROM (SELECT failed, lo, w, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((score - lo) / w), 49) END AS INTEGER) AS bin
      FROM clean, (SELECT min(score) AS lo, (max(score) - min(score)) / 50.0 AS w FROM clean
                   WHERE score IS NOT NULL) mm
      WHERE score IS NOT NULL) t GROUP BY failed, bin"""


@query("histogram_density", rounded(_DENS_SQL, ["bin_lo", "bin_hi", "density"]))
def histogram_density(spark, d):
    """50-bin density histogram per outcome on a shared range."""
    return finish(SM.histogram_equal_width(B.clean(spark, d), "score", 50, group="failed", density=True))


_BOX_VARS = ["score", "score_trend", "yelp_rating"]


def _box_sql(v):
    inside = f"{v} >= q[1] - 1.5 * (q[3] - q[1]) AND {v} <= q[3] + 1.5 * (q[3] - q[1])"
    return (f"SELECT '{v}' AS variable, c.failed, q[1] AS q1, q[2] AS median, q[3] AS q3, "
            f"CAST(count(*) AS BIGINT) AS n, min({v}) FILTER (WHERE {inside}) AS whisker_lo, "
            f"max({v}) FILTER (WHERE {inside}) AS whisker_hi, "
            f"CAST(count(*) FILTER (WHERE NOT ({inside})) AS BIGINT) AS n_outliers "
            f"FROM clean c JOIN (SELECT failed, quantile_cont({v}, [0.25, 0.5, 0.75]) AS q FROM clean "
            f"WHERE {v} IS NOT NULL GROUP BY 1) bq ON c.failed = bq.failed WHERE {v} IS NOT NULL GROUP BY c.failed, q")


@query("box_stats", rounded(" UNION ALL ".join(_box_sql(v) for v in _BOX_VARS),
                            ["q1", "median", "q3", "whisker_lo", "whisker_hi"]))
def box_stats(spark, d):
    """Box statistics of score, score trend and rating by outcome."""
    return finish(SM.box_stats_many(B.clean(spark, d), _BOX_VARS, "failed"))


@query("complete_categories", rounded(
    "SELECT g.grade_label, coalesce(r.n, 0) AS n FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('No grade', 3)) "
    "g(grade_label, k) LEFT JOIN (SELECT coalesce(grade, 'No grade') AS grade_label, CAST(count(*) AS BIGINT) AS n "
    "FROM clean GROUP BY 1) r ON r.grade_label = g.grade_label", []))
def complete_categories(spark, d):
    """Grade counts reindexed to the fixed order, absent grades 0."""
    c = B.clean(spark, d).withColumn("grade_label", F.coalesce(F.col("grade"), F.lit("No grade")))
    agg = c.groupBy("grade_label").agg(F.count(F.lit(1)).alias("n"))
    return SM.complete_categories(agg, "grade_label", ["A", "B", "C", "No grade"], fill={"n": 0})


@query("display_labels", rounded(
    "SELECT camis, inspection_date, CASE WHEN failed = 1 THEN 'Failed' ELSE 'Passed' END AS failed_label, "
    "coalesce(grade, 'No grade') AS grade_label, "
    "['" + "', '".join(S.MONTH_NAMES) + "'][inspection_month] AS month_name, "
    "['" + "', '".join(S.WEEKDAY_NAMES) + "'][inspection_dow + 1] AS dow_name FROM clean", []))
def display_labels(spark, d):
    """Outcome, grade, month and weekday labels."""
    return SM.display_labels(B.clean(spark, d)).select("camis", "inspection_date", "failed_label",
                                                       "grade_label", "month_name", "dow_name")


@query("seeded_sample", rounded(
    "SELECT camis, inspection_date, prev_score, score, failed FROM clean "
    "ORDER BY md5(camis || '|' || CAST(inspection_date AS VARCHAR) || '|42'), camis, inspection_date LIMIT 10000",
    ["prev_score", "score"]))
def seeded_sample(spark, d):
    """Exact-n repeatable sample (10,000 rows, capped at the table size) for scatter data."""
    c = B.clean(spark, d).select("camis", "inspection_date", "prev_score", "score", "failed")
    return finish(SM.seeded_sample(c, ["camis", "inspection_date"], 10000))
