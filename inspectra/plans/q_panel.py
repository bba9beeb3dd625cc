"""Registered queries: sources, collapse, joins, windows and the panel (stage 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as E
from ..operators import panel as P
from ..session import fresh_path
from ..sources import landing as L
from ..sources import sinks
from ..sources import standin as SI
from ..sources.tables import read
from . import build as B
from .oracle_base import PANEL_DOUBLES, rounded
from .registry import finish, query

WEATHER_D = S.WEATHER_DAILY_COLUMNS
RAW_COLS = ("camis, dba, boro, zipcode, cuisine_description, inspection_date, action, "
            "violation_code, critical_flag, score, grade, ord")


@query("panel_build", rounded("SELECT * FROM panel", PANEL_DOUBLES))
def panel_build(spark, d):
    """J12 (flagship): the 43-column inspection panel."""
    return finish(B.panel_plan(spark, d))


@query("scan_inspections", rounded(f"SELECT {RAW_COLS} FROM raw", ["score"]))
def scan_inspections(spark, d):
    """S3: violation-level landing rows in the study window, declared types."""
    return finish(B.raw(spark, d).drop("violation_description", "area"))


@query("normalize_keys", """
WITH geo AS (SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT upper(CASE WHEN c.c_custkey % 97 = 0 THEN '0' ELSE g.r_name END) AS boro,
       CAST(count(*) AS BIGINT) AS n_rows
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.n_nationkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY 1""")
def normalize_keys(spark, d):
    """Upper-cased region key, rows per key."""
    return B.raw(spark, d).groupBy("boro").agg(F.count(F.lit(1)).alias("n_rows"))


@query("inspection_collapse", rounded(
    "SELECT camis, inspection_date, dba, boro, zipcode, cuisine, score, grade, action, "
    "violation_count, critical_count, failed FROM insp", ["score"]))
def inspection_collapse(spark, d):
    """A1: one row per (camis, inspection_date) with first values and counts."""
    return finish(B.inspections(spark, d).drop("area"))


@query("label_failed", """
WITH v AS (SELECT o.o_orderpriority, o.o_orderstatus,
                  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B'
                       WHEN '3-MEDIUM' THEN 'C' END AS grade,
                  CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'P' THEN NULL
                       ELSE CAST(floor(o.o_totalprice / 12500) AS DOUBLE) END AS score
           FROM orders o)
SELECT grade, CAST(coalesce(grade = 'C', false) OR coalesce(score >= 28, false) AS INTEGER) AS failed,
       CAST(count(*) AS BIGINT) AS n
FROM v GROUP BY 1, 2""")
def label_failed(spark, d):
    """Failed label by grade (NULL comparisons count as False)."""
    o = read(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    no_score = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P")
    v = o.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "A").when(F.col("o_orderpriority") == "2-HIGH", "B")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "C").alias("grade"),
        F.when(no_score, F.lit(None).cast("double"))
         .otherwise(F.floor(F.col("o_totalprice") / 12500).cast("double")).alias("score"))
    return v.withColumn("failed", E.failed_label()).groupBy("grade", "failed").agg(
        F.count(F.lit(1)).alias("n"))


@query("lag_features", rounded(
    "SELECT camis, inspection_date, prev_score, prev_failed, inspection_count, score_trend FROM panel",
    ["prev_score", "score_trend"]))
def lag_features(spark, d):
    """Previous score / outcome, visit number, score change per entity."""
    ins = B.inspections(spark, d)
    return finish(P.lag_features(ins).select("camis", "inspection_date", "prev_score", "prev_failed",
                                             "inspection_count", "score_trend"))


@query("weather_daily", rounded("SELECT inspection_date AS date, * EXCLUDE (inspection_date) FROM weather",
                                WEATHER_D))
def weather_daily(spark, d):
    """Hourly -> daily weather (means, max, min, sums with all-missing = 0)."""
    return finish(B.weather(spark, d))


@query("weather_hourly_explode", rounded(
    "SELECT timestamp_local, temperature_2m, precipitation, rain, snowfall, wind_speed_10m, "
    "wind_gusts_10m, cloud_cover FROM hourly", S.WEATHER_MEASURES))
def weather_hourly_explode(spark, d):
    """S6 + F20: columnar JSON landing -> one row per reading."""
    return finish(L.weather_hourly_explode(SI.weather_landing(spark, d)))


@query("complaints_daily", rounded(
    "SELECT inspection_date AS date, boro AS borough, food_complaints_total, "
    "rodent_complaints, food_safety_complaints FROM complaints", []))
def complaints_daily(spark, d):
    """A3: complaints per (day, borough): total and two conditional counts."""
    return B.complaints(spark, d)


@query("complaints_scan", rounded(
    "SELECT unique_key, created_date, complaint_type, upper(borough) AS borough FROM complaints_raw "
    "WHERE complaint_type IN ('Food Establishment', 'Food Poisoning', 'Unsanitary Condition', "
    "'Food Safety', 'Rodents', 'Cockroaches') AND upper(borough) IN ('AFRICA', 'AMERICA', 'ASIA', "
    "'EUROPE', 'MIDDLE EAST')", []))
def complaints_scan(spark, d):
    """Food-related complaint types, window and valid boroughs, pushed to the scan."""
    s = L.complaints_scan(SI.complaints_raw(spark, d), S.STANDIN_REGIONS, *B.STUDY_WINDOW)
    return s.select("unique_key", "created_date", "complaint_type", "borough")


@query("census_explode", rounded(
    "SELECT c.area, r.boro, c.median_household_income, c.total_population, c.white_population, "
    "lpad(CAST(r.n_nationkey AS VARCHAR), 3, '0') AS county, c.area AS NAME "
    "FROM census c JOIN census_raw r ON c.area = r.area", S.CENSUS_COLUMNS))
def census_explode(spark, d):
    """S8 + F21 + P11 + J9: census JSON matrices -> rows, sentinel -> NULL, code -> region."""
    out = L.census_explode(SI.census_landing(spark, d), SI.census_area_map(spark, d))
    return finish(out.select("area", "boro", *S.CENSUS_COLUMNS, "county", "NAME"))


@query("scan_master", rounded(
    "SELECT camis, latitude, longitude FROM master", ["latitude", "longitude"]))
def scan_master(spark, d):
    """S4 + W7: entities with coordinates, first row per key."""
    return finish(B.master(spark, d).select("camis", "latitude", "longitude"))


@query("flatten_business_json", rounded(
    "SELECT camis, yelp_id, yelp_rating, yelp_reviews, yelp_price, yelp_category, high_rating FROM ratings",
    ["yelp_rating", "yelp_reviews", "yelp_price"]))
def flatten_business_json(spark, d):
    """S5 + F12 + F13: nested search responses -> 7 flat columns."""
    return finish(B.ratings(spark, d))


@query("label_high_rating", """
SELECT high_rating, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CAST(coalesce(3.0::DOUBLE + 1.5::DOUBLE * lb.quality - 0.5::DOUBLE * lb.toxic >= 4.0, false)
              AS INTEGER) AS high_rating
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id) t GROUP BY 1""")
def label_high_rating(spark, d):
    """Rating >= 4 -> 1, missing -> 0 on the enrichment table."""
    return B.ratings(spark, d).groupBy("high_rating").agg(F.count(F.lit(1)).alias("n"))


_JOIN_SQL = "SELECT camis, inspection_date, {cols} FROM panel"


@query("join_coordinates", rounded(_JOIN_SQL.format(cols="latitude, longitude"), ["latitude", "longitude"]))
def join_coordinates(spark, d):
    """Visits left join coordinates on camis (row count unchanged)."""
    ins = B.inspections(spark, d).select("camis", "inspection_date")
    return finish(ins.join(B.master(spark, d).select("camis", "latitude", "longitude"), "camis", "left"))


@query("join_ratings", rounded(_JOIN_SQL.format(
    cols="yelp_rating, yelp_reviews, yelp_price, yelp_category, high_rating"),
    ["yelp_rating", "yelp_reviews", "yelp_price"]))
def join_ratings(spark, d):
    """Visits left join the static per-entity ratings."""
    ins = B.inspections(spark, d).select("camis", "inspection_date")
    r = B.ratings(spark, d).select("camis", "yelp_rating", "yelp_reviews", "yelp_price",
                                   "yelp_category", "high_rating")
    return finish(ins.join(r, "camis", "left"))


@query("join_weather", rounded(_JOIN_SQL.format(cols=", ".join(WEATHER_D)), WEATHER_D))
def join_weather(spark, d):
    """Visits left join daily weather on the visit date."""
    ins = B.inspections(spark, d).select("camis", "inspection_date")
    w = B.weather(spark, d).withColumnRenamed("date", "inspection_date")
    return finish(ins.join(w, "inspection_date", "left"))


@query("join_complaints", rounded(_JOIN_SQL.format(cols=", ".join(S.COMPLAINT_COLUMNS)), []))
def join_complaints(spark, d):
    """J4 + P12: composite (date, borough) left join, missing counts -> 0."""
    ins = B.inspections(spark, d).select("camis", "inspection_date", "boro")
    c = B.complaints(spark, d).withColumnRenamed("date", "inspection_date").withColumnRenamed("borough", "boro")
    return ins.join(c, ["inspection_date", "boro"], "left").fillna(0, subset=S.COMPLAINT_COLUMNS) \
              .select("camis", "inspection_date", *S.COMPLAINT_COLUMNS)


@query("join_census", rounded(_JOIN_SQL.format(cols=", ".join(S.CENSUS_COLUMNS)), S.CENSUS_COLUMNS))
def join_census(spark, d):
    """Visits left join the census on its geography key."""
    ins = B.inspections(spark, d).select("camis", "inspection_date", "area")
    return finish(ins.join(B.census(spark, d), "area", "left").drop("area"))


@query("calendar_features", rounded(
    "SELECT camis, inspection_date, inspection_year, inspection_month, inspection_dow, "
    "inspection_quarter, is_weekend, CASE WHEN inspection_month IN (12, 1, 2) THEN 'Winter' "
    "WHEN inspection_month IN (3, 4, 5) THEN 'Spring' WHEN inspection_month IN (6, 7, 8) THEN 'Summer' "
    "WHEN inspection_month IN (9, 10, 11) THEN 'Fall' ELSE 'Unknown' END AS season, "
    "CAST(inspection_month IN (6, 7, 8) AS INTEGER) AS summer_flag FROM panel", []))
def calendar_features(spark, d):
    """F1 + F2 + P19 + P20: calendar parts, weekend / summer flags, season label."""
    ins = B.inspections(spark, d).select("camis", "inspection_date")
    return P.calendar_features(ins).withColumns({
        "season": E.season(), "summer_flag": F.col("inspection_month").isin(6, 7, 8).cast("int")})


@query("scan_typed", rounded("SELECT * FROM panel", PANEL_DOUBLES))
def scan_typed(spark, d):
    """S1 + S2 + P27: the panel's text (CSV) form read back with declared types."""
    panel = B.panel(spark, d)
    return finish(L.coerce_types(L.as_text(panel), panel.schema))


@query("scan_csv", rounded("SELECT * FROM panel", PANEL_DOUBLES))
def scan_csv(spark, d):
    """S1 + S10: the panel written as header CSV and scanned with declared types."""
    panel, path = B.panel(spark, d), fresh_path(spark, "csv")
    (L.as_text(panel).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return finish(L.read_typed_csv(spark, path, panel.schema))


_JSON_COLS = [c for c in RAW_COLS.split(", ") if c in S.INSPECTIONS_RAW.names]


@query("scan_inspections_json", rounded(f"SELECT {', '.join(_JSON_COLS)} FROM raw", ["score"]))
def scan_inspections_json(spark, d):
    """S3: the violation rows landed as JSON records and scanned with the declared schema."""
    path = fresh_path(spark, "json")
    rows = SI.raw_inspections(spark, d)
    # the landing is compressed: its texts repeat from record to record
    rows.select(*[c for c in S.INSPECTIONS_RAW.names if c in rows.columns]).write.option("compression", "gzip").json(path)
    return finish(L.read_inspections_json(spark, path, *B.STUDY_WINDOW).select(*_JSON_COLS))


@query("table_round_trip", rounded("SELECT * FROM panel", PANEL_DOUBLES))
def table_round_trip(spark, d):
    """The panel saved as a table by year and read back."""
    panel, path = B.panel(spark, d), fresh_path(spark, "table")
    sinks.write_table(panel, path, "inspection_year")
    return finish(spark.read.parquet(path).select(*panel.columns))


@query("metrics_round_trip", rounded(
    "SELECT boro, CAST(count(*) AS BIGINT) AS n, avg(failed) AS failure_rate FROM clean GROUP BY 1", ["failure_rate"]))
def metrics_round_trip(spark, d):
    """A metric table saved as CSV and read back with declared types."""
    from ..operators import summary as SM
    metrics, path = SM.rate_by(B.clean(spark, d), "boro"), fresh_path(spark, "metrics")
    sinks.write_metrics(metrics, path)
    return finish(L.read_typed_csv(spark, path, metrics.schema))


@query("dedupe_first", """
SELECT camis, min_by(dba, ord) AS dba, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT CAST(o.o_custkey AS VARCHAR) AS camis, c.c_name AS dba, o.o_orderkey AS ord
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) t GROUP BY camis""")
def dedupe_first(spark, d):
    """First row per key in a stated order (here: each entity's first order)."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey")
    c = read(spark, d, "customer", "c_custkey", "c_name")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").cast("string").alias("camis"), F.col("c_name").alias("dba"),
        F.col("o_orderkey").alias("ord"))
    first = P.dedupe_first(rows, ["camis"], "ord").select("camis", "dba")
    n = rows.groupBy("camis").agg(F.count(F.lit(1)).alias("n_rows"))
    return first.join(n, "camis")
