"""SQL twins (DuckDB dialect) of the stand-in stages, as composable CTEs.

Each registered query's oracle is ``WITH <stage CTEs> SELECT ...``; the CTEs
restate the stand-in mapping and the stage rules in plain SQL so DuckDB can
recompute every result independently of Spark.
"""

from __future__ import annotations

from .. import schemas as S

REGIONS_SQL = ", ".join(f"'{r}'" for r in S.STANDIN_REGIONS)

PANEL_DOUBLES = (["score", "latitude", "longitude", "yelp_rating", "yelp_reviews", "yelp_price"]
                 + S.WEATHER_DAILY_COLUMNS + S.CENSUS_COLUMNS + ["prev_score", "score_trend"])
CLEAN_DOUBLES = PANEL_DOUBLES + ["white_pct"]
FEATURE_DOUBLES = CLEAN_DOUBLES + ["complaint_intensity", "complaint_density", "month_sin",
                                   "month_cos", "dow_sin", "dow_cos", "log_yelp_reviews"]


def title_sql(x: str) -> str:
    """pandas title case for ASCII text."""
    return (f"list_aggregate(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', '')")


BASE_CTES = f"""
geo AS (
  SELECT n.n_nationkey, n.n_name, r.r_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
raw AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS camis, c.c_name AS dba,
         upper(CASE WHEN c.c_custkey % 97 = 0 THEN '0' ELSE g.r_name END) AS boro,
         CASE WHEN c.c_custkey % 50 = 0 THEN NULL ELSE CAST(c.c_custkey * 37 AS VARCHAR) || '.0' END AS zipcode,
         '  ' || lower(g.n_name) AS cuisine_description,
         CAST(o.o_orderdate AS DATE) AS inspection_date,
         o.o_orderstatus AS action,
         CAST(l.l_partkey AS VARCHAR) AS violation_code,
         CASE WHEN l.l_orderkey IS NULL THEN NULL WHEN l.l_returnflag = 'R' THEN 'Critical'
              ELSE 'Not Critical' END AS critical_flag,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'P' THEN NULL
              ELSE CAST(floor(o.o_totalprice / 12500) AS DOUBLE) END AS score,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B'
              WHEN '3-MEDIUM' THEN 'C' END AS grade,
         o.o_orderkey AS ord, g.n_name AS area
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN geo g ON c.c_nationkey = g.n_nationkey
       LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  WHERE CAST(o.o_orderdate AS DATE) BETWEEN DATE '1992-01-01' AND DATE '2001-12-31'),
insp0 AS (
  SELECT camis, inspection_date,
         min_by(dba, ord) FILTER (WHERE dba IS NOT NULL) AS dba,
         min_by(boro, ord) FILTER (WHERE boro IS NOT NULL) AS boro,
         min_by(zipcode, ord) FILTER (WHERE zipcode IS NOT NULL) AS zipcode,
         min_by(cuisine_description, ord) FILTER (WHERE cuisine_description IS NOT NULL) AS cuisine,
         min_by(score, ord) FILTER (WHERE score IS NOT NULL) AS score,
         min_by(grade, ord) FILTER (WHERE grade IS NOT NULL) AS grade,
         min_by(action, ord) FILTER (WHERE action IS NOT NULL) AS action,
         min_by(area, ord) FILTER (WHERE area IS NOT NULL) AS area,
         CAST(count(violation_code) AS BIGINT) AS violation_count,
         CAST(count(*) FILTER (WHERE critical_flag = 'Critical') AS BIGINT) AS critical_count
  FROM raw WHERE camis IS NOT NULL AND inspection_date IS NOT NULL
  GROUP BY camis, inspection_date),
insp AS (
  SELECT *, CAST(coalesce(grade = 'C', false) OR coalesce(score >= 28, false) AS INTEGER) AS failed
  FROM insp0),
master AS (
  SELECT CAST(c_custkey AS VARCHAR) AS camis,
         40.5::DOUBLE + CAST(c_custkey AS DOUBLE) / 10000.0::DOUBLE AS latitude,
         -74.0::DOUBLE + CAST(c_custkey AS DOUBLE) / 10000.0::DOUBLE AS longitude
  FROM customer WHERE c_custkey % 5 = 0),
ratings AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS camis,
         CASE WHEN lb.doc_id IS NOT NULL THEN 'b' || CAST(d.doc_id AS VARCHAR) END AS yelp_id,
         3.0::DOUBLE + 1.5::DOUBLE * lb.quality - 0.5::DOUBLE * lb.toxic AS yelp_rating,
         CASE WHEN lb.doc_id IS NOT NULL THEN CAST(d.n_chars AS DOUBLE) END AS yelp_reviews,
         CASE WHEN lb.doc_id IS NOT NULL THEN CAST(d.doc_id % 4 AS DOUBLE) END AS yelp_price,
         CASE WHEN lb.doc_id IS NOT NULL THEN d.source || ',' || d.lang END AS yelp_category,
         CAST(coalesce(3.0::DOUBLE + 1.5::DOUBLE * lb.quality - 0.5::DOUBLE * lb.toxic >= 4.0, false)
              AS INTEGER) AS high_rating
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id),
hourly AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) AS timestamp_local, l_quantity - 15 AS temperature_2m,
         l_tax * 100 AS precipitation,
         CASE WHEN l_linestatus = 'O' THEN l_tax * 100 END AS rain,
         CAST(NULL AS DOUBLE) AS snowfall, l_discount * 100 AS wind_speed_10m,
         l_extendedprice / 5000 AS wind_gusts_10m, CAST(l_linenumber * 10 AS DOUBLE) AS cloud_cover
  FROM lineitem),
weather AS (
  SELECT CAST(timestamp_local AS DATE) AS inspection_date,
         avg(temperature_2m) AS temp_mean, max(temperature_2m) AS temp_max,
         min(temperature_2m) AS temp_min,
         coalesce(sum(precipitation), 0.0::DOUBLE) AS precipitation_sum,
         coalesce(sum(rain), 0.0::DOUBLE) AS rain_sum,
         coalesce(sum(snowfall), 0.0::DOUBLE) AS snowfall_sum,
         avg(wind_speed_10m) AS wind_speed_mean, avg(wind_gusts_10m) AS wind_gust_mean,
         avg(cloud_cover) AS cloud_cover_mean
  FROM hourly GROUP BY 1),
complaints_raw AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS unique_key,
         CAST(l.l_shipdate AS TIMESTAMP) AS created_date,
         CASE l.l_returnflag WHEN 'A' THEN 'Rodents' WHEN 'N' THEN 'Food Safety'
              ELSE 'Food Poisoning' END AS complaint_type,
         g.r_name AS borough
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN geo g ON s.s_nationkey = g.n_nationkey),
complaints AS (
  SELECT CAST(created_date AS DATE) AS inspection_date, upper(borough) AS boro,
         CAST(count(unique_key) AS BIGINT) AS food_complaints_total,
         CAST(count(*) FILTER (WHERE complaint_type = 'Rodents') AS BIGINT) AS rodent_complaints,
         CAST(count(*) FILTER (WHERE complaint_type = 'Food Safety') AS BIGINT) AS food_safety_complaints
  FROM complaints_raw
  WHERE complaint_type IN ('Food Establishment', 'Food Poisoning', 'Unsanitary Condition',
                           'Food Safety', 'Rodents', 'Cockroaches')
    AND created_date >= TIMESTAMP '1992-01-01 00:00:00'
    AND created_date <= TIMESTAMP '2001-12-31 23:59:59'
    AND upper(borough) IN ({REGIONS_SQL})
  GROUP BY 1, 2),
census_raw AS (
  SELECT g.n_name AS area, g.r_name AS boro, g.n_nationkey,
         CASE WHEN g.n_nationkey % 6 = 0 THEN -666666666.0::DOUBLE ELSE inc.inc END AS median_household_income,
         pop.total_population, pop.white_population
  FROM geo g
  LEFT JOIN (SELECT s_nationkey, quantile_cont(s_acctbal, 0.5) AS inc FROM supplier GROUP BY 1) inc
         ON g.n_nationkey = inc.s_nationkey
  LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS total_population,
                    CAST(count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS DOUBLE)
                      AS white_population
             FROM customer GROUP BY 1) pop ON g.n_nationkey = pop.c_nationkey),
census AS (
  SELECT area, nullif(median_household_income, -666666666.0::DOUBLE) AS median_household_income,
         nullif(total_population, -666666666.0::DOUBLE) AS total_population,
         nullif(white_population, -666666666.0::DOUBLE) AS white_population
  FROM census_raw),
panel0 AS (
  SELECT i.camis, i.inspection_date, i.dba, i.boro, i.zipcode, i.cuisine, i.score, i.grade, i.action,
         i.violation_count, i.critical_count, i.failed, m.latitude, m.longitude,
         r.yelp_rating, r.yelp_reviews, r.yelp_price, r.yelp_category, r.high_rating,
         w.temp_mean, w.temp_max, w.temp_min, w.precipitation_sum, w.rain_sum, w.snowfall_sum,
         w.wind_speed_mean, w.wind_gust_mean, w.cloud_cover_mean,
         coalesce(cp.food_complaints_total, 0) AS food_complaints_total,
         coalesce(cp.rodent_complaints, 0) AS rodent_complaints,
         coalesce(cp.food_safety_complaints, 0) AS food_safety_complaints,
         ce.median_household_income, ce.total_population, ce.white_population
  FROM insp i
  LEFT JOIN master m ON m.camis = i.camis
  LEFT JOIN ratings r ON r.camis = i.camis
  LEFT JOIN weather w ON w.inspection_date = i.inspection_date
  LEFT JOIN complaints cp ON cp.inspection_date = i.inspection_date AND cp.boro = i.boro
  LEFT JOIN census ce ON ce.area = i.area),
panel AS (
  SELECT *,
         CAST(year(inspection_date) AS INTEGER) AS inspection_year,
         CAST(month(inspection_date) AS INTEGER) AS inspection_month,
         CAST(isodow(inspection_date) - 1 AS INTEGER) AS inspection_dow,
         CAST(quarter(inspection_date) AS INTEGER) AS inspection_quarter,
         CAST(isodow(inspection_date) - 1 >= 5 AS INTEGER) AS is_weekend,
         lag(score) OVER w AS prev_score,
         CAST(lag(failed, 1, -1) OVER w AS INTEGER) AS prev_failed,
         CAST(row_number() OVER w AS BIGINT) AS inspection_count,
         score - lag(score) OVER w AS score_trend
  FROM panel0 WINDOW w AS (PARTITION BY camis ORDER BY inspection_date)),
c1 AS (
  SELECT * FROM panel
  WHERE boro IN ({REGIONS_SQL})
    AND NOT (score IS NULL AND grade IS NULL AND coalesce(violation_count, 0) = 0)),
meds AS (
  SELECT boro, quantile_cont(median_household_income, 0.5) AS m_inc,
         quantile_cont(total_population, 0.5) AS m_pop, quantile_cont(white_population, 0.5) AS m_white
  FROM c1 GROUP BY boro),
c2 AS (
  SELECT c1.*, {title_sql('trim(c1.cuisine)')} AS cuisine_t,
         regexp_replace(c1.zipcode, '\\.0$', '') AS zip_t,
         coalesce(c1.median_household_income, meds.m_inc) AS inc_f,
         coalesce(c1.total_population, meds.m_pop) AS pop_f,
         coalesce(c1.white_population, meds.m_white) AS white_f
  FROM c1 LEFT JOIN meds ON c1.boro = meds.boro),
topc AS (
  SELECT cuisine_t FROM c2 WHERE cuisine_t IS NOT NULL
  GROUP BY cuisine_t ORDER BY count(*) DESC, cuisine_t ASC LIMIT 20),
clean AS (
  SELECT camis, inspection_date, dba, boro,
         CASE WHEN length(zip_t) < 5 THEN lpad(zip_t, 5, '0') ELSE zip_t END AS zipcode,
         cuisine_t AS cuisine, score, grade, action, violation_count, critical_count, failed,
         latitude, longitude, yelp_rating, yelp_reviews, nullif(yelp_price, 0.0::DOUBLE) AS yelp_price,
         yelp_category, high_rating, temp_mean, temp_max, temp_min, precipitation_sum, rain_sum,
         snowfall_sum, wind_speed_mean, wind_gust_mean, cloud_cover_mean,
         food_complaints_total, rodent_complaints, food_safety_complaints,
         inc_f AS median_household_income, pop_f AS total_population, white_f AS white_population,
         inspection_year, inspection_month, inspection_dow, inspection_quarter, is_weekend,
         coalesce(prev_score, -1.0::DOUBLE) AS prev_score, coalesce(prev_failed, -1) AS prev_failed,
         inspection_count, coalesce(score_trend, 0.0::DOUBLE) AS score_trend,
         CAST(grade IS NOT NULL AS INTEGER) AS grade_available,
         CAST(latitude IS NOT NULL AS INTEGER) AS has_location,
         CAST(yelp_rating IS NOT NULL AS INTEGER) AS has_yelp,
         CAST(inspection_count = 1 AS INTEGER) AS is_first_inspection,
         CAST(prev_score IS NOT NULL AS INTEGER) AS has_history,
         CASE WHEN cuisine_t IN (SELECT cuisine_t FROM topc) THEN cuisine_t ELSE 'Other' END AS cuisine_grouped,
         trim(split_part(coalesce(yelp_category, 'unknown'), ',', 1)) AS yelp_category_primary,
         CASE WHEN pop_f = 0 THEN NULL ELSE white_f / pop_f END AS white_pct,
         CASE WHEN score IS NULL THEN 'NA' WHEN score <= 13 THEN 'A' WHEN score <= 27 THEN 'B'
              ELSE 'C' END AS score_bucket
  FROM c2),
q75 AS (SELECT quantile_cont(food_complaints_total, 0.75) AS q FROM clean),
fe AS (
  SELECT clean.*,
         CAST(coalesce(prev_failed = 1, false) OR coalesce(prev_score >= 28, false) AS INTEGER)
           AS poor_history_flag,
         coalesce(CAST(food_complaints_total AS DOUBLE), 0.0::DOUBLE)
           + coalesce(CAST(rodent_complaints AS DOUBLE), 0.0::DOUBLE)
           + coalesce(CAST(food_safety_complaints AS DOUBLE), 0.0::DOUBLE) AS complaint_intensity,
         CASE WHEN total_population IS NULL OR total_population = 0 THEN NULL
              ELSE coalesce(CAST(food_complaints_total AS DOUBLE), 0.0::DOUBLE) / total_population
              END * 10000.0::DOUBLE AS complaint_density,
         CAST(coalesce(food_complaints_total > (SELECT q FROM q75), false) AS INTEGER) AS high_complaint_flag,
         sin(2 * pi() * inspection_month / 12.0::DOUBLE) AS month_sin,
         cos(2 * pi() * inspection_month / 12.0::DOUBLE) AS month_cos,
         sin(2 * pi() * inspection_dow / 7.0::DOUBLE) AS dow_sin,
         cos(2 * pi() * inspection_dow / 7.0::DOUBLE) AS dow_cos,
         CAST(inspection_month IN (6, 7, 8) AS INTEGER) AS summer_flag,
         CASE WHEN yelp_reviews > -1 THEN ln(1 + yelp_reviews) END AS log_yelp_reviews
  FROM clean)
"""


def with_base(select_sql: str) -> str:
    return f"WITH {BASE_CTES.strip()}\n{select_sql}"


def rounded(select_sql: str, doubles, extra_ctes: str = "") -> str:
    """Wrap a query so the named double columns are rounded to 6 places
    (the same IEEE formula as ``registry.round6``)."""
    rep = ", ".join(f"CAST(floor({c} * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS DOUBLE) AS {c}"
                    for c in doubles)
    body = f"SELECT * REPLACE ({rep}) FROM ({select_sql}) q_" if rep else select_sql
    ctes = BASE_CTES.strip() + ((",\n" + extra_ctes.strip()) if extra_ctes else "")
    return f"WITH {ctes}\n{body}"
