"""Panel construction: A1-A3, J1-J5, J12, W1-W4, W7, calendar.

Physical plan at scale:
* A1 aggregates on (camis, inspection_date) with map-side partial aggregation:
  a hot key is combined before the shuffle.  The first-value columns are text,
  so this is a sort aggregate; the panel therefore collapses order rows that
  already carry their line counts (``preaggregated``), not line rows.
* J1/J2 and the W1-W4 window all key on ``camis``; the entity-level joins come
  first so one hash partitioning on ``camis`` serves joins and window.  After
  A1 an entity has at most one row per day, so a window partition is bounded by
  the date domain, never by the fact volume.
* J3-J5 join daily / per-area dimensions whose size is bounded by the date and
  geography domains; whether they are broadcast is left to the planner and AQE,
  which go by their measured bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as E

FIRST_COLUMNS = [("dba", "dba"), ("boro", "boro"), ("zipcode", "zipcode"),
                 ("cuisine_description", "cuisine"), ("score", "score"),
                 ("grade", "grade"), ("action", "action")]


def first_non_null(c: str, order_col: str):
    """pandas ``first``: first non-NULL value in row order (min_by over non-NULL rows)."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col)))


def collapse_inspections(raw: DataFrame, order_col: str = "ord", carry=(), preaggregated: bool = False) -> DataFrame:
    """A1 + P6: violation rows -> one row per (camis, inspection_date).

    ``preaggregated``: the rows already carry violation_count and critical_count
    (lines counted per order), which are added up.

    NULL keys are dropped first (pandas ``groupby`` drops them).  ``carry``
    names extra columns taken with the same first-non-NULL rule.
    """
    firsts = list(FIRST_COLUMNS) + [(c, c) for c in carry]
    if preaggregated:
        counts = [F.sum(c).alias(c) for c in ("violation_count", "critical_count")]
    else:
        counts = [F.count("violation_code").alias("violation_count"),
                  F.count_if(F.col("critical_flag") == "Critical").cast("long").alias("critical_count")]
    agg = (raw.dropna(subset=["camis", "inspection_date"])
              .groupBy("camis", "inspection_date")
              .agg(*[first_non_null(src, order_col).alias(dst) for src, dst in firsts], *counts))
    return agg.withColumn("failed", E.failed_label())


def weather_daily(hourly: DataFrame, ts_col: str = "timestamp_local") -> DataFrame:
    """A2: hourly readings -> one row per day (4 means, max, min, 3 sums; an
    all-missing sum is 0 as in pandas)."""
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0.0))
    return (hourly.groupBy(F.to_date(F.col(ts_col)).alias("date"))
                  .agg(F.avg("temperature_2m").alias("temp_mean"),
                       F.max("temperature_2m").alias("temp_max"),
                       F.min("temperature_2m").alias("temp_min"),
                       total("precipitation").alias("precipitation_sum"),
                       total("rain").alias("rain_sum"),
                       total("snowfall").alias("snowfall_sum"),
                       F.avg("wind_speed_10m").alias("wind_speed_mean"),
                       F.avg("wind_gusts_10m").alias("wind_gust_mean"),
                       F.avg("cloud_cover").alias("cloud_cover_mean")))


def complaints_daily(complaints: DataFrame) -> DataFrame:
    """A3: complaints -> (day, borough): total + two conditional counts."""
    return (complaints.groupBy(F.to_date("created_date").alias("date"), F.upper("borough").alias("borough"))
                      .agg(F.count("unique_key").alias("food_complaints_total"),
                           F.count_if(F.col("complaint_type") == "Rodents").cast("long")
                            .alias("rodent_complaints"),
                           F.count_if(F.col("complaint_type") == "Food Safety").cast("long")
                            .alias("food_safety_complaints")))


def census_clean(census: DataFrame, key: str = "boro") -> DataFrame:
    """The sentinel -666666666 -> NULL on the three measures."""
    return census.select(key, *[F.nullif(F.col(c), F.lit(float(S.CENSUS_SENTINEL))).alias(c)
                               for c in S.CENSUS_COLUMNS])


def calendar_features(df: DataFrame, date_col: str = "inspection_date") -> DataFrame:
    """F1/F2/P19 (part): year, month, Monday=0 weekday, quarter, weekend flag."""
    d = F.col(date_col)
    return df.withColumns({
        "inspection_year": F.year(d),
        "inspection_month": F.month(d),
        "inspection_dow": E.weekday_mon0(d),
        "inspection_quarter": F.quarter(d),
        "is_weekend": (E.weekday_mon0(d) >= 5).cast("int"),
    })


def lag_features(df: DataFrame, key: str = "camis", order: str = "inspection_date") -> DataFrame:
    """W1-W4 over each entity's visits in date order."""
    w = Window.partitionBy(key).orderBy(order)
    prev = F.lag("score").over(w)
    return df.withColumns({
        "prev_score": prev,
        "prev_failed": F.lag("failed", 1, -1).over(w).cast("int"),
        "inspection_count": F.row_number().over(w).cast("long"),
    }).withColumn("score_trend", F.col("score") - F.col("prev_score"))


def dedupe_first(df: DataFrame, keys, order_col: str) -> DataFrame:
    """Keep the first row per key in a stated order (not bare dropDuplicates).

    ``min_by`` over a struct is a partial-aggregating hash aggregate, so a hot
    key is combined map-side rather than sorted in one task.
    """
    cols = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.col(order_col)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def build_panel(insp: DataFrame, master: DataFrame, ratings: DataFrame, weather: DataFrame,
                complaints: DataFrame, census: DataFrame, census_key: str = "boro") -> DataFrame:
    """Visits + coordinates + ratings + weather + complaints + census,
    calendar and lag features, complaint zero fill (P12)."""
    p = insp
    p = p.join(master.select("camis", "latitude", "longitude"), "camis", "left")              # J1
    p = p.join(ratings.select("camis", "yelp_rating", "yelp_reviews", "yelp_price",
                              "yelp_category", "high_rating"), "camis", "left")               # J2
    p = lag_features(p)                                                                        # W1-W4
    p = p.join(weather.withColumnRenamed("date", "inspection_date"), "inspection_date", "left")  # J3
    c = complaints.withColumnRenamed("date", "inspection_date").withColumnRenamed("borough", "boro")
    p = p.join(c, ["inspection_date", "boro"], "left")                                         # J4
    p = p.join(census.select(census_key, *S.CENSUS_COLUMNS), census_key, "left")               # J5
    p = calendar_features(p)
    p = p.fillna(0, subset=S.COMPLAINT_COLUMNS)                                                # P12
    return p.select(*S.PANEL_COLUMNS)
