"""Readers and parsers for landing data.

The published pipeline pulled JSON over HTTP; here the landing data is files
(or a DataFrame with one JSON document per row) parsed with built-in JSON
functions, never with per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expr as E


# -- S1 / S2 / P27: typed scans ------------------------------------------------

def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV read with a declared schema (never inferred)."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text_schema).option("header", True).csv(path)
    return coerce_types(raw, schema)


def coerce_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One projection of ``try_cast`` per column; bad text, '' and NaN -> NULL."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(c == "", F.lit(None).cast("string")).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.to_date(F.try_to_timestamp(c)).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.try_to_timestamp(c).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(E.nan_to_null(c.try_cast("double")).cast(f.dataType).alias(f.name))
        else:
            out.append(c.try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def as_text(df: DataFrame) -> DataFrame:
    """The text form of a table as it is stored in CSV (every column a string)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# -- S3: inspections landing -----------------------------------------------------

def read_inspections_json(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """S3: JSON records with a declared schema, date window pushed to the scan."""
    df = spark.read.schema(S.INSPECTIONS_RAW).json(path)
    return scan_inspections(df, start, end)


def scan_inspections(df: DataFrame, start: str, end: str) -> DataFrame:
    """S3 filter + P1: the study window and upper-case borough."""
    return (df.filter((F.col("inspection_date") >= F.lit(start).cast("date"))
                      & (F.col("inspection_date") <= F.lit(end).cast("date")))
              .withColumn("boro", F.upper("boro")))


# -- S4: restaurant master ---------------------------------------------------------

def scan_master(master: DataFrame, order_col: str = "ord") -> DataFrame:
    """Rows with coordinates, first row per entity (W7), upper-case borough."""
    from ..operators.panel import dedupe_first
    located = master.filter(F.col("latitude").isNotNull())
    return dedupe_first(located, ["camis"], order_col).withColumn("boro", F.upper("boro"))


# -- S5: ratings landing -----------------------------------------------------------

def flatten_business_json(landing: DataFrame, json_col: str = "json") -> DataFrame:
    """S5 + F12 + F13 + P7: first business of each search response -> 7 columns.

    ``get`` returns NULL for an empty array (``[0]`` would raise under ANSI).
    """
    parsed = F.from_json(F.col(json_col), T.StructType([S.RATINGS_JSON["businesses"]]))
    b = F.get(parsed["businesses"], 0)
    found = b.isNotNull()
    out = landing.select(
        "camis",
        b["id"].alias("yelp_id"),
        b["rating"].alias("yelp_rating"),
        b["review_count"].cast("double").alias("yelp_reviews"),
        F.when(found, F.length(F.coalesce(b["price"], F.lit(""))).cast("double")).alias("yelp_price"),
        F.when(found, F.array_join(F.transform(b["categories"], lambda c: c["alias"]), ","))
         .alias("yelp_category"),
    )
    return out.withColumn("high_rating", E.high_rating_label("yelp_rating"))


# -- S6 / F20: columnar weather landing --------------------------------------------

def weather_hourly_explode(landing: DataFrame, json_col: str = "json") -> DataFrame:
    """``{"hourly": {"time": [...], m: [...]}}`` -> one row per reading."""
    parsed = landing.select(F.from_json(F.col(json_col), S.WEATHER_JSON)["hourly"].alias("h"))
    zipped = F.arrays_zip(F.col("h.time").alias("time"),
                          *[F.col(f"h.{m}").alias(m) for m in S.WEATHER_MEASURES])
    rows = parsed.select(F.inline(zipped))
    return rows.select(
        F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("timestamp_local"),
        *S.WEATHER_MEASURES)


# -- S7: complaints ----------------------------------------------------------------

def complaints_scan(raw: DataFrame, regions, start: str, end: str) -> DataFrame:
    """Food-related types in the date window, valid boroughs (pushed filters)."""
    return (raw.filter(F.col("complaint_type").isin(S.FOOD_COMPLAINT_TYPES))
               .filter((F.col("created_date") >= F.lit(start).cast("timestamp_ntz"))
                       & (F.col("created_date") <= F.lit(end + " 23:59:59").cast("timestamp_ntz")))
               .withColumn("borough", F.upper("borough"))
               .filter(F.col("borough").isin(list(regions))))


# -- S8 / F21 / J9: census matrix ------------------------------------------------

def census_explode(landing: DataFrame, area_map: DataFrame | None = None,
                   json_col: str = "json") -> DataFrame:
    """JSON matrix (header row + rows) -> named columns; P11 sentinel -> NULL;
    J9 county code -> borough through a small map (``area_map`` has a fixed size:
    one row per census county)."""
    m = landing.select(F.from_json(F.col(json_col), "array<array<string>>").alias("m"))
    rows = m.select(F.col("m")[0].alias("header"), F.posexplode("m").alias("pos", "row")) \
            .filter(F.col("pos") > 0)

    def field(name):
        return F.element_at(F.col("row"), F.array_position(F.col("header"), name).cast("int"))

    def measure(name):
        v = E.nan_to_null(field(name).try_cast("double"))
        return F.nullif(v, F.lit(float(S.CENSUS_SENTINEL)))

    out = rows.select(
        measure("B19013_001E").alias("median_household_income"),
        measure("B01003_001E").alias("total_population"),
        measure("B02001_002E").alias("white_population"),
        field("NAME").alias("NAME"),
        field("county").alias("county"))
    if area_map is None:
        mp = F.create_map(*[F.lit(x) for kv in S.COUNTY_TO_BORO.items() for x in kv])
        return out.withColumn("boro", F.upper(F.element_at(mp, F.col("county"))))
    return out.join(F.broadcast(area_map), "county", "left")


def violation_lookup(spark: SparkSession) -> DataFrame:
    """The static violation reference (written, never joined)."""
    return spark.createDataFrame(S.VIOLATION_LOOKUP, "violation_code string, severity string, category string")
