"""Fixed values, feature lists and declared schemas.

Everything in the block marked FIXED VALUES must stay equal to the published
pipeline for results to agree; it is stated plainly and in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the published pipeline's definitions)
# ---------------------------------------------------------------------------

# failed = grade 'C' or score >= 28
FAIL_GRADE = "C"
FAIL_SCORE = 28
# score buckets: NULL -> 'NA', <=13 -> 'A', <=27 -> 'B', else 'C'
BUCKET_A_MAX = 13
BUCKET_B_MAX = 27
# high rating = rating >= 4.0
HIGH_RATING_MIN = 4.0
# categories kept before pooling into 'Other'
TOP_CUISINES = 20
# complaint types kept at the source
FOOD_COMPLAINT_TYPES = ["Food Establishment", "Food Poisoning", "Unsanitary Condition",
                        "Food Safety", "Rodents", "Cockroaches"]
# census sentinel for "not available"
CENSUS_SENTINEL = -666666666
# census county code -> borough
COUNTY_TO_BORO = {"061": "MANHATTAN", "047": "BROOKLYN", "081": "QUEENS",
                  "005": "BRONX", "085": "STATEN ISLAND"}
NYC_BOROUGHS = ["BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND"]
# static violation reference (code, severity, category)
VIOLATION_LOOKUP = [
    ("04L", "critical", "food_temperature"),
    ("04N", "critical", "food_contamination"),
    ("06D", "critical", "personal_hygiene"),
    ("08A", "not_critical", "vermin"),
    ("10F", "not_critical", "facility"),
    ("10B", "not_critical", "facility"),
    ("02B", "critical", "food_source"),
    ("09C", "not_critical", "other"),
]
# leakage audit: excluded column -> reason
LEAKAGE_AUDIT = [
    ("score", "Directly defines failed; using it would leak the target."),
    ("grade", "Directly reflects inspection outcome."),
    ("score_bucket", "Derived from score, therefore leaks target information."),
    ("action", "Post-inspection administrative outcome."),
    ("violation_count", "Current inspection violation count is only known during/after inspection."),
    ("critical_count", "Current inspection critical violations are only known during/after inspection."),
    ("critical_ratio", "Derived from current inspection violations."),
    ("score_trend", "Uses current score, therefore leaks outcome information."),
    ("cluster", "Part B cluster may use score/violation variables; excluded for leakage-safe modeling."),
    ("camis", "Restaurant ID, not generalizable."),
    ("dba", "Restaurant name, not generalizable."),
    ("inspection_date", "Raw date replaced by engineered temporal features."),
    ("latitude", "High missingness; not used directly."),
    ("longitude", "High missingness; not used directly."),
    ("zipcode", "High cardinality; borough captures broader location context."),
]
# model inputs (stage 4 and stage 5 use the same lists)
NUMERIC_FEATURES = [
    "prev_score", "prev_failed", "inspection_count",
    "poor_history_flag", "is_first_inspection", "has_history",
    "food_complaints_total", "rodent_complaints", "food_safety_complaints",
    "complaint_intensity", "complaint_density", "high_complaint_flag",
    "temp_mean", "precipitation_sum", "rain_sum", "snowfall_sum",
    "wind_speed_mean", "cloud_cover_mean",
    "month_sin", "month_cos", "dow_sin", "dow_cos",
    "summer_flag", "is_weekend",
    "median_household_income", "total_population", "white_pct",
    "has_yelp", "has_location", "log_yelp_reviews", "yelp_price",
]
CATEGORICAL_FEATURES = ["boro", "cuisine_grouped", "yelp_category_primary"]
# correlation matrix inputs (28)
CORR_FEATURES = [
    "violation_count", "critical_count", "temp_mean", "precipitation_sum", "rain_sum",
    "snowfall_sum", "wind_speed_mean", "wind_gust_mean", "cloud_cover_mean",
    "food_complaints_total", "rodent_complaints", "food_safety_complaints",
    "median_household_income", "total_population", "white_population", "white_pct",
    "inspection_month", "inspection_dow", "is_weekend", "prev_score", "prev_failed",
    "inspection_count", "score_trend", "grade_available", "has_yelp",
    "is_first_inspection", "has_history", "has_location",
]
# PCA inputs (12)
PCA_FEATURES = [
    "score", "violation_count", "critical_count", "temp_mean", "precipitation_sum",
    "food_complaints_total", "rodent_complaints", "median_household_income",
    "white_pct", "prev_score", "inspection_count", "score_trend",
]
# clustering inputs (15)
CLUSTER_FEATURES = [
    "violation_count", "critical_count", "temp_mean", "precipitation_sum",
    "food_complaints_total", "rodent_complaints", "median_household_income",
    "white_pct", "prev_score", "prev_failed", "inspection_count",
    "has_history", "is_first_inspection", "has_yelp", "has_location",
]
# cluster names chosen by rule
CLUSTER_NAME_STABLE = "Stable Compliant"
CLUSTER_NAME_STABLE_RATED = "Yelp-Matched Stable Compliant"
CLUSTER_NAME_NO_HISTORY = "No-History Higher Risk"
CLUSTER_NAME_REPEAT = "Repeat Operators With Prior Risk"
CLUSTER_NAME_MIXED = "High-Risk Mixed Profile"
# readable feature names for importance tables (literal replacements, in order)
FEATURE_LABEL_REPLACEMENTS = [
    ("num__", ""), ("cat__", ""), ("cuisine_grouped_", "Cuisine: "),
    ("yelp_category_primary_", "Yelp: "), ("_", " "),
]
# calendar display names
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# fixed bin edges (right-closed)
VIOLATION_BINS = [(-0.1, 0, "0"), (0, 1, "1"), (1, 2, "2"), (2, 3, "3"), (3, 4, "4"), (4, None, "5+")]
CRITICAL_BINS = [(-0.1, 0, "0"), (0, 1, "1"), (1, 2, "2"), (2, 3, "3"), (3, None, "4+")]
TEMP_BINS = [(-20, 0, "(-20, 0]"), (0, 10, "(0, 10]"), (10, 20, "(10, 20]"),
             (20, 30, "(20, 30]"), (30, 45, "(30, 45]")]
# decision threshold chosen by the final model, and sweep range
FINAL_THRESHOLD = 0.47
SWEEP_FROM, SWEEP_TO = 10, 90          # thresholds k/100 for k in [10, 90]
# dashboard risk bands and fallback score
RISK_BANDS = [(0, 30, "low"), (30, 60, "medium"), (60, 100, "high")]
# map colours (RGBA): by outcome, by score bucket, by borough, constant, grey fallback
COLORS_BY_OUTCOME = {1: [230, 57, 70, 180], 0: [42, 157, 143, 180]}
COLORS_BY_BUCKET = {"A": [42, 157, 143, 180], "B": [233, 196, 106, 180],
                    "C": [230, 57, 70, 180], "NA": [150, 150, 150, 180]}
COLORS_BY_BORO = {"MANHATTAN": [69, 123, 157, 180], "BROOKLYN": [230, 57, 70, 180],
                  "QUEENS": [42, 157, 143, 180], "BRONX": [233, 196, 106, 180],
                  "STATEN ISLAND": [109, 104, 117, 180]}
COLOR_CONSTANT = [100, 100, 200, 180]
COLOR_GREY = [150, 150, 150, 180]
# quartile labels of the interaction heatmap
INCOME_QUARTILES = ["Q1 low income", "Q2", "Q3", "Q4 high income"]
COMPLAINT_QUARTILES = ["Q1 low complaints", "Q2", "Q3", "Q4 high complaints"]
# time split cut-off of the published pipeline (the stand-in uses its own)
CUTOFF_DATE = "2024-01-01"
SEED = 42

# ---------------------------------------------------------------------------
# Stand-in parameters (driver tables; see FIXTURES.md section 3)
# ---------------------------------------------------------------------------
STANDIN_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
STANDIN_CUTOFF = "2000-01-01"

# ---------------------------------------------------------------------------
# Declared schemas of the landing and produced tables
# ---------------------------------------------------------------------------
INSPECTIONS_RAW = T.StructType([
    T.StructField("camis", T.StringType(), False),
    T.StructField("dba", T.StringType()),
    T.StructField("boro", T.StringType()),
    T.StructField("zipcode", T.StringType()),
    T.StructField("cuisine_description", T.StringType()),
    T.StructField("inspection_date", T.DateType(), False),
    T.StructField("action", T.StringType()),
    T.StructField("violation_code", T.StringType()),
    T.StructField("violation_description", T.StringType()),
    T.StructField("critical_flag", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("grade", T.StringType()),
    T.StructField("ord", T.LongType(), False),
])

RATINGS_JSON = T.StructType([
    T.StructField("camis", T.StringType()),
    T.StructField("businesses", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("price", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StructType([
            T.StructField("alias", T.StringType())]))),
    ]))),
])

WEATHER_MEASURES = ["temperature_2m", "precipitation", "rain", "snowfall",
                    "wind_speed_10m", "wind_gusts_10m", "cloud_cover"]

WEATHER_JSON = T.StructType([
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(m, T.ArrayType(T.DoubleType())) for m in WEATHER_MEASURES])),
])

CENSUS_COLUMNS = ["median_household_income", "total_population", "white_population"]
WEATHER_DAILY_COLUMNS = ["temp_mean", "temp_max", "temp_min", "precipitation_sum", "rain_sum",
                         "snowfall_sum", "wind_speed_mean", "wind_gust_mean", "cloud_cover_mean"]
COMPLAINT_COLUMNS = ["food_complaints_total", "rodent_complaints", "food_safety_complaints"]

PANEL_COLUMNS = (
    ["camis", "inspection_date", "dba", "boro", "zipcode", "cuisine", "score", "grade", "action",
     "violation_count", "critical_count", "failed", "latitude", "longitude",
     "yelp_rating", "yelp_reviews", "yelp_price", "yelp_category", "high_rating"]
    + WEATHER_DAILY_COLUMNS + COMPLAINT_COLUMNS + CENSUS_COLUMNS
    + ["inspection_year", "inspection_month", "inspection_dow", "inspection_quarter", "is_weekend",
       "prev_score", "prev_failed", "inspection_count", "score_trend"]
)

CLEAN_EXTRA_COLUMNS = ["grade_available", "has_location", "has_yelp", "is_first_inspection",
                       "has_history", "cuisine_grouped", "yelp_category_primary", "white_pct",
                       "score_bucket"]
CLEAN_COLUMNS = PANEL_COLUMNS + CLEAN_EXTRA_COLUMNS


def resolve_features(df, wanted):
    """Keep the wanted names that exist in ``df`` (the 'use if present' guard)."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
