"""Stage composition on the stand-in sources: raw -> panel -> clean -> features.

Each function returns a lazy DataFrame; nothing runs until an action.  The study
window is an argument; ``STUDY_WINDOW`` covers the stand-in's order dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..session import stage_table
from ..operators import cleaning as C
from ..operators import features as FE
from ..operators import panel as P
from ..operators import serving as SV
from ..sources import landing as L
from ..sources import standin as SI

# the stand-in's study window covers its whole order-date range
STUDY_WINDOW = ("1992-01-01", "2001-12-31")


def raw(spark: SparkSession, d: str, window=STUDY_WINDOW) -> DataFrame:
    return L.scan_inspections(SI.raw_inspections(spark, d), *window)


def inspections(spark: SparkSession, d: str, window=STUDY_WINDOW) -> DataFrame:
    """A1 over rows whose lines have been counted per order (the row-level form is ``raw``)."""
    return P.collapse_inspections(L.scan_inspections(SI.order_inspections(spark, d), *window), carry=("area",),
                                  preaggregated=True)


def master(spark: SparkSession, d: str) -> DataFrame:
    return L.scan_master(SI.restaurants_master(spark, d))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return L.flatten_business_json(SI.ratings_landing(spark, d))


def weather(spark: SparkSession, d: str) -> DataFrame:
    return P.weather_daily(SI.weather_hourly(spark, d))


def complaints(spark: SparkSession, d: str, window=STUDY_WINDOW) -> DataFrame:
    scanned = L.complaints_scan(SI.complaints_raw(spark, d), S.STANDIN_REGIONS, *window)
    return P.complaints_daily(scanned)


def census(spark: SparkSession, d: str) -> DataFrame:
    return P.census_clean(SI.census_raw(spark, d), key="area")


def panel_plan(spark: SparkSession, d: str, window=STUDY_WINDOW) -> DataFrame:
    """The lazily planned panel (for ``explain`` and one-shot runs)."""
    return P.build_panel(inspections(spark, d, window), master(spark, d), ratings(spark, d),
                         weather(spark, d), complaints(spark, d, window), census(spark, d),
                         census_key="area")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Stage 1 output, written once per input (partitioned by year)."""
    return stage_table(spark, "panel", d, lambda: panel_plan(spark, d), partition_by="inspection_year")


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Stage 2 output, written once per input (partitioned by year)."""
    return stage_table(spark, "clean", d, lambda: C.clean_panel(panel(spark, d), S.STANDIN_REGIONS),
                       partition_by="inspection_year")


def features(spark: SparkSession, d: str) -> DataFrame:
    return FE.engineer(clean(spark, d))


def overview_cube(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's cube, written once per input: a selection reads it and not the visits."""
    return stage_table(spark, "cube", d, lambda: SV.overview_cube(clean(spark, d)))
