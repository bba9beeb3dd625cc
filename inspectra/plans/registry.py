"""Query registry: name -> (Spark callable, optional SQL twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its SQL twin."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round6(c) -> F.Column:
    """6-place rounding written as plain IEEE arithmetic, floor(x * 1e6 + 0.5) / 1e6,
    so Spark and the SQL twin round a tie the same way (the built-in ``round``
    functions of the two engines disagree on exact halves)."""
    return (F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).cast("double")


def finish(df: DataFrame) -> DataFrame:
    """Presentation step shared with the SQL twins: doubles rounded to 6 places."""
    return df.select(*[round6(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
