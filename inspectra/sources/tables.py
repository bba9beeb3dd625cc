"""Readers for the driver's Parquet tables.

Every reader selects only the columns it needs, so the Parquet scan's
``ReadSchema`` is pruned and filters written later are pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


_scans: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table, projecting ``columns``; the scan relation is reused per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _scans.get(key)
    if df is None:
        df = _scans[key] = spark.read.parquet(path)
    return df.select(*columns) if columns else df
