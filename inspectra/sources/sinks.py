"""Sinks: S10 tables, S11 metric tables, S12 fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import write_parquet


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A stage table as Parquet (the panel / clean tables by year)."""
    write_parquet(df, path, partition_by, "overwrite")


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small metric table as one file (its size is a few rows by construction)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_model(model, path: str) -> None:
    """Persist a fitted model (replaces pickled models): JSON and a Parquet table of tree nodes."""
    model.save(SparkSession.active(), path)


def load_model(path: str):
    from ..operators.modeling import Model
    return Model.load(SparkSession.active(), path)
