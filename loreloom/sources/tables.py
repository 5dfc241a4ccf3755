"""Table access by name under one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``data_dir``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
