"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``folder``, which may be any path that Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
