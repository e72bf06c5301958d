"""Reading the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` below ``folder``; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
