"""All core queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixspark.plans import catalogue, composition, data_problems, extras, intake, patterns, presentation, similarity

MODULES = [data_problems, composition, patterns, catalogue, similarity, extras, intake, presentation]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return data_problems.p4_found(spark, folder)
