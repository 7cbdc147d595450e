"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetry.plans import reference, skewed


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference.QUERIES | skewed.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference.SQL | skewed.SQL
