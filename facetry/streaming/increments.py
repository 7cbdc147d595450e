"""Incremental forms of the aggregates: the same results from rows that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(rows: DataFrame, keys: list[str], values: list[str], at: str, late: str = "500 days") -> DataFrame:
    """The latest row of each key among those seen so far, in update mode; rows later than ``late`` are dropped with their state."""
    rows = rows.withColumn("__t", F.col(at).cast("timestamp")).withWatermark("__t", late)
    best = F.max_by(F.struct(*values), F.col("__t")).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, "r.*")


def feature_sizes_stream(members: DataFrame) -> DataFrame:
    """(feature_id, n) over the memberships seen so far, in complete or update mode."""
    return members.where("weight > 0").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
