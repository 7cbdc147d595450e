"""Exact ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.sources.tables import stored


def grouped_rank(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with place (from 0, by ``order``) and group_rows, the size of the group.

    Rows are range-partitioned by group and order, so a group with a third of all rows lies in
    many partitions; the counts of the partitions before give each its first place. ``order`` must
    tell rows of a group apart for the result to be defined.
    """
    keys = [F.col(group), *(F.col(c) for c in order)]
    placed = stored(rows.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    per = placed.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__p")
    starts = per.withColumn("__first", F.sum("__n").over(before) - F.col("__n")).withColumn("group_rows", F.sum("__n").over(Window.partitionBy(group)))
    local = placed.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order)))
    return local.join(starts.drop("__n"), [group, "__p"]).withColumn("place", F.col("__first") + F.col("__r") - 1).drop("__p", "__first", "__r")
