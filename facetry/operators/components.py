"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.sources.tables import release, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the smallest of each component, which is its root.

    ``edges`` has two BIGINT columns; their order and repetitions don't matter, loops and rows
    with a null are dropped. Large-star and small-star steps alternate until nothing changes,
    about log n times; minima are pre-aggregated before each shuffle and nothing but two
    numbers a step reaches the driver. Each step is stored, so lineage stays short.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b))
    state = stored(edges.distinct())
    before = None
    while True:
        sums = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(sums) == before or not sums[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = tuple(sums), state
        state = stored(_small_star(_large_star(old).distinct()).distinct())
        release(old)
