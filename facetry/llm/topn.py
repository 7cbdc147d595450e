"""Top N items within every group (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.operators.skew import heavy_keys, split_heavy
from facetry.sources.tables import latest, stored

#: Histogram bins for each doubling of the score.
PER_OCTAVE, FAR = 8, 1 << 16


def score_bin(score: Column) -> Column:
    """A bin number that never falls as the score rises, for any finite or infinite double.

    Bins are logarithmic, so no range has to be known beforehand; zero has its own bin and
    negative scores mirror the positive ones.
    """
    size = F.least(F.greatest(F.log2(F.abs(score)) * PER_OCTAVE, F.lit(-FAR + 1.0)), F.lit(FAR - 1.0))
    return F.when(score > 0, F.floor(size) + FAR).when(score < 0, -(F.floor(size) + FAR)).otherwise(F.lit(0)).cast("int")


def top_n(rows: DataFrame, groups: list[str], item: str, score: str, n: int, small: bool = False) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every group, of equal ones the smaller ``item``.

    Returns ``groups``, ``item``, ``score`` and ``place`` (1 to n). Rows whose score is null
    or NaN are left out; groups with fewer rows give all; a repeated item counts as often as
    it occurs; a null group is a group of its own; an empty table gives an empty result.
    Other columns of ``rows`` are ignored. ``small`` tells that every group has few rows by construction.

    Method: a histogram of scores for each group that holds too many rows for one task (found by a
    sketch, so at most :data:`facetry.operators.skew.MOST_KEYS`) gives the highest bin edge above which
    at least n rows lie. These floors are broadcast, and rows below them dropped where they are
    read, before any shuffle. All groups are then ranked exactly; each task first limits its part of a
    group to n rows, so ties cannot pile up either. Groups that fit into a task need no floor.
    """
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    names = [f"__g{i}" for i in range(len(groups))]
    rows = rows.select(*keys, F.col(item).alias("__item"), F.col(score).cast("double").alias("__score")).where("__score is not null and not isnan(__score)")
    heavy = {}
    if not small:
        rows = stored(rows)
        heavy = heavy_keys(rows, names)
    if heavy:
        hot, rows = split_heavy(rows, names, heavy)
        hot = hot.select(*names, "__item", "__score", score_bin(F.col("__score")).alias("__bin"))
        counts = hot.groupBy(*names, "__bin").agg(F.count(F.lit(1)).alias("__n"))
        above = Window.partitionBy(*names).orderBy(F.col("__bin").desc())
        floors = (
            counts.withColumn("__above", F.sum("__n").over(above) - F.col("__n"))
            .where(F.col("__above") < n)
            .groupBy(*[F.col(x).alias(f"{x}f") for x in names])
            .agg(F.min("__bin").alias("__floor"))
        )
        same = F.lit(True)
        for x in names:
            same = same & F.col(x).eqNullSafe(F.col(f"{x}f"))
        rows = rows.unionByName(hot.join(F.broadcast(floors), same).where("__bin >= __floor").select(*names, "__item", "__score"))
    order = Window.partitionBy(*names).orderBy(F.col("__score").desc(), F.col("__item").asc())
    return (
        rows.select(*names, "__item", "__score")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .select(*[F.col(x).alias(g) for x, g in zip(names, groups)], F.col("__item").alias(item), F.col("__score").alias(score), "place")
    )


def topic_scores(topic2doc: DataFrame) -> DataFrame:
    """(kind, group_id, item_id, score): the latest weight of every pair of topic and record."""
    rows = latest(topic2doc.where("topic_id is not null and doc_id is not null"), ["topic_id", "doc_id"], ["weight"])
    return rows.select(F.lit("topic").alias("kind"), F.col("topic_id").cast("bigint").alias("group_id"), F.col("doc_id").alias("item_id"), F.col("weight").alias("score"))


def doc_scores(theta: DataFrame) -> DataFrame:
    """(kind, group_id, item_id, score): the features above 0 in the latest theta of each record.

    A null, NaN or negative value counts as 0; a null array has no features.
    """
    rows = latest(theta.where("doc_id is not null"), ["doc_id"], ["theta"])
    cells = rows.select("doc_id", F.posexplode("theta").alias("item_id", "score"))
    return cells.where("score > 0 and not isnan(score)").select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("group_id"), F.col("item_id").cast("bigint").alias("item_id"), "score"
    )


def strongest(topic2doc: DataFrame, theta: DataFrame, per_topic: int = 10, per_doc: int = 3) -> DataFrame:
    """(kind, group_id, item_id, score, place): the strongest records of each topic and features of each record."""
    keys = ["kind", "group_id"]
    topics = top_n(topic_scores(topic2doc), keys, "item_id", "score", per_topic)
    return topics.unionByName(top_n(doc_scores(theta), keys, "item_id", "score", per_doc, small=True))
