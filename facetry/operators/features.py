"""Feature weights in long form, memberships and their aggregates.

The long form has the columns feature_id, doc_id and weight. A null or NaN weight is no weight;
null ids are left out; an empty table gives empty results throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.sources.tables import latest


def long_weights(rows: DataFrame, id_col: str, array_col: str, at: str | None = "loaded_at") -> DataFrame:
    """The long form of one array per document (position = feature); the latest row of a document holds."""
    rows = rows.where(F.col(id_col).isNotNull())
    rows = latest(rows, [id_col], [array_col], at) if at else rows
    cells = rows.select(F.col(id_col).alias("doc_id"), F.posexplode(array_col).alias("feature_id", "weight"))
    return cells.where("weight is not null and not isnan(weight)").select("feature_id", "doc_id", F.col("weight").cast("double").alias("weight"))


def pair_weights(rows: DataFrame, feature_col: str, id_col: str, weight_col: str) -> DataFrame:
    """The long form of rows that hold a feature, a document and a weight; the latest row of a pair holds."""
    rows = latest(rows.where(F.col(feature_col).isNotNull() & F.col(id_col).isNotNull()), [feature_col, id_col], [weight_col])
    rows = rows.select(F.col(feature_col).alias("feature_id"), F.col(id_col).alias("doc_id"), F.col(weight_col).alias("weight"))
    return rows.where("weight is not null and not isnan(weight)")


def members(weights: DataFrame) -> DataFrame:
    """Multi-label membership: every feature of positive weight."""
    return weights.where("weight > 0")


def strongest_feature(weights: DataFrame) -> DataFrame:
    """(doc_id, feature_id): single-label membership, the feature of highest weight, of equal ones the first."""
    best = F.max(F.struct("weight", (-F.col("feature_id")).alias("f")))
    return weights.groupBy("doc_id").agg(best.alias("b")).select("doc_id", (-F.col("b.f")).alias("feature_id"))


def share_of_feature(weights: DataFrame) -> DataFrame:
    """Weights divided by the sum of their feature, which is pre-aggregated and joined; a sum of 0 gives null."""
    sums = weights.groupBy("feature_id").agg(F.sum("weight").alias("total"))
    return weights.join(sums, "feature_id").select("feature_id", "doc_id", F.try_divide("weight", "total").alias("weight"))


def share_of_document(weights: DataFrame, least: float = 1e-6) -> DataFrame:
    """Weights divided by the sum of their document, or ``least`` if that is smaller."""
    sums = weights.groupBy("doc_id").agg(F.greatest(F.sum("weight"), F.lit(least)).alias("total"))
    return weights.join(sums, "doc_id").select("feature_id", "doc_id", (F.col("weight") / F.col("total")).alias("weight"))


def sizes(membership: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(feature_id, n) of every feature with members, or of all ``features``, 0 for those without."""
    found = membership.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
    if features is None:
        return found
    return features.select("feature_id").join(found, "feature_id", "left").select("feature_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def inverted_index(membership: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, doc_ids): the members of all ``features`` in ascending order, an empty list for one without.

    An edge format: a list is one value, so it is for features whose members fit into a row.
    """
    lists = membership.groupBy("feature_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    return features.select("feature_id").join(lists, "feature_id", "left").select("feature_id", F.coalesce("doc_ids", F.array().cast("array<bigint>")).alias("doc_ids"))


def evaluated_features(membership: DataFrame, labels: DataFrame, above: int = 1000) -> DataFrame:
    """(feature_id, n) of the features that have a label and more than ``above`` members."""
    return sizes(membership).where(F.col("n") > above).join(labels.select("feature_id"), "feature_id", "left_semi")


def excluded(docs: DataFrame, taken: DataFrame, cluster: int | None = None) -> DataFrame:
    """Documents that have not been sampled yet, and only those outside of ``cluster`` (column feature_id) if that is given."""
    rows = docs.join(taken.select("doc_id"), "doc_id", "left_anti")
    return rows if cluster is None else rows.where(F.col("feature_id") != cluster)


def large_features(membership: DataFrame, least: int) -> DataFrame:
    """Features with at least ``least`` members, and their sizes."""
    return sizes(membership).where(F.col("n") >= least)


def of_large_features(membership: DataFrame, least: int) -> DataFrame:
    """The members of the features that :func:`large_features` gives."""
    return membership.join(large_features(membership, least).select("feature_id"), "feature_id", "left_semi")


def highest_weight(weights: DataFrame) -> DataFrame:
    """(doc_id, weight): the highest weight of each document over all features."""
    return weights.groupBy("doc_id").agg(F.max("weight").alias("weight"))


def top_words(topic_word: DataFrame, vocab: DataFrame, k: int = 10) -> DataFrame:
    """(topic_id, place, word): the ``k`` words of highest probability of each topic, of equal ones the smaller word_id."""
    cells = topic_word.select("topic_id", F.posexplode("p").alias("word_id", "p")).where("p is not null")
    order = Window.partitionBy("topic_id").orderBy(F.col("p").desc(), "word_id")
    top = cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.join(vocab.select("word_id", "word"), "word_id").select("topic_id", "place", "word_id", "word")
