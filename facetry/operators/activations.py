"""From activations of tokens to features of chunks and documents.

Token activations hold chunk (one or more key columns), pos, token_id, feature_id, act and valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunk_features(acts: DataFrame, chunk: list[str], how: str = "max", threshold: float = 0.0) -> DataFrame:
    """(chunk, feature_id, theta): ``mean``, ``max`` or ``frac_above`` of the valid tokens; 0 where none is valid."""
    ok = F.col("valid") & F.col("act").isNotNull()
    n = F.greatest(F.count_if(F.col("valid")), F.lit(1))
    ways = {
        "mean": F.coalesce(F.sum(F.when(ok, F.col("act"))), F.lit(0.0)) / n,
        "max": F.coalesce(F.max(F.when(ok, F.col("act"))), F.lit(0.0)),
        "frac_above": F.count_if(ok & (F.col("act") > threshold)) / n,
    }
    if how not in ways:
        raise ValueError(f"unknown aggregation {how!r}; there are {sorted(ways)}")
    return acts.groupBy(*chunk, "feature_id").agg(ways[how].alias("theta"))


def document_features(chunks: DataFrame, how: str = "max") -> DataFrame:
    """(doc_id, feature_id, theta): elementwise ``mean`` or ``max`` over the chunks of a document."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {how!r}; there are mean and max")
    return chunks.groupBy("doc_id", "feature_id").agg((F.avg if how == "mean" else F.max)("theta").alias("theta"))


def top_tokens(acts: DataFrame, chunk: list[str], k: int, excluded_token: int | None = None, act_threshold: float = 0.0) -> DataFrame:
    """(chunk, feature_id, feature_weight, place, pos, token_id, act): the ``k`` strongest valid tokens of each feature of a chunk.

    A feature is active where its highest finite activation exceeds ``act_threshold``; that is its
    weight, the excluded token's included. Of the k strongest (of equal ones the earlier), those
    not positive, not finite or of the excluded token are then dropped.
    """
    rows = acts.where("valid and act is not null and not isnan(act)").where(F.abs("act") < F.lit(float("inf")))
    by = [*chunk, "feature_id"]
    active = rows.groupBy(*by).agg(F.max("act").alias("feature_weight")).where(F.col("feature_weight") > act_threshold)
    order = Window.partitionBy(*by).orderBy(F.col("act").desc(), "pos")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where("act > 0")
    if excluded_token is not None:
        top = top.where(F.col("token_id") != excluded_token)
    return top.join(active, by).select(*by, "feature_weight", "place", "pos", "token_id", "act")


def nested(tokens: DataFrame, chunk: list[str]) -> DataFrame:
    """(chunk, theta_sparse): the rows of :func:`top_tokens` as one ordered list of structs for each chunk."""
    cell = F.struct("place", "pos", "token_id", "act")
    per = tokens.groupBy(*chunk, "feature_id", "feature_weight").agg(F.array_sort(F.collect_list(cell)).alias("tokens"))
    return per.groupBy(*chunk).agg(F.array_sort(F.collect_list(F.struct("feature_id", "feature_weight", "tokens"))).alias("theta_sparse"))


def nested_labelled(tokens: DataFrame, chunk: list[str]) -> DataFrame:
    """As :func:`nested`, with the feature_label that :func:`explain` added."""
    cell = F.struct("place", "pos", "token_id", "act")
    per = tokens.groupBy(*chunk, "feature_id", "feature_weight", "feature_label").agg(F.array_sort(F.collect_list(cell)).alias("tokens"))
    return per.groupBy(*chunk).agg(F.array_sort(F.collect_list(F.struct("feature_id", "feature_weight", "tokens", "feature_label"))).alias("theta_sparse"))


def with_documents(theta: DataFrame, sparse: DataFrame) -> DataFrame:
    """``theta`` with the concatenated theta_sparse of each document's chunks, an empty list where there are none."""
    lists = sparse.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "theta_sparse"))).alias("l"))
    flat = lists.select("doc_id", F.flatten(F.transform("l", lambda x: x["theta_sparse"])).alias("theta_sparse"))
    return theta.join(flat, "doc_id", "left").withColumn("theta_sparse", F.coalesce("theta_sparse", F.array().cast(dict(flat.dtypes)["theta_sparse"])))


def explain(features: DataFrame, explanations: DataFrame | None, default: str = "<no explanation>") -> DataFrame:
    """``features`` with feature_label, the description of each feature, ``default`` where it has none or a blank one."""
    if explanations is None:
        return features
    few = explanations.select("feature_id", F.col("description").alias("feature_label"))
    label = F.coalesce(F.when(F.trim("feature_label") != "", F.col("feature_label")), F.lit(default))
    return features.join(few, "feature_id", "left").withColumn("feature_label", label)


def last_explanations(batches: DataFrame, default: str = "<no explanation>") -> DataFrame:
    """(feature_id, description) of bulk records (feature_id, description, batch, line): the last of an id holds, blank ones read as ``default``."""
    last = F.max_by(F.coalesce(F.when(F.trim("description") != "", F.col("description")), F.lit(default)), F.struct("batch", "line"))
    return batches.where("feature_id is not null").groupBy("feature_id").agg(last.alias("description"))


def fetched_explanation(feature: int, cache: dict[int, str], fetch: Callable[[int], dict], missing: str = "<no explanation field found in JSON>") -> str:
    """The first description of a feature's record, by a ``fetch`` plug-in, which is asked once for each feature."""
    if feature not in cache:
        found = [e.get("description") for e in fetch(feature).get("explanations") or []]
        cache[feature] = next((d for d in found if d is not None), missing)
    return cache[feature]
