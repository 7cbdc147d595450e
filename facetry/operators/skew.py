"""Per-key results when a few keys hold most rows (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.keys import feature_number, usable
from facetry.sources.tables import stored

#: Rows of one key that a task takes; keys that the sketch tells apart at least and at most, and how many more it tracks.
TASK_ROWS, LEAST_KEYS, MOST_KEYS, TRACKED = 1_000_000, 256, 100_000, 10


def heavy_keys(rows: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> dict[int, int]:
    """Hashes of the keys that hold too many of ``rows`` for one task, with their rows, by a frequent-items sketch.

    Heavy is a key of more than 1/k of the rows, k being the tasks of ``task_rows`` rows, :data:`LEAST_KEYS` at
    least and :data:`MOST_KEYS` at most, which also bounds the list. A second pass is only taken where k
    exceeds what the first tells apart. The result only steers how a key is processed, never what
    comes out, so neither the sketch's error nor a collision of hashes can change a result.
    """

    def look(k: int):
        # the sketch takes a power of two and fills it to three quarters
        tracked = 1 << (TRACKED * k).bit_length()
        return rows.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {k}, {min(tracked, 1_000_000)})").alias("top")).head()

    k, row = LEAST_KEYS, look(LEAST_KEYS)
    if row["n"] // task_rows > k:
        k = min(MOST_KEYS, row["n"] // task_rows)
        row = look(k)
    return {t["item"]: t["count"] for t in row["top"] or [] if t["count"] * k > row["n"]}


def split_heavy(rows: DataFrame, keys: list[str], heavy: dict[int, int], task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the heavy keys with __slices, how many tasks each should take, and the other rows, by a broadcast join with the key list.

    The list is bounded by :data:`MOST_KEYS`; a key with nulls is a key like any other.
    """
    few = [(h, max(8, -(-2 * n // task_rows))) for h, n in heavy.items()]
    few = F.broadcast(rows.sparkSession.createDataFrame(few, "__h bigint, __slices bigint"))
    rows = rows.withColumn("__h", F.xxhash64(*keys))
    return rows.join(few, "__h").drop("__h"), rows.join(few, "__h", "left_anti").drop("__h")


def feature_members(rows: DataFrame) -> DataFrame:
    """(saved_features, feature_id, doc_id, weight) of the rows that are members.

    A row without a number in ``feature_key`` or without ``doc_id`` is no member; a null
    or NaN weight stays a member with a null weight. Rows without a file name form a file
    of their own.
    """
    return rows.select(
        "saved_features", feature_number(F.col("feature_key")).alias("feature_id"), "doc_id", usable(F.col("weight")).alias("weight")
    ).where("feature_id is not null and doc_id is not null")


def feature_results(members: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row for every feature of every file, without a few features holding up the rest.

    Columns: saved_features, feature_id, members (distinct doc_id), rows, weight_sum and
    weight_max over the members, mean_weight, top_doc_id (the member of the highest weight,
    of equal ones the smallest), file_members and share (of the members of the file).
    A repeated member counts once, with its highest weight; null weights are left out of
    the weight columns, which are null where no member has one.

    Method: a sketch finds the features that hold most rows. Their rows are split off by a
    broadcast join, and de-duplicated and aggregated in slices by doc_id, as many as their rows
    fill tasks of ``task_rows``, whose few partial results are then merged; all other features take one ordinary shuffle by feature
    in which de-duplication and aggregation run together. Both parts are united. An empty
    table gives an empty result.
    """
    keys = ["saved_features", "feature_id"]
    members = stored(members)  # keys are read once for the sketch and both parts
    heavy = heavy_keys(members, keys, task_rows)
    hot, rest = split_heavy(members, keys, heavy, task_rows)

    def partial(df: DataFrame, by: list[str]) -> DataFrame:
        per = df.groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("r"), F.max("weight").alias("w"))
        top = F.max(F.when(F.col("w").isNotNull(), F.struct("w", (-F.col("doc_id")).alias("d"))))
        return per.groupBy(*by).agg(
            F.count(F.lit(1)).alias("members"), F.sum("r").alias("rows"), F.sum("w").alias("weight_sum"), F.count("w").alias("weighted"), top.alias("top")
        )

    slices = partial(hot.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("__slices"))), [*keys, "slice"])
    merged = slices.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("members", "rows", "weight_sum", "weighted")], F.max("top").alias("top"))
    per = partial(rest.repartition(*[F.col(k) for k in keys]), keys).unionByName(merged)
    per = per.select(
        *keys, "members", "rows", "weight_sum", F.col("top.w").alias("weight_max"),
        F.when(F.col("weighted") > 0, F.col("weight_sum") / F.col("weighted")).alias("mean_weight"), (-F.col("top.d")).alias("top_doc_id"),
    )
    files = per.groupBy(F.col("saved_features").alias("__file")).agg(F.sum("members").alias("file_members"))
    return (
        per.join(files, F.col("saved_features").eqNullSafe(F.col("__file")))
        .withColumn("share", F.col("members") / F.col("file_members"))
        .drop("__file")
    )


def heavy_features(results: DataFrame, percent: int = 4) -> DataFrame:
    """(saved_features, feature_id) with more than ``percent`` % of the members of their file."""
    return results.where(F.col("members") * 100 > F.col("file_members") * percent).select("saved_features", "feature_id")
