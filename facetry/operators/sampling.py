"""Samples of the documents of each feature, reproducible by a seed.

Each sampler returns feature_id, ord (from 0), doc_id and, for positives, weight. ``k`` of 0 or less
gives no rows, except that :func:`top_k` then gives all. A feature with fewer members gives all it has; one
without members gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.operators.ranking import grouped_rank
from facetry.sources.tables import stored


#: Documents that are put in order by one task.
FEW = 100_000


def draw_key(seed: int) -> Column:
    """A key by which rows of a feature come in an order that is as good as random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), "feature_id", "doc_id"))


def _first(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """At most ``k`` rows of each group; every task limits its groups before the shuffle."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("ord") < k)


def random_members(members: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Members without replacement, each as likely as any other."""
    return _first(members, k, ["feature_id"], draw_key(seed), F.col("doc_id")).select("feature_id", "ord", "doc_id", "weight")


def top_k(weights: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents of highest weight of all that have one, lightest first; of equal ones the larger doc_id counts as heavier."""
    if k <= 0:
        ranked = grouped_rank(weights, "feature_id", ["weight", "doc_id"])
        return ranked.select("feature_id", F.col("place").cast("int").alias("ord"), "doc_id", "weight")
    top = _first(weights, k, ["feature_id"], F.col("weight").desc(), F.col("doc_id").desc())
    up = Window.partitionBy("feature_id").orderBy("weight", "doc_id")
    return top.withColumn("ord", F.row_number().over(up) - 1).select("feature_id", "ord", "doc_id", "weight")


def weighted_members(members: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Members without replacement, drawn one after another with chances in proportion to their weights."""
    u = (F.conv(F.substring(draw_key(seed), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    drawn = members.where("weight > 0").withColumn("draw", F.ln(u) / F.col("weight"))
    return _first(drawn, k, ["feature_id"], F.col("draw").desc(), F.col("doc_id")).select("feature_id", "ord", "doc_id", "weight")


def stratified_members(members: DataFrame, k: int, strata: int = 10, seed: int = 42) -> DataFrame:
    """As many random members from each of min(strata, k) equal slices of the members by weight.

    The slices hold consecutive members by (weight, doc_id), the first ones one more where sizes
    don't divide; each gives k // slices members. Rows are in the order of slices.
    """
    if k <= 0:
        return members.limit(0).select("feature_id", F.lit(0).alias("ord"), "doc_id", "weight")
    s = min(strata, k)
    ranked = grouped_rank(members, "feature_id", ["weight", "doc_id"])
    base, more = F.floor(F.col("group_rows") / s), F.col("group_rows") % s
    wide = more * (base + 1)
    slot = F.when(F.col("place") < wide, F.floor(F.col("place") / (base + 1))).otherwise(more + F.floor((F.col("place") - wide) / F.greatest(base, F.lit(1))))
    picked = _first(ranked.withColumn("stratum", slot.cast("int")), k // s, ["feature_id", "stratum"], draw_key(seed), F.col("doc_id"))
    order = Window.partitionBy("feature_id").orderBy("stratum", "ord")
    return picked.withColumn("o", F.row_number().over(order) - 1).select("feature_id", F.col("o").alias("ord"), "doc_id", "weight", "stratum")


def negatives(members: DataFrame, docs: DataFrame, features: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Documents that are no members of the feature, each as likely as any other: feature_id, ord, doc_id.

    Documents come in one random order for all features, of which only as many are ranked as any
    feature needs (without a single-task sort where these are more than :data:`FEW`). A feature looks at the
    first of that order, as many as will hold k others if its members are spread evenly, and at four times
    as many only if they don't. So only the memberships of these documents are counted, not all, and a
    feature with nearly all documents unfolds its places in blocks over several tasks.
    """
    if k <= 0:
        return features.limit(0).select("feature_id", F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("doc_id"))
    keyed = stored(docs.select("doc_id", F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id")).alias("key")))
    total = keyed.count()

    def ordered(most: int) -> DataFrame:
        """(doc_id, at): the first ``most`` documents, at least."""
        if most <= FEW:
            first = keyed.orderBy("key", "doc_id").limit(most)
            return stored(first.select("doc_id", (F.row_number().over(Window.orderBy("key", "doc_id")) - 1).cast("bigint").alias("at")))
        ranked = grouped_rank(keyed.withColumn("g", F.lit(0)), "g", ["key", "doc_id"])
        return stored(ranked.select("doc_id", F.col("place").alias("at")).where(F.col("at") < most))

    n = members.groupBy("feature_id").agg(F.count(F.lit(1)).alias("m"))
    others = F.greatest(F.lit(total) - F.coalesce("m", F.lit(0)), F.lit(1))
    first = F.least(F.lit(total), F.ceil(F.lit(2.0 * k * total) / others) + 8).cast("bigint")
    reach = stored(features.select("feature_id").join(n, "feature_id", "left").select("feature_id", first.alias("reach")))
    while True:
        most = reach.agg(F.max("reach")).head()[0] or 0
        order = ordered(most)
        seen = members.select("feature_id", "doc_id").join(order, "doc_id").join(reach, "feature_id").where("at < reach")
        seen = stored(seen.select("feature_id", "at").distinct())
        met = seen.groupBy("feature_id").agg(F.count(F.lit(1)).alias("c"))
        short = reach.join(met, "feature_id", "left").select("feature_id", "reach", ((F.col("reach") - F.coalesce("c", F.lit(0)) < k) & (F.col("reach") < total)).alias("short"))
        if short.where("short").isEmpty():
            break
        reach = stored(short.select("feature_id", F.when(F.col("short"), F.least(F.col("reach") * 4, F.lit(total))).otherwise(F.col("reach")).alias("reach")))
    block = 1 << 16
    blocks = reach.where("reach > 0").select("feature_id", "reach", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("reach") - 1) / block))).alias("b"))
    last = F.least(F.col("reach"), (F.col("b") + 1) * block) - 1
    places = blocks.repartition("feature_id", "b").select("feature_id", F.explode(F.sequence(F.col("b") * block, last)).alias("at"))
    free = _first(places.join(seen, ["feature_id", "at"], "left_anti"), k, ["feature_id"], F.col("at"))
    return free.join(order, "at").select("feature_id", "ord", "doc_id")


def of_other_topics(members: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(feature_id, other_id, ord, doc_id): ``k`` random members of every other feature, for each feature.

    Drawn once for each feature and then set against all others, which makes rows of features times features times k.
    """
    drawn = stored(random_members(members, k, seed).select(F.col("feature_id").alias("other_id"), "ord", "doc_id"))
    pairs = feature_pairs(members.select("feature_id").distinct())
    return pairs.join(drawn, "other_id").select("feature_id", "other_id", "ord", "doc_id")


def feature_pairs(features: DataFrame) -> DataFrame:
    """(feature_id, other_id): all ordered pairs of different features, a stated set that is small by definition."""
    ids = features.agg(F.sort_array(F.collect_set("feature_id")).alias("ids"))
    return ids.select(F.explode("ids").alias("feature_id"), "ids").select("feature_id", F.explode("ids").alias("other_id")).where("feature_id <> other_id")


def unseen(members: DataFrame, taken: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` random members of each feature that ``taken`` (feature_id, doc_id) doesn't hold; fewer where there are fewer."""
    return random_members(members.join(taken.select("feature_id", "doc_id"), ["feature_id", "doc_id"], "left_anti"), k, seed)


def sample(method: str, weights: DataFrame, members: DataFrame, docs: DataFrame, features: DataFrame, pos_k: int, neg_k: int, strata: int = 10, seed: int = 42) -> DataFrame:
    """(feature_id, polarity, ord, doc_id, weight): positives by ``method`` and random negatives; any other method raises ValueError."""
    ways = {
        "random": lambda: random_members(members, pos_k, seed),
        "topk": lambda: top_k(weights, pos_k),
        "weighted": lambda: weighted_members(members, pos_k, seed),
        "stratified": lambda: stratified_members(members, pos_k, strata, seed),
    }
    if method not in ways:
        raise ValueError(f"unknown sampling method {method!r}; there are {sorted(ways)}")
    pos = ways[method]().select("feature_id", F.lit("pos").alias("polarity"), "ord", "doc_id", "weight")
    neg = negatives(members, docs, features, neg_k, seed).select("feature_id", F.lit("neg").alias("polarity"), "ord", "doc_id", F.lit(None).cast("double").alias("weight"))
    return pos.unionByName(neg)
