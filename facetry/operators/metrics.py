"""Quality of labels, clusters and samples.

Verdicts hold feature_id, polarity (``pos`` or ``neg``), ord, doc_id and verdict (1 yes, 0 no, -1 failed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.sources.tables import one_row, stored

TINY = 1e-5


def _ratio(a: Column, b: Column) -> Column:
    return a / (b + TINY)


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + TINY)


def label_scores(verdicts: DataFrame) -> DataFrame:
    """(feature_id, recall, precision, f1) with verdicts summed as they are, so a failed one counts -1; features without positives are left out."""
    pos, neg = F.col("polarity") == "pos", F.col("polarity") == "neg"
    sums = verdicts.groupBy("feature_id").agg(
        F.coalesce(F.sum(F.when(pos, F.col("verdict"))), F.lit(0)).alias("p"), F.count_if(pos).alias("n"), F.coalesce(F.sum(F.when(neg, F.col("verdict"))), F.lit(0)).alias("q")
    )
    r, p = F.col("p") / F.col("n"), _ratio(F.col("p"), F.col("p") + F.col("q"))
    return sums.where("n > 0").select("feature_id", r.alias("recall"), p.alias("precision"), _f1(p, r).alias("f1"))


def confusion(verdicts: DataFrame, doc_weight: DataFrame | None = None) -> DataFrame:
    """(feature_id, tp, fp, fn, tn, precision, recall, f1); every verdict but 1 counts as no.

    With ``doc_weight`` (doc_id, weight) each document counts by its weight instead of 1, one without
    weight not at all.
    """
    w = F.lit(1.0)
    if doc_weight is not None:
        verdicts = verdicts.join(doc_weight, "doc_id", "left")
        w = F.coalesce("weight", F.lit(0.0))
    yes, pos = F.coalesce(F.col("verdict") == 1, F.lit(False)), F.col("polarity") == "pos"
    cells = {"tp": pos & yes, "fp": ~pos & yes, "fn": pos & ~yes, "tn": ~pos & ~yes}
    sums = verdicts.groupBy("feature_id").agg(*[F.sum(F.when(c, w).otherwise(F.lit(0.0))).alias(n) for n, c in cells.items()])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("feature_id", *cells, p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def method_table(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of precision, recall and f1 over the features of each method, to 3 places."""
    return scores.groupBy(*by).agg(
        *[F.round(f(c), 3).alias(f"{c}_{n}") for c in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def recall_by_decile(verdicts: DataFrame, width: int = 10) -> DataFrame:
    """(decile, recall, n): mean verdict of the positives in each tenth of their order, pooled over features; failed ones count -1."""
    rows = verdicts.where("polarity = 'pos'").select(F.floor(F.col("ord") / width).cast("int").alias("decile"), "verdict").where("decile < 10")
    return rows.groupBy("decile").agg(F.avg("verdict").alias("recall"), F.count(F.lit(1)).alias("n"))


def purity(pairs: DataFrame) -> DataFrame:
    """(purity, inverse_purity, harmonic) of predicted against true classes (columns pred and truth).

    purity is the unweighted mean over predicted clusters of the share of their largest class;
    inverse purity the share of rows that lie in the largest cluster of their class.
    """
    cells = stored(pairs.where("pred is not null and truth is not null").groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("n")))
    p = cells.groupBy("pred").agg((F.max("n") / F.sum("n")).alias("x")).agg(F.avg("x").alias("purity"))
    ip = cells.groupBy("truth").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg((F.sum("m") / F.sum("s")).alias("inverse_purity"))
    both = one_row(p, ip)
    return both.select("purity", "inverse_purity", (2 / (1 / F.col("purity") + 1 / F.col("inverse_purity"))).alias("harmonic"))


def consistency(verdicts: DataFrame) -> DataFrame:
    """(feature_id, consistency): share of a feature's positives that the judge accepts."""
    return verdicts.where("polarity = 'pos'").groupBy("feature_id").agg(F.avg((F.col("verdict") == 1).cast("double")).alias("consistency"))


def generalization(verdicts: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature_id, generalization): mean verdict of a feature's positives, weighted by their weight for it."""
    rows = verdicts.where("polarity = 'pos'").join(weights.select("feature_id", "doc_id", F.col("weight").alias("w")), ["feature_id", "doc_id"])
    return rows.groupBy("feature_id").agg(F.try_divide(F.sum(F.col("verdict") * F.col("w")), F.sum("w")).alias("generalization"))


def distinctiveness(matches: DataFrame) -> DataFrame:
    """(feature_id, distinctiveness): mean over the other features of the weighted share of their documents that match.

    ``matches`` hold feature_id (of the label), other_id, verdict and weight (of the document for the other feature).
    """
    rows = matches.where("feature_id <> other_id").groupBy("feature_id", "other_id")
    each = rows.agg(F.try_divide(F.sum(F.col("verdict") * F.col("weight")), F.sum("weight")).alias("x"))
    return each.groupBy("feature_id").agg(F.avg("x").alias("distinctiveness"))


def cost(usage: DataFrame, price_in: float, price_out: float, only_ok: bool = False) -> DataFrame:
    """(calls, tokens_in, tokens_out, cost) of calls with tokens_in, tokens_out and ok; ``only_ok`` leaves failed calls out."""
    rows = usage.where("ok") if only_ok else usage
    total_in, total_out = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens_in", "tokens_out"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), total_in.alias("tokens_in"), total_out.alias("tokens_out"), (total_in * price_in + total_out * price_out).alias("cost"))


def overall(scores: DataFrame) -> DataFrame:
    """(recall, precision, f1): plain averages over features of the scores that :func:`label_scores` gives."""
    return scores.agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "f1")])
