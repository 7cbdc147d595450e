"""Greedy selection of diverse or covering documents for each feature.

The steps are sequential, the work of a step isn't: each is one pass over all candidates of all
features, a pre-aggregated maximum for each feature and a join with the rows picked. No feature has
to fit into a task, however many members it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.sources.tables import release, stored


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def relevance(weight: Column, alpha: float) -> Column:
    """exp(weight / (2 alpha))."""
    return F.exp(weight / (2 * alpha))


def _picked(state: DataFrame, score: Column) -> DataFrame:
    """The rows of highest score of each feature, of equal ones the smaller doc_id; only numbers are aggregated."""
    best = state.groupBy("feature_id").agg(F.max(F.struct(score.alias("s"), (-F.col("doc_id")).alias("i"))).alias("p"))
    return state.join(best.select("feature_id", (-F.col("p.i")).alias("doc_id")), ["feature_id", "doc_id"])


def greedy_dpp(rows: DataFrame, k: int, start: str = "compat") -> DataFrame:
    """(feature_id, ord, doc_id, weight, degenerate): greedy picks of a determinantal point process.

    ``rows`` hold feature_id, doc_id, v (the vector) and weight (the relevance). The first pick has
    the highest relevance, each further one the largest part that the picks so far leave of its
    weighted vector; of equal ones the smaller doc_id. ``start`` is the first entry of the factor:
    ``compat`` the root of the first relevance, ``exact`` the length of the first weighted vector.
    A pick whose part isn't positive is ``degenerate``, as are all after it of the feature, which are
    then taken by doc_id. A feature with fewer rows gives all; one pick at least is made (k <= 1).
    """
    state = stored(rows.select("feature_id", "doc_id", "weight", F.transform("v", lambda x: x.cast("double") * F.col("weight")).alias("v")))
    state = stored(state.withColumn("d", dot("v", "v")).withColumn("c", F.array().cast("array<double>")).withColumn("bad", F.lit(False)))
    out = None
    for step in range(max(1, k)):
        score = F.col("weight") if step == 0 else F.when(F.col("bad"), F.lit(0.0)).otherwise(F.col("d"))
        pick = _picked(state, score).select("feature_id", F.col("doc_id").alias("id"), F.col("d").alias("pd"), F.col("v").alias("pv"), F.col("c").alias("pc"), F.col("weight").alias("pw"), F.col("bad").alias("pb"))
        pick = stored(pick)
        root = F.sqrt("pw" if start == "compat" else "pd") if step == 0 else F.sqrt("pd")
        bad = F.col("pb") | (F.lit(False) if step == 0 else (F.col("pd") <= 0) | F.isnan("pd"))
        one = pick.select("feature_id", F.lit(step).alias("ord"), F.col("id").alias("doc_id"), F.col("pw").alias("weight"), bad.alias("degenerate"))
        out = one if out is None else out.unionByName(one)
        if step + 1 == max(1, k):
            break
        left = state.join(pick, "feature_id").where("doc_id <> id")
        e = (dot("v", "pv") - dot("c", "pc")) / root
        left = left.withColumn("e", F.when(bad, F.lit(0.0)).otherwise(e)).withColumn("bad", bad)
        old = state
        state = stored(left.select("feature_id", "doc_id", "weight", "v", (F.col("d") - F.col("e") * F.col("e")).alias("d"), F.concat("c", F.array("e")).alias("c"), "bad"))
        release(old)
    return out


def coverage(rows: DataFrame) -> DataFrame:
    """(feature_id, doc_id, coverage): for each feature and document the weighted sum of its cosines with all documents.

    ``rows`` hold feature_id, doc_id, weight and v of length 1. As the cosine of unit vectors is
    their product, the sum over documents is a product with one weighted sum vector for each
    feature: linear in the rows, no pairs of documents.
    """
    cells = rows.select("feature_id", "weight", F.posexplode("v").alias("i", "x")).groupBy("feature_id", "i").agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("x"))
    sums = cells.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("feature_id", F.transform("s", lambda c: c["x"]).alias("s"))
    return rows.join(sums, "feature_id").select("feature_id", "doc_id", dot("v", "s").alias("coverage"))


def covering_picks(rows: DataFrame, k: int, alpha: float = 0.5, beta: float = 1.0, repeat: bool = False) -> DataFrame:
    """(feature_id, ord, doc_id): greedy picks of high coverage, low redundancy and low coverage of other features.

    The score of a document is its coverage by the feature, less ``alpha`` times its highest cosine
    with a pick so far (0 at least), less ``beta`` times its mean coverage by the other features; of
    equal scores the smaller doc_id is taken. ``rows`` are as in :func:`coverage`. With ``repeat`` a document can
    be picked again.
    """
    cov = stored(coverage(rows))
    over = cov.groupBy("doc_id").agg(F.sum("coverage").alias("all"), F.count(F.lit(1)).alias("t"))
    cross = F.when(F.col("t") > 1, (F.col("all") - F.col("coverage")) / (F.col("t") - 1)).otherwise(F.lit(0.0))
    state = rows.join(cov, ["feature_id", "doc_id"]).join(over, "doc_id")
    state = stored(state.select("feature_id", "doc_id", "v", (F.col("coverage") - beta * cross).alias("base"), F.lit(0.0).alias("red")))
    out = None
    for step in range(k):
        pick = stored(_picked(state, F.col("base") - alpha * F.col("red")).select("feature_id", F.col("doc_id").alias("id"), F.col("v").alias("pv")))
        one = pick.select("feature_id", F.lit(step).alias("ord"), F.col("id").alias("doc_id"))
        out = one if out is None else out.unionByName(one)
        if step + 1 < k:
            left = state.join(pick, "feature_id")
            left = left if repeat else left.where("doc_id <> id")
            old, state = state, stored(left.select("feature_id", "doc_id", "v", "base", F.greatest("red", dot("v", "pv")).alias("red")))
            release(old)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of (doc_id, v) as one row of bytes."""
    for b in batches:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64")
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (b.column(0).to_numpy().astype("int64"), x)], names=["ids", "x"])


def _best_of_blocks(k: int):
    """A map over pairs of blocks (qids, q, ids, x): the ``k`` nearest rows of the block for each query of the other."""

    def read(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, "int64")
        return ids, np.frombuffer(x).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, q, ids, x in zip(*(c.to_pylist() for c in batch.columns)):
                (qids, q), (ids, x) = read(qids, q), read(ids, x)
                order = np.argsort(ids, kind="stable")
                own, x = ids[order], x[order]
                sims = q @ x.T
                sims[qids[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]  # of equal ones the smaller id
                r, c = np.repeat(np.arange(len(qids)), top.shape[1]), top.ravel()
                ok = np.isfinite(sims[r, c])
                yield pa.RecordBatch.from_arrays([pa.array(qids[r[ok]]), pa.array(own[c[ok]]), pa.array(sims[r[ok], c[ok]])], names=["query_id", "doc_id", "cosine"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, place, doc_id, cosine): the ``k`` nearest of all ``rows`` for a stated set of queries, by brute force in blocks.

    ``queries`` and ``rows`` hold doc_id and v of length 1; a row isn't its own neighbour, and of
    equal cosines (to 9 places) the smaller doc_id comes first. No queries or no rows give an empty result.

    Queries are packed into blocks of about ``block``, rows into blocks of one Arrow batch, each a row of
    bytes; every block of rows meets every block of queries by a join on the queries' block number, and gives its best k
    for each query, which are then merged. The driver sees only how many queries there are.
    """
    blocks = max(1, -(-queries.count() // block))

    def pack(table: pa.Table) -> pa.Table:
        held = next(_packed(iter(table.select(["doc_id", "v"]).combine_chunks().to_batches(max_chunksize=len(table)))))
        return pa.table({"block": table["block"][:1], "qids": held.column(0), "q": held.column(1)})

    asked = queries.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "v").groupBy("block").applyInArrow(pack, "block bigint, qids binary, q binary")
    held = rows.select("doc_id", "v").mapInArrow(_packed, "ids binary, x binary").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    met = held.join(asked, "block").select("qids", "q", "ids", "x")
    out = met.mapInArrow(_best_of_blocks(k), "query_id bigint, doc_id bigint, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "doc_id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "place", "doc_id", "cosine")


def dpp_samples(members: DataFrame, vectors: DataFrame, k: int, alpha: float, start: str = "compat") -> DataFrame:
    """(feature_id, polarity, ord, doc_id, weight): up to ``k`` diverse members of each feature, with exp(weight / (2 alpha)).

    ``members`` hold feature_id, doc_id and weight, ``vectors`` doc_id and v; members without a vector
    are left out. A feature with fewer members gives all, one without none; there are no negatives.
    """
    rows = members.select("feature_id", "doc_id", relevance(F.col("weight"), alpha).alias("weight")).join(vectors.select("doc_id", "v"), "doc_id")
    return greedy_dpp(rows, k, start).select("feature_id", F.lit("pos").alias("polarity"), "ord", "doc_id", "weight")
