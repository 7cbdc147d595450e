"""Filling fixed-capacity containers with items (problem 9)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.sources.tables import stored

CAPACITY = 2048
#: Patterns tried for each length, items in one at most, steps of the fit, items of a length that a task ranks.
PER_LENGTH, MOST_ITEMS, STEPS, SLICE_ROWS = 4, 12, 300, 1 << 17

Recipe = tuple[int, list[tuple[int, int]]]  # how often, [(length, how many)]


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, per_length: int = PER_LENGTH, seed: int = 7) -> list[dict[int, int]]:
    """Combinations of few lengths that fill a container well, some for each length.

    A pattern starts with the length it is made for; more lengths are drawn by their frequency
    while they fit, and the last is the largest that still fits.
    """
    rng, out = np.random.default_rng(seed), {}
    upto = np.cumsum(counts, dtype="float64")
    for first in lengths:
        for _ in range(per_length):
            items, left = [int(first)], capacity - int(first)
            while left >= lengths[0] and len(items) < MOST_ITEMS:
                k = bisect_right(lengths, left)
                i = int(np.searchsorted(upto[:k], rng.random() * upto[k - 1], side="right"))
                pick = int(lengths[min(i, k - 1)])
                if left - pick < lengths[0] or len(items) == MOST_ITEMS - 1:
                    pick = int(lengths[k - 1])
                items.append(pick)
                left -= pick
            found: dict[int, int] = {}
            for x in items:
                found[x] = found.get(x, 0) + 1
            out[tuple(sorted(found.items()))] = found
    return list(out.values())


def fit(patterns_: list[dict[int, int]], lengths: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each pattern: non-negative least squares against the histogram.

    Multiplicative steps keep every entry non-negative; the matrix is only held sparse.
    """
    at = {int(x): i for i, x in enumerate(lengths)}
    row = np.array([at[x] for p in patterns_ for x in p])
    col = np.array([j for j, p in enumerate(patterns_) for _ in p])
    val = np.array([m for p in patterns_ for m in p.values()], "float64")
    weight = 1 / np.maximum(counts.astype("float64"), 1)  # relative error of each length counts alike
    x = np.full(len(patterns_), counts.sum() / max(1.0, val.sum()))
    toward = np.bincount(col, val * (weight * counts)[row], len(patterns_))
    for _ in range(steps):
        have = np.bincount(row, val * x[col], len(lengths))
        x *= toward / np.maximum(np.bincount(col, val * (weight * have)[row], len(patterns_)), 1e-12)
    return x


def recipes(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Recipe]:
    """Containers for exactly the items of ``histogram`` ({length: how many}, lengths 1 to capacity).

    Fitted pattern counts are rounded down and taken as far as the items last. The rest is packed
    by greedy patterns, the largest length first and each gap by the largest that fits, used as
    often as the items last; every such pattern uses up a length, so there are about as many as
    lengths, whatever the number of items.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    if not left:
        return []
    lengths = np.array(sorted(left))
    counts = np.array([left[int(k)] for k in lengths])
    out: list[Recipe] = []
    tried = patterns(lengths, counts, capacity)
    often = np.floor(fit(tried, lengths, counts)).astype("int64")
    for j in np.argsort(-often, kind="stable"):
        n = min([int(often[j]), *(left[k] // m for k, m in tried[j].items())])
        if n > 0 and sum(k * m for k, m in tried[j].items()) >= 0.99 * capacity:
            out.append((n, sorted(tried[j].items(), reverse=True)))
            for k, m in tried[j].items():
                left[k] -= n * m
    sizes = sorted(k for k, v in left.items() if v)
    while sizes:
        gap, used = capacity, []
        while i := bisect_right(sizes, min(gap, used[-1][0] - 1) if used else gap):
            k = sizes[i - 1]
            m = min(gap // k, left[k])
            used.append((k, m))
            gap -= k * m
        n = min(left[k] // m for k, m in used)
        out.append((n, used))
        for k, m in used:
            left[k] -= n * m
        sizes = [k for k in sizes if left[k]]
    return out


def slots(found: list[Recipe]) -> dict[int, np.ndarray]:
    """For each length the ranks at which its places begin: rows (rank, per container, container, offset)."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    container = 0
    for n, items in found:
        offset = 0
        for length, m in items:
            at = rank.get(length, 0)
            rows.setdefault(length, []).append((at, m, container, offset))
            rank[length] = at + n * m
            offset += length * m
        container += n
    return {k: np.array(v, "int64") for k, v in rows.items()}


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """Each item's place: ``id_col``, piece, n_pieces, size, from_size, container_id, offset.

    An item above ``capacity`` is split into full pieces and a rest, no other is; from_size is where
    the piece begins in the item, offset where it lies in its container. An item of size 0 or null
    takes no space: one row with null container_id and offset. Repeated rows are items of their
    own. Every container holds at most ``capacity``. An empty table gives an empty result.
    ``sizes`` is read twice and should be a stored table.

    Method: the histogram of piece sizes (at most ``capacity`` rows, so bounded whatever the data)
    goes to the driver, where repeat counts of few-item patterns are fitted to it by non-negative
    least squares, rounded, and the residual packed (:func:`recipes`). Items are ranked within
    their size, a frequent size in slices by hash of about :data:`SLICE_ROWS`, whose counts give each slice its
    first rank, and take their rank's place; no item goes to the driver and no frequent size to a single task.
    """
    kind = dict(sizes.dtypes)[id_col]
    n = F.greatest(F.ceil(F.coalesce(F.col(size_col), F.lit(0)) / F.lit(capacity)), F.lit(1)).cast("int")
    whole = sizes.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("__all"), n.alias("n_pieces"))
    parts = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    parts = parts.withColumn("from_size", F.col("piece").cast("bigint") * capacity).withColumn("size", F.least(F.lit(capacity).cast("bigint"), F.col("__all") - F.col("from_size"))).drop("__all")
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(recipes({k: n for k, n in histogram.items() if k > 0}, capacity))

    frequent = [(k, -(-n // SLICE_ROWS)) for k, n in histogram.items() if n > SLICE_ROWS]
    frequent = F.broadcast(sizes.sparkSession.createDataFrame(frequent, "size bigint, slices bigint"))  # at most one row a size
    sliced = parts.join(frequent, "size", "left").withColumn("slice", F.pmod(F.xxhash64(id_col, "piece"), F.coalesce("slices", F.lit(1).cast("bigint"))))
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("size", "slice").orderBy(id_col, "piece")) - 1)
    per = sliced.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n"))
    first = per.select("size", "slice", (F.sum("n").over(Window.partitionBy("size").orderBy("slice")) - F.col("n")).alias("first"))
    ranked = ranked.join(first, ["size", "slice"]).select(id_col, "piece", "n_pieces", "size", "from_size", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            container, offset = np.full(len(size), -1, "int64"), np.full(len(size), -1, "int64")
            order = np.argsort(size, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if not len(group) or size[group[0]] == 0:
                    continue
                rows = places[int(size[group[0]])]
                at = rows[np.searchsorted(rows[:, 0], rank[group], side="right") - 1]
                into = rank[group] - at[:, 0]
                container[group] = at[:, 2] + into // at[:, 1]
                offset[group] = at[:, 3] + into % at[:, 1] * size[group]
            none = container < 0
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(container, mask=none), pa.array(offset, mask=none)], names=[id_col, "piece", "n_pieces", "size", "from_size", "container_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, n_pieces int, size bigint, from_size bigint, container_id bigint, offset bigint")


def containers(packed: DataFrame) -> DataFrame:
    """(container_id, items, filled) of every container."""
    return packed.where("container_id is not null").groupBy("container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("filled"))


def pack_documents(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """:func:`pack` over (doc_id, tokens), which is stored first so that texts are encoded once."""
    return pack(stored(counts), capacity=capacity)
