"""Grouping records into clusters of alike records (problem 5)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.llm.words import terms_of
from facetry.operators.components import connected_components
from facetry.sources.tables import latest, release, stored

#: Places that terms are hashed to, weight of the topic part, Lloyd passes for each level of splits.
PLACES, TOPIC_WEIGHT, PASSES = 96, 0.7, 2
#: A leaf is compact at this root mean square distance from its centre. Rows of a leaf that a task splits further
#: by itself, and leaves whose centres the driver holds; larger and more leaves are split by joins.
RADIUS, FEW_ROWS, MOST_LEAVES = 0.45, 32768, 1024
#: Rows of sums (one for each task and leaf) that go to the driver as they are; more are merged by leaf before.
MOST_SENT = 4096
#: Two records are alike at this Jaccard similarity of terms, or this L1 distance of topics.
ALIKE, TOPICS_APART = 0.5, 0.02
#: Rows of one block that are compared with each other in a task.
BLOCK_ROWS = 4096
#: 64-bit words of a record's signature, size from which candidates are told by all of them and not
#: by half as many (each the exclusive or of two), and terms that are ordered by their number of records.
WORDS, LONG, COMMON = 8, 100, 8192
HALF = WORDS // 2


# --- bisecting k-means -----------------------------------------------------------------------


class Tree:
    """A binary tree of splits: node 0 is the root; ``left`` < 0 marks a leaf."""

    def __init__(self, width: int):
        self.left = [-1]
        self.centers = [np.zeros((2, width))]

    def split(self, node: int, centers: np.ndarray) -> None:
        self.left[node] = len(self.left)
        self.centers[node] = centers
        self.left += [-1, -1]
        self.centers += [np.zeros((2, centers.shape[1]))] * 2

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, down from the root by the nearer centre."""
        at = np.zeros(len(x), "int64")
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            at[rows] = node
            if self.left[node] < 0 or not len(rows):
                continue
            a, b = self.centers[node]
            right = x[rows] @ (b - a).astype(x.dtype) > (b @ b - a @ a) / 2
            todo += [(self.left[node], rows[~right]), (self.left[node] + 1, rows[right])]
        return at


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dense(column, width: int) -> np.ndarray:
    """The lists of ``column`` as rows of ``width``, filled up with 0, as null lists are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    out, flat = np.zeros((len(sizes), width)), column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _sums(rows: DataFrame, tree: Tree, width: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(rows, sum, sum of squares) of each leaf. Each task sends a row a leaf; at most :data:`MOST_SENT` reach the driver as they are, or :data:`MOST_LEAVES` merged ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            x = _vectors(b.column(0))
            leaf = tree.leaf_of(x)
            for k in np.unique(leaf):
                y = x[leaf == k]
                h = held.setdefault(int(k), [0, np.zeros(width), np.zeros(width)])
                h[0] += len(y)
                h[1] += y.sum(0, dtype="float64")
                h[2] += np.einsum("ij,ij->j", y, y, dtype="float64")
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([np.concatenate(held[k][1:]).tolist() for k in keys], pa.list_(pa.float64()))], names=["leaf", "n", "s"])

    def merge(table: pa.Table) -> pa.Table:
        s = table["s"].combine_chunks()
        total = s.flatten().to_numpy().reshape(len(s), -1).sum(0)
        return pa.table({"leaf": table["leaf"][:1], "n": pa.array([int(table["n"].to_numpy().sum())], pa.int64()), "s": pa.array([total], pa.list_(pa.float64()))})

    schema = "leaf bigint, n bigint, s array<double>"
    parts = rows.select("v").mapInArrow(run, schema)
    if rows._jdf.rdd().getNumPartitions() * tree.left.count(-1) > MOST_SENT:  # else merged here, which saves a shuffle
        parts = parts.groupBy("leaf").applyInArrow(merge, schema)
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for leaf, n, s in sorted(parts.toArrow().to_pandas().itertuples(index=False), key=lambda r: (r[0], r[1], tuple(r[2][:8]))):
        m, a, b = found.get(leaf, (0, 0.0, 0.0))
        found[leaf] = (m + n, a + np.array(s[:width]), b + np.array(s[width:]))
    return found


def bisect(rows: DataFrame, width: int, radius: float = RADIUS, few: int = FEW_ROWS, most: int = MOST_LEAVES) -> tuple[Tree, dict[int, tuple[int, np.ndarray, float]]]:
    """The tree of a bisecting k-means over ``rows`` (v), and (rows, centre, mean squared distance) of each leaf.

    The leaves of largest dispersion (summed squared distance) are split until each is compact,
    within ``radius`` (root mean square), or holds at most ``few`` rows, which :func:`compact` splits
    on in a task, or no longer divisible; at most ``most`` leaves are made, and those that are too large then are left
    to :func:`_deeper`. All leaves due are split in the same passes over the rows, the most
    dispersed first where the bound leaves room for only some, so the number of passes grows
    with the depth, not with the leaves, and the last Lloyd pass of a level gives the dispersions that
    decide on the next. A split starts at the centre, shifted both ways by one
    deviation along the dimension that varies most, and takes :data:`PASSES` Lloyd passes.
    """
    tree, sums, final = Tree(width), {}, {}
    sums = _sums(rows, tree, width)

    def shape(s) -> tuple[int, np.ndarray, np.ndarray]:
        center = s[1] / s[0]
        return s[0], center, np.maximum(s[2] / s[0] - center * center, 0)

    done: set[int] = set()
    while True:
        for k, s in sums.items():
            n, center, var = shape(s)
            final[k] = (n, center, float(var.sum()))
        leaves = [k for k in final if tree.left[k] < 0]
        due = [k for k in leaves if k not in done and final[k][0] > few and final[k][2] > radius * radius]
        due = sorted(due, key=lambda k: (-final[k][0] * final[k][2], k))[: max(0, most - len(leaves))]
        if not due:
            for k, s in _sums(rows, tree, width).items():
                n, center, var = shape(s)
                final[k] = (n, center, float(var.sum()))
            return tree, {k: final[k] for k in leaves}
        for k in due:
            n, center, var = shape(sums[k])
            step = np.zeros(width)
            step[int(np.argmax(var))] = math.sqrt(var.max())
            tree.split(k, np.array([center - step, center + step]))
        for _ in range(PASSES):
            new = _sums(rows, tree, width)
            for k in due:
                pair = [new.get(tree.left[k] + i) for i in (0, 1)]
                if all(pair):
                    tree.centers[k] = np.array([p[1] / p[0] for p in pair])
        for k in due:
            pair = [new.get(tree.left[k] + i) for i in (0, 1)]
            sums.pop(k)
            if all(pair):
                sums |= {tree.left[k] + i: pair[i] for i in (0, 1)}
            else:  # a split that leaves one side empty is taken back
                tree.left[k] = -1
                done.add(k)


# --- records ----------------------------------------------------------------------------------


def _place(term: str) -> tuple[int, float]:
    h = zlib.crc32(term.encode())
    return h % PLACES, 1.0 if h & 0x80000000 else -1.0


def records(wikitext: DataFrame, doc2topic: DataFrame) -> DataFrame:
    """(doc_id, p, terms, sig, text_key): each latest record with its topic row, distinct hashed terms and signature.

    terms holds the 64-bit hashes of the distinct terms in ascending order (empty without terms);
    sig has bit i set if an odd number of them fall on bit i; text_key is equal for equal sets of
    terms. p is null without a topic row or with a null array; null or NaN elements count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets, sigs, keys = [], [], []
            for text in b.column(1):
                found = set()
                for t in set(terms_of(text.as_py())):
                    h = known.get(t)
                    if h is None:
                        if len(known) > 500_000:
                            known.clear()
                        h = known[t] = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True)
                    found.add(h)
                x = np.sort(np.fromiter(found, "int64", len(found)))
                bits = np.bincount((x & (64 * WORDS - 1)), minlength=64 * WORDS).astype("uint8") & 1
                sets.append(x)
                sigs.append(np.packbits(bits, bitorder="little").view("int64"))
                keys.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else None)
            ends = np.cumsum([0, *map(len, sets)]).astype("int32")
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "int64"), *sets])))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, WORDS * len(sigs) + 1, WORDS, dtype="int32")), pa.array(np.concatenate([np.zeros(0, "int64"), *sigs])))
            yield pa.RecordBatch.from_arrays([b.column(0), terms, sig, pa.array(keys, pa.int64())], names=["doc_id", "terms", "sig", "text_key"])

    texts = latest(wikitext.where("doc_id is not null"), ["doc_id"], ["tokenized_text"]).mapInArrow(run, "doc_id bigint, terms array<bigint>, sig array<bigint>, text_key bigint")
    clean = F.transform("p", lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0))))
    topics = latest(doc2topic.where("doc_id is not null"), ["doc_id"], ["p"]).select("doc_id", clean.alias("p"))
    return texts.join(topics, "doc_id", "left")


def record_vectors(rows: DataFrame, n_topics: int, idf: dict[int, float]) -> DataFrame:
    """(doc_id, v): hashed term weights scaled to length 1, and beside them the weighted topic row scaled likewise.

    Frequent terms weigh less by ``idf``, which holds those that many records have; every other
    term has its key None.
    """
    rest = idf[None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(k for k in idf if k is not None), "int64")
        weights = np.array([idf[k] for k in keys.tolist()])
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            w = np.full(len(flat), rest)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                w = np.where(keys[i] == flat, weights[i], rest)
            w = np.where(flat & 1, w, -w)
            place = (flat >> 1) % PLACES
            x = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * PLACES + place, w, len(sizes) * PLACES).reshape(len(sizes), PLACES)
            t = _dense(b.column(2), n_topics)
            for m, scale in ((x, 1.0), (t, TOPIC_WEIGHT)):
                m *= scale / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            v = np.hstack([x, t]).astype("float32")
            ends = np.arange(0, v.size + 1, v.shape[1], dtype="int32")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], names=["doc_id", "v"])

    return rows.select("doc_id", "terms", "p").mapInArrow(run, "doc_id bigint, v array<float>")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, d): how many records have each hashed term."""
    return rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d"))


def assigned(vectors: DataFrame, tree: Tree, leaves: dict[int, tuple[int, np.ndarray, float]]) -> DataFrame:
    """(doc_id, leaf, distance): each record's leaf and its distance from the leaf's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1))
            leaf = tree.leaf_of(x)
            far = np.zeros(len(x))
            for k in np.unique(leaf):
                if int(k) in leaves:
                    far[leaf == k] = np.linalg.norm(x[leaf == k] - leaves[int(k)][1], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf), pa.array(far)], names=["doc_id", "leaf", "distance"])

    return vectors.select("doc_id", "v").mapInArrow(run, "doc_id bigint, leaf bigint, distance double")


def stored_vectors(rows: DataFrame, counts: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, v) of every record, stored, and how long each v is."""
    n = rows.count()
    width = rows.agg(F.max(F.size("p"))).head()[0] or 0
    common = counts.where(F.col("d") > max(2, n // 200)).orderBy(F.col("d").desc(), "term").limit(4096).collect()
    idf = {r["term"]: math.log((n + 1) / r["d"]) for r in common} | {None: math.log(201.0)}
    return stored(record_vectors(rows, width, idf)), PLACES + width


def _settle(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row and its distance from the part's centre: ``x`` bisected as in :func:`bisect` until every part is within ``radius``."""
    part, far, todo, parts = np.zeros(len(x), "int64"), np.zeros(len(x)), [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        y = x[rows]
        center = y.mean(0)
        apart = ((y - center) ** 2).sum(1)
        if len(rows) == 1 or apart.mean() <= radius * radius:
            part[rows], far[rows] = parts, np.sqrt(apart)
            parts += 1
            continue
        if len(rows) == 2:
            todo += [rows[1:], rows[:1]]
            continue
        j = int(np.argmax(y.var(0)))
        right = y[:, j] > center[j]
        for _ in range(PASSES):
            a, b = y[~right].mean(0), y[right].mean(0)
            new = y @ (b - a) > (b @ b - a @ a) / 2
            if new.all() or not new.any():
                break
            right = new
        todo += [rows[right], rows[~right]]
    return part, far


def _deeper(rows: DataFrame, width: int, radius: float, few: int) -> DataFrame:
    """``rows`` (doc_id, leaf, v), bisected as in :func:`bisect` until each leaf has at most ``few`` rows or is within ``radius``.

    For the leaves that the driver's tree has no room for: centres are rows of a table that is
    joined by leaf, so neither their number nor a leaf's size is bounded. The halves of leaf k are 2k and 2k + 1.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, leaf = _vectors(b.column(1)).astype("float64"), b.column(0).to_numpy()
            order = np.argsort(leaf, kind="stable")
            keys, starts = np.unique(leaf[order], return_index=True)
            sums = np.add.reduceat(np.hstack([np.ones((len(x), 1)), x, x * x])[order], starts, axis=0) if len(keys) else np.zeros((0, 2 * width + 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(sums), pa.list_(pa.float64()))], names=["leaf", "s"])

    def plane(table: pa.Table) -> pa.Table:
        s = _vectors(table["s"].combine_chunks()).sum(0)
        n, center = s[0], s[1 : width + 1] / s[0]
        var = np.maximum(s[width + 1 :] / n - center * center, 0)
        step = np.zeros(width)
        step[int(np.argmax(var))] = math.sqrt(var.max())
        due = n > few and var.sum() > radius * radius
        return pa.table({"leaf": table["leaf"][:1], "a": pa.array([center - step], pa.list_(pa.float64())), "b": pa.array([center + step], pa.list_(pa.float64()))}).slice(0, int(due))

    def means(table: pa.Table) -> pa.Table:
        s = _vectors(table["s"].combine_chunks())
        right = (table["leaf"].to_numpy() & 1).astype(bool)
        halves = [s[~right].sum(0), s[right].sum(0)]
        if not halves[0][0] or not halves[1][0]:
            return pa.table({"leaf": pa.array([], pa.int64()), "a": pa.array([], pa.list_(pa.float64())), "b": pa.array([], pa.list_(pa.float64()))})
        a, b = (h[1 : width + 1] / h[0] for h in halves)
        return pa.table({"leaf": table["leaf"][:1].cast(pa.int64()), "a": pa.array([a], pa.list_(pa.float64())), "b": pa.array([b], pa.list_(pa.float64()))})

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, known = b.column(1).to_numpy(), b.column(3).is_valid().to_numpy(zero_copy_only=False)
            x = _vectors(b.column(2)).astype("float64")
            lo, hi = _dense(b.column(3), width), _dense(b.column(4), width)
            right = np.einsum("ij,ij->i", x, hi - lo) > (np.einsum("ij,ij->i", hi, hi) - np.einsum("ij,ij->i", lo, lo)) / 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(known, 2 * leaf + right, leaf)), b.column(2)], names=["doc_id", "leaf", "v"])

    places = "leaf bigint, a array<double>, b array<double>"
    while True:
        planes = stored(rows.select("leaf", "v").mapInArrow(partial, "leaf bigint, s array<double>").groupBy("leaf").applyInArrow(plane, places))
        if planes.isEmpty():
            return rows
        hot = rows.join(planes.select("leaf"), "leaf", "left_semi").select("doc_id", "leaf", "v")
        for _ in range(PASSES):
            sides = hot.join(planes, "leaf").select("doc_id", "leaf", "v", "a", "b").mapInArrow(half, "doc_id bigint, leaf bigint, v array<float>")
            sums = sides.select("leaf", "v").mapInArrow(partial, "leaf bigint, s array<double>")
            moved = sums.groupBy(F.shiftright("leaf", 1).alias("of")).applyInArrow(means, places).select(F.shiftright("leaf", 1).alias("leaf"), F.col("a").alias("na"), F.col("b").alias("nb"))
            # a pass that leaves one side empty is taken back
            planes = stored(planes.join(moved, "leaf", "left").select("leaf", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")))
        old = rows
        rows = stored(rows.join(planes, "leaf", "left").select("doc_id", "leaf", "v", "a", "b").mapInArrow(half, "doc_id bigint, leaf bigint, v array<float>"))
        release(old)


def compact(rows: DataFrame, counts: DataFrame, radius: float = RADIUS, few: int = FEW_ROWS, most: int = MOST_LEAVES) -> DataFrame:
    """(doc_id, leaf, distance) of every record, stored; every leaf is within ``radius`` (root mean square).

    The passes of :func:`bisect` over all rows, and of :func:`_deeper` where there are more leaves than
    the driver's tree holds, go on until a leaf fits into a task; each leaf that is not
    compact by then is split further in one task, down to single records where need be. A leaf's
    number is its node's in the upper bits and the part's in the lower 16.
    """
    vectors, width = stored_vectors(rows, counts)
    tree, leaves = bisect(vectors, width, radius, few, most)
    loose = {int(k): n for k, (n, _, var) in leaves.items() if var > radius * radius}
    base = 1 << (2 * most).bit_length()  # above every node of the tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf_of(_vectors(b.column(1)))
            kept = np.flatnonzero(np.isin(leaf, list(loose)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array(leaf[kept] + base), b.column(1).take(pa.array(kept))], names=["doc_id", "leaf", "v"])

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        part, far = _settle(_vectors(table["v"].combine_chunks()).astype("float64"), radius)
        return pa.table({"doc_id": table["doc_id"], "leaf": pa.array((table["leaf"].to_numpy() << 16) + part), "distance": pa.array(far)})

    def split(df: DataFrame) -> DataFrame:
        return df.groupBy("leaf").applyInArrow(settle, "doc_id bigint, leaf bigint, distance double")

    out = []
    if loose:
        placed = vectors.select("doc_id", "v").mapInArrow(place, "doc_id bigint, leaf bigint, v array<float>")
        if max(loose.values()) > few:
            placed = _deeper(stored(placed), width, radius, few)
            sums = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
            large = stored(sums.where(F.col("n") > few).select("leaf"))
            # what is still larger is within the radius
            out.append(_from_centres(placed.join(large, "leaf", "left_semi"), width))
            placed = placed.join(large, "leaf", "left_anti")
        out.append(split(placed))
    if len(loose) < len(leaves):
        out.append(assigned(vectors, tree, leaves).where(~F.col("leaf").isin(list(loose))).withColumn("leaf", F.shiftleft(F.col("leaf") + base, 16)))
    found = stored(reduce(DataFrame.unionByName, out))
    release(vectors)
    return found


def _from_centres(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, leaf, distance) of rows (doc_id, leaf, v) whose leaves are compact but larger than a task takes."""
    cells = rows.select("leaf", F.posexplode("v").alias("i", "x")).groupBy("leaf", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = cells.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("leaf", F.transform("c", lambda c: c["x"]).alias("c"))
    square = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(centres, "leaf").select("doc_id", F.shiftleft("leaf", 16).alias("leaf"), F.sqrt(square).alias("distance"))


def typical(rows: DataFrame, per_cluster: int = 5) -> DataFrame:
    """(cluster, size, spread, place, doc_id, distance): each leaf with its members nearest to the centre.

    Of equally near members the smaller doc_id comes first; distances are to 6 places.
    """
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("spread"))
    order = Window.partitionBy("leaf").orderBy(F.round("distance", 6), "doc_id")
    near = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_cluster)
    return near.join(sizes, "leaf").select(F.col("leaf").alias("cluster"), "size", F.round("spread", 6).alias("spread"), "place", "doc_id", F.round("distance", 6).alias("distance"))


# --- exact links ------------------------------------------------------------------------------


def _alike(sets: list[np.ndarray], sig: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) share at least half of their distinct terms.

    The signatures differ in at most as many bits as the sets in terms, and alike sets differ in
    at most a third of their summed sizes; the pairs left are compared term by term.
    """
    apart = np.bitwise_count(sig[a] ^ sig[b]).sum(1)
    out = 3 * apart <= size[a] + size[b]
    for i in np.flatnonzero(out):
        x, y = sets[a[i]], sets[b[i]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = 2 * both >= len(x) + len(y) - both
    return out


def _stars(ids: np.ndarray, sets: list[np.ndarray], sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the alike records of a block: each member with the smallest id of its set."""
    size, root = np.array([len(x) for x in sets]), np.arange(len(ids))
    order = np.argsort(size, kind="stable")
    limit = np.searchsorted(size[order], 2 * size[order], side="right")  # alike sets are at most twice as large
    for i, row in enumerate(order):
        others = order[i + 1 : limit[i]]
        others = others[root[others] != root[row]]  # linked already
        for o in others[_alike(sets, sig, size, np.full(len(others), row), others)] if len(others) else ():
            root[root == root[o]] = root[row]
    least = np.full(len(ids), np.iinfo("int64").max)
    np.minimum.at(least, root, ids)
    far = np.flatnonzero(least[root] != ids)
    return ids[far], least[root][far]


def _link_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_stars` of each (leaf, part) of rows that come in this order."""

    def link(table: pa.Table) -> pa.RecordBatch:
        leaf, part, ids = (table[c].to_numpy() for c in ("leaf", "part", "doc_id"))
        lists = table["terms"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), WORDS).view("uint64")
        begins = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])]))
        node, root = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for i, j in zip(begins.tolist(), np.append(begins[1:], len(ids)).tolist()):
            if j - i > 1:
                found = _stars(ids[i:j], [flat[ends[k] : ends[k + 1]] for k in range(i, j)], sig[i:j])
                node.append(found[0])
                root.append(found[1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(root))], names=["doc_id", "root"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        leaf, part = table["leaf"].to_numpy(), table["part"].to_numpy()
        changed = np.flatnonzero((leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]))  # the last group may go on
        if len(changed):
            yield link(table.slice(0, int(changed[-1]) + 1).combine_chunks())
            table = table.slice(int(changed[-1]) + 1)
        held = table.to_batches()
    if held:
        yield link(pa.Table.from_batches(held).combine_chunks())


_EDGE = "doc_id bigint, root bigint"


def _sliced(rows: DataFrame, key: str) -> DataFrame:
    """The ``rows`` of keys with more than one, with part, so that all pairs of rows of a key meet within some (key, part).

    A key with up to :data:`BLOCK_ROWS` rows is one part; above that its rows are cut into slices by
    doc_id, and each pair of slices is a part.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slices = F.when(F.col("n") > BLOCK_ROWS, F.ceil(F.col("n") / (BLOCK_ROWS // 2))).otherwise(F.lit(1).cast("bigint"))
    s = F.pmod(F.xxhash64("doc_id"), F.col("slices"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1), lambda o: F.least(o, s) * F.col("slices") + F.greatest(o, s))
    return rows.join(sizes.select(key, slices.alias("slices")), key).withColumn("part", F.explode(pairs)).drop("slices")


def _alike_sets(a: str, b: str):
    both = F.size(F.array_intersect(a, b))
    return 2 * both >= F.size(a) + F.size(b) - both


def _led(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to one leader in each ``large`` leaf, and (leaf, doc_id, part) of what has to be compared besides.

    Rows alike to the leader are one set already, so only the others have to meet all rows: where
    they are few they are copied to every slice of the leaf, else all pairs of slices meet. A leaf of near
    copies, however large, so costs one comparison a row.
    """
    lead = rows.join(large.select(F.col("lead").alias("doc_id")), "doc_id", "left_semi").select("leaf", F.col("doc_id").alias("lead"), F.col("terms").alias("lead_terms"))
    near = stored(rows.join(lead, "leaf").select("leaf", "doc_id", "lead", _alike_sets("terms", "lead_terms").alias("near")))
    counts = near.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("others")).where("others > 0")
    slices = F.ceil(F.col("n") / (BLOCK_ROWS // 2))
    s = F.pmod(F.xxhash64("doc_id"), F.col("slices"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)
    pairs = F.transform(every, lambda o: F.least(o, s) * F.col("slices") + F.greatest(o, s))
    parts = F.when(F.col("others") > BLOCK_ROWS, pairs).when(F.col("near"), F.array(s)).otherwise(every)
    placed = near.join(counts.select("leaf", "others", slices.alias("slices")), "leaf").select("leaf", "doc_id", F.explode(parts).alias("part"))
    return near.where("near and doc_id <> lead").select("doc_id", F.col("lead").alias("root")), placed


def _in_leaves(rows: DataFrame) -> DataFrame:
    """Links within each leaf, as stars; one above :data:`BLOCK_ROWS` rows goes through :func:`_led`."""
    sizes = stored(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lead")).where("n > 1"))
    placed = rows.join(sizes.where(F.col("n") <= BLOCK_ROWS).select("leaf"), "leaf", "left_semi").select("leaf", F.lit(0).cast("bigint").alias("part"), "doc_id", "terms", "sig")
    large, links = sizes.where(F.col("n") > BLOCK_ROWS), None
    if not large.isEmpty():
        links, more = _led(rows, large)
        placed = placed.unionByName(more.join(rows.select("doc_id", "terms", "sig"), "doc_id").select(placed.columns))
    found = placed.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(_link_leaves, _EDGE)
    return found if links is None else found.unionByName(links)


#: Bits of an entry's place in its record and of the record's size, of which :func:`_packed` makes one number with the part.
BITS = 22


def _packed(part, size, at):
    """Part, size and place as one number, by which entries of a term are sorted."""
    return ((part + 1) << 2 * BITS) | (size << BITS) | at


def _prefixes(rows: DataFrame, common: list[tuple[int, int]]) -> DataFrame:
    """(term, key, doc_id, leaf, sig): the terms at which a record may meet an alike one.

    key is the entry's part, the record's size and the term's place in it (:func:`_packed`).
    sig is the signature folded in half, and for records of more than :data:`LONG` terms also its second half.
    part is -1 but for ``common`` terms (with their numbers of records, rarest first) of more than :data:`BLOCK_ROWS`
    records, whose rows it spreads over tasks.

    All records order their terms alike: those not ``common`` first, by hash, then ``common`` from
    the rarest. Two alike records of sizes s <= t share at least (s + t) / 3 terms, so the first
    they share is among the first s / 3 + 1 of the smaller and the first t / 2 + 1 of the larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([t for t, _ in common], "int64")
        spread = np.array([1, *(-(-d // BLOCK_ROWS) for _, d in common)])
        by_hash = np.argsort(keys)
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy()).astype("int64")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(flat), "int64")
            if len(keys):
                i = np.minimum(np.searchsorted(keys[by_hash], flat), len(keys) - 1)
                rank = np.where(keys[by_hash][i] == flat, by_hash[i] + 1, 0)
            order = np.lexsort((flat, rank, owner))
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            kept = at <= np.repeat(size // 2, size)
            of, terms, at, parts = owner[order][kept], flat[order][kept], at[kept], spread[rank[order][kept]]
            part = np.where(parts > 1, b.column(0).to_numpy()[of] % np.maximum(parts, 1), -1)
            key = _packed(part, size[of], at)
            sig = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
            folded = sig[:, :HALF] ^ sig[:, HALF:]
            sigs = pa.array([f.tobytes() if n <= LONG else f.tobytes() + h.tobytes() for f, h, n in zip(folded, sig[:, HALF:], size)], pa.binary())
            for j in range(0, len(of), 1 << 16):
                o = pa.array(of[j : j + (1 << 16)])
                cols = [pa.array(terms[j : j + (1 << 16)]), pa.array(key[j : j + (1 << 16)]), b.column(0).take(o), b.column(1).take(o), sigs.take(o)]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "key", "doc_id", "leaf", "sig"])

    return rows.select("doc_id", "leaf", "terms", "sig").mapInArrow(run, "term bigint, key bigint, doc_id bigint, leaf bigint, sig binary")


def _starts(term: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])]))


def _meeting(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a (term, part) that lie in different leaves and may be alike by size, place and signature.

    Rows come in the order of terms and sizes; those of a term are compared at every distance in
    the order, all terms of the block at once.
    """
    term, key, ids, leaf = (block[c].to_numpy() for c in ("term", "key", "doc_id", "leaf"))
    size, at = (key >> BITS) & ((1 << BITS) - 1), key & ((1 << BITS) - 1)
    sigs = block["sig"].combine_chunks()
    sigs = sigs.chunk(0) if isinstance(sigs, pa.ChunkedArray) else sigs
    first = np.frombuffer(sigs.buffers()[1], "int32")[sigs.offset : sigs.offset + len(sigs)] >> 3
    words = np.frombuffer(sigs.buffers()[2], "uint64", count=len(sigs.buffers()[2]) >> 3)
    sig = words[first[:, None] + np.arange(HALF)]
    begins = _starts(term, key >> 2 * BITS)
    end = np.repeat(np.append(begins[1:], len(term)), np.diff(np.append(begins, len(term))))
    found_a, found_b, rows, step = [], [], np.flatnonzero(at <= size // 3), 1
    while len(rows := rows[rows + step < end[rows]]):
        # a is the smaller or as large: rows of a term are in the order of sizes
        rows = rows[size[rows + step] <= 2 * size[rows]]
        a, b = rows, rows + step
        # terms they can still share from here on
        ok = (3 * np.minimum(size[a] - at[a], size[b] - at[b]) >= size[a] + size[b]) & (leaf[a] != leaf[b])
        a, b = a[ok], b[ok]
        both = sig[a] ^ sig[b]
        ok = 3 * np.bitwise_count(both).sum(1) <= size[a] + size[b]
        a, b, both = a[ok], b[ok], both[ok]
        if len(long := np.flatnonzero(size[a] > LONG)):
            apart = words[first[a[long], None] + np.arange(HALF, WORDS)] ^ words[first[b[long], None] + np.arange(HALF, WORDS)]
            apart = np.bitwise_count(apart).sum(1) + np.bitwise_count(apart ^ both[long]).sum(1)
            ok = np.ones(len(a), bool)
            ok[long] = 3 * apart.astype("int64") <= size[a[long]] + size[b[long]]
            a, b = a[ok], b[ok]
        found_a.append(ids[a])
        found_b.append(ids[b])
        step += 1
    a, b = (np.concatenate([np.zeros(0, "int64"), *x]) for x in (found_a, found_b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _candidates(entries: DataFrame) -> DataFrame:
    """(a, b): the pairs of :func:`_meeting` over all terms.

    One shuffle by term, whose tasks compare the rows of each term as they come; of a
    term with more than :data:`BLOCK_ROWS` rows they only pass the rows on (b null), and all such rows are then
    compared in pairs of slices, each by a task of its own.
    """
    names = ["a", "b", "term", "key", "leaf", "sig"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def passed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        table = pa.table([rows["doc_id"], pa.nulls(len(rows), pa.int64()), *(rows[c] for c in names[2:])], names=names)
        yield from table.combine_chunks().to_batches()

    def run(limit: int | None):
        def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if limit is not None:
                term = table["term"].to_numpy()
                begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                n = np.diff(np.append(begins, len(term)))
                large = np.repeat(n > limit, n) | (table["key"].to_numpy() >> 2 * BITS > 0)
                if large.any():
                    yield from passed(table.filter(pa.array(large)))
                    table = table.filter(pa.array(~large)).combine_chunks()
            if len(table):
                a, b = _meeting(table)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in types[2:])], names=names)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            rows, over = 0, None
            for batch in batches:
                if over is not None:  # a term that has been found too large goes on
                    same = batch.column("term").to_numpy() == over
                    if same.any():
                        yield from passed(pa.Table.from_batches([batch.filter(pa.array(same))]))
                        batch = batch.filter(pa.array(~same))
                if not batch.num_rows:
                    continue
                over = None
                held.append(batch)
                rows += batch.num_rows
                if rows >= 1 << 16:
                    table = pa.Table.from_batches(held).combine_chunks()
                    term = table["term"].to_numpy()
                    cut = int(_starts(term, table["key"].to_numpy() >> 2 * BITS)[-1])  # the last group may go on
                    if cut:
                        yield from compared(table.slice(0, cut).combine_chunks())
                    table = table.slice(cut)
                    if limit is not None and len(table) > limit:
                        over = int(term[-1])
                        yield from passed(table)
                        table = table.slice(0, 0)
                    held, rows = table.to_batches(), len(table)
            if rows:
                yield from compared(pa.Table.from_batches(held).combine_chunks())

        return go

    def sorted_in(df: DataFrame) -> DataFrame:
        df = df.select("term", "key", "doc_id", "leaf", "sig")
        return df.repartition("term", F.shiftright("key", 2 * BITS)).sortWithinPartitions("term", "key")

    schema = "a bigint, b bigint, term bigint, key bigint, leaf bigint, sig binary"
    found = stored(sorted_in(entries).mapInArrow(run(BLOCK_ROWS), schema))
    large = found.where("b is null")
    pairs = found.where("b is not null").select("a", "b")
    if not large.isEmpty():
        again = _sliced(large.select("term", F.col("a").alias("doc_id"), "key", "leaf", "sig"), "term")
        inside = F.col("key").bitwiseAND((1 << 2 * BITS) - 1)
        again = again.withColumn("key", F.shiftleft(F.col("part") + 1, 2 * BITS).bitwiseOR(inside))
        pairs = pairs.unionByName(sorted_in(again).mapInArrow(run(None), schema).select("a", "b"))
    return pairs.distinct()


def _thin(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of equal sets of terms, and one row of each set."""
    firsts = rows.groupBy("text_key").agg(F.min("doc_id").alias("root"))
    equal = rows.select("doc_id", "text_key").join(firsts, "text_key").where("doc_id <> root").select("doc_id", "root")
    return equal, rows.join(firsts.select(F.col("root").alias("doc_id")), "doc_id", "left_semi")


def term_links(rows: DataFrame, leaves: DataFrame, counts: DataFrame) -> DataFrame:
    """Links (doc_id, root) whose connected sets are those of all pairs of records with alike terms.

    Records with equal terms are one from here on. Records of one cluster of the bisecting k-means
    are compared within it. Pairs that a split has parted meet at the first term they share
    (:func:`_candidates`), and those that may be alike are compared term by term.
    """
    equal, single = _thin(rows.where(F.size("terms") > 0))
    single = stored(single.select("doc_id", "terms", "sig").join(leaves.select("doc_id", "leaf"), "doc_id"))
    common = [(r["term"], r["d"]) for r in counts.orderBy(F.col("d").desc(), "term").limit(COMMON).collect()][::-1]
    found = stored(_candidates(_prefixes(single, common)))
    # only the sets that occur in a pair, stored so that the joins know their size
    named = found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct()
    sets = stored(single.select("doc_id", "terms").join(named, "doc_id", "left_semi"))
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("terms").alias(f"t{c}")) for c in "ab")
    across = found.join(x, "a").join(y, "b").where(_alike_sets("ta", "tb")).select(F.col("b").alias("doc_id"), F.col("a").alias("root"))
    return reduce(DataFrame.unionByName, [equal, _in_leaves(single), across])


def _link_topics(table: pa.Table) -> pa.Table:
    """Stars of the rows of a cell that are near to one without terms: each member with the smallest id of its set."""
    ids, bare = table["doc_id"].to_numpy(), table["bare"].to_numpy()
    lists = table["p"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(ids), max(sizes.max(initial=0), 1)))
    x[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    root = np.arange(len(ids))
    for i in np.flatnonzero(bare):
        others = np.flatnonzero(root != root[i])
        near = others[np.abs(x[others] - x[i]).sum(1) <= TOPICS_APART + 1e-12]
        root[np.isin(root, root[near])] = root[i]
    least = np.full(len(ids), np.iinfo("int64").max)
    np.minimum.at(least, root, ids)
    far = np.flatnonzero(least[root] != ids)
    return pa.table({"doc_id": pa.array(ids[far], pa.int64()), "root": pa.array(least[root][far], pa.int64())})


def topic_links(rows: DataFrame) -> DataFrame:
    """Links (doc_id, root) whose connected sets hold all pairs at most :data:`TOPICS_APART` apart in their topic rows, one of them without terms.

    Cells along signed sums of the row's elements (which differ no more than the rows do) bring
    such pairs together; only cells with a record without terms are looked at, and give stars, not
    pairs. Records without terms and with equal rows are one from the start.
    """
    known = rows.where("p is not null").select("doc_id", "p", (F.size("terms") == 0).alias("bare"))
    bare = stored(known.where("bare").select("doc_id", "p"))
    firsts = stored(bare.groupBy("p").agg(F.min("doc_id").alias("root")))
    equal = bare.join(firsts, "p").where("doc_id <> root").select("doc_id", "root")
    width = known.agg(F.max(F.size("p"))).head()[0] or 0
    if not width:
        return equal
    signs = np.where(np.random.default_rng(5).random((6, width)) < 0.5, -1.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _dense(b.column(1), width) @ signs.T / 0.1
            home, over = np.floor(y).astype("int64"), (np.ceil(y) - y) * 0.1 <= TOPICS_APART * 1.001
            owner, cells = np.arange(len(y)), home
            for j in range(y.shape[1]):
                twice = over[owner, j]
                moved = cells[twice].copy()
                moved[:, j] += 1
                owner, cells = np.concatenate([owner, owner[twice]]), np.concatenate([cells, moved])
            code = np.zeros(len(cells), "int64")
            for j in range(cells.shape[1]):
                code = code * np.int64(1000003) + cells[:, j]
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(code), b.column(0).take(of), b.column(1).take(of), b.column(2).take(of)], names=["cell", "doc_id", "p", "bare"])

    schema = "cell bigint, doc_id bigint, p array<double>, bare boolean"
    bare = stored(firsts.select(F.col("root").alias("doc_id"), "p", F.lit(True).alias("bare")).mapInArrow(run, schema))
    others = known.where("not bare").mapInArrow(run, schema).join(bare.select("cell").distinct(), "cell", "left_semi")
    near = _sliced(stored(bare.unionByName(others)), "cell")
    return equal.unionByName(near.groupBy("cell", "part").applyInArrow(_link_topics, _EDGE))


def alike_groups(rows: DataFrame, leaves: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, root): the connected sets of alike records, every member but the smallest doc_id with that doc_id."""
    return connected_components(term_links(rows, leaves, counts).unionByName(topic_links(rows)))


def prepared(wikitext: DataFrame, doc2topic: DataFrame, few: int = FEW_ROWS, most: int = MOST_LEAVES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, their clusters and the counts of terms, each stored once."""
    rows = stored(records(wikitext, doc2topic))
    counts = stored(term_counts(rows))
    return rows, compact(rows, counts, RADIUS, few, most), counts
