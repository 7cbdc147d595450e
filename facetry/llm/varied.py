"""Choosing a varied subset (problem 4)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.components import connected_components
from facetry.sources.tables import latest, stored

#: Rows of a slot that nominates, rows of a cell compared in one task, most cell coordinates, rows taken by one round.
SLOT_ROWS, CELL_ROWS, MOST_COORDINATES, ROUND_ROWS = 4096, 4096, 48, 160
#: Cosine from which two records say the same.
SAME = 0.999
#: Random directions of the sketch by which the rows of a cell are compared first, rows that a cell should have at
#: most on average, how often a row may be in a cell on average, and width of the bins that place the cells.
SKETCH, AIM, REPEATS, BIN = 24, 256, 6.0, 0.01


def unit_rows(rows: DataFrame, col: str, width: int) -> DataFrame:
    """(doc_id, v, same): the array ``col`` of each row scaled to length 1, and a digest that equal arrays share.

    Null, NaN, infinite and negative elements count as 0; rows whose array is null, empty or
    all 0 are left out. Arrays are filled up with 0 to ``width``, which none may exceed.
    """

    def run(batches):
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(sizes), max(width, 0)))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
            flat = np.where(np.isfinite(flat) & (flat > 0), flat, 0.0)
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            kept = np.flatnonzero((norm > 0) & np.isfinite(norm))
            digests = [hashlib.blake2b(x[i].tobytes(), digest_size=16).digest() for i in kept]
            v = x[kept] / norm[kept, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, max(1, width), dtype="int32")), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), lists, pa.array(digests, pa.binary())], names=["doc_id", "v", "same"])

    return rows.where(F.size(col) > 0).select("doc_id", col).mapInArrow(run, "doc_id bigint, v array<double>, same binary")


def theta_rows(theta: DataFrame) -> DataFrame:
    """:func:`unit_rows` of the latest theta of each record."""
    width = theta.agg(F.max(F.size("theta"))).head()[0] or 0
    return unit_rows(latest(theta.where("doc_id is not null"), ["doc_id"], ["theta"]), "theta", width)


def topic_rows(topic2doc: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, v, same): :func:`unit_rows` of the latest topic weights of each record, and their width."""
    width = (topic2doc.agg(F.max("topic_id")).head()[0] or 0) + 1
    pairs = latest(topic2doc.where("topic_id >= 0 and doc_id is not null"), ["topic_id", "doc_id"], ["weight"]).where("weight > 0 and not isnan(weight)")
    cells = pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "weight"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return unit_rows(cells.select("doc_id", dense.alias("t")), "t", width), width


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pivot(ids: np.ndarray, rows: np.ndarray, k: int, least: float = 1e-6, scale: float | None = None) -> list[int]:
    """Positions of at most ``k`` rows in the order that pivoted QR takes them.

    Each step takes the row with the largest part outside the span of those taken, of equal
    ones (to 12 places) the smallest id; it ends where no row has a part above ``least`` of
    ``scale``, the longest row's square where that isn't given.
    """
    order = np.argsort(ids, kind="stable")
    x = rows[order]
    rest = np.einsum("ij,ij->i", x, x)
    scale = rest.max(initial=0.0) if scale is None else scale
    basis = np.zeros((0, x.shape[1]))
    taken: list[int] = []
    while len(taken) < min(k, len(x)):
        best = int(np.argmax(np.round(rest, 12)))
        if rest[best] <= least * scale or rest[best] <= 0:
            break
        q = x[best] - (x[best] @ basis.T) @ basis
        q -= (q @ basis.T) @ basis
        size = np.linalg.norm(q)
        rest[best] = -1.0
        if size * size <= least * scale:
            continue
        q /= size
        basis = np.vstack([basis, q])
        rest = np.where(rest < 0, -1.0, np.maximum(rest - (x @ q) ** 2, 0.0))
        taken.append(best)
    return [int(order[i]) for i in taken]


def tournament(rows: DataFrame, k: int, n_rows: int, known: np.ndarray | None = None) -> DataFrame:
    """(doc_id, v, place): at most ``k`` linearly independent rows by tournament-pivoted QR.

    With ``known``, an orthonormal basis, rows are first deflated: only their parts outside of it count and are given.

    Slots of about :data:`SLOT_ROWS` rows, by a hash of the id, each nominate up to k rows by
    pivoted QR; pairs of slots then meet in a tree and re-pivot the nominees of both, until one
    slot is left. A task never holds more than a slot or two sets of nominees, and the result
    doesn't depend on how the rows are partitioned.
    """
    levels = max(0, math.ceil(math.log2(max(1, n_rows) / SLOT_ROWS)))

    def nominate(first: bool):
        def run(table: pa.Table) -> pa.Table:
            x = _matrix(table["v"])
            if first and known is not None and len(known):
                x = x - (x @ known.T) @ known
                x -= (x @ known.T) @ known
            kept = pivot(table["doc_id"].to_numpy(), x, k, scale=1.0)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * x.shape[1] + 1, max(1, x.shape[1]), dtype="int32")), pa.array(x[kept].ravel()))
            at = pa.array(kept, pa.int64())
            return pa.table({"slot": table["slot"].take(at), "doc_id": table["doc_id"].take(at), "v": v, "place": pa.array(range(len(kept)), pa.int32())})

        return run

    schema = "slot int, doc_id bigint, v array<double>, place int"
    state = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << levels)).cast("int").alias("slot"), "doc_id", "v").groupBy("slot").applyInArrow(nominate(True), schema)
    for _ in range(levels):
        state = state.select(F.shiftright("slot", 1).alias("slot"), "doc_id", "v").groupBy("slot").applyInArrow(nominate(False), schema)
    return state.select("doc_id", "v", "place")


def directions(rows: DataFrame, k: int, n_rows: int) -> np.ndarray:
    """An orthonormal basis of the first ``k`` tournament pivots; at most k rows reach the driver."""
    found = sorted((r["place"], r["v"]) for r in tournament(rows, k, n_rows).collect())
    q, _ = np.linalg.qr(np.array([v for _, v in found], "float64").T)
    return q.T


def _linked(ids: np.ndarray, x: np.ndarray, same: float, block: int = 512) -> tuple[list[int], list[int]]:
    """Stars of the connected sets of rows with cosine of at least ``same``: members and their smallest id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    busy = np.concatenate([((x[i : i + block] @ x.T) >= same).sum(1) > 1 for i in range(0, len(x), block)])
    ids, x = ids[busy], x[busy]
    rest, node, root = np.arange(len(ids)), [], []
    while len(rest):
        first, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for i in range(0, len(front), block):
                hit |= ((x[front[i : i + block]] @ x[rest].T) >= same).any(0)
            front, rest = rest[hit], rest[~hit]
            node += ids[front].tolist()
            root += [int(ids[first])] * len(front)
    return node, root


def _cuts(shares: np.ndarray, n: int, apart: float, aim: float = AIM, most: float = REPEATS) -> list[np.ndarray]:
    """Where to cut along each direction, from the shares of rows in bins along it (:func:`_grid`)."""
    bins, reach = shares.shape[1], math.ceil(apart / BIN) + 1
    upto = np.hstack([np.zeros((len(shares), 1)), np.cumsum(shares, axis=1)])
    near = upto - np.hstack([np.zeros((len(shares), reach)), upto[:, :-reach]])  # rows less than apart below each edge
    free = np.ones_like(upto, bool)
    free[:, [0, -1]] = False
    cuts: list[list[int]] = [[] for _ in shares]
    met, extra, size, repeats = np.ones(len(shares)), np.zeros(len(shares)), float(n), 1.0
    while size > aim and free.any():
        # how much less likely two rows share a cell after a cut, for the repeats it costs
        left = np.array([np.concatenate([np.repeat(upto[j, e[i]], e[i + 1] - e[i]) for i in range(len(e) - 1)] + [[1.0]]) for j, e in enumerate([0, *c, bins] for c in cuts)])
        right = np.array([np.concatenate([np.repeat(upto[j, e[i + 1]], e[i + 1] - e[i]) for i in range(len(e) - 1)] + [[1.0]]) for j, e in enumerate([0, *c, bins] for c in cuts)])
        after = np.maximum(met[:, None] - 2 * (upto - left) * (right - upto), 1e-9)
        gain = np.where(free, np.log(met[:, None] / after) / (near + 0.001), 0.0)
        j, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[j, c] <= 0:
            break
        more = repeats * (1 + extra[j] + near[j, c]) / (1 + extra[j])
        free[j, c] = False
        if more > most:
            continue
        cuts[j] = sorted([*cuts[j], int(c)])
        free[j, max(0, c - 2 * reach) : c + 2 * reach + 1] = False  # a row is near one cut of a direction at most
        size, repeats = size * after[j, c] / met[j], more
        met[j], extra[j] = after[j, c], extra[j] + near[j, c]
    return [np.array(c) * BIN - 1 for c in cuts]


def _grid(rows: DataFrame, basis: np.ndarray, apart: float, n: int) -> list[np.ndarray]:
    """Where to cut along the directions of ``basis`` so that rows are seldom near a cut.

    From one histogram along each direction (counted in the tasks, of a fixed size), cuts are made one by one, each
    time the one that parts the most rows for the repeats it costs, until cells have :data:`AIM` rows on
    average, or rows would be repeated more than :data:`REPEATS` times.
    """
    bins = int(round(2 / BIN)) + 2

    def run(batches):
        held = np.zeros((len(basis), bins), "int64")
        for b in batches:
            at = np.clip(np.floor((_matrix(b.column(0)) @ basis.T + 1) / BIN).astype("int64"), 0, bins - 1)
            for j in range(len(basis)):
                held[j] += np.bincount(at[:, j], minlength=bins)
        j, i = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype("int32")), pa.array(i.astype("int32")), pa.array(held[j, i])], names=["j", "i", "n"])

    shares = np.zeros((len(basis), bins))
    for r in rows.select("v").mapInArrow(run, "j int, i int, n bigint").groupBy("j", "i").agg(F.sum("n").alias("n")).collect():
        shares[r["j"], r["i"]] = r["n"] / n
    return _cuts(shares, n, apart)


def _in_cells(rows: DataFrame, basis: np.ndarray, cuts: list[np.ndarray], apart: float) -> DataFrame:
    """(cell, doc_id, z) with every row in each cell that it shares with a row at distance ``apart`` or less.

    A cell is an interval between ``cuts`` along every direction of ``basis``. As projections never lengthen a distance,
    two such rows lie in the same or in neighbouring intervals; a row less than ``apart`` below
    an upper edge also enters the next interval, so any such pair meets in at least one cell. z is a sketch:
    the row's projection to :data:`SKETCH` random directions, in which they aren't further apart either.
    """
    width = basis.shape[1]
    random, _ = np.linalg.qr(np.random.default_rng(11).normal(size=(width, min(SKETCH, width))))

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            z = (x @ random).astype("float32")
            y = x @ basis.T
            home, above = (np.stack([np.searchsorted(c, y[:, j] + d, side="right") for j, c in enumerate(cuts)], axis=1) for d in (0.0, apart * 1.001))
            over = above > home
            owner, cells = np.arange(len(y)), home
            for j in range(y.shape[1]):
                twice = over[owner, j]
                moved = cells[twice].copy()
                moved[:, j] += 1
                owner, cells = np.concatenate([owner, owner[twice]]), np.concatenate([cells, moved])
            code = np.zeros(len(cells), "int64")
            for j in range(cells.shape[1]):
                code = code * np.int64(1000003) + cells[:, j]
            for i in range(0, len(owner), 1 << 14):
                of = owner[i : i + (1 << 14)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z[of].size + 1, z.shape[1], dtype="int32")), pa.array(z[of].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 14)]), b.column(0).take(pa.array(of)), lists], names=["cell", "doc_id", "z"])

    return rows.select("doc_id", "v").mapInArrow(run, "cell bigint, doc_id bigint, z array<float>")


def _by_group(link):
    """A map over rows that come in the order of their first column: ``link`` (ids, vectors) of each group of several rows.

    Columns are group, doc_id and vector; ``link`` gives members and roots. The result has group, doc_id and root.
    """

    def groups(table: pa.Table) -> pa.RecordBatch:
        key, ids, x = table.column(0).to_numpy(), table["doc_id"].to_numpy(), _matrix(table.column(2))
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out = [[np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]]
        for i, j in zip(begins.tolist(), np.append(begins[1:], len(key)).tolist()):
            if j - i > 1:
                node, root = link(ids[i:j], x[i:j])
                for held, new in zip(out, (np.full(len(node), key[i]), node, root)):
                    held.append(np.asarray(new, "int64"))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["of", "doc_id", "root"])

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            changed = np.flatnonzero(key[1:] != key[:-1])  # the last group may go on
            if len(changed):
                yield groups(table.slice(0, int(changed[-1]) + 1).combine_chunks())
                table = table.slice(int(changed[-1]) + 1)
            held = table.to_batches()
        if held:
            yield groups(pa.Table.from_batches(held).combine_chunks())

    return run


def _near(apart: float):
    """Stars of the connected sets of rows at most ``apart`` from each other, a rounding error more allowed.

    Rows in the order of the coordinate that varies most are compared with those that follow within
    ``apart`` along it; each takes the smallest label of its neighbours until none changes.
    """

    def link(ids: np.ndarray, z: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        axis = int(np.argmax(z.var(0)))
        order = np.argsort(z[:, axis], kind="stable")
        ids, z = ids[order], z[order]
        label, first = np.argsort(np.argsort(ids, kind="stable"), kind="stable"), True
        by_label = np.sort(ids)
        while True:
            along, square, before = z[:, axis], np.einsum("ij,ij->i", z, z), label.copy()
            busy = np.zeros(len(z), bool)
            for i in range(0, len(z), block):
                j = min(i + block, len(z))
                end = int(np.searchsorted(along, along[j - 1] + apart + 1e-5, side="right"))
                close = square[i:j, None] + square[None, i:end] - 2 * z[i:j] @ z[i:end].T <= apart * apart + 1e-5
                a, b = np.nonzero(close)
                a, b = a[a != b] + i, b[a != b] + i
                np.minimum.at(label, a, label[b])
                np.minimum.at(label, b, label[a])
                busy[a] = busy[b] = True
            if first:
                ids, z, label, before, first = ids[busy], z[busy], label[busy], before[busy], False
            if np.array_equal(before, label):
                return ids, by_label[label]

    return link


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _thinned(cells: DataFrame, hot: DataFrame, apart: float) -> tuple[DataFrame, DataFrame]:
    """Links to one leader in each hot cell, and the cells without the rows that need no more comparing.

    With g the distance from the leader to the nearest row that isn't linked to it, a row nearer
    to the leader than g - apart cannot be within ``apart`` of any row that the leader isn't.
    """
    members = cells.join(hot.select("cell"), "cell", "left_semi")
    leaders = members.groupBy("cell").agg(F.min(F.struct("doc_id", "v")).alias("lead"))
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * _dot(F.col("v"), F.col("lead.v"))))
    near = members.join(leaders, "cell").select("cell", "doc_id", F.col("lead.doc_id").alias("leader"), far.alias("far"))
    near = stored(near)
    gap = near.where(F.col("far") > apart).groupBy("cell").agg(F.min("far").alias("gap"))
    links = near.where((F.col("far") <= apart) & (F.col("doc_id") != F.col("leader"))).select("doc_id", "leader")
    done = near.join(gap, "cell", "left").where((F.col("far") < F.coalesce(F.col("gap") - apart, F.lit(9.0)) - 1e-9) & (F.col("far") <= apart)).select("cell", "doc_id")
    return links, cells.join(done, ["cell", "doc_id"], "left_anti")


def same_groups(rows: DataFrame, same: float = SAME) -> DataFrame:
    """(node, root): groups of records that say the same, every member but the smallest doc_id with that doc_id.

    ``rows`` (doc_id, v, same) come from :func:`unit_rows`. Two records say the
    same if the cosine of their vectors is at least ``same``; groups are the connected sets.

    Method: equal vectors are one row from the start. Tournament-pivoted QR gives the directions
    along which the rows differ most; cells between cuts along them (:func:`_grid`) bring every pair near enough
    together (:func:`_in_cells`). Rows travel there as short sketches; the vectors are only
    joined to rows that have a neighbour by sketch in their cell, and an exact check among these links them.
    A set of more than :data:`CELL_ROWS` such rows, or a cell of more than eight times as many, is first thinned
    around a leader, which a group of near copies holding a third of all rows shrinks to a few, and what is left is compared in pairs of blocks.
    Cells give stars, not pairs, whose connected components are found without the driver.
    """
    apart = math.sqrt(max(0.0, 2 - 2 * same)) + 1e-9
    rows = stored(rows)
    firsts = rows.groupBy("same").agg(F.min("doc_id").alias("root"))
    equal = stored(rows.select("doc_id", "same").join(firsts, "same").where("doc_id <> root").select("doc_id", "root"))
    units = stored(rows.join(equal, "doc_id", "left_anti").select("doc_id", "v"))
    n = units.count()
    if n < 2:
        return connected_components(equal)
    basis = directions(units, MOST_COORDINATES, n)
    cells = stored(_in_cells(units, basis, _grid(units, basis, apart, n), apart))
    large = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 8 * CELL_ROWS).select("cell"))
    crowded = not large.isEmpty()
    small = cells.join(large, "cell", "left_anti") if crowded else cells
    sets = small.select("cell", "doc_id", "z").repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_group(_near(apart)), "of bigint, doc_id bigint, root bigint")
    # stored, so that its size is known to the join: where it is small, no vector is shuffled
    sets = stored(sets.select(F.xxhash64("of", "root").alias("cell"), "doc_id"))
    many = stored(sets.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).select("cell"))
    hot = None if many.isEmpty() else sets.join(many, "cell", "left_semi")
    if crowded:
        rows_of = cells.join(large, "cell", "left_semi").select("cell", "doc_id")
        hot = rows_of if hot is None else hot.unionByName(rows_of)
    links = equal
    if hot is not None:
        links = links.unionByName(_in_crowded(stored(hot.join(units, "doc_id").select("cell", "doc_id", "v")), same, apart))
        sets = sets.join(many, "cell", "left_anti")
    exact = _by_group(lambda ids, x: _linked(ids, x, same))
    placed = sets.join(units, "doc_id").select("cell", "doc_id", "v").repartition("cell").sortWithinPartitions("cell")
    return connected_components(links.unionByName(placed.mapInArrow(exact, "of bigint, doc_id bigint, root bigint").select("doc_id", "root")))


def _in_crowded(cells: DataFrame, same: float, apart: float) -> DataFrame:
    """Links (doc_id, root) within cells (cell, doc_id, v) of very many rows."""
    found = None
    rows_in, hot = None, _hot(cells)
    while hot is not None and (rows_in is None or hot[1] < 0.75 * rows_in):
        rows_in = hot[1]
        links, cells = _thinned(cells, hot[0], apart)
        links = links.toDF("doc_id", "root")
        found, cells = links if found is None else found.unionByName(links), stored(cells)
        hot = _hot(cells)
    if hot is not None:
        cells = _block_pairs(cells, hot[0])
    else:
        cells = cells.withColumn("part", F.lit(0).cast("bigint"))

    def link(table: pa.Table) -> pa.Table:
        node, root = _linked(table["doc_id"].to_numpy(), _matrix(table["v"]), same)
        return pa.table({"doc_id": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})

    links = cells.groupBy("cell", "part").applyInArrow(link, "doc_id bigint, root bigint")
    return links if found is None else found.unionByName(links)


def _hot(cells: DataFrame) -> tuple[DataFrame, int] | None:
    """The cells of more than :data:`CELL_ROWS` rows with their number of blocks, and how many rows they hold."""
    hot = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).withColumn("blocks", F.ceil(F.col("n") / (CELL_ROWS // 2))))
    held = hot.agg(F.sum("n")).head()[0]
    return (hot, held) if held else None


def _block_pairs(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot cells once for each pair of blocks that theirs is in, so that all pairs still meet."""
    b = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    placed = cells.join(hot.select("cell", "blocks"), "cell", "left").withColumn("b", b)
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda o: F.least(o, F.col("b")) * F.col("blocks") + F.greatest(o, F.col("b")))
    )
    return placed.select("cell", "doc_id", "v", F.explode(others).alias("part"))


def varied_subset(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, round, place): ``k`` rows of ``rows`` (doc_id, v) that vary most, all of them if there are fewer.

    Each round takes up to :data:`ROUND_ROWS` rows of a tournament-pivoted QR; the rows left are deflated by
    the directions taken so far for the next. Where nothing is left outside of these, the next round
    begins anew over the rows not yet taken. Rows without a
    positive length are never taken. After rounds of full rank every feature that is
    active anywhere is active in a row taken.
    """
    rows = stored(rows)
    n, taken, found, turn, known = rows.count(), 0, None, 0, None
    while taken < k and n > taken:
        asked = min(ROUND_ROWS, k - taken)
        more = stored(tournament(rows, asked, n - taken, known))
        picked = sorted((r["place"], r["v"]) for r in more.collect())  # at most ROUND_ROWS rows
        ids, got = more.select("doc_id", F.lit(turn).alias("round"), "place"), len(picked)
        if got:
            found = ids if found is None else found.unionByName(ids)
            rows = rows.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti")  # as many ids
            taken, turn = taken + got, turn + 1
        if got == asked:
            new = np.array([v for _, v in picked]).T
            q, _ = np.linalg.qr(new if known is None else np.hstack([known.T, new]))
            known = q.T
        elif got or known is not None:
            known = None
        else:
            break
    return found if found is not None else rows.sparkSession.createDataFrame([], "doc_id bigint, round int, place int")


def one_of_each(theta: DataFrame, topic2doc: DataFrame, k: int) -> DataFrame:
    """(doc_id, round, place): ``k`` varied records, at most one of each group that says the same.

    A record is its theta row and its topic weights, each scaled to length 1, side by side; where one
    is missing or all 0, that side is 0. Groups go by theta; of a group only the smallest doc_id can be taken.
    """
    rows = stored(theta_rows(theta))
    groups = same_groups(rows)
    seen = rows.agg(F.max(F.size("v"))).head()[0] or 0
    topics, width = topic_rows(topic2doc)
    both = rows.select("doc_id", "v").join(topics.select("doc_id", F.col("v").alias("t")), "doc_id", "full")
    single = both.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
    side = F.concat(*[F.coalesce(c, F.array_repeat(F.lit(0.0), n)) for c, n in (("v", seen), ("t", width))])
    return varied_subset(single.select("doc_id", side.alias("v")), k)
