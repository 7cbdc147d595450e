"""Top-K sparse autoencoder: inference, losses and training."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.operators.ranking import grouped_rank
from facetry.sources.tables import stored


def _top(pre: np.ndarray, k: int) -> np.ndarray:
    """``pre`` with only the ``k`` highest of each row, of equal ones the first."""
    keep = np.argsort(-pre, axis=1, kind="stable")[:, :k]
    out = np.zeros_like(pre)
    np.put_along_axis(out, keep, np.take_along_axis(pre, keep, 1), 1)
    return out


def _top_of_batch(pre: np.ndarray, k: int) -> np.ndarray:
    """``pre`` with only the ``k`` times rows highest of the whole batch, of equal ones the first."""
    flat, out = pre.ravel(), np.zeros(pre.size)
    keep = np.argsort(-flat, kind="stable")[: k * len(pre)]
    out[keep] = flat[keep]
    return out.reshape(pre.shape)


@dataclass
class Autoencoder:
    """x -> top-K of relu(W (x - b) + c) -> decoder; ``threshold`` replaces the top-K where it is set."""

    encoder: np.ndarray
    decoder: np.ndarray
    offset: np.ndarray
    bias: np.ndarray
    k: int
    threshold: float | None = None
    history: list[dict] = field(default_factory=list)

    def active(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.offset) @ self.encoder.T + self.bias, 0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        pre = self.active(x)
        return np.where(pre > self.threshold, pre, 0) if self.threshold is not None else _top(pre, self.k)

    def decode(self, a: np.ndarray) -> np.ndarray:
        return a @ self.decoder.T + self.offset

    def store(self, spark: SparkSession, path: str) -> None:
        """Writes the model as a small table to ``path``, a folder that the executors share."""
        names = [*PARAMS, "k", "threshold"]
        arrays = [np.asarray(np.nan if getattr(self, n) is None else getattr(self, n), "float64") for n in names]
        rows = [(n, list(a.shape), bytearray(a.tobytes())) for n, a in zip(names, arrays)]
        spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> Autoencoder:
        """The model that :meth:`store` wrote."""
        found = {r["name"]: np.frombuffer(bytes(r["data"])).reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
        threshold = float(found["threshold"])
        return cls(*(found[n] for n in PARAMS), int(found["k"]), None if np.isnan(threshold) else threshold)

    def save(self, path: str) -> None:
        """Writes the model to a file of the driver."""
        np.savez(path, encoder=self.encoder, decoder=self.decoder, offset=self.offset, bias=self.bias, k=self.k, threshold=np.nan if self.threshold is None else self.threshold)

    @classmethod
    def load(cls, path: str) -> Autoencoder:
        z = np.load(path)
        return cls(z["encoder"], z["decoder"], z["offset"], z["bias"], int(z["k"]), None if np.isnan(z["threshold"]) else float(z["threshold"]))


def activations(rows: DataFrame, model: Autoencoder, id_col: str = "doc_id", vector_col: str = "v") -> DataFrame:
    """(``id_col``, theta ARRAY<DOUBLE>): the sparse code of each vector; a map, as codes don't depend on other rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype("float64")
            a = sent.value.encode(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(a), pa.list_(pa.float64()))], names=[id_col, "theta"])

    return rows.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, theta array<double>")


def top_activations(pre: DataFrame, k: int) -> DataFrame:
    """(doc_id, neuron, act): the ``k`` highest pre-activations of each row as relu, of equal ones the first neuron."""
    order = Window.partitionBy("doc_id").orderBy(F.col("pre").desc(), "neuron")
    return pre.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("doc_id", "neuron", F.greatest("pre", F.lit(0.0)).alias("act"))


def batch_activations(pre: DataFrame, k: int) -> DataFrame:
    """(doc_id, neuron, act): the ``k`` times as many highest pre-activations of all rows as there are rows, as relu.

    Of equal ones the first document, then the first neuron. Ranked in range partitions, not by one task.
    """
    rows = stored(pre.select(F.greatest("pre", F.lit(0.0)).alias("act"), (-F.col("doc_id")).alias("d"), (-F.col("neuron")).alias("n"), F.lit(0).alias("g")))
    wanted = k * rows.select("d").distinct().count()
    ranked = grouped_rank(rows, "g", ["act", "d", "n"])
    return ranked.where(F.col("group_rows") - F.col("place") <= wanted).select((-F.col("d")).alias("doc_id"), (-F.col("n")).alias("neuron"), "act")


def dead_share(idle: DataFrame, after: int) -> DataFrame:
    """(dead): the share of neurons (column steps, since each last fired) silent for more than ``after`` steps."""
    return idle.agg(F.avg((F.col("steps") > after).cast("double")).alias("dead"))


def dense(codes: DataFrame, width: int) -> DataFrame:
    """(doc_id, theta): sparse codes (doc_id, neuron, act) as arrays of ``width``, 0 elsewhere."""
    cells = codes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("neuron", "act"))).alias("m"))
    return cells.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("theta"))


def above_threshold(pre: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, neuron, act): the pre-activations above ``threshold``, which is positive or 0."""
    return pre.where(F.col("pre") > threshold).select("doc_id", "neuron", F.col("pre").alias("act"))


def normalized_mse(pairs: DataFrame) -> DataFrame:
    """(nmse): squared error of ``pairs`` (i, x, y) over that of each dimension's mean; one shuffle by dimension."""
    d = F.col("x") - F.col("y")
    per = pairs.groupBy("i").agg(F.sum(d * d).alias("e"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("e") / F.sum(F.col("v") * F.col("n"))).alias("nmse"))


def lower_median(cells: DataFrame) -> DataFrame:
    """(i, median): the lower median of each dimension of ``cells`` (i, x)."""
    return cells.groupBy("i").agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("median"))


PARAMS = ("encoder", "decoder", "offset", "bias")


@dataclass
class _State:
    """What training carries from pass to pass: the model, Adam's moments and steps, and the rows since each neuron fired."""

    model: Autoencoder
    m: dict[str, np.ndarray]
    s: dict[str, np.ndarray]
    idle: np.ndarray
    t: int = 0


def _error(model: Autoencoder, y: np.ndarray) -> np.ndarray:
    """Squared error, and rows, sum and sum of squares, from which that of the mean is known."""
    e = model.decode(model.encode(y)) - y
    return np.concatenate([[(e * e).sum(), len(y), (y * y).sum()], y.sum(0)])


def _relative(e: np.ndarray) -> float:
    return float(e[0] / max(1e-12, e[2] - (e[3:] ** 2).sum() / max(1, e[1])))


def _split(x: np.ndarray, share: float = 0.12, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Rows to learn from, and a seeded random ``share`` held out, both in order (all in both, where there is one row)."""
    held = np.zeros(len(x), bool)
    held[np.random.default_rng(seed).permutation(len(x))[: math.ceil(share * len(x))]] = True
    return (x[~held], x[held]) if 0 < held.sum() < len(x) else (x, x)


@dataclass
class _Terms:
    """What a step's loss is made of."""

    aux: float
    aux_k: int
    cuts: list[int]
    multi: float
    multi_k: int
    by_batch: bool


def _pass(state: _State, x: np.ndarray, rng: np.random.Generator, batch: int, rate: float, terms: _Terms) -> _State:
    """One pass of Adam over the rows of a part."""
    model, m, s, idle, t = replace(state.model), dict(state.m), dict(state.s), state.idle, state.t
    for at in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
        y = x[at]
        pre = model.active(y)
        a = _top_of_batch(pre, model.k) if terms.by_batch else _top(pre, model.k)
        if terms.by_batch and (a > 0).any():  # towards the smallest activation that the batch lets pass
            model.threshold = 0.99 * (model.threshold or 0.0) + 0.01 * float(a[a > 0].min())
        scale = max(1e-12, ((y - y.mean(0)) ** 2).sum())
        g = {p: np.zeros_like(getattr(model, p)) for p in PARAMS}
        back = np.zeros_like(a)
        for c in terms.cuts:
            e = 2 * (a[:, :c] @ model.decoder[:, :c].T + model.offset - y) / scale / len(terms.cuts)
            g["decoder"][:, :c] += e.T @ a[:, :c]
            g["offset"] += e.sum(0)
            back[:, :c] += e @ model.decoder[:, :c]
        idle = np.where((a > 0).any(0), 0, idle + len(at))
        dead = idle > len(x)
        back *= a > 0
        if terms.aux and dead.any():
            few, left = _top(pre[:, dead], terms.aux_k), y - model.decode(a)
            e = 2 * terms.aux * (few @ model.decoder[:, dead].T - left) / max(1e-12, ((left - left.mean(0)) ** 2).sum())
            g["decoder"][:, dead] += e.T @ few
            live = (e @ model.decoder[:, dead]) * (few > 0)
            g["encoder"][dead] += live.T @ (y - model.offset)
            g["bias"][dead] += live.sum(0)
        if terms.multi:
            more = _top(pre, terms.multi_k)
            e = 2 * terms.multi * (more @ model.decoder.T + model.offset - y) / scale
            g["decoder"] += e.T @ more
            g["offset"] += e.sum(0)
            back += (e @ model.decoder) * (more > 0)
        g["encoder"] += back.T @ (y - model.offset)
        g["bias"] += back.sum(0)
        g["offset"] -= back.sum(0) @ model.encoder
        g["decoder"] -= model.decoder * (g["decoder"] * model.decoder).sum(0)
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        t += 1
        for p in PARAMS:
            d = g[p] / max(1.0, norm)
            m[p] = 0.9 * m[p] + 0.1 * d
            s[p] = 0.999 * s[p] + 0.001 * d * d
            setattr(model, p, getattr(model, p) - rate * (m[p] / (1 - 0.9**t)) / (np.sqrt(s[p] / (1 - 0.999**t)) + 1e-8))
        model.decoder = model.decoder / np.maximum(np.linalg.norm(model.decoder, axis=0), 1e-12)
    return _State(model, m, s, idle, t)


def _averaged(states: list[_State], rows: list[int]) -> _State:
    """The mean of the parts' models and moments by their rows; a neuron has been idle for as long as in the part that it fired in last."""
    w = np.array(rows) / sum(rows)
    mean = lambda xs: sum(k * x for k, x in zip(w, xs))
    model = replace(states[0].model, **{p: mean([getattr(s.model, p) for s in states]) for p in PARAMS})
    model.decoder = model.decoder / np.maximum(np.linalg.norm(model.decoder, axis=0), 1e-12)
    if model.threshold is not None:
        model.threshold = float(mean([s.model.threshold for s in states]))
    m, s = ({p: mean([getattr(x, k)[p] for x in states]) for p in PARAMS} for k in ("m", "s"))
    return _State(model, m, s, np.min([x.idle for x in states], 0), max(x.t for x in states))


def train(rows: DataFrame, n_features: int, k: int, vector_col: str = "v", bound: int = 50_000, epochs: int = 30, batch: int = 512, rate: float = 5e-4, patience: int = 5, aux: float = 1 / 32, prefixes: tuple[float, ...] = (), seed: int = 42, aux_k: int | None = None, multi_k: int | None = None, multi: float = 0.0, batch_top: bool = False) -> Autoencoder:
    """An autoencoder fitted by Adam on all rows, in parts of about ``bound`` rows (by a hash of the vector).

    Each epoch is a pass over every part in a task of its own, after which the driver averages
    the parts' models by their rows; a single part is learnt on the driver. Only models, moments and sums
    of errors leave the tasks.

    Loss: squared error relative to the batch's spread, for each of the ``prefixes`` (shares of the
    neurons, nested) and all, plus ``aux`` times that of reconstructing the residual with neurons
    that haven't fired for an epoch of their part (the ``aux_k`` strongest of a row, twice k by default), plus ``multi`` times
    that of the ``multi_k`` strongest neurons (four times k by default). With ``batch_top`` a step keeps the k times
    rows strongest activations of its batch instead of k of each row, and the model gets a threshold for its
    codes, which follows the smallest activation kept. Decoder columns have length 1; gradients are clipped to norm 1;
    the offset starts at the lower median (the mean of the parts'). Twelve percent are held out, and training ends when
    its loss hasn't fallen for ``patience`` epochs. ``history`` has the losses of each epoch and the rows learnt from.
    """
    rng = np.random.default_rng(seed)
    hashed = rows.where(F.col(vector_col).isNotNull()).select(F.xxhash64(vector_col).alias("h"), F.col(vector_col).alias("v"))
    parts = max(1, -(-hashed.count() // bound))
    cuts = sorted({max(1, int(c * n_features)) for c in prefixes} | {n_features})

    def matrix(table: pa.Table) -> np.ndarray:
        v = table.sort_by("h")["v"].combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype("float64")

    if parts == 1:
        alone = matrix(hashed.toArrow())
        each = lambda f: [f(alone, 0)]
    else:
        split = hashed.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")).repartition(parts, "part").persist(StorageLevel.DISK_ONLY)

        def each(f) -> list:
            def run(table: pa.Table) -> pa.Table:
                return pa.table({"x": pa.array([pickle.dumps(f(matrix(table), table["part"][0].as_py()))], pa.binary())})

            return [pickle.loads(r.x) for r in split.groupBy("part").applyInArrow(run, "x binary").collect()]

    def begin(x: np.ndarray, part: int) -> tuple[int, np.ndarray]:
        x = _split(x)[0]
        return len(x), np.sort(x, axis=0)[(len(x) - 1) // 2]

    begun = each(begin)
    offset = sum(n * v for n, v in begun) / sum(n for n, _ in begun)
    dec = rng.normal(size=(len(offset), n_features))
    dec /= np.linalg.norm(dec, axis=0)
    model = Autoencoder(dec.T.copy(), dec, offset, np.zeros(n_features), k, 0.0 if batch_top else None)
    terms = _Terms(aux, aux_k or min(2 * k, n_features), cuts, multi, multi_k or min(4 * k, n_features), batch_top)
    m, s = ({p: np.zeros_like(getattr(model, p)) for p in PARAMS} for _ in range(2))
    state, history, best, waited = _State(model, m, s, np.zeros(n_features)), [], np.inf, 0
    for epoch in range(epochs + 1):  # each pass first has the losses of the epoch before

        def step(x: np.ndarray, part: int, state: _State = state, epoch: int = epoch) -> tuple:
            x, val = _split(x)
            after = _pass(state, x, np.random.default_rng([seed, epoch, part]), batch, rate, terms) if epoch < epochs else None
            return len(x), _error(state.model, x), _error(state.model, val), state.idle > len(x), after

        found = each(step)
        if epoch:
            learnt, val = (sum(f[i] for f in found) for i in (1, 2))
            history.append({"epoch": epoch - 1, "train": _relative(learnt), "val": _relative(val), "dead": float(np.mean([f[3] for f in found])), "rows": sum(f[0] for f in found)})
            if history[-1]["val"] < best - 1e-9:
                best, waited = history[-1]["val"], 0
            elif (waited := waited + 1) >= patience:
                break
        if epoch < epochs:
            state = _averaged([f[4] for f in found], [f[0] for f in found])
    if parts > 1:
        split.unpersist()
    return replace(state.model, history=history)


def model_name(n_features: int, k: int, prefixes: tuple[float, ...] = ()) -> str:
    """The name a model is kept under: by its size, its k and, if nested, its prefixes."""
    if prefixes:
        return f"SAE_matryoshka_M={n_features}_K={k}_prefixes=" + "-".join(str(max(1, int(c * n_features))) for c in (*prefixes, 1.0))
    return f"SAE_M={n_features}_K={k}"


def train_or_load(rows: DataFrame, n_features: int, k: int, folder: str, prefixes: tuple[float, ...] = (), **options) -> Autoencoder:
    """The model kept in ``folder`` under its name, or else a new one by :func:`train`, which is then kept there."""
    spark, path = rows.sparkSession, f"{folder}/{model_name(n_features, k, prefixes)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return Autoencoder.stored(spark, path)
    model = train(rows, n_features, k, prefixes=prefixes, **options)
    model.store(spark, path)
    return model
