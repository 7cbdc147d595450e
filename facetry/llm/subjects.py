"""Subject areas of each document (problem 10)."""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.sources.tables import latest, release, stored

#: Labelled records that are learnt from at most, by a hash of their ids.
LABELLED = 12_000
#: Rows of the table of word and subword vectors, their width, and the lengths of subwords.
BUCKETS, WIDTH, SUBWORDS = 1 << 16, 16, (4, 5)
#: Gradient steps that go once through the sentences, how often they do, step size, and most partitions that share a step.
STEPS, EPOCHS, RATE, MOST_LEARNERS = 30, 3, 0.5, 16
#: Output from which a sentence treats an area beyond doubt, and by how much context may lift others.
SURE, CONTEXT = 2.0, 1.5
#: Words of a sentence whose vectors are remembered by a worker.
REMEMBERED = 400_000

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LINES = re.compile(r"[\r\n\u2028\u2029\x85]+|<[A-Za-z/!?][^<>]*>")
_ENDS = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]」』]*\s+(?=\S)|(?<=[。！？])[\"'”’»)\]」』]*(?=\S)")
_ENDED = re.compile(r"[.!?。！？…][\"'”’»)\]」』\s]*$")
#: Scripts that put no space between words: Thai and Lao, Burmese, Khmer, Kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+")


def words(part: str) -> list[str]:
    """The lower-cased words; of scripts without spaces every two neighbouring characters are one."""
    found = _WORD.findall(part.lower())
    if part.isascii() or not _UNSPACED.search(part):
        return found
    out = []
    for w in found:
        at = 0
        for m in _UNSPACED.finditer(w):
            run = m.group()
            out += [w[at : m.start()]] if m.start() > at else []
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
            at = m.end()
        out += [w[at:]] if at < len(w) else []
    return out


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, lower-cased; headings, list marks and lines without sentence are left out.

    A sentence ends at a full stop, exclamation or question mark before white space (an ideographic
    one anywhere), or at the end of its line; one of fewer than four words must end with such a mark. Entities
    are read as the characters they stand for, invisible characters and tags removed.
    """
    out = []
    for line in _LINES.split(_INVISIBLE.sub("", html.unescape(text or ""))):
        for part in _ENDS.split(line):
            found = words(part)
            if len(found) > 3 or (len(found) > 1 and _ENDED.search(part)):
                out.append(found)
    return out


def features(word: str) -> tuple[int, ...]:
    """Rows of the vector table that make up a word: its own and those of its subwords."""
    return _known(word) if len(word) <= 64 else _features(word)


def _features(word: str) -> tuple[int, ...]:
    marked = f"<{word}>"
    subwords = (marked[i : i + n] for n in SUBWORDS for i in range(len(marked) - n + 1))
    return (zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(b"#" + w.encode()) % BUCKETS for w in subwords))


_known = lru_cache(maxsize=1 << 17)(_features)


class Model:
    """Averaged word and subword vectors with an independent logistic output for each subject."""

    def __init__(self, subjects: list[str], vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.subjects, self.vectors, self.out, self.bias = subjects, vectors, out, bias
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(subjects)), "float32")

    @classmethod
    def fresh(cls, subjects: list[str], seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        return cls(subjects, rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype("float32"), np.zeros((len(subjects), WIDTH), "float32"), np.full(len(subjects), -2.0, "float32"))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """What each word adds to each subject's output; remembered, as the outputs are linear in the words."""
        ids = np.empty(len(words), "int64")
        for k, w in enumerate(words):
            i = self.known.get(w)
            if i is None:
                i = self.known[w] = len(self.known)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.vectors[list(features(w))].mean(0) @ self.out.T
            ids[k] = i
        found = self.rows[ids]
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, np.zeros((1024, len(self.subjects)), "float32")
        return found

    def scores(self, found: list[list[str]]) -> np.ndarray:
        """The outputs (log odds) of each sentence for each subject."""
        sizes = np.array([len(s) for s in found])
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.word_scores([w for s in found for w in s]), starts, axis=0) / sizes[:, None] + self.bias


class Batch:
    """Labelled sentences with the places of their words and features, for one gradient step."""

    def __init__(self, found: list[list[str]], labels: np.ndarray):
        words = {w: i for i, w in enumerate(dict.fromkeys(w for s in found for w in s))}
        parts = [features(w) for w in words]
        per_word = np.array([len(p) for p in parts])
        self.used, slot = np.unique(np.concatenate([np.array(p) for p in parts]), return_inverse=True)
        self.slot, self.word_starts = slot, np.cumsum(per_word) - per_word
        self.word = np.array([words[w] for s in found for w in s])
        self.sizes = np.array([len(s) for s in found])
        self.starts = np.cumsum(self.sizes) - self.sizes
        by_word = np.argsort(self.word, kind="stable")
        self.sentence_of = np.repeat(np.arange(len(found)), self.sizes)[by_word]
        self.word_at = np.searchsorted(self.word[by_word], np.arange(len(parts)))
        by_feature = np.argsort(slot, kind="stable")
        self.word_of = np.repeat(np.arange(len(parts)), per_word)[by_feature]
        self.feature_at = np.searchsorted(slot[by_feature], np.arange(len(self.used)))
        self.per_word, self.labels = per_word[:, None].astype("float32"), labels.astype("float32")
        self.sizes = self.sizes[:, None].astype("float32")

    def gradients(self, v: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the logistic loss by the vectors of the features used, the outputs and their bias."""
        vec = np.add.reduceat(v[self.slot], self.word_starts, axis=0) / self.per_word
        mean = np.add.reduceat(vec[self.word], self.starts, axis=0) / self.sizes
        e = 1 / (1 + np.exp(-(mean @ out.T + bias))) - self.labels
        d_mean = (e @ out) / self.sizes
        d_vec = np.add.reduceat(d_mean[self.sentence_of], self.word_at, axis=0) / self.per_word
        return np.add.reduceat(d_vec[self.word_of], self.feature_at, axis=0), e.T @ mean, e.sum(0)


def labelled(documents: DataFrame, labels: DataFrame, wikitext: DataFrame, bills: DataFrame, areas: list[str], bound: int = LABELLED) -> DataFrame:
    """(text, subject) to learn from: records that are known to be about exactly one area, ``bound`` at most of all.

    Hand-labelled documents with one distinct label, wikitext records by their supercategory and
    bills by their topic; labels are read trimmed and lower-cased, and those that are no area left out. All
    hand-labelled documents come before the others, which are taken by a hash of their ids.

    Which records those are is found without a text: a histogram of their hashes, of a fixed
    size, gives the hash up to which records are taken, and only texts below it are shuffled.
    """

    def read(subject: str):
        return F.lower(F.trim(subject)).alias("subject")

    space = (1 << 31) - 1
    mark = F.xxhash64("doc_id").bitwiseAND(space).alias("mark")
    marks = labels.select("doc_id", read("subject")).where(F.col("subject").isin(areas))
    single = marks.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.max("subject").alias("other")).where("subject = other").drop("other")
    sources = [(single, None), (wikitext, "supercategory"), (bills, "topic")]
    known = [(df if c is None else latest(df.where("doc_id is not null"), ["doc_id"], [c]).select("doc_id", read(c))).where(F.col("subject").isin(areas)).select(F.lit(c is not None).alias("later"), mark) for df, c in sources]
    known = stored(known[0].unionByName(known[1]).unionByName(known[2]))
    n = {r["later"]: r["n"] for r in known.groupBy("later").agg(F.count(F.lit(1)).alias("n")).collect()}
    least, left = {}, bound
    for later in (False, True):
        if n.get(later, 0) <= left:
            least[later], left = space, left - n.get(later, 0)
            continue
        reach = min(1.0, 2 * (left + 100) / n[later]) * space
        width = max(1, int(reach / (1 << 16)))
        counts = known.where((F.col("later") == later) & (F.col("mark") <= int(reach))).groupBy(F.floor(F.col("mark") / width).alias("i")).agg(F.count(F.lit(1)).alias("n"))
        edge = 0
        for r in sorted(counts.collect()):
            if r["n"] > left:
                break
            left, edge = left - r["n"], (r["i"] + 1) * width - 1
        least[later], left = edge if edge else -1, 0
    release(known)
    few = F.broadcast(single.where(mark <= least[False]))  # at most ``bound`` rows
    hand = documents.select("doc_id", "text").join(few, "doc_id").select("text", "subject")
    wiki = latest(wikitext.where("doc_id is not null").where(mark <= least[True]), ["doc_id"], ["text", "supercategory"]).select("text", read("supercategory"))
    bill = latest(bills.where("doc_id is not null").where(mark <= least[True]), ["doc_id"], ["summary", "topic"]).select(F.col("summary").alias("text"), read("topic"))
    return hand.unionByName(wiki).unionByName(bill).where(F.col("text").isNotNull() & F.col("subject").isin(areas))


def _batches(areas: list[str], steps: int):
    """A map over labelled texts: what their sentences add to each of the steps, as a pickled :class:`Batch`."""
    place = {a: i for i, a in enumerate(areas)}

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[list[str], int]]] = {}
        for b in tables:
            for text, subject in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, s in enumerate(sentences(text)):
                    found.setdefault(zlib.crc32(f"{i} {' '.join(s)}".encode()) % steps, []).append((s, place[subject]))
        for step, rows in sorted(found.items()):
            rows.sort()
            batch = Batch([s for s, _ in rows], np.eye(len(areas))[[k for _, k in rows]])
            yield pa.RecordBatch.from_arrays([pa.array([step], pa.int32()), pa.array([pickle.dumps(batch)], pa.binary())], names=["step", "batch"])

    return run


def _gradients(now):
    """A map over batches: the gradients of each by the parameters ``now`` broadcast, with the rows of the vector table they are for."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for blob in t.column(0).to_pylist():
                batch = pickle.loads(blob)
                vectors, out, bias = now.value
                g = batch.gradients(vectors[batch.used], out, bias)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (batch.used.astype("int32").tobytes(), *(a.astype("float32").tobytes() for a in g))], names=["used", "vectors", "out", "bias"])

    return run


def train(rows: DataFrame, areas: list[str], steps: int = STEPS, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Word and subword vectors averaged over a sentence, with one independent logistic output for each area.

    Every sentence of a record carries the record's subject; a sentence about nothing occurs under all
    subjects alike, so its words learn to speak for none. Sentences are spread over as many
    partitions as there are cores (:data:`MOST_LEARNERS` at most, which bounds what reaches the driver to so many
    times the model) and, by their hashes, over ``steps``. In every step all partitions give the gradients of their sentences by the same
    parameters; the driver adds them up, steps each parameter by its own gradients so far (Adagrad)
    and sends the parameters out again, ``epochs`` times through all steps. How the rows are
    partitioned doesn't change the model but for the rounding of sums.
    """
    spark = rows.sparkSession
    learners = max(1, min(MOST_LEARNERS, spark.sparkContext.defaultParallelism))
    data = stored(rows.select("text", "subject").repartition(learners, F.xxhash64("text")).mapInArrow(_batches(areas, steps), "step int, batch binary"), by="step")
    model = Model.fresh(areas)
    if data.isEmpty():
        return model
    v, out, bias = model.vectors, model.out, model.bias
    seen = [np.full(len(v), 1e-2, "float32"), np.full(out.shape, 1.0, "float32"), np.full(bias.shape, 10.0, "float32")]
    for turn in range(steps * epochs):
        now = spark.sparkContext.broadcast((v, out, bias))
        schema = "used binary, vectors binary, out binary, bias binary"
        parts = data.where(F.col("step") == turn % steps).select("batch").mapInArrow(_gradients(now), schema).toArrow().to_pylist()
        g, g_out, g_bias = np.zeros_like(v), np.zeros_like(out), np.zeros_like(bias)
        for p in sorted(parts, key=lambda p: p["used"]):
            g[np.frombuffer(p["used"], "int32")] += np.frombuffer(p["vectors"], "float32").reshape(-1, v.shape[1])
            g_out += np.frombuffer(p["out"], "float32").reshape(out.shape)
            g_bias += np.frombuffer(p["bias"], "float32")
        seen[0] += np.einsum("ij,ij->i", g, g)
        v = v - rate * g / np.sqrt(seen[0])[:, None]
        seen[1] += g_out * g_out
        out = out - rate * g_out / np.sqrt(seen[1])
        seen[2] += g_bias * g_bias
        bias = bias - rate * g_bias / np.sqrt(seen[2])
        now.destroy()  # its file on the driver too, as there is one for every step
    release(data)
    return Model(areas, v, out, bias)


def subject_counts(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, treated, n_sentences): how many sentences of each document treat each area, where any does.

    A sentence treats an area if its output is above 0. An area that at least two sentences treat
    beyond doubt (output above :data:`SURE`) also counts in sentences that leave it open by less than
    :data:`CONTEXT`. Whole texts are scored; a null or blank text has no rows.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((model.subjects, model.vectors, model.out, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            found = [sentences(t.as_py()) for t in b.column(1)]
            ids, subjects, treated, sizes = [], [], [], []
            with_any = [i for i, s in enumerate(found) if s]
            if with_any:
                x = m.scores([s for i in with_any for s in found[i]])
                starts = np.cumsum([0, *(len(found[i]) for i in with_any)])[:-1]
                size = np.array([len(found[i]) for i in with_any])
                sure = np.add.reduceat((x > SURE).astype("int64"), starts, axis=0)
                lift = CONTEXT * (sure >= 2) * np.minimum(1, 4 * sure / size[:, None])
                counts = np.add.reduceat((x + np.repeat(lift, size, axis=0) > 0).astype("int64"), starts, axis=0)
                r, k = np.nonzero(counts)
                ids, sizes = np.array(with_any)[r], size[r]
                subjects, treated = [m.subjects[i] for i in k], counts[r, k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(subjects, pa.string()), pa.array(treated, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "subject", "treated", "n_sentences"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {kind}, subject string, treated bigint, n_sentences bigint")


def areas_of(subject_areas: DataFrame) -> list[str]:
    """The closed list of subjects (a small table by definition), lower-cased, in order."""
    return sorted({r["s"] for r in subject_areas.select(F.lower(F.trim("subject")).alias("s")).where("s <> ''").distinct().collect()})


def document_subjects(documents: DataFrame, labels: DataFrame, wikitext: DataFrame, bills: DataFrame, subject_areas: DataFrame) -> DataFrame:
    """(doc_id, subject, treated, n_sentences) of the subjects that at least a third of a document's sentences treat."""
    areas = areas_of(subject_areas)
    model = train(labelled(documents, labels, wikitext, bills, areas), areas)
    return subject_counts(documents, model).where(F.col("treated") * 3 >= F.col("n_sentences"))


def composition(found: DataFrame, n_documents: int) -> DataFrame:
    """(subject, documents, share): how many documents of the corpus treat each subject."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).withColumn("share", F.round(F.col("documents") / F.lit(max(1, n_documents)), 6))
