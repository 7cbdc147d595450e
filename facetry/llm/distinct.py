"""How distinctive a term is of its record or topic (problem 6)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.words import term_of, terms_of
from facetry.sources.tables import latest, stored

#: Share of a record's own model in the mixture, most steps, and the change that ends them.
OWN, STEPS, SETTLED = 0.2, 50, 1e-6
#: Probabilities of an owner count as equal within this share: far more than rounding, so none that may be the highest is missed.
EQUAL = 1e-9
#: Terms whose background goes to every task at most, and share of the records that makes one heavy.
MOST_HEAVY, HEAVY_SHARE = 2048, 0.01
_CELLS = "doc_id bigint, term string, n bigint"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, terms, counts = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = Counter(terms_of(text.as_py()))
            ids += [i] * len(found)
            terms += found.keys()
            counts += found.values()
            if len(ids) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "term", "n"])
                ids, terms, counts = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "term", "n"])


def term_cells(wikitext: DataFrame) -> DataFrame:
    """(doc_id, term, n): how often each record has each of its terms, over the latest records."""
    return latest(wikitext.where("doc_id is not null"), ["doc_id"], ["tokenized_text"]).where("tokenized_text is not null").mapInArrow(_cells, _CELLS)


def parsimonious(n: np.ndarray, background: np.ndarray, starts: np.ndarray, own: float = OWN) -> np.ndarray:
    """Converged term probabilities of each owner's parsimonious language model.

    ``starts`` marks where each owner's terms begin. Expectation: the share of each occurrence
    that the owner's own model explains against the background; maximisation: these shares
    normalised. All owners of a batch take their steps together, each until its own probabilities
    settle, so the result doesn't depend on how owners are batched.

    Of two terms that an owner has equally often the one with the smaller background ends with the higher
    probability: it begins with the same, and each step gives more to a smaller background and to a
    higher probability.
    """
    sizes = np.diff(np.append(starts, len(n)))
    total = np.repeat(np.add.reduceat(n, starts), sizes) if len(starts) else n
    p = n / np.where(total > 0, total, 1)
    rows, at, size = np.arange(len(n)), starts, sizes  # of the owners that haven't settled
    for _ in range(STEPS):
        if not len(size):
            break
        mine = own * p[rows]
        e = n[rows] * mine / np.maximum((1 - own) * background[rows] + mine, 1e-300)
        total = np.repeat(np.add.reduceat(e, at), size)
        new = e / np.where(total > 0, total, 1)
        moving = np.maximum.reduceat(np.abs(new - p[rows]), at) >= SETTLED
        p[rows] = new
        rows, size = rows[np.repeat(moving, size)], size[moving]
        at = np.cumsum(size) - size
    return p


def _likeliest(n: np.ndarray, p: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The rows of highest probability among those of an owner with the same ``n``."""
    order = np.lexsort((n, owner))
    new = np.flatnonzero(np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (n[order][1:] != n[order][:-1])]))
    most = np.repeat(np.maximum.reduceat(p[order], new), np.diff(np.append(new, len(order))))
    return np.sort(order[p[order] >= most * (1 - EQUAL)])


def _scored(best: bool, n_records: int):
    """A map over owners with their terms: probability and exact score of each, or the best row of each owner.

    The best row is sought among the terms that the model finds likeliest of those with the same n.
    """
    names = ["owner", "owner_id", "term", "n", "records", "probability", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            cells = lists.flatten()
            keep = np.flatnonzero(sizes > 0)
            if not len(keep):
                continue
            starts = np.concatenate([[0], np.cumsum(sizes[keep])[:-1]])
            of = np.repeat(keep, sizes[keep])
            n, back, d, mean = (cells.field(f).to_numpy(zero_copy_only=False).astype("float64") for f in ("n", "background", "records", "mean"))
            p = parsimonious(n, back, starts)
            rows = _likeliest(n, p, of) if best else np.arange(len(of))
            with np.errstate(divide="ignore", invalid="ignore"):
                doc = n[rows] * np.log(n_records / d[rows])
                topic = np.where(n[rows] > 0, n[rows] * np.log(n[rows] / mean[rows]), 0.0)
            score = np.round(np.where(np.isnan(mean[rows]), doc, topic), 9) + 0.0
            terms = cells.field("term")
            if best:
                begins = np.flatnonzero(np.concatenate([[True], of[rows][1:] != of[rows][:-1]]))
                top = np.repeat(np.maximum.reduceat(score, begins), np.diff(np.append(begins, len(rows))))
                tied = np.flatnonzero(score == top)
                first: dict[int, tuple[str, int]] = {}
                for i, t in zip(tied.tolist(), terms.take(pa.array(rows[tied])).to_pylist()):
                    k = int(of[rows[i]])
                    if k not in first or t < first[k][0]:
                        first[k] = (t, i)
                kept = np.array([i for _, i in first.values()], "int64")
                rows, score = rows[kept], score[kept]
            at = pa.array(rows)
            none = np.isnan(d[rows])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[rows])), b.column(1).take(pa.array(of[rows])), terms.take(at), pa.array(n[rows]), pa.array(np.where(none, 0, d[rows]).astype("int64"), mask=none), pa.array(p[rows]), pa.array(score)], names=names)

    return run


_OUT = "owner string, owner_id bigint, term string, n double, records bigint, probability double, score double"
_CELL = ["term", "n", "background", "records", "mean"]


def record_terms(wikitext: DataFrame, best: bool = False) -> DataFrame:
    """The terms of each latest wikitext record: owner ``doc``, owner_id, term, n, records, probability, score.

    n is how often the record has the term, records how many records have it. probability is
    that of the term in the record's parsimonious language model, near 0 where the collection
    explains the term as well. score is n · ln(N / records), N the records with terms, to 9
    decimals. ``best`` gives only the row of highest score of each record, of equal ones the
    first term by code point. A record without terms gives no row, an empty table an empty result.

    Method: counts of records are pre-aggregated and merged by term; a term's share of them is its background.
    Those of heavy terms (at most :data:`MOST_HEAVY`) are broadcast, those of all others joined by term, so no
    hot term meets a single task. Expectation-maximisation then runs record by record, over the
    arrays of a whole batch at once. ``best`` takes the terms of highest converged probability for every n: as the
    background rises with the number of records, these are the ones of highest score with that n
    (:func:`parsimonious`), so only they are scored and the best of them is the best of all.
    """
    cells = stored(term_cells(wikitext))
    total = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("doc_id").alias("docs")).head()
    n_records, mass = total["docs"], float(total["cells"] or 1)
    counts = stored(cells.groupBy("term").agg(F.count(F.lit(1)).alias("records")))
    counts = counts.select("term", (F.col("records") / mass).alias("background"), "records")
    heavy = F.broadcast(counts.where(F.col("records") > HEAVY_SHARE * n_records).orderBy(F.col("records").desc(), "term").limit(MOST_HEAVY))
    light = counts.join(heavy.select("term"), "term", "left_anti")
    known = cells.join(heavy, "term").unionByName(cells.join(heavy.select("term"), "term", "left_anti").join(light, "term"))
    known = known.select("doc_id", F.struct("term", F.col("n").cast("double").alias("n"), "background", F.col("records").cast("double").alias("records"), F.lit(float("nan")).alias("mean")).alias("c"))
    lists = known.groupBy("doc_id").agg(F.collect_list("c").alias("cells")).select(F.lit("doc").alias("owner"), F.col("doc_id").alias("owner_id"), "cells")
    return lists.mapInArrow(_scored(best, n_records), _OUT)


def topic_terms(topic2word: DataFrame, vocab: DataFrame, best: bool = False) -> DataFrame:
    """The words of each topic in the same form: owner ``topic``, n the probability p of the word, records null.

    Words are read as terms; score is p · ln(p / mean of p over all topics) to 9 decimals, 0 where
    p is 0. Null elements count as 0, positions without a word in the vocabulary are left out.
    The background of the parsimonious model is the mean over the topics. Words of a topic seldom have the
    same p, so for ``best`` nearly all of them are scored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([term_of(w) for w in b.column(1).to_pylist()], pa.string())], names=["word_id", "term"])

    words = vocab.select("word_id", "word").mapInArrow(read, "word_id int, term string").where("term is not null")
    p = F.coalesce(F.when(~F.isnan("p"), F.col("p")), F.lit(0.0))
    cells = topic2word.select("topic_id", F.posexplode("p").alias("word_id", "p")).select("topic_id", "word_id", p.alias("n"))
    topics = topic2word.count() or 1
    means = cells.groupBy("word_id").agg((F.sum("n") / topics).alias("mean"))
    known = cells.join(means, "word_id").join(words, "word_id")
    known = known.select("topic_id", F.struct("term", "n", F.col("mean").alias("background"), F.lit(None).cast("double").alias("records"), "mean").alias("c"))
    lists = known.groupBy("topic_id").agg(F.collect_list("c").alias("cells")).select(F.lit("topic").alias("owner"), F.col("topic_id").cast("bigint").alias("owner_id"), "cells")
    return lists.mapInArrow(_scored(best, 1), _OUT)


def distinctive(wikitext: DataFrame, topic2word: DataFrame, vocab: DataFrame, best: bool = False) -> DataFrame:
    """:func:`record_terms` and :func:`topic_terms` united."""
    return record_terms(wikitext, best).unionByName(topic_terms(topic2word, vocab, best))
