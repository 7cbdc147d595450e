"""Frequency of every distinct term (problem 1)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.words import term_of, terms_of
from facetry.sources.tables import latest

#: Records looked at to detect heavy terms, share of them that makes a term heavy, and most
#: heavy terms kept. They only steer which way a term is counted; every count is exact.
DETECT, HEAVY_SHARE, MOST_HEAVY = 4096, 0.01, 2048
#: Light terms a task holds before it sends their counts on.
HELD = 200_000
_COUNTS = "term string, occurrences bigint, records bigint"


def _local_counts(text_at: int, sent: Broadcast | None = None):
    """A map over batches: exact counters for the heavy terms ``sent``, the others as they come."""

    def batch(terms: list[str], n: list[int], d: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["term", "occurrences", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value if sent else []
        place = {t: i for i, t in enumerate(heavy)}
        often, in_records = np.zeros(len(heavy), "int64"), np.zeros(len(heavy), "int64")
        n, d = {}, {}
        for b in batches:
            for text in b.column(text_at):
                for t, k in Counter(terms_of(text.as_py())).items():
                    i = place.get(t)
                    if i is not None:
                        often[i] += k
                        in_records[i] += 1
                    elif t in n:
                        n[t] += k
                        d[t] += 1
                    else:
                        n[t] = k
                        d[t] = 1
                if len(n) >= HELD:
                    yield batch(list(n), list(n.values()), list(d.values()))
                    n, d = {}, {}
        used = np.flatnonzero(in_records)
        yield batch([*n, *(heavy[i] for i in used)], [*n.values(), *often[used].tolist()], [*d.values(), *in_records[used].tolist()])

    return run


def heavy_terms(rows: DataFrame, id_col: str, text_col: str, n_rows: int) -> list[str]:
    """At most :data:`MOST_HEAVY` terms that many of about :data:`DETECT` records have."""
    every = max(1, n_rows // DETECT)
    seen = rows.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(text_col).mapInArrow(_local_counts(0), _COUNTS)
    least = max(2, int(HEAVY_SHARE * min(n_rows, DETECT)))
    top = seen.groupBy("term").agg(F.sum("records").alias("d")).where(F.col("d") >= least).orderBy(F.col("d").desc(), "term").limit(MOST_HEAVY)
    return [r["term"] for r in top.collect()]


def read_words(vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """(term) of every vocabulary word, read as terms are; words with nothing left give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([term_of(w) for w in b.column(0).to_pylist()], pa.string())], names=["term"])

    return vocab.select(word_col).mapInArrow(run, "term string").where("term is not null")


def term_table(wikitext: DataFrame, vocab: DataFrame, rare_below: int = 3, common_percent: int = 40) -> DataFrame:
    """(term, occurrences, records, in_vocab, mark) of each term of the collection or the vocabulary.

    Counted are the latest records (:func:`facetry.sources.tables.latest`); mark is ``rare``
    with fewer than ``rare_below`` records, ``common`` with more than ``common_percent`` % of
    all records (distinct doc_id, those without terms included), else null. A term of the
    vocabulary that no record has comes with zeros. Null texts have no terms; rows with a
    null doc_id are ignored; empty tables give the terms of the other one. A corpus so small
    that a term is both marks it ``rare``.

    Method: a bounded look at the records detects heavy terms. They are sent to all tasks,
    each of which counts them in exact arrays and sends one row per heavy term at its end;
    only the remaining terms go through the shuffle as they come, pre-aggregated by a
    bounded table in the task. The two tables of counts are disjoint by term, and are united
    with the vocabulary's zero counts in the one merge by term.
    """
    rows = wikitext.where("doc_id is not null")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).head()
    heavy = wikitext.sparkSession.sparkContext.broadcast(heavy_terms(rows, "doc_id", "tokenized_text", seen["n"]))
    records = latest(rows, ["doc_id"], ["tokenized_text"])
    counts = records.select("tokenized_text").where("tokenized_text is not null").mapInArrow(_local_counts(0, heavy), _COUNTS)
    words = read_words(vocab).select("term", F.lit(0).cast("bigint").alias("occurrences"), F.lit(0).cast("bigint").alias("records"), F.lit(True).alias("v"))
    both = counts.withColumn("v", F.lit(False)).unionByName(words)
    table = both.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("v").alias("in_vocab"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > F.lit(seen["ids"] * common_percent), "common")
    return table.withColumn("mark", mark)
