"""Topic coherence by normalised pointwise mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.sources.tables import stored


def _window_counts(words: list[str], window: int):
    """A map over token lists: how many windows there are (a and b null), hold word a (b equal) and both a and b (a before b)."""
    listed, size = pa.array(words, pa.string()), np.int64(len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            n = np.diff(lists.offsets.to_numpy()).astype("int64")
            windows = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            word = pc.fill_null(pc.index_in(lists.flatten(), value_set=listed), -1).to_numpy(zero_copy_only=False).astype("int64")
            hit = np.flatnonzero(word >= 0)
            doc, pos, word = doc[hit], pos[hit], word[hit]
            first, last = np.maximum(pos - window + 1, 0), np.minimum(pos, np.maximum(n[doc] - window, 0))
            spans = last - first + 1
            start = np.repeat(first + (np.cumsum(windows) - windows)[doc], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
            held = np.unique(start * size + np.repeat(word, spans))  # each word of each window once, in order
            at, held = held // size, held % size
            pairs, step = [held * size + held], 1
            while step < len(at) and (same := at[step:] == at[:-step]).any():
                pairs.append(held[:-step][same] * size + held[step:][same])
                step += 1
            pair, count = np.unique(np.concatenate(pairs), return_counts=True)
            a, b, c = np.append(pair // max(size, 1), -1), np.append(pair % max(size, 1), -1), np.append(count, windows.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a.astype("int64")), pa.array(b.astype("int64")), pa.array(c.astype("int64"))], names=["a", "b", "c"])

    return run


def npmi(docs: DataFrame, tokens: str, words: DataFrame, window: int = 10, eps: float = 1e-12) -> DataFrame:
    """(topic_id, npmi, pairs): mean NPMI over all ordered pairs of a topic's ``words`` (topic_id, word).

    Probabilities are shares of sliding windows of ``window`` tokens (a shorter document is one
    window) that hold a word, or both. Words that no window holds are left out; pairs that never
    occur together count with ``eps``.

    A document's windows are counted where it lies: each batch gives one row for every word and every pair
    of words that its windows hold, and only these are shuffled. The topics' words are a
    bounded list (as many as topics times words), which every task holds.
    """
    listed = sorted({r["word"] for r in words.select("word").where("word is not null").distinct().collect()})
    every = docs.select(F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    counts = stored(every.mapInArrow(_window_counts(listed, window), "a bigint, b bigint, c bigint").groupBy("a", "b").agg(F.sum("c").alias("c")))
    total = float((counts.where("a < 0").head() or {"c": 0})["c"] or 1)
    numbered = words.join(words.sparkSession.createDataFrame(list(enumerate(listed)), "i bigint, word string"), "word")
    one = counts.where("a = b").select(F.col("a").alias("i"), "c")
    held = numbered.join(one, "i").select("topic_id", "i", "c")
    pairs = held.select("topic_id", F.col("i").alias("x"), F.col("c").alias("cx")).join(held.select("topic_id", F.col("i").alias("y"), F.col("c").alias("cy")), "topic_id").where("x <> y")
    both = pairs.join(counts.withColumnRenamed("c", "cxy"), (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")), "left")
    p = F.coalesce("cxy", F.lit(0)) / total + eps
    score = F.ln(p / ((F.col("cx") / total) * (F.col("cy") / total))) / -F.ln(p)
    return both.groupBy("topic_id").agg(F.avg(score).alias("npmi"), F.count(F.lit(1)).alias("pairs"))
