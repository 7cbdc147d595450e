"""Readers and writers of the JSON artefacts: corpora, feature matrices, embeddings, samples, labels and verdicts.

Artefacts that are one JSON object (samples, labels, verdicts, embeddings, topic models) are written
entry by entry, one partition at a time, so the driver never holds more; for large results there are JSON lines and Parquet (:func:`save`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Registered kinds of corpora: the fields of a line, and the engine's names for some of them.
CORPORA = {
    "wikitext": ("id string, text string, subcategory string, category string, supercategory string, page_name string, tokenized_text string", {"category": "category"}),
    "bills": ("summary string, topic string, subtopic string, tokenized_text string", {"text": "summary", "category": "topic", "subcategory": "subtopic"}),
    "plain": ("text string", {}),
}
_MATRIX = "topic2word_dist array<array<double>>, doc2topic_dist array<array<double>>, topic2doc_dist array<array<double>>, vocab array<string>"
_SAMPLES = "map<string, struct<pos: map<string, double>, neg: array<bigint>>>"
_LABELS = "map<string, struct<pos_docs: array<bigint>, neg_docs: array<bigint>, topic: string>>"
_VERDICTS = "map<string, struct<match: struct<pos: map<string, int>, neg: map<string, int>>>>"


class Registry:
    """Data sets by name: their kind and path."""

    def __init__(self, paths: dict[str, tuple[str, str]] | None = None):
        self.paths = dict(paths or {})

    def add(self, name: str, kind: str, path: str) -> None:
        if kind not in CORPORA:
            raise ValueError(f"unknown kind {kind!r}; there are {sorted(CORPORA)}")
        self.paths[name] = (kind, path)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.paths:
            raise ValueError(f"unknown data set {name!r}; there are {sorted(self.paths)}")
        kind, path = self.paths[name]
        return read_corpus(spark, path, kind)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(doc_id, r): JSON lines with the number of the line over all files in the order of their names.

    The number comes from the counts of lines in the partitions before, not from a sort of the lines; only
    the counts, one row for each file and partition, are summed up in one task.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "f", F.shiftright("m", 33).alias("p"), F.col("m").bitwiseAND((1 << 33) - 1).alias("i"))
    per = rows.groupBy("f", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low"))
    per = per.withColumn("first", F.sum("n").over(Window.orderBy("f", "p", "low")) - F.col("n"))
    return rows.join(per.select("f", "p", "low", "first"), ["f", "p"]).select((F.col("first") + F.col("i") - F.col("low")).alias("doc_id"), "r")


def read_corpus(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a registered ``kind`` with doc_id, the number of the line (:func:`_lines`)."""
    schema, names = CORPORA[kind]
    out = _lines(spark, path, schema).select("doc_id", "r.*")
    for new, old in names.items():
        out = out.withColumnRenamed(old, new)
    return out.withColumn("tokens", F.split("tokenized_text", " ")) if "tokenized_text" in out.columns else out


def read_theta(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, theta) of JSON lines with theta; doc_id is the number of the line."""
    return _lines(spark, path, "theta array<double>").select("doc_id", "r.theta")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, v) of an embedding file, one JSON object of vectors by id."""
    cells = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("k", "v"))
    return cells.select(F.col("k").cast("bigint").alias("doc_id"), "v")


def from_pandas(spark: SparkSession, rows: pd.DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of documents held in memory."""
    return spark.createDataFrame(rows[[id_col, text_col]]).toDF("doc_id", "text")


def by_id(rows: DataFrame, doc_id: int) -> dict | None:
    """One row as a dict, none without such an id."""
    found = rows.where(F.col("doc_id") == doc_id).limit(1).collect()
    return found[0].asDict() if found else None


def in_order(rows: DataFrame) -> Iterator[dict]:
    """The rows by id, one partition at a time."""
    for r in rows.orderBy("doc_id").toLocalIterator():
        yield r.asDict()


def read_topic_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The long tables of a topic-model file (one JSON object): topic_word, doc_topic, topic_doc and vocab."""
    doc = spark.read.schema(_MATRIX).option("multiLine", True).json(path)

    def long(col: str, a: str, b: str) -> DataFrame:
        return doc.select(F.posexplode(col).alias(a, "row")).select(a, F.posexplode("row").alias(b, "p"))

    return {
        "topic_word": long("topic2word_dist", "topic_id", "word_id"), "doc_topic": long("doc2topic_dist", "doc_id", "topic_id"),
        "topic_doc": long("topic2doc_dist", "topic_id", "doc_id"), "vocab": doc.select(F.posexplode("vocab").alias("word_id", "word")),
    }


def _entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.map_entries(F.from_json("value", kind))).alias("e")).select(F.col("e.key").cast("int").alias("feature_id"), "e.value.*")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, polarity, ord, doc_id, weight) of a sample file; ord is the order of the entries."""
    rows = _entries(spark, path, _SAMPLES)
    pos = rows.select("feature_id", F.lit("pos").alias("polarity"), F.posexplode(F.map_entries("pos")).alias("ord", "e")).select("feature_id", "polarity", "ord", F.col("e.key").cast("bigint").alias("doc_id"), F.col("e.value").alias("weight"))
    neg = rows.select("feature_id", F.lit("neg").alias("polarity"), F.posexplode("neg").alias("ord", "doc_id"), F.lit(None).cast("double").alias("weight"))
    return pos.unionByName(neg)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, pos_docs, neg_docs, name, description, raw, status) of a label file.

    ``title`` is read where there is no ``name``; a topic that is a plain string is kept as raw (``unparsed``), a null one is ``failed``.
    """
    rows = _entries(spark, path, _LABELS).withColumn("t", F.from_json("topic", "name string, title string, description string"))
    name = F.coalesce("t.name", "t.title")
    status = F.when(F.col("topic").isNull(), "failed").when(name.isNull(), "unparsed").otherwise("ok")
    return rows.select("feature_id", "pos_docs", "neg_docs", name.alias("name"), "t.description", F.when(status == "unparsed", F.col("topic")).alias("raw"), status.alias("status"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, polarity, ord, doc_id, verdict) of an evaluation file."""
    rows = _entries(spark, path, _VERDICTS)
    parts = [rows.select("feature_id", F.lit(p).alias("polarity"), F.posexplode(F.map_entries(f"match.{p}")).alias("ord", "e")) for p in ("pos", "neg")]
    return parts[0].unionByName(parts[1]).select("feature_id", "polarity", "ord", F.col("e.key").cast("bigint").alias("doc_id"), F.col("e.value").alias("verdict"))


def batches_to_gap(spark: SparkSession, pattern: str, most: int = 16) -> list[str]:
    """The paths ``pattern.format(0)``, ``pattern.format(1)`` and so on up to the first that doesn't exist, ``most`` at most."""
    out = []
    for i in range(most):
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern.format(i))
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            break
        out.append(pattern.format(i))
    return out


def read_explanations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(feature_id, description, batch, line) of gzipped JSON lines in files whose names hold the batch number."""
    rows = spark.read.schema("index string, description string").json(path)
    name = F.input_file_name()
    return rows.select(F.col("index").try_cast("bigint").alias("feature_id"), "description", F.regexp_extract(name, r"(\d+)[^/\d]*$", 1).try_cast("int").alias("batch"), F.monotonically_increasing_id().alias("line")).where("feature_id is not null")


def samples_json(samples: DataFrame) -> DataFrame:
    """(feature_id, json): each feature's positives as an ordered object of weights and its negatives as a list."""
    cell = F.struct("ord", F.col("doc_id").cast("string").alias("id"), "weight")
    lists = samples.groupBy("feature_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("polarity") == p, cell))).alias(p) for p in ("pos", "neg")])
    pos = F.map_from_entries(F.transform("pos", lambda x: F.struct(x["id"], x["weight"])))
    return lists.select("feature_id", F.to_json(F.struct(pos.alias("pos"), F.transform("neg", lambda x: x["id"].cast("bigint")).alias("neg"))).alias("json"))


class _File:
    """A text file on any file system that the session knows, written in pieces of about a megabyte."""

    def __init__(self, spark: SparkSession, path: str):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out, self.held = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True), bytearray()

    def __enter__(self) -> _File:
        return self

    def write(self, text: str) -> None:
        self.held += text.encode()
        if len(self.held) > 1 << 20:
            self._send()

    def _send(self) -> None:
        self.out.write(self.held)
        self.held = bytearray()

    def __exit__(self, *raised) -> None:
        self._send()
        self.out.close()


def write_object(entries: DataFrame, path: str) -> None:
    """Writes (key, json) as one JSON object, in the order of the rows, one partition at a time."""
    with _File(entries.sparkSession, path) as f:
        f.write("{")
        for i, r in enumerate(entries.toLocalIterator()):
            f.write(f"{', ' if i else ''}{json.dumps(str(r[0]))}: {r[1]}")
        f.write("}")


def write_samples(samples: DataFrame, path: str, features: DataFrame | None = None) -> None:
    """A sample file; with ``features`` also those without a sample, as empty ones."""
    rows = samples_json(samples)
    if features is not None:
        empty = F.lit('{"pos":{},"neg":[]}')
        rows = features.select("feature_id").join(rows, "feature_id", "left").select("feature_id", F.coalesce("json", empty).alias("json"))
    write_object(rows.orderBy("feature_id"), path)


def write_labels(labels: DataFrame, path: str, field: str = "name") -> None:
    """A label file from the columns that :func:`facetry.operators.annotate.annotate` gives; an unread reply is written as it is."""
    quoted = F.regexp_replace(F.to_json(F.array("raw")), r"^\[|\]$", "")
    topic = F.when(F.col("status") == "ok", F.to_json(F.struct(F.col("name").alias(field), "description"))).when(F.col("status") == "unparsed", quoted).otherwise("null")
    text = F.concat(F.lit('{"pos_docs": '), F.to_json("pos_docs"), F.lit(', "neg_docs": '), F.to_json("neg_docs"), F.lit(', "topic": '), topic, F.lit("}"))
    write_object(labels.select("feature_id", text.alias("json")).orderBy("feature_id"), path)


def write_evaluation(found: DataFrame, path: str) -> None:
    """An evaluation file from the columns that :func:`facetry.operators.annotate.evaluation` gives."""
    verdicts = lambda p: F.map_from_entries(F.transform(f"match.{p}", lambda x: F.struct(x["doc_id"].cast("string"), x["verdict"]))).alias(p)
    row = F.to_json(F.struct("recall", "precision", "f1", F.struct(verdicts("pos"), verdicts("neg")).alias("match")))
    write_object(found.select("feature_id", row.alias("json")).orderBy("feature_id"), path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """An embedding file from (doc_id, v)."""
    write_object(rows.select("doc_id", F.to_json("v").alias("json")).orderBy("doc_id"), path)


def write_topic_model(model: dict[str, DataFrame], path: str) -> None:
    """A topic-model file from the long tables that :func:`facetry.operators.topics.fit_topics` gives.

    Each matrix is written row by row. A row of topic2doc_dist holds all documents: that is the format's limit.
    """

    def rows(df: DataFrame, by: str, at: str) -> Iterator[str]:
        wide = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, "p"))).alias("c")).select(by, F.to_json(F.transform("c", lambda x: x["p"])).alias("json"))
        for r in wide.orderBy(by).toLocalIterator():
            yield r["json"]

    parts = {"topic2word_dist": ("topic_word", "topic_id", "word_id"), "doc2topic_dist": ("doc_topic", "doc_id", "topic_id"), "topic2doc_dist": ("topic_doc", "topic_id", "doc_id")}
    with _File(model["vocab"].sparkSession, path) as f:
        f.write("{")
        for name, (table, by, at) in parts.items():
            f.write(f'"{name}": [')
            for i, row in enumerate(rows(model[table], by, at)):
                f.write((", " if i else "") + row)
            f.write("], ")
        words = (r["word"] for r in model["vocab"].orderBy("word_id").toLocalIterator())
        f.write('"vocab": [' + ", ".join(map(json.dumps, words)) + "]}")


def save(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes ``df`` as ``json`` lines or to ``disk`` (Parquet), over what is there; any other kind raises ValueError."""
    if kind not in ("json", "disk"):
        raise ValueError(f"unknown format {kind!r}; there are json and disk")
    getattr(df.write.mode("overwrite"), "json" if kind == "json" else "parquet")(path)
