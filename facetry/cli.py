"""Command line: ``python -m facetry COMMAND ...`` over JSON artefacts, one command for each stage.

A data set is given as ``KIND:PATH`` (kinds: wikitext, bills, plain), features as a topic-model file or a file
of theta lines (``--feature_type topic`` or ``sae``), a model as ``MODULE:FUNCTION``.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions import text as tx
from facetry.operators import annotate, coherence, extract, features, metrics, sampling, selection, topics
from facetry.sources import json_io
from facetry.sources.tables import stored


def plug_in(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def dataset(spark: SparkSession, name: str) -> DataFrame:
    kind, _, path = name.partition(":")
    registry = json_io.Registry()
    registry.add(kind, kind, path)
    return registry.read(spark, kind)


def feature_tables(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, members, features) of the features file, features without members included."""
    if a.feature_type == "topic":
        cells = json_io.read_topic_model(spark, a.saved_features)["topic_doc"]
        weights = stored(cells.select(F.col("topic_id").alias("feature_id"), "doc_id", F.col("p").alias("weight")))
        members = features.strongest_feature(weights).join(weights, ["doc_id", "feature_id"])
    else:
        weights = stored(features.long_weights(json_io.read_theta(spark, a.saved_features), "doc_id", "theta", at=None))
        members = features.members(weights)
    n = weights.agg(F.max("feature_id")).head()[0]
    every = spark.range(0 if n is None else n + 1).select(F.col("id").cast("int").alias("feature_id"))
    return weights, stored(members.select("feature_id", "doc_id", "weight")), every


def topic_model(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.task == "train":
        docs = dataset(spark, a.dataset).select("doc_id", F.col("tokens").alias("t"))
        json_io.write_topic_model(topics.fit_topics(docs, "t", a.num_topics, a.max_iterations), a.output_file)
        return
    model = json_io.read_topic_model(spark, a.output_file)
    p = model["topic_word"].groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "p"))), lambda x: x["p"]).alias("p"))
    docs = dataset(spark, a.dataset).select(tx.words_lower(F.col("text")).alias("t"))
    each = coherence.npmi(docs, "t", features.top_words(p, model["vocab"]).select("topic_id", "word"))
    print(each.agg(F.avg("npmi")).head()[0])


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    weights, members, every = feature_tables(spark, a)
    docs = weights.select("doc_id").distinct()
    found = sampling.sample(a.sample_method, weights, members, docs, every, a.pos_k, a.neg_k, a.num_strata, a.seed)
    json_io.write_samples(found, a.output_file, every)


def dpp(spark: SparkSession, a: argparse.Namespace) -> None:
    _, members, every = feature_tables(spark, a)
    found = selection.dpp_samples(members, json_io.read_embeddings(spark, a.saved_embeddings), a.k, a.alpha)
    json_io.write_samples(found, a.output_file, every)


def sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    """Diverse samples for every k and alpha, each to a file named by both."""
    _, members, every = feature_tables(spark, a)
    vectors = stored(json_io.read_embeddings(spark, a.saved_embeddings))
    for k in map(int, a.ks):
        for alpha in map(float, a.alphas):
            json_io.write_samples(selection.dpp_samples(members, vectors, k, alpha), f"{a.output_dir}/pos{k}_neg0_dpp_alpha_{alpha:g}.json", every)


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = extract.encoded(dataset(spark, a.dataset).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), plug_in(a.model), normalise=True)
    json_io.write_embeddings(rows.select("doc_id", "v"), a.output_file)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    weights, _, every = feature_tables(spark, a)
    rows = weights.join(json_io.read_embeddings(spark, a.saved_embeddings), "doc_id")
    picks = selection.covering_picks(rows, a.k, a.alpha, a.beta).join(weights, ["feature_id", "doc_id"])
    json_io.write_samples(picks.select("feature_id", F.lit("pos").alias("polarity"), "ord", "doc_id", "weight"), a.output_file, every)


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    _, members, _ = feature_tables(spark, a)
    template = "explanation" if a.feature_type == "sae" else "simple"
    found = stored(annotate.annotate(json_io.read_samples(spark, a.samples), dataset(spark, a.dataset), members, plug_in(a.model), template, a.min_feature_size, a.max_text_length))
    json_io.write_labels(found, a.output_file, "title" if template == "explanation" else "name")
    usage = metrics.cost(found.withColumn("ok", F.col("status") != "failed"), annotate.PRICE_IN, annotate.PRICE_OUT, only_ok=True)
    print(usage.head().asDict())


def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    _, members, _ = feature_tables(spark, a)
    template = "judge_feature" if a.feature_type == "sae" else "judge_single"
    rows = annotate.judge(json_io.read_samples(spark, a.eval_samples), dataset(spark, a.dataset), json_io.read_labels(spark, a.topic_annotations), members, plug_in(a.model), template, a.min_feature_size, a.doc_max_length)
    json_io.write_evaluation(annotate.evaluation(stored(rows)), a.output_file)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    weights, _, _ = feature_tables(spark, a)
    heaviest, scores = features.highest_weight(weights), None
    for path in a.evaluations:
        one = metrics.confusion(json_io.read_verdicts(spark, path), heaviest).withColumn("method", F.lit(path))
        scores = one if scores is None else scores.unionByName(one)
    metrics.method_table(scores, ["method"]).orderBy("method").show(truncate=False)
    metrics.recall_by_decile(json_io.read_verdicts(spark, a.evaluations[0])).orderBy("decile").show()


COMMANDS = {"topic-model": topic_model, "sample": sample, "dpp": dpp, "sweep": sweep, "embed": embed, "score": score, "label": label, "judge": judge, "report": report}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="facetry", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, with_features: bool = True, **options) -> None:
        p = sub.add_parser(name)
        if with_features:
            p.add_argument("--saved_features", required=True)
            p.add_argument("--feature_type", choices=["topic", "sae"], default="topic")
        for key, value in options.items():
            if isinstance(value, type):
                p.add_argument(f"--{key}", type=value, required=True)
            elif isinstance(value, list):
                p.add_argument(f"--{key}", nargs="+", required=True)
            else:
                p.add_argument(f"--{key}", type=type(value), default=value)

    command("topic-model", False, task="train", dataset=str, num_topics=25, max_iterations=1000, output_file=str)
    command("sample", sample_method=str, pos_k=10, neg_k=0, num_strata=10, seed=42, output_file=str)
    command("dpp", saved_embeddings=str, alpha=0.1, k=10, output_file=str)
    command("sweep", saved_embeddings=str, ks=[], alphas=[], output_dir=str)
    command("embed", False, dataset=str, model=str, output_file=str)
    command("score", saved_embeddings=str, alpha=0.5, beta=1.0, k=10, output_file=str)
    command("label", dataset=str, samples=str, model=str, max_text_length=256, min_feature_size=500, output_file=str)
    command("judge", dataset=str, eval_samples=str, topic_annotations=str, model=str, doc_max_length=300, min_feature_size=1000, output_file=str)
    command("report", evaluations=[])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("facetry").getOrCreate(), a)
