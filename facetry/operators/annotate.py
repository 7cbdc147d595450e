"""Inputs and outputs of labelling and judging by a language model, which is a plug-in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import truncate
from facetry.operators.features import evaluated_features, large_features
from facetry.operators.metrics import label_scores

#: Price of a token read and of a token written, in dollars.
PRICE_IN, PRICE_OUT = 0.15 / 1e6, 0.60 / 1e6
#: What a labelling model must answer with (name and description, or title and description of an autoencoder's
#: feature) and a judge (a single digit); judge_multi asks about several numbered documents at once.
TEMPLATES = {
    "full": "You name topics. Read the documents that belong to one topic, then those that don't.\nThink about what only the first share. Answer with JSON holding name (a few words) and description (one sentence).\nDocuments of the topic:\n{documents}\nOther documents:\n{others}",
    "simple": "These documents share one topic. Answer with JSON holding name and description.\n{documents}\nDocuments outside the topic:\n{others}",
    "explanation": "A feature of a network is active on these documents. Answer with JSON holding title and description of what it responds to.\n{documents}\nDocuments on which it is silent:\n{others}",
    "judge_old": "Label: {name}\nExplanation: {description}\nText: {text}\nAnswer 1 if the label fits the text, else 0, and nothing more.",
    "judge_multi": "Topic: {name}\n{description}\nDocuments:\n{text}\nAnswer with JSON: a list of 1 or 0 for each document in order.",
    "judge_single": "Topic: {name}\n{description}\nDocument: {text}\nDoes the document belong to the topic? Answer 1 or 0.",
    "judge_feature": "A feature is described as: {name}\n{description}\nText: {text}\nWould the feature be active on the text? Answer 1 or 0.",
}


def filled(template: str, **values: Column) -> Column:
    """The template as a column, with each ``{key}`` replaced once by its value; null where a value is null."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        out += [F.lit(before), values[key].cast("string")]
    return F.concat(*out, F.lit(rest))


def prompts(samples: DataFrame, docs: DataFrame, max_words: int = 256, least_members: DataFrame | None = None) -> DataFrame:
    """(feature_id, documents, others): the sampled texts of each feature, numbered in their order, truncated to ``max_words``.

    ``others`` is ``No documents`` without negatives. With ``least_members`` only its features come out;
    that gate and the join with the small sample come before any text is touched.
    """
    rows = samples if least_members is None else samples.join(least_members.select("feature_id"), "feature_id", "left_semi")
    rows = rows.join(docs.select("doc_id", "text"), "doc_id").select("feature_id", "polarity", "ord", truncate(F.col("text"), max_words).alias("text"))

    def listed(polarity: str) -> Column:
        cells = F.array_sort(F.collect_list(F.when(F.col("polarity") == polarity, F.struct("ord", "text"))))
        return F.array_join(F.transform(cells, lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), x["text"])), "\n")

    lists = rows.groupBy("feature_id").agg(listed("pos").alias("documents"), listed("neg").alias("others"))
    return lists.withColumn("others", F.coalesce(F.nullif(F.col("others"), F.lit("")), F.lit("No documents")))


def verdict(reply: Column) -> Column:
    """The integer of a reply with white space around it allowed, -1 for anything else and for null."""
    return F.coalesce(F.regexp_replace(reply, r"^\s+|\s+$", "").try_cast("int"), F.lit(-1))


def label(reply: Column, field: str = "name") -> Column:
    """(name, description, raw, status) of a labelling reply; status ``ok``, ``unparsed`` (raw holds it) or ``failed`` (null reply)."""
    read = F.from_json(reply, f"{field} string, description string")
    name = read[field]
    status = F.when(reply.isNull(), "failed").when(name.isNull(), "unparsed").otherwise("ok")
    return F.struct(name.alias("name"), read["description"].alias("description"), F.when(status == "unparsed", reply).alias("raw"), status.alias("status"))


def _reads(field: str) -> Callable[[str], bool]:
    """Whether a reply is JSON with a text in ``field``, as :func:`label` reads it."""

    def reads(reply: str) -> bool:
        try:
            found = json.loads(reply)
        except ValueError:
            return False
        return isinstance(found, dict) and found.get(field) is not None

    return reads


def ask(rows: DataFrame, prompt_col: str, model: Callable[[str], str], tries: int = 1, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """``rows`` with reply, tokens_in, tokens_out (words), calls, ok and error.

    A call is repeated, up to ``tries`` in all, where it raises or where its reply isn't what
    ``accept`` wants. The last reply stands even then (ok is false); reply is null where every
    call raised, and error has the last exception. The model is called in the tasks; store the result before using it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, calls, fine, errors = [], [], [], []
            for p in b.column(b.schema.get_field_index(prompt_col)).to_pylist():
                reply, good, error, n = None, False, None, 0
                while n < tries and not good:
                    n += 1
                    try:
                        reply = model(p)
                        good = accept is None or accept(reply)
                    except Exception as e:  # noqa: BLE001 - a model may fail in any way; kept in error
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                calls.append(n)
                fine.append(good)
                errors.append(error)
            new = [pa.array(replies, pa.string()), pa.array(calls, pa.int32()), pa.array(fine, pa.bool_()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "reply", "calls", "ok", "error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", reply string, calls int, ok boolean, error string"
    asked = rows.mapInArrow(run, schema)
    words = lambda c: F.coalesce(F.size(F.split(F.col(c), " ")), F.lit(0)).cast("bigint")
    return asked.withColumns({"tokens_in": words(prompt_col), "tokens_out": F.when(F.col("reply").isNull(), F.lit(0).cast("bigint")).otherwise(words("reply"))})


def annotate(samples: DataFrame, docs: DataFrame, members: DataFrame, model: Callable[[str], str], template: str = "simple", least: int = 500, max_words: int = 256, tries: int = 3) -> DataFrame:
    """(feature_id, pos_docs, neg_docs, name, description, raw, status, tokens_in, tokens_out): a label of every sampled feature of at least ``least`` members.

    The model is asked again, up to ``tries`` times, while its reply can't be read; then raw holds its last
    reply (status ``unparsed``), or nothing where every call raised (``failed``). The gate comes before any text is touched.
    """
    field = "title" if template == "explanation" else "name"
    asked = prompts(samples, docs, max_words, large_features(members, least))
    asked = asked.withColumn("prompt", filled(TEMPLATES[template], documents=F.col("documents"), others=F.col("others")))
    replies = ask(asked.select("feature_id", "prompt"), "prompt", model, tries, _reads(field))
    ids = samples.groupBy("feature_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("ord", "doc_id")))), lambda x: x["doc_id"]).alias(f"{p}_docs") for p in ("pos", "neg")
    ])
    read = replies.withColumn("l", label(F.col("reply"), field)).select("feature_id", "l.*", "tokens_in", "tokens_out")
    return read.join(ids, "feature_id").select("feature_id", "pos_docs", "neg_docs", "name", "description", "raw", "status", "tokens_in", "tokens_out")


def judge(samples: DataFrame, docs: DataFrame, labels: DataFrame, members: DataFrame, model: Callable[[str], str], template: str = "judge_single", above: int = 1000, max_words: int = 300) -> DataFrame:
    """(feature_id, polarity, ord, doc_id, verdict): one call for every sampled document of the features that have a readable label and more than ``above`` members.

    Both gates are semi-joins before any text is touched. A reply that is no integer, and a call that raises, is -1.
    """
    known = labels.where("name is not null").select("feature_id", "name", F.coalesce("description", F.lit("")).alias("description"))
    rows = samples.select("feature_id", "polarity", "ord", "doc_id").join(evaluated_features(members, known, above).select("feature_id"), "feature_id", "left_semi")
    rows = rows.join(known, "feature_id").join(docs.select("doc_id", "text"), "doc_id")
    prompt = filled(TEMPLATES[template], name=F.col("name"), description=F.col("description"), text=truncate(F.col("text"), max_words))
    return ask(rows.select("feature_id", "polarity", "ord", "doc_id", prompt.alias("prompt")), "prompt", model).select("feature_id", "polarity", "ord", "doc_id", verdict(F.col("reply")).alias("verdict"))


def evaluation(verdicts: DataFrame) -> DataFrame:
    """(feature_id, recall, precision, f1, match): the scores of each feature with its verdicts as ordered lists, for export."""
    cell = lambda p: F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("ord", "doc_id", "verdict")))).alias(p)
    lists = verdicts.groupBy("feature_id").agg(cell("pos"), cell("neg"))
    return label_scores(verdicts).join(lists, "feature_id").select("feature_id", "recall", "precision", "f1", F.struct("pos", "neg").alias("match"))
