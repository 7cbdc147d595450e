"""From documents to features: chunks, a plug-in model, an autoencoder, features of documents.

A ``tokenize`` plug-in turns a text into token ids (white space and hashes by default), an ``encode``
plug-in a list of texts into vectors; an ``activate`` plug-in turns the table of chunks into one of token
activations (doc_id, chunk_idx, pos, token_id, feature_id, act, valid).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.config import Settings, chunk_limits, settings
from facetry.functions import text as tx
from facetry.operators import activations, sae
from facetry.sources.json_io import save
from facetry.sources.tables import stored

#: Ways to read an autoencoder's activations, by name; see :func:`register`.
BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, activate: Callable[[DataFrame], DataFrame]) -> None:
    """Makes an ``activate`` plug-in known as a backend."""
    BACKENDS[name] = activate


def backend(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[name]


def words_as_tokens(text: str) -> list[int]:
    """A stand-in for a model's tokenizer: a hash of each word."""
    return [zlib.crc32(w.encode()) & 0x7FFFFFFF for w in text.split()]


def with_padding(tokens: list[list[int]], pad: int | None, end: int) -> np.ndarray:
    """Token lists as rows of one length, filled up with ``pad``, or the end token where a model has none."""
    out = np.full((len(tokens), max(map(len, tokens), default=0)), end if pad is None else pad)
    for i, t in enumerate(tokens):
        out[i, : len(t)] = t
    return out


def chunked(docs: DataFrame, s: Settings, tokenize: Callable[[str], list[int]] = words_as_tokens, model_limit: int | None = None) -> DataFrame:
    """(chunk_id, doc_id, chunk_idx, text, token_ids): the chunks of each document's text.

    Without chunking each document is one row, cut to the model's limit. chunk_id is the document's
    id and the chunk's number. A text that is null, empty or blank has no chunk.
    """
    s = chunk_limits(s, model_limit)
    rows = docs.select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    rows = rows.select("doc_id", F.split("text", r"\s+").alias("words"))
    if s.do_chunking:
        pieces = tx.chunks(rows, "words", s.chunk_size, s.chunk_overlap, ["doc_id"])
    else:
        pieces = rows.select("doc_id", F.lit(0).alias("chunk_idx"), (F.slice("words", 1, model_limit) if model_limit else F.col("words")).alias("tokens"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([tokenize(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=["doc_id", "chunk_idx", "text", "token_ids"])

    pieces = pieces.select("doc_id", "chunk_idx", F.array_join("tokens", " ").alias("text"))
    found = pieces.mapInArrow(tokens, f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_idx int, text string, token_ids array<bigint>")
    return found.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "*")


def encoded(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], normalise: bool = False, batch: int = 32) -> DataFrame:
    """``rows`` with v, the vector of their text by the plug-in, to length 1 if ``normalise``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            x = np.concatenate([np.asarray(encode(texts[i : i + batch]), "float64") for i in range(0, len(texts), batch)]) if texts else np.zeros((0, 1))
            if normalise:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names, "v"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, v array<double>")


def document_arrays(chunks: DataFrame, how: str, width: int) -> DataFrame:
    """(doc_id, theta): elementwise mean or max of the chunks' theta."""
    cells = chunks.select("doc_id", F.posexplode("theta").alias("feature_id", "theta")).where("theta <> 0")
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {how!r}; there are mean and max")
    per = cells.groupBy("doc_id", "feature_id").agg((F.sum if how == "mean" else F.max)("theta").alias("x"))
    per = per.join(n, "doc_id").select("doc_id", F.col("feature_id").alias("neuron"), (F.col("x") / F.col("n") if how == "mean" else F.col("x")).alias("act"))
    zeros = F.array_repeat(F.lit(0.0), width)
    return n.select("doc_id").join(sae.dense(per, width), "doc_id", "left").select("doc_id", F.coalesce("theta", zeros).alias("theta"))


class EmbeddingExtractor:
    """Chunks, vectors of a plug-in encoder, an autoencoder trained on them or loaded, features of documents."""

    def __init__(self, encode: Callable[[list[str]], np.ndarray], config: str | None = None, model_limit: int | None = None, **given):
        self.encode, self.limit, self.settings = encode, model_limit, settings("emb", config, **given)

    def fit_transform(self, docs: DataFrame, folder: str, save_path: str | None = None, save_chunks: bool = False, kind: str = "json", **options) -> tuple[DataFrame, DataFrame]:
        """(chunks, documents), each with theta; ``docs`` hold doc_id and text. Models are kept in ``folder``."""
        s = self.settings
        vectors = stored(encoded(chunked(docs, s, model_limit=self.limit), self.encode))
        model = sae.train_or_load(vectors, s.n_features, s.k, folder, **options)
        chunks = vectors.drop("v").join(sae.activations(vectors, model, "chunk_id"), "chunk_id")
        documents = document_arrays(chunks, s.doc_agg, s.n_features)
        if save_path:
            save(documents, f"{save_path}/documents", kind)
            if save_chunks:
                save(chunks, f"{save_path}/chunks", kind)
        return chunks, documents


class ActivationExtractor:
    """Chunks, token activations of a plug-in or registered backend, features of chunks and documents with their strongest tokens."""

    def __init__(self, activate: Callable[[DataFrame], DataFrame] | str, config: str | None = None, model_limit: int | None = None, explanations: DataFrame | None = None, **given):
        self.activate = backend(activate) if isinstance(activate, str) else activate
        self.limit, self.explanations, self.settings = model_limit, explanations, settings("llm", config, **given)

    def fit_transform(self, docs: DataFrame, save_path: str | None = None, save_chunks: bool = False, kind: str = "json") -> tuple[DataFrame, DataFrame]:
        """(chunks, documents), each with theta, num_features and theta_sparse."""
        s, by = self.settings, ["doc_id", "chunk_idx"]
        acts = stored(self.activate(chunked(docs, s, model_limit=self.limit)))
        theta = activations.chunk_features(acts, by, s.chunk_agg, s.threshold)
        width = acts.agg(F.max("feature_id")).head()[0]
        width = 0 if width is None else width + 1
        tokens = activations.top_tokens(acts, by, s.top_tokens, s.excluded_token)
        sparse = activations.nested(tokens, by) if self.explanations is None else activations.nested_labelled(activations.explain(tokens, self.explanations), by)
        key = theta.select(F.struct(*by).alias("doc_id"), F.col("feature_id").alias("neuron"), F.col("theta").alias("act"))
        wide = sae.dense(key.where("act <> 0"), width).select("doc_id.*", "theta")
        zeros = F.array_repeat(F.lit(0.0), width)
        every = acts.select(*by).distinct().join(wide, by, "left").select(*by, F.coalesce("theta", zeros).alias("theta"))
        none = F.array().cast(dict(sparse.dtypes)["theta_sparse"])
        chunks = stored(every.join(sparse, by, "left").select(*by, "theta", F.lit(width).alias("num_features"), F.coalesce("theta_sparse", none).alias("theta_sparse")))
        documents = activations.with_documents(document_arrays(chunks, s.doc_agg, width), chunks)
        if save_path:
            save(documents, f"{save_path}/documents", kind)
            if save_chunks:
                save(chunks, f"{save_path}/chunks", kind)
        return chunks, documents


def create_extractor(method: str, *args, **given) -> EmbeddingExtractor | ActivationExtractor:
    """The extractor of ``emb`` or ``llm``, in any case; any other method raises ValueError."""
    ways = {"emb": EmbeddingExtractor, "llm": ActivationExtractor}
    if method.lower() not in ways:
        raise ValueError(f"unknown method {method!r}; there are {sorted(ways)}")
    return ways[method.lower()](*args, **given)
