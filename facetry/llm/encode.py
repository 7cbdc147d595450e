"""Encoding a corpus with a public tokenizer (problem 8)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, and the rank file of byte_bpe_50k.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded in parts of about this many characters.
LONG = 1 << 16
#: Ids in an Arrow batch that a task sends back.
BATCH_IDS = 1 << 20
#: White space after a visible character always begins a new piece, as does a mark or digit after a letter
#: (the control characters 1C to 1F are white space in Python only).
_SAFE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])|(?<=[A-Za-z\u3400-\u4dbf\u4e00-\u9fff])(?=[!-@\[-`{-~、。，：；？！])")
_loaded: dict[str, object] = {}


def tokenizer(folder: str = TOKENIZERS, ranks: str = RANKS):
    """The tokenizer of a local rank file, loaded once in each Python worker."""
    path = f"{folder}/{ranks}"
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[path]


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` cut where the tokenizer's pattern cuts in any case, into parts of about ``size``.

    A stretch without such a place stays whole, so the ids of the parts joined are always
    the ids of the text.
    """
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def ids_of(encoding, text: str | None) -> list[int]:
    """Ids without special tokens: none for a null or an empty text; a blank text as it stands."""
    if not text:
        return []
    if len(text) <= LONG:
        return encoding.encode_ordinary(text)
    return [i for part in parts(text) for i in encoding.encode_ordinary(part)]


def text_of(encoding, ids: list[int]) -> bytes:
    """The raw bytes the ids stand for; joined before any decoding, as a character may span ids."""
    return encoding.decode_bytes(ids)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>) of every row, a map without shuffle.

    A null or an empty text has an empty list, a blank text is encoded as it stands; repeated
    rows and null ids come out as often as they are; other columns are not read. Batches
    sent back are bounded by their ids, so a long text takes a batch of its own.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(folder, ranks)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, flat, ends = 0, [], [0]
            for row, text in enumerate(texts):
                flat += ids_of(enc, text.as_py())
                ends.append(len(flat))
                if len(flat) >= BATCH_IDS or row == len(texts) - 1:
                    lists = pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.array(flat, "int32")))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, row + 1 - start), lists], names=[id_col, "ids"])
                    start, flat, ends = row + 1, [], [0]

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(``id_col``, bytes BINARY) of every row of :func:`encode`; a null list gives null."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(folder, ranks)
        for batch in batches:
            raw = [None if x is None else text_of(enc, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(``id_col``, tokens BIGINT) of every row; 0 for a null or an empty text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(folder, ranks)
        for batch in batches:
            sizes = [sum(len(enc.encode_ordinary(p)) for p in parts(t)) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, "tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **where: str) -> DataFrame:
    """(``id_col``, digest): MD5 of the bytes that the ids of each text decode to."""
    return decode(encode(docs, id_col, text_col, **where), id_col, **where).select(id_col, F.md5("bytes").alias("digest"))
