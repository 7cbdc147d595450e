"""Places where long texts may be cut, and groups that are too large for one task."""

import os

import numpy as np
import pytest

from facetry.llm import encode, packing, topn, varied
from facetry.operators import skew

needs_tokenizer = pytest.mark.skipif(not os.path.exists(f"{encode.TOKENIZERS}/{encode.RANKS}"), reason="no vocabulary files")


@needs_tokenizer
def test_every_cut_is_safe():
    rng, enc = np.random.default_rng(2), encode.tokenizer()
    signs = ["a", "Bc", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "1", "²", "é", "漢", "字", "。", "，", "!", "-", "_", "​", "ไ", "🙂", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(signs, 12))
        want = enc.encode_ordinary(text)
        for m in encode._SAFE.finditer(text):
            assert enc.encode_ordinary(text[: m.start()]) + enc.encode_ordinary(text[m.start() :]) == want, repr(text)


@needs_tokenizer
def test_long_texts_without_spaces_are_cut():
    for line in ("word\n", "tab\tand\t", "x=1;", "漢字。"):
        text = line * 40_000
        assert len(list(encode.parts(text))) > 1 and "".join(encode.parts(text)) == text


def test_hot_groups_without_broadcast_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(0 if rng.random() < 0.5 else int(rng.integers(1, 400)), i, float(rng.integers(0, 90))) for i in range(6000)] + [(None, i, 1.0) for i in range(900)]
    want = {}
    for g, i, s in data:
        want.setdefault(g, []).append((-s, i))
    df = spark.createDataFrame(data, "g int, item int, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got: dict = {}
        for r in topn.top_n(df, ["g"], "item", "score", 3).orderBy("place").collect():
            got.setdefault(r.g, []).append((-r.score, r.item))
        assert got == {g: sorted(m)[:3] for g, m in want.items()}
        heavy = skew.heavy_keys(df, ["g"], 10)
        assert max(heavy.values()) > 2500 and len(heavy) > 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_frequent_sizes_are_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    sizes = [(i, [5, 5, 5, 3, 0, None, 23][i % 7]) for i in range(200)]
    packed = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), capacity=10).collect()
    assert sum(r["size"] for r in packed) == sum(s or 0 for _, s in sizes)
    taken: dict = {}
    for r in packed:
        if r.container_id is not None:
            taken.setdefault(r.container_id, []).append((r.offset, r.offset + r["size"]))
    for spans in taken.values():
        spans.sort()
        assert spans[-1][1] <= 10 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_neighbours_by_sketch_miss_none():
    rng = np.random.default_rng(6)
    for n, spread in ((1, 1.0), (40, 0.05), (700, 0.3), (900, 0.02)):
        z = rng.normal(0, spread, (n, 4)).astype("float32")
        z[n // 2 :] = z[: n - n // 2] + rng.normal(0, 0.02, (n - n // 2, 4))
        ids = rng.permutation(10 * n)[:n].astype("int64")
        node, root = varied._near(0.0447)(ids, z)
        close = ((z[:, None].astype("float64") - z[None]) ** 2).sum(2) <= 0.0447**2
        label = ids.copy()
        for _ in range(n):
            new = np.array([label[c].min() for c in close])
            if np.array_equal(new, label):
                break
            label = new
        got = dict(zip(node.tolist(), root.tolist()))
        for i in np.flatnonzero(close.sum(1) > 1):
            assert got[int(ids[i])] <= label[i]
        for i in np.flatnonzero(close.sum(1) > 1):
            for j in np.flatnonzero(close[i]):
                assert got[int(ids[i])] == got[int(ids[j])]
