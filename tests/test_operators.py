"""Edge cases of the core operators."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import text as tx
from facetry.functions.keys import feature_number
from facetry.operators import activations as ac
from facetry.operators import annotate, coherence, features, gibbs, metrics, sae, sampling, selection, skew, topics
from facetry.operators.components import connected_components
from facetry.operators.ranking import grouped_rank
from facetry.plans import reference
from facetry.sources import json_io
from facetry.sources.tables import latest, stored

WEIGHTS = "feature_id int, doc_id bigint, weight double"


def test_latest_row_holds_even_with_null_fields(spark):
    rows = [(1, "a", "2024-01-01"), (1, None, "2024-01-02"), (2, "b", None), (2, "c", None), (None, "d", "2024-01-01")]
    df = spark.createDataFrame(rows, "k int, v string, t string").withColumn("loaded_at", F.col("t").cast("timestamp_ntz"))
    assert {(r.k, r.v) for r in latest(df, ["k"], ["v"]).collect()} == {(1, None), (2, "c"), (None, "d")}
    num = df.withColumn("x", F.length("v").cast("double"))
    assert {(r.k, r.x) for r in latest(num, ["k"], ["x"]).collect()} == {(1, None), (2, 1.0), (None, 1.0)}
    assert latest(df.limit(0), ["k"], ["v"]).count() == 0


def test_feature_numbers(spark):
    keys = {"22": 22, " 7": 7, "160\n": 160, "１３９": 139, "f22": 22, "feature_249": 249, "F-0030": 30, "92.0": 92, "030": 30, "": None, "-": None, "n/a": None, "nan": None, "1.5": None, None: None, "9" * 30: None}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.n for r in df.select("k", feature_number(F.col("k")).alias("n")).collect()} == keys


def test_skewed_features_match_a_plain_aggregation(spark):
    rows = [("a", str(1 if i % 3 else i), i % 500, float(i % 7)) for i in range(3000)]
    rows += [("a", None, 1, 1.0), ("a", "1", None, 1.0), ("b", "x", 1, 1.0), (None, "5", 1, None), ("b", "5", 2, float("nan"))]
    df = spark.createDataFrame(rows, "saved_features string, feature_key string, doc_id bigint, weight double").withColumn("members", F.lit("clash"))
    got = {(r.saved_features, r.feature_id): r for r in skew.feature_results(skew.feature_members(df)).collect()}
    want: dict = {}
    for f, k, d, w in rows:
        if k and k.isdigit() and d is not None:
            m = want.setdefault((f, int(k)), {})
            w = None if w is None or math.isnan(w) else w
            m[d] = max([x for x in (m.get(d), w) if x is not None], default=None)
    assert set(got) == set(want)
    for key, m in want.items():
        ws = [w for w in m.values() if w is not None]
        r = got[key]
        assert r.members == len(m) and r.weight_max == max(ws, default=None)
        assert r.weight_sum == (pytest.approx(sum(ws)) if ws else None)
        assert r.top_doc_id == (min(d for d, w in m.items() if w == max(ws)) if ws else None)
    assert skew.feature_results(skew.feature_members(df.limit(0))).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 50)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100)} | {(500 + i, 500) for i in range(1, 50)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ranks_of_a_hot_group(spark):
    rows = [(0 if i % 3 else i, (i * 7919) % 1000, i) for i in range(2000)]
    got = {(r.g, r.i): (r.place, r.group_rows) for r in grouped_rank(spark.createDataFrame(rows, "g int, w int, i int"), "g", ["w", "i"]).collect()}
    groups: dict = {}
    for g, w, i in rows:
        groups.setdefault(g, []).append((w, i))
    assert got == {(g, i): (k, len(m)) for g, m in groups.items() for k, (_, i) in enumerate(sorted(m))}


def test_samplers_at_the_edges(spark):
    w = spark.createDataFrame([(1, i, float(i % 4)) for i in range(13)] + [(2, 1, 1.0)], WEIGHTS)
    m = features.members(w)
    docs, feats = w.select("doc_id").distinct(), spark.createDataFrame([(1,), (2,), (3,)], "feature_id int")
    assert sampling.random_members(m, 0).count() == 0
    assert sampling.random_members(m, 99).count() == m.count()
    assert sampling.top_k(w, 0).count() == w.count()
    top = [r.weight for r in sampling.top_k(w, 4).where("feature_id = 1").orderBy("ord").collect()]
    assert top == sorted(top) and len(top) == 4
    for k, s in ((5, 10), (25, 10), (6, 3), (1, 1)):
        got = sampling.stratified_members(m, k, s).where("feature_id = 1").collect()
        order = sorted((r.weight, r.doc_id) for r in m.where("feature_id = 1").collect())
        parts = np.array_split(np.arange(len(order)), min(s, k))
        assert len(got) == sum(min(k // min(s, k), len(p)) for p in parts)
        for r in got:
            assert order.index((r.weight, r.doc_id)) in parts[r.stratum]
    neg = sampling.negatives(m, docs, feats, 5)
    inside = {(r.feature_id, r.doc_id) for r in m.collect()}
    assert not inside & {(r.feature_id, r.doc_id) for r in neg.collect()}
    assert neg.where("feature_id = 3").count() == 5 and neg.where("feature_id = 1").count() == 4
    with pytest.raises(ValueError):
        sampling.sample("other", w, m, docs, feats, 1, 1)
    assert sampling.stratified_members(m.limit(0), 5).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a  b"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", tx.truncate(F.col("text"), 2).alias("t")).collect()}
    assert got == {1: "a b ...", 2: "a  ...", 3: "", 4: None}
    t = spark.createDataFrame([(n, list(map(str, range(n)))) for n in (0, 1, 4, 5, 9, 10, 11)], "doc_id int, t array<string>")
    for size, overlap in ((4, 1), (4, 4), (4, 9), (1, 0), (3, 2)):
        step = size - overlap if size > overlap else max(1, size // 2)
        want = set()
        for n in (1, 4, 5, 9, 10, 11):
            at = i = 0
            while True:
                want.add((n, i, tuple(map(str, range(at, min(n, at + size))))))
                if at + size >= n:
                    break
                at, i = at + step, i + 1
        assert {(r.doc_id, r.chunk_idx, tuple(r.tokens)) for r in tx.chunks(t, "t", size, overlap, ["doc_id"]).collect()} == want


def literal_dpp(v, w, k):
    psi = v * w[:, None]
    gram = psi @ psi.T
    picked, c = [int(np.argmax(w))], np.array([[math.sqrt(w.max())]])
    while len(picked) < min(k, len(w)):
        best, at, row = -np.inf, None, None
        for i in range(len(w)):
            if i not in picked:
                y = np.linalg.solve(c, gram[picked, i])
                d = gram[i, i] - y @ y
                if d > best:
                    best, at, row = d, i, y
        if best <= 0:
            break
        c = np.block([[c, np.zeros((len(c), 1))], [row[None, :], np.array([[math.sqrt(best)]])]])
        picked.append(at)
    return picked


def test_words_of_every_text(spark, tmp_path):
    texts = [(1, "Plain  ASCII "), (2, "Émile ÄRGER"), (3, "ΟΔΟΣ ΣΑΣ"), (4, "İstanbul K"), (5, "МОСКВА 東京"), (6, ""), (7, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.words) for r in reference.QUERIES["tokenize_lower"](spark, str(tmp_path)).collect()}
    words = {i: t.lower().split(" ") for i, t in texts if t is not None}
    assert got == {i: (len(w), hashlib.md5("|".join(w).encode()).hexdigest()) for i, w in words.items()}


def test_full_list_of_stop_words(spark, tmp_path):
    df = spark.createDataFrame([(1, "the cat , which had been here , can't The again"), (2, None)], "doc_id bigint, text string")
    df.selectExpr("*", "text as tokenized_text", "'s' as supercategory", "'2024-01-01' as loaded_at").write.parquet(f"{tmp_path}/wikitext.parquet")
    got = [tuple(r) for r in reference.QUERIES["remove_stopwords"](spark, str(tmp_path)).collect()]
    assert got == [(1, "cat , , can't The")]


def test_dpp_equals_the_literal_formulation(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    w = np.exp(rng.random(30) / 2)
    df = spark.createDataFrame([(0, i, v[i].tolist(), float(w[i])) for i in range(30)] + [(1, 5, v[0].tolist(), 1.0)], "feature_id int, doc_id bigint, v array<double>, weight double")
    got = selection.greedy_dpp(df, 6).orderBy("ord").collect()
    assert [r.doc_id for r in got if r.feature_id == 0][: len(literal_dpp(v, w, 6))] == literal_dpp(v, w, 6)
    assert [r.doc_id for r in got if r.feature_id == 1] == [5]


def test_metrics_with_failed_verdicts(spark):
    rows = [(1, "pos", i, i, x) for i, x in enumerate([1, 1, 0, -1])] + [(1, "neg", 0, 9, 1), (2, "neg", 0, 9, 1)]
    v = spark.createDataFrame(rows, "feature_id int, polarity string, ord int, doc_id bigint, verdict int")
    s = metrics.label_scores(v).collect()
    assert len(s) == 1 and s[0].recall == pytest.approx(0.25) and s[0].precision == pytest.approx(1 / (2 + 1e-5))
    c = metrics.confusion(v).where("feature_id = 1").head()
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 2, 0)
    p = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b"), (None, "b")], "pred int, truth string")
    m = metrics.purity(p).head()
    assert m.purity == pytest.approx((2 / 3 + 1) / 2) and m.inverse_purity == pytest.approx(3 / 4)


def test_activations(spark):
    rows = [(1, 0, 0, 9, 1, 5.0, True), (1, 0, 1, 8, 1, 2.0, True), (1, 0, 2, 8, 1, 7.0, False), (1, 1, 0, 9, 2, 3.0, True), (1, 1, 1, 8, 3, 1.0, False)]
    a = spark.createDataFrame(rows, "doc_id int, chunk_idx int, pos int, token_id int, feature_id int, act double, valid boolean")
    top = ac.top_tokens(a, ["doc_id", "chunk_idx"], 1, excluded_token=9).collect()
    assert top == []
    top = ac.top_tokens(a, ["doc_id", "chunk_idx"], 2, excluded_token=9).collect()
    assert [(r.feature_id, r.feature_weight, r.pos) for r in top] == [(1, 5.0, 1)]
    assert {(r.feature_id, r.theta) for r in ac.chunk_features(a, ["doc_id", "chunk_idx"], "max").collect()} == {(1, 5.0), (2, 3.0), (3, 0.0)}
    with pytest.raises(ValueError):
        ac.document_features(a, "frac_above")


def test_npmi_by_brute_force(spark):
    texts = ["a b c d".split(), "a b x".split(), "c d".split(), "a x y z q".split(), []]
    words = spark.createDataFrame([(0, w) for w in "abc"], "topic_id int, word string")
    got = coherence.npmi(spark.createDataFrame([(t,) for t in texts], "t array<string>"), "t", words, window=2).head()
    win = [set(t[s : s + 2]) for t in texts if t for s in range(max(len(t) - 2, 0) + 1)]
    p = lambda *x: sum(set(x) <= w for w in win) / len(win)
    want = [math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12) for a in "abc" for b in "abc" if a != b]
    assert got.npmi == pytest.approx(sum(want) / 6)


def test_coherence_counts_over_the_raw_text(spark, tmp_path):
    texts = [(1, "A b x", None), (2, "x A y", "a b"), (3, "b", "b"), (4, "z", "a b")]
    wiki = spark.createDataFrame(texts, "doc_id bigint, text string, tokenized_text string").withColumn("loaded_at", F.lit("2024-01-01")).withColumn("supercategory", F.lit("s"))
    tables = {"wikitext": wiki, "vocab": spark.createDataFrame([(0, "a"), (1, "b")], "word_id int, word string"), "topic2word_dist": spark.createDataFrame([(0, [0.6, 0.4])], "topic_id int, p array<double>")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = reference.QUERIES["npmi_coherence"](spark, str(tmp_path)).head()
    assert (got.npmi, got.pairs) == (pytest.approx(math.log(0.25 / (0.5 * 0.5)) / -math.log(0.25), abs=1e-6), 2)  # each text is one window


def test_labels_and_prompts(spark):
    replies = [(0, ' 1\n'), (1, "1."), (2, None), (3, "yes"), (4, "7")]
    df = spark.createDataFrame(replies, "i int, r string")
    assert [r.v for r in df.orderBy("i").select(annotate.verdict(F.col("r")).alias("v")).collect()] == [1, -1, -1, -1, 7]
    df = spark.createDataFrame([('{"name": "x", "description": "y"}',), ("no",), (None,)], "r string")
    assert [(x.name, x.raw, x.status) for x in (r.l for r in df.select(annotate.label(F.col("r")).alias("l")).collect())] == [("x", None, "ok"), (None, "no", "unparsed"), (None, None, "failed")]
    asked = annotate.ask(spark.createDataFrame([("a b",), ("boom",)], "p string"), "p", lambda p: "1" if p != "boom" else 1 / 0, 2).collect()
    assert [(r.reply, r.ok, r.tokens_in, r.tokens_out) for r in asked] == [("1", True, 2, 1), (None, False, 1, 0)]


def test_autoencoder_learns(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    x = np.array([base[rng.choice(12, 2, replace=False)].sum(0) for _ in range(600)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id bigint, v array<double>")
    model = sae.train(df, 24, 3, epochs=40, rate=5e-3)
    assert model.history[-1]["val"] < 0.5 * model.history[0]["val"]
    model.save(str(tmp_path / "m.npz"))
    again = sae.Autoencoder.load(str(tmp_path / "m.npz"))
    got = {r.doc_id: r.theta for r in sae.activations(df, again).collect()}
    assert np.allclose(np.array([got[i] for i in range(600)]), model.encode(x))
    assert ((np.array(list(got.values())) > 0).sum(1) <= 3).all()


def test_autoencoder_learns_from_every_row(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = np.array([base[rng.choice(12, 2, replace=False)].sum(0) for _ in range(900)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id bigint, v array<double>")
    model = sae.train(df, 24, 3, bound=300, epochs=25, batch=32, rate=5e-3)  # three parts
    learnt = model.history[-1]["rows"]
    assert 900 * 0.88 - 3 <= learnt <= 900 * 0.88  # twelve percent of each part are held out
    e = model.decode(model.encode(x)) - x
    assert (e * e).sum() < 0.3 * ((x - x.mean(0)) ** 2).sum()


def test_topics_of_all_documents_and_words(spark):
    docs = [(i, [f"{'ab'[i % 2]}{(i // 2 + j) % 5}" for j in range(6)] + [f"only{i}"]) for i in range(40)] + [(99, [])]
    found = topics.fit_topics(spark.createDataFrame(docs, "doc_id bigint, t array<string>"), "t", 2, max_iterations=200)
    assert {r.word for r in found["vocab"].collect()} == {w for _, t in docs for w in t}
    assert [r.n for r in found["doc_topic"].groupBy("topic_id").agg(F.count("doc_id").alias("n")).collect()] == [41, 41]
    words = {r.word_id: r.word for r in found["vocab"].collect()}
    most = {words[r.word_id]: r.p for r in found["topic_word"].groupBy("word_id").agg(F.max("p").alias("p")).collect()}
    own = [most[f"only{i}"] for i in range(40)]
    assert max(own) < 3 * min(own)  # each record has been learnt from alike
    assert not topics._ended([-9.0, -8.0, -8.0, -8.0]) and not topics._ended([-7.0, -8.0, -9.0])
    assert topics._ended([-9.0, -7.0, -8.0, -9.0])


def two_subjects(n, rng):
    """Records of words of one of two subjects, some of them long, each with a word of its own; and their subjects."""
    return [(i, [f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 12, 150 if i % 10 < 2 else 20)] + [f"only{i}"]) for i in range(n)]


def test_topics_end_by_the_likelihood(spark, monkeypatch):
    seen, ended = [], topics._ended
    monkeypatch.setattr(topics, "_ended", lambda found: seen.append(len(found)) or ended(found))
    words = np.random.default_rng(3).integers(0, 40, (80, 30))
    docs = spark.createDataFrame([(i, [f"w{j}" for j in row]) for i, row in enumerate(words)], "doc_id bigint, t array<string>")
    topics.fit_topics(docs, "t", 2, max_iterations=1000)
    assert 4 <= seen[-1] < 100  # variational Bayes never gets worse, so it took all the iterations


@pytest.mark.parametrize("block, few", [(1_000_000, 64), (700, 64), (700, 2)])
def test_topics_in_blocks_count_every_token(spark, monkeypatch, block, few):
    monkeypatch.setattr(topics, "BLOCK", block)
    monkeypatch.setattr(topics, "FEW", few)
    docs = two_subjects(60, np.random.default_rng(4)) + [(60, None), (61, ["a1", None])]
    df = spark.createDataFrame(docs, "doc_id bigint, t array<string>")
    found = topics.fit_topics(df, "t", 2, max_iterations=30)
    again = topics.fit_topics(df.repartition(3), "t", 2, max_iterations=30)
    rows = {n: {tuple(r[:-1]): r.p for r in found[n].select(*k, "p").collect()} for n, k in (("topic_word", ["topic_id", "word_id"]), ("doc_topic", ["doc_id", "topic_id"]))}
    assert rows["doc_topic"] == {(r.doc_id, r.topic_id): r.p for r in again["doc_topic"].collect()}
    main = {i: max((0, 1), key=lambda t: rows["doc_topic"][i, t]) for i in range(60)}
    assert {main[i] for i in range(0, 60, 2)} != {main[i] for i in range(1, 60, 2)} and len(set(main.values())) == 2
    assert rows["doc_topic"][60, 0] == 0.5 and len(rows["doc_topic"]) == 124
    # from the probabilities every topic's count of each word comes back, and they add up to the corpus
    n = Counter(w for _, t in docs for w in t or [] if w)
    words = {r.word_id: r.word for r in found["vocab"].collect()}
    assert Counter(words.values()) == Counter(n.keys()) and [n[words[i]] for i in range(len(n))] == sorted(n.values(), reverse=True)
    least = [min(rows["topic_word"][t, i] for i in words) for t in (0, 1)]  # of a word that the topic doesn't have
    got = {words[i]: [rows["topic_word"][t, i] / least[t] * gibbs.ETA - gibbs.ETA for t in (0, 1)] for i in words}
    assert all(np.allclose(x, np.round(x), atol=1e-6) and round(sum(x)) == n[w] for w, x in got.items())


def test_driver_holds_only_words_that_occur_again(spark, monkeypatch):
    held, sampled = [], topics._sampled
    monkeypatch.setattr(topics, "_sampled", lambda *a: held.append(a[4]) or sampled(*a))
    df = spark.createDataFrame([(i, ["all", f"only{i}"]) for i in range(20)], "doc_id bigint, t array<string>")
    found = topics.fit_topics(df, "t", 2, max_iterations=10)
    assert held == [1] and found["topic_word"].count() == 42


@pytest.mark.parametrize("records", [3, 10_000])
def test_topics_of_texts_are_those_of_their_tokens(spark, monkeypatch, records):
    monkeypatch.setattr(topics, "BLOCK", 300)  # several blocks, of several batches each
    rows = [(f"r{i}", " ".join(t)) for i, t in two_subjects(40, np.random.default_rng(7))] + [("none", None), ("empty", ""), ("gaps", " a1  only1 "), ("wide", "a1\tb1 \u00e9\u4e2d")]
    df = spark.createDataFrame(rows, "doc_id string, t string")
    lists = topics.fit_topics(df.select("doc_id", F.split("t", " ").alias("t")), "t", 2, max_iterations=10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        found = topics.fit_topics(df.repartition(2), "t", 2, max_iterations=10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("vocab", "topic_word", "doc_topic"):
        assert sorted(map(tuple, found[n].collect())) == sorted(map(tuple, lists[n].collect()))
    assert {r.word for r in found["vocab"].collect()} == {w for _, t in rows if t is not None for w in t.split(" ")}
    assert found["doc_topic"].where("doc_id = 'none' and p = 0.5").count() == 2 and found["doc_topic"].count() == 88


def test_likelihood_and_prior_of_topics():
    z, docs, w = np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 1, 1]), np.array([0, 0, 1, 1, 2])  # the word 2 occurs once
    alpha, e = np.array([0.3, 0.6]), gibbs.ETA
    want = 0.0
    for d in (0, 1):
        n = [((docs == d) & (z == t)).sum() for t in (0, 1)]
        want += math.lgamma(0.9) - math.lgamma(0.9 + sum(n)) + sum(math.lgamma(a + x) - math.lgamma(a) for a, x in zip(alpha, n))
    for t in (0, 1):
        want += math.lgamma(3 * e) - math.lgamma(3 * e + (z == t).sum()) + sum(math.lgamma(e + ((w == v) & (z == t)).sum()) - math.lgamma(e) for v in range(3))
    sizes, lens = np.array([[0, 2, 0, 0], [0, 1, 1, 0]]), np.array([0, 0, 1, 1])
    assert np.isclose(gibbs.log_likelihood(np.array([[2, 0], [0, 2]]), np.array([2, 3]), alpha, sizes, lens, 3), want / 5)
    rng = np.random.default_rng(0)
    n = np.array([rng.multinomial(50, rng.dirichlet([0.5, 2.0])) for _ in range(4000)])
    sizes, got = np.array([np.bincount(n[:, t], minlength=51) for t in (0, 1)]), np.full(2, 0.1)
    for _ in range(30):
        got = gibbs.fitted_alpha(got, sizes, np.bincount([50] * 4000, minlength=51))
    assert np.allclose(got, [0.5, 2.0], rtol=0.1)


def test_json_round_trips(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text("\n".join(json.dumps({"id": str(i), "text": f"t{i}", "tokenized_text": "x y"}) for i in range(5)))
    got = json_io.read_corpus(spark, str(tmp_path / "c"), "wikitext").orderBy("doc_id").collect()
    assert [(r.doc_id, r.id, r.tokens) for r in got] == [(i, str(i), ["x", "y"]) for i in range(5)]
    (tmp_path / "s.json").write_text(json.dumps({"3": {"pos": {"9": 0.5, "2": 0.75}, "neg": [4]}}))
    s = json_io.read_samples(spark, str(tmp_path / "s.json"))
    assert {(r.polarity, r.ord, r.doc_id, r.weight) for r in s.collect()} == {("pos", 0, 9, 0.5), ("pos", 1, 2, 0.75), ("neg", 0, 4, None)}
    assert json.loads(json_io.samples_json(s).head().json) == {"pos": {"9": 0.5, "2": 0.75}, "neg": [4]}
    (tmp_path / "m.json").write_text(json.dumps({"topic2word_dist": [[0.1, 0.9]], "doc2topic_dist": [[1.0]], "topic2doc_dist": [[1.0]], "vocab": ["u", "v"]}))
    assert {(r.topic_id, r.word_id, r.p) for r in json_io.read_topic_model(spark, str(tmp_path / "m.json"))["topic_word"].collect()} == {(0, 0, 0.1), (0, 1, 0.9)}
    json_io.save(s, str(tmp_path / "out"), "disk")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        json_io.save(s, str(tmp_path / "out"), "csv")


def test_explanations_are_fetched_once():
    asked, cache = [], {}

    def fetch(i):
        asked.append(i)
        return {"explanations": [{"description": None}, {"description": f"d{i}"}] if i else None}

    assert [ac.fetched_explanation(i, cache, fetch) for i in (1, 1, 0)] == ["d1", "d1", "<no explanation field found in JSON>"] and asked == [1, 0]


@pytest.mark.parametrize("few", [100_000, 5])
def test_negatives_of_nearly_full_features(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    m = spark.createDataFrame([(1, i, 1.0) for i in range(300) if i not in (7, 250)] + [(2, i, 1.0) for i in range(200)] + [(2, 5, 1.0)], WEIGHTS)
    docs = spark.range(300).select(F.col("id").alias("doc_id"))
    got = sampling.negatives(m, docs, spark.createDataFrame([(1,), (2,), (3,)], "feature_id int"), 4).collect()
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    inside = {1: set(range(300)) - {7, 250}, 2: set(range(200)), 3: set()}
    assert {(r.feature_id, r.ord, r.doc_id) for r in got} == {(f, k, i) for f in inside for k, i in enumerate([i for i in order if i not in inside[f]][:4])}


def test_stored_tables_survive(spark):
    df = stored(spark.range(10))
    assert df.count() == 10


def test_streams(spark, tmp_path):
    from facetry.streaming import increments

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.0), (2, 3, 1.0)], WEIGHTS).coalesce(1).write.parquet(str(src))
    stream = increments.feature_sizes_stream(spark.readStream.schema(WEIGHTS).parquet(str(src)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.feature_id, r.n) for r in spark.table("sizes").collect()} == {(1, 1), (2, 1)}
