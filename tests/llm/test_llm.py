"""Operators for training data against brute force, exact round trips and held-out accuracy."""

import math
import os
import sys
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare  # noqa: E402

from facetry.llm import clusters, distinct, encode, packing, pieces, queries, subjects, terms, topn, varied  # noqa: E402


needs_tokenizer = pytest.mark.skipif(not os.path.exists(f"{encode.TOKENIZERS}/{encode.RANKS}"), reason="no vocabulary files")


def frame(spark, rows, schema):
    """Rows with a load time, and with columns of names the operators use inside."""
    return spark.createDataFrame(rows, schema).withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("slot", F.lit("clash")).withColumn("n", F.lit(-1))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, name):
    compare(spark, sf, queries.queries()[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.SQL)))
def test_query_without_sql(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= 0


# 1

TEXTS = [(0, "a A b"), (1, "a  c c"), (2, "é é x"), (3, None), (4, ""), (5, "a"), (5, "a"), (6, " "), (None, "a a")]


def test_term_counts_with_and_without_heavy_terms(spark, monkeypatch):
    wiki, vocab = frame(spark, TEXTS, "doc_id bigint, tokenized_text string"), frame(spark, [(0, "B"), (1, "zz"), (2, " "), (3, None)], "word_id int, word string")
    latest = {i: t for i, t in TEXTS if i is not None}
    split = {i: unicodedata.normalize("NFC", t or "").lower().split() for i, t in latest.items()}
    occ, rec = Counter(t for s in split.values() for t in s), Counter(t for s in split.values() for t in set(s))
    want = {(t, occ[t], rec[t], t in ("b", "zz"), "rare" if rec[t] < 3 else "common" if rec[t] * 100 > 40 * 7 else None) for t in [*occ, "zz"]}
    for held in (1, 200_000):
        monkeypatch.setattr(terms, "HELD", held)
        got = {(r.term, r.occurrences, r.records, r.in_vocab, r.mark) for r in terms.term_table(wiki, vocab).collect()}
        assert got == want
    assert {r.term for r in terms.term_table(wiki.limit(0), vocab).collect()} == {"b", "zz"}
    assert terms.term_table(wiki.limit(0), vocab.limit(0)).count() == 0


# 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a" * 7, "b", " ", "\n\n", ". ", "x" * 45, "\t", "é" * 21, "。 "]), max_size=60), st.integers(0, 9))
def test_pieces_of_any_text(parts, overlap):
    text, limit = "".join(parts), 40
    found = pieces.pieces_of(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in found) == text
    assert all(e - s <= limit and c - s <= overlap for s, c, e, _ in found)
    assert len(found) == 1 if len(text) <= limit else len(found) > 1
    longest = max((len(w) for w in text.split()), default=0)
    assert any(cut == "hard" for *_, cut in found) == (longest > limit)
    for s, c, e, cut in found:
        if cut not in ("hard", "end"):
            assert text[e - 1].isspace() or text[e].isspace()


def test_pieces_prefer_strong_boundaries(spark):
    text = "One two. Three four five.\n\nSix seven. Eight nine ten."
    assert [c for *_, c in pieces.pieces_of(text, 30, 2)] == ["paragraph", "end"]
    df = frame(spark, [(1, None), (2, ""), (3, "x" * 9000), (3, "x" * 9000), (None, "y")], "doc_id bigint, text string")
    got = pieces.split_texts(df, ["doc_id"], "text").collect()
    assert Counter((r.doc_id, r.record_cut) for r in got if r.piece == 0) == {(2, None): 1, (3, "hard"): 2, (None, None): 1}
    assert pieces.split_texts(df.limit(0), ["doc_id"], "text").count() == 0


# 4


def groups_by_brute_force(ids, x, same):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if x[a] @ x[b] >= same:
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return {(i, find(i)) for i in ids if find(i) != i}


def test_groups_and_subsets_with_a_hot_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    hot = rng.random(12)
    rows = [rng.random(12) * (rng.random(12) < 0.4) for _ in range(120)] + [hot * (1 + 0.01 * rng.random(12)) for _ in range(70)] + [hot] * 10
    rows += [rows[5] * 3, rows[6] * (1 + 0.02 * rng.random(12)), np.zeros(12)]
    data = [(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None), (901, [math.nan, None, -1.0] + [0.0] * 9), (902, [])]
    data[7] = (7, [None, -5.0, math.nan, *data[7][1][3:]])
    theta = frame(spark, data, "doc_id bigint, theta array<double>")
    clean = {i: np.array([0 if v is None or math.isnan(v) or v < 0 else v for v in r]) for i, r in data if r}
    ids = [i for i, r in clean.items() if r.any()]
    x = np.array([clean[i] / np.linalg.norm(clean[i]) for i in ids])
    want = groups_by_brute_force(ids, x, varied.SAME)
    for cap in (4096, 24):  # the second goes through leaders and pairs of blocks
        monkeypatch.setattr(varied, "CELL_ROWS", cap)
        assert {(r.node, r.root) for r in varied.same_groups(varied.theta_rows(theta)).collect()} == want
    pairs = frame(spark, [(0, 1, 0.5), (1, 2, None), (2, 3, math.nan)], "topic_id int, doc_id bigint, weight double")
    got = varied.one_of_each(theta, pairs, 20).collect()
    group = dict(want)
    assert len(got) == 20 == len({group.get(r.doc_id, r.doc_id) for r in got})
    active = np.array(list(clean.values())).any(0)
    assert (np.array([clean[r.doc_id] for r in got]).any(0) == active).all()
    assert varied.one_of_each(theta, pairs, 10_000).count() == len(ids) - len(want)
    assert varied.same_groups(varied.theta_rows(theta.limit(0))).count() == 0


def test_subset_covers_topics_of_records_without_theta(spark):
    theta = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0])], "doc_id bigint, theta array<double>")
    pairs = frame(spark, [(0, 1, 0.5), (1, 3, 0.5), (2, 4, 0.5), (3, 5, 0.5), (4, 6, 0.5), (4, 7, 0.0)], "topic_id int, doc_id bigint, weight double")
    assert {r.doc_id for r in varied.one_of_each(theta, pairs, 10).collect()} == {1, 2, 4, 5, 6}  # 3 says the same as 2
    assert {r.doc_id for r in varied.one_of_each(theta.limit(0), pairs, 10).collect()} == {1, 3, 4, 5, 6}
    assert {r.doc_id for r in varied.one_of_each(theta, pairs.limit(0), 10).collect()} == {1, 2}


def test_pivots_span_the_rows():
    rng = np.random.default_rng(0)
    x = rng.random((200, 5)) @ rng.random((5, 30))
    kept = varied.pivot(np.arange(200), x, 30)
    assert len(kept) == 5 and np.linalg.matrix_rank(x[kept]) == 5
    assert varied.pivot(np.arange(0), np.zeros((0, 4)), 3) == []


# 5


def alike_by_brute_force(texts, topics):
    sets = {i: frozenset(unicodedata.normalize("NFC", t or "").lower().split()) for i, t in texts}
    ids = sorted(sets)

    def alike(a, b):
        if sets[a] and sets[b]:
            return 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])
        p, q = topics.get(a), topics.get(b)
        return p is not None and q is not None and sum(abs((u or 0) - (v or 0)) for u, v in zip(p, q)) <= 0.02

    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and alike(a, b):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {(i, find(i)) for i in ids if find(i) != i}


def test_alike_records(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    base = [list(rng.choice(words, rng.integers(3, 14), replace=False)) for _ in range(40)]
    texts = [(i, " ".join(rng.choice(b, max(1, int(len(b) * rng.uniform(0.5, 1))), replace=False))) for i, b in enumerate(base * 4)]
    texts += [(500 + i, "hot " + " ".join(words[:10]) + f" v{i % 40}") for i in range(80)]
    texts += [(700, None), (701, ""), (702, " "), (703, None), (704, texts[0][1].upper())]
    topics = {i: (rng.dirichlet([0.3] * 4)).round(3).tolist() for i, _ in texts}
    topics |= {700: topics[3], 701: [x + 0.004 for x in topics[3]], 702: None, 703: [0.25, None, 0.25, 0.5]}
    wiki = frame(spark, texts, "doc_id bigint, tokenized_text string")
    dist = frame(spark, list(topics.items()), "doc_id bigint, p array<double>")
    want = alike_by_brute_force(texts, topics)
    # the second goes through slices and passes over all rows, the third through splits by joins
    for block, few, most in ((4096, 2048, 1024), (16, 8, 1024), (16, 8, 2)):
        monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
        rows, leaves, counts = clusters.prepared(wiki, dist, few, most)
        assert {(r.node, r.root) for r in clusters.alike_groups(rows, leaves, counts).collect()} == want
        report = clusters.typical(leaves, 3).collect()
        assert sum({r.cluster: r.size for r in report}.values()) == len(texts) == leaves.select("doc_id").distinct().count()
        assert len({r.cluster for r in report}) > 1 and all(r.spread <= clusters.RADIUS for r in report)


def test_clusters_keep_to_the_radius(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"u{i}x{j}" for j in range(12))) for i in range(40)]
    shared = [[f"s{g}x{j}" for j in range(20)] for g in range(3)]
    texts += [(100 * (g + 1) + i, " ".join(s)) for g, s in enumerate(shared) for i in range(5)]
    wiki = frame(spark, texts, "doc_id bigint, tokenized_text string")
    dist = frame(spark, [(i, [1.0, 0.5 * (i < 20)]) for i, _ in texts], "doc_id bigint, p array<double>")
    rows, _, counts = clusters.prepared(wiki, dist)
    leaves = clusters.compact(rows, counts)
    report = clusters.typical(leaves).collect()
    assert all(r.spread <= clusters.RADIUS for r in report)
    assert sum({r.cluster: r.size for r in report}.values()) == len(texts)
    of = {r.doc_id: r.leaf for r in leaves.collect()}
    assert len(of) == len(texts) and len(set(of.values())) > 3
    assert all(len({of[100 * (g + 1) + i] for i in range(5)}) == 1 for g in range(3))
    part, far = clusters._settle(rng.normal(size=(300, 5)), 0.3)
    assert all(np.sqrt((far[part == k] ** 2).mean()) <= 0.3 for k in np.unique(part))


# 6


def test_parsimonious_models_favour_own_terms():
    n, back = np.array([5.0, 5.0, 1.0, 3.0]), np.array([0.3, 0.0001, 0.0001, 0.2])
    p = distinct.parsimonious(n, back, np.array([0, 3]))
    assert p[0] < 0.05 < p[1] and p[:3].sum() == pytest.approx(1) and p[3] == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(data=st.lists(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 400)), min_size=1, max_size=25), min_size=1, max_size=6))
def test_likeliest_terms_hold_the_best_score(data):
    n, d = (np.array([x[k] for o in data for x in o], "float64") for k in (0, 1))
    sizes = np.array(list(map(len, data)))
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(data)), sizes)
    p = distinct.parsimonious(n, d / 3000, starts)
    kept, score = distinct._likeliest(n, p, owner), n * np.log(500 / d)
    for k in range(len(data)):
        mine = np.flatnonzero(owner == k)
        best = set(mine[np.round(score[mine], 9) == np.round(score[mine].max(), 9)])
        assert best & set(kept) and all(i in kept for i in best if n[i] == max(n[list(best)]))
        one = distinct.parsimonious(n[mine], d[mine] / 3000, np.array([0]))
        assert np.array_equal(one, p[mine])


def test_scores_of_terms(spark):
    wiki = frame(spark, TEXTS, "doc_id bigint, tokenized_text string")
    latest = {i: unicodedata.normalize("NFC", t or "").lower().split() for i, t in TEXTS if i is not None}
    with_terms = {i: s for i, s in latest.items() if s}
    d = Counter(t for s in with_terms.values() for t in set(s))
    want = {(i, t, round(k * math.log(len(with_terms) / d[t]), 9)) for i, s in with_terms.items() for t, k in Counter(s).items()}
    assert {(r.owner_id, r.term, r.score) for r in distinct.record_terms(wiki).collect()} == want
    best = {r.owner_id: r.term for r in distinct.record_terms(wiki, best=True).collect()}
    assert best == {i: min((-s, t) for j, t, s in want if j == i)[1] for i in with_terms}
    assert distinct.record_terms(wiki.limit(0)).count() == 0
    topics = frame(spark, [(0, [0.5, None, 0.5]), (1, [0.5, 0.5, 0.0])], "topic_id int, p array<double>")
    vocab = frame(spark, [(0, "A"), (1, "b"), (2, None)], "word_id int, word string")
    got = {(r.owner_id, r.term): r.score for r in distinct.topic_terms(topics, vocab).collect()}
    assert got == {(0, "a"): 0.0, (0, "b"): 0.0, (1, "a"): 0.0, (1, "b"): round(0.5 * math.log(2), 9)}


# 7


@settings(max_examples=25, deadline=None)
@given(data=st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, None]), st.integers(0, 30), st.one_of(st.none(), st.floats(), st.sampled_from([0.0, 1.0, -1.0, 5e-324]))), max_size=60), n=st.integers(1, 5))
def test_top_n_of_any_scores(spark, data, n):
    want = {}
    for g, i, s in data:
        if s is not None and not math.isnan(s):
            want.setdefault(g, []).append((-s, i))
    df = spark.createDataFrame(data, "g int, item int, score double").withColumn("place", F.lit("clash"))
    got: dict = {}
    for r in topn.top_n(df, ["g"], "item", "score", n).orderBy("place").collect():
        got.setdefault(r.g, []).append((-r.score, r.item))
    assert got == {g: sorted(m)[:n] for g, m in want.items()}


def test_bins_never_fall(spark):
    x = sorted([0.0, -0.0, 1.0, -1.0, 5e-324, 1.7e308, math.inf, -math.inf, 0.3, 0.3000001, *np.random.default_rng(1).normal(size=200).tolist()])
    bins = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(topn.score_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


# 8


@needs_tokenizer
def test_ids_match_another_library_and_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = ["", " ", "plain text", "  two  spaces\n\nend ", "naïve café", "日本語" * 50, "a" * 70_000, "<|endoftext|>", "x1y2 'll don't\t​🎻", "word " * 20_000, None]
    df = frame(spark, [*enumerate(texts), (2, "plain text"), (None, "no id")], "doc_id bigint, text string")
    got = encode.encode(df).collect()
    assert Counter(r.doc_id for r in got)[2] == 2 and len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id]
            assert r.ids == (other.encode(text, add_special_tokens=False).ids if text else [])
            assert encode.text_of(encode.tokenizer(), r.ids).decode() == (text or "")
    assert {(r.doc_id, r.tokens) for r in encode.token_counts(df).collect()} == {(r.doc_id, len(r.ids)) for r in got}
    assert encode.encode(df.limit(0)).count() == 0


@needs_tokenizer
@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab1'.é　\x1c"), max_size=80))
def test_parts_never_change_the_ids(text):
    enc = encode.tokenizer()
    assert [i for p in encode.parts(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# 9


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=30))
def test_recipes_hold_exactly_the_items(histogram):
    used: Counter = Counter()
    total = 0
    for n, items in packing.recipes(histogram, 64):
        assert n > 0 and sum(k * m for k, m in items) <= 64
        total += n
        for k, m in items:
            used[k] += n * m
    assert used == Counter(histogram)
    need = math.ceil(sum(k * v for k, v in histogram.items()) / 64)
    assert total <= 1.7 * need + 1  # first fit decreasing stays within 11/9 of the best, which may exceed the volume


def test_places_in_containers(spark):
    rng = np.random.default_rng(2)
    sizes = [(i, int(s)) for i, s in enumerate(rng.geometric(0.05, 3000))] + [(5000, 0), (5001, None), (5002, 1000), (5003, 7), (5003, 7)] + [(6000 + i, 64) for i in range(1500)]
    got = packing.pack(frame(spark, sizes, "doc_id bigint, tokens bigint"), capacity=64).collect()
    where: dict = {}
    for r in got:
        if r.container_id is not None:
            where.setdefault(r.container_id, []).append((r.offset, r.size))
    for places in where.values():
        at = 0
        for offset, size in sorted(places):
            assert offset >= at
            at = offset + size
        assert at <= 64
    assert sum(r.size for r in got) == sum(s or 0 for _, s in sizes)
    assert {r.doc_id for r in got if r.n_pieces > 1} == {i for i, s in sizes if s and s > 64}
    assert len(where) <= 1.02 * math.ceil(sum(s or 0 for _, s in sizes) / 64)
    assert {r.doc_id for r in got if r.container_id is None} == {5000, 5001}
    assert packing.pack(frame(spark, sizes, "doc_id bigint, tokens bigint").limit(0)).count() == 0


# 10


def test_sentences():
    text = "A heading\n* One two three four. Five six seven eight!\n(1) Nine &amp; ten ele​ven twelve thirteen."
    assert [len(s) for s in subjects.sentences(text)] == [4, 4, 5]
    assert subjects.sentences(None) == [] == subjects.sentences(" \n ")


def test_subjects_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "subject_labels", "wikitext", "bills", "subject_areas")}
    areas = subjects.areas_of(t["subject_areas"])
    wiki = t["wikitext"].where("supercategory is not null and text is not null").dropDuplicates(["doc_id"])
    held = wiki.where("doc_id % 4 = 0")
    model = subjects.train(subjects.labelled(t["documents"], t["subject_labels"], wiki.where("doc_id % 4 <> 0"), t["bills"], areas, 900), areas)
    got = subjects.subject_counts(held, model).where("treated * 3 >= n_sentences").join(held.select("doc_id", F.lower("supercategory").alias("truth")), "doc_id").collect()
    right = {r.doc_id for r in got if r.subject == r.truth}
    assert len(right) > 0.85 * held.count() and len(got) < 1.15 * held.count()
    edge = frame(spark, [(1, None), (2, ""), (3, "No.")], "doc_id bigint, text string")
    assert subjects.subject_counts(edge, model).count() == 0
    none = subjects.labelled(t["documents"].limit(0), t["subject_labels"].limit(0), wiki.limit(0), t["bills"].limit(0), areas)
    assert subjects.subject_counts(held, subjects.train(none, areas)).count() == 0


def test_sentences_of_any_script_and_length():
    found = subjects.sentences("法院判决了合同纠纷。原告上诉！\nภาษาไทยไม่มีช่องว่าง\nCourts ruled. Yes.\nA heading\n<a " + "x" * 500 + ">four words are here")
    assert found[0][:3] == ["法院", "院判", "判决"] and found[1] == ["原告", "告上", "上诉"]
    assert found[-2:] == [["courts", "ruled"], ["four", "words", "are", "here"]] and len(found) >= 4
    assert len(subjects.features("ab" * 500)) == 1 + sum(1002 - n + 1 for n in subjects.SUBWORDS)


def test_subjects_in_a_script_without_spaces(spark):
    rng = np.random.default_rng(1)
    own = {"law": "法院判决合同原告上诉律师", "sport": "球队比赛进球冠军教练联赛"}
    text = lambda a: "".join("".join(rng.choice(list(own[a]), 9)) + "。" for _ in range(6))
    rows = spark.createDataFrame([(text(a), a) for a in own for _ in range(60)], "text string, subject string")
    model = subjects.train(rows, sorted(own))
    held = spark.createDataFrame([(i, text(a), a) for i, a in enumerate(["law", "sport"] * 20)], "doc_id bigint, text string, truth string")
    got = subjects.subject_counts(held, model).where("treated * 3 >= n_sentences").join(held.select("doc_id", "truth"), "doc_id").collect()
    assert len(got) == 40 and all(r.subject == r.truth for r in got)
    again = subjects.train(rows.repartition(7), sorted(own))
    assert np.abs(again.vectors - model.vectors).max() < 1e-2


def test_labelled_rows_keep_to_the_bound(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(300)], "doc_id bigint, text string")
    hand = frame(spark, [(i, "Law ") for i in range(200)] + [(5, "sport"), (6, None)], "doc_id bigint, subject string")
    wiki = frame(spark, [(i, f"wiki {i}", "sport") for i in range(400)] + [(None, "x", "law")], "doc_id bigint, text string, supercategory string")
    bills = frame(spark, [(i, f"bill {i}", "law") for i in range(100)], "doc_id bigint, summary string, topic string")
    for bound, hands in ((100, 0), (250, 199), (10_000, 199)):
        got = [r.text for r in subjects.labelled(docs, hand, wiki, bills, ["law", "sport"], bound).collect()]
        assert len(got) == len(set(got)) <= bound and len(got) >= min(0.9 * bound, 699)
        assert hands == 0 or sum(t.startswith("text") for t in got) == hands
