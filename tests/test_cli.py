"""The command line from features to report, the extractors, and settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry import cli, config
from facetry.operators import annotate, extract, sae
from facetry.sources import json_io


@pytest.fixture
def corpus(tmp_path):
    rng = np.random.default_rng(0)
    lines = [{"id": str(i), "text": " ".join(f"x{i % 4}a{rng.integers(9)}" for _ in range(5 + i % 7)), "tokenized_text": "a b c"} for i in range(40)]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, lines)))
    theta = [{"theta": [float(i % 4 == f) * (1 + i) for f in range(4)] + [0.0]} for i in range(40)]
    (tmp_path / "theta.json").write_text("\n".join(map(json.dumps, theta)))
    return tmp_path


def test_from_features_to_report(spark, corpus, capsys):
    run = lambda *a: cli.main(list(map(str, a)), spark)
    feats = ["--saved_features", corpus / "theta.json", "--feature_type", "sae"]
    data = f"wikitext:{corpus}/c.json"
    for method in ("random", "topk", "weighted", "stratified"):
        run("sample", *feats, "--sample_method", method, "--pos_k", 4, "--neg_k", 2, "--output_file", corpus / f"{method}.json")
        found = json.loads((corpus / f"{method}.json").read_text())
        assert set(found) == {"0", "1", "2", "3", "4"} and all(len(found[f]["pos"]) == 4 for f in "0123") and len(found["4"]["neg"]) == 2
    run("embed", "--dataset", data, "--model", "tests.plugins:encode", "--output_file", corpus / "e.json")
    vectors = json.loads((corpus / "e.json").read_text())
    assert len(vectors) == 40 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in vectors.values())
    for command in ("dpp", "score"):
        run(command, *feats, "--saved_embeddings", corpus / "e.json", "--k", 3, "--output_file", corpus / f"{command}.json")
        found = json.loads((corpus / f"{command}.json").read_text())
        assert (command == "score" or found["4"] == {"pos": {}, "neg": []}) and all(len(found[f]["pos"]) == 3 for f in "0123")
    run("sweep", *feats, "--saved_embeddings", corpus / "e.json", "--ks", 1, 2, "--alphas", 0.1, "--output_dir", corpus)
    assert len(json.loads((corpus / "pos2_neg0_dpp_alpha_0.1.json").read_text())["1"]["pos"]) == 2 and (corpus / "pos1_neg0_dpp_alpha_0.1.json").exists()
    run("label", *feats, "--dataset", data, "--samples", corpus / "topk.json", "--model", "tests.plugins:label", "--min_feature_size", 5, "--output_file", corpus / "l.json")
    found = json.loads((corpus / "l.json").read_text())
    assert found["3"]["topic"] == "no idea" and len(found["0"]["pos_docs"]) == 4
    # a feature's label is read from title, so these replies without one are kept as they are
    assert "name" in json.loads(found["0"]["topic"])
    labels = {f: {"pos_docs": [], "neg_docs": [], "topic": {"title": f"t{f}", "description": "d"}} for f in "012"} | {"3": {"topic": "raw"}, "4": {"topic": None}}
    (corpus / "l2.json").write_text(json.dumps(labels))
    run("judge", *feats, "--dataset", data, "--eval_samples", corpus / "topk.json", "--topic_annotations", corpus / "l2.json", "--model", "tests.plugins:judge", "--min_feature_size", 5, "--output_file", corpus / "v.json")
    found = json.loads((corpus / "v.json").read_text())
    assert set(found) == {"0", "1", "2"} and all(len(v["match"]["pos"]) == 4 and 0 <= v["recall"] <= 1 for v in found.values())
    run("report", *feats, "--evaluations", corpus / "v.json")
    assert "precision_mean" in capsys.readouterr().out
    run("topic-model", "--dataset", data, "--num_topics", 2, "--max_iterations", 3, "--output_file", corpus / "m.json")
    model = json.loads((corpus / "m.json").read_text())
    assert len(model["topic2word_dist"]) == 2 and len(model["doc2topic_dist"]) == 40 and len(model["topic2doc_dist"][0]) == 40 and sorted(model["vocab"]) == ["a", "b", "c"]
    run("topic-model", "--task", "eval", "--dataset", data, "--output_file", corpus / "m.json")
    run("sample", "--saved_features", corpus / "m.json", "--sample_method", "topk", "--output_file", corpus / "t.json")
    assert set(json.loads((corpus / "t.json").read_text())) == {"0", "1"}


def test_replies_are_asked_for_again(spark):
    calls = []

    def model(prompt):
        calls.append(prompt)
        return '{"name": "n"}' if len(calls) % 3 == 0 else "what?"

    rows = spark.createDataFrame([(1, "p")], "feature_id int, p string").coalesce(1)
    got = annotate.ask(rows, "p", model, 3, annotate._reads("name")).head()
    assert (got.reply, got.calls, got.ok) == ('{"name": "n"}', 3, True)
    got = annotate.ask(rows, "p", lambda p: "never", 3, annotate._reads("name")).head()
    assert (got.reply, got.calls, got.ok, got.error) == ("never", 3, False, None)
    got = annotate.ask(rows, "p", lambda p: 1 / 0, 2, annotate._reads("name")).head()
    assert (got.reply, got.calls, got.ok) == (None, 2, False) and got.error.startswith("ZeroDivisionError")


def test_artefacts(spark, corpus):
    assert [json_io.by_id(json_io.read_theta(spark, f"{corpus}/theta.json"), 2)["theta"][2], json_io.by_id(json_io.read_theta(spark, f"{corpus}/theta.json"), 99)] == [3.0, None]
    assert [r["doc_id"] for r in json_io.in_order(json_io.read_theta(spark, f"{corpus}/theta.json"))] == list(range(40))
    for i in (0, 1, 3):
        (corpus / f"batch-{i}.jsonl").write_text("")
    assert len(json_io.batches_to_gap(spark, f"{corpus}/batch-{{}}.jsonl")) == 2
    import pandas as pd

    assert json_io.from_pandas(spark, pd.DataFrame({"id": [1], "text": ["t"], "n": [0]})).head().text == "t"
    with pytest.raises(ValueError):
        json_io.Registry().add("x", "csv", "p")
    with pytest.raises(ValueError):
        json_io.Registry().read(spark, "x")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("mte:\n  gen: {do_chunking: true, chunk_size: 64, hf_token_env: X}\n  emb: {k: 5, embeddings_model: m}\n")
    s = config.settings("EMB", str(tmp_path / "c.yaml"), k=3)
    assert (s.do_chunking, s.chunk_size, s.k) == (True, 64, 3)
    assert config.settings("emb", str(tmp_path / "c.yaml")).k == 5
    for wrong in (lambda: config.settings("other"), lambda: config.settings("emb", nothing=1), lambda: config.load_section(str(tmp_path / "c.yaml"), "x")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(FileNotFoundError):
        config.load_section(str(tmp_path / "d.yaml"), "x")
    small = config.chunk_limits(config.Settings(chunk_size=128, chunk_overlap=32), 20)
    assert (small.chunk_size, small.chunk_overlap) == (20, 5)
    assert config.for_layer("24-gemma-16k", 7) == "7-gemma-16k"
    for i in range(7):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / f"facetry-test-2020-01-0{i + 1}.log").write_text("")
    log = config.logger("facetry-test", str(tmp_path / "logs"))
    log.info("x")
    assert len(list((tmp_path / "logs").glob("*.log"))) == 5


def test_embedding_extractor(spark, corpus, tmp_path):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdef"), 3 + i % 20))) for i in range(60)] + [(98, " "), (99, None)], "doc_id bigint, text string")
    ex = extract.create_extractor("Emb", lambda texts: [[t.count(c) for c in "abcdef"] for t in texts], do_chunking=True, chunk_size=8, chunk_overlap=2, n_features=12, k=3, doc_agg="mean")
    chunks, documents = ex.fit_transform(docs, str(tmp_path / "models"), str(tmp_path / "out"), save_chunks=True, epochs=3, batch_top=True, multi=0.1)
    held = chunks.collect()
    assert len({r.chunk_id for r in held}) == len(held) > 60 and all(len(r.token_ids) <= 8 for r in held)
    mean = {}
    for r in held:
        mean.setdefault(r.doc_id, []).append(r.theta)
    got = {r.doc_id: r.theta for r in documents.collect()}
    assert set(got) == set(range(60)) and all(np.allclose(got[i], np.mean(v, 0)) for i, v in mean.items())
    assert spark.read.json(str(tmp_path / "out/documents")).count() == 60
    again = sae.train_or_load(spark.createDataFrame([], "v array<double>"), 12, 3, str(tmp_path / "models"))
    assert again.threshold > 0 and again.k == 3
    plain = extract.chunked(docs, config.Settings(), model_limit=4).collect()
    assert len(plain) == 60 and max(len(r.token_ids) for r in plain) == 4
    with pytest.raises(ValueError):
        extract.create_extractor("other")


def test_activation_extractor(spark):
    def activate(chunks):
        tokens = chunks.select("doc_id", "chunk_idx", F.posexplode("token_ids").alias("pos", "token_id"))
        return tokens.withColumn("feature_id", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("act", (F.col("pos") + F.col("feature_id")).cast("double")).withColumn("valid", F.lit(True))

    extract.register("stand-in", activate)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a"), (3, "")], "doc_id bigint, text string")
    why = spark.createDataFrame([(2, "two")], "feature_id int, description string")
    ex = extract.create_extractor("LLM", "stand-in", do_chunking=True, chunk_size=3, chunk_overlap=0, top_tokens=2, explanations=why)
    chunks, documents = ex.fit_transform(docs)
    got = {r.doc_id: r for r in documents.collect()}
    assert got[1].theta == [2.0, 0.0, 4.0] and got[2].theta == [0.0, 0.0, 2.0] and set(got) == {1, 2}
    assert [(x.feature_id, x.feature_label, len(x.tokens)) for x in got[1].theta_sparse] == [(0, "<no explanation>", 2), (2, "two", 2), (0, "<no explanation>", 1), (2, "two", 2)]
    assert {r.num_features for r in chunks.collect()} == {3}
    with pytest.raises(ValueError):
        extract.backend("none")


def test_padding():
    assert extract.with_padding([[1], [1, 2]], None, 9).tolist() == [[1, 9], [1, 2]]
    assert extract.with_padding([[1], [1, 2]], 0, 9).tolist() == [[1, 0], [1, 2]]
