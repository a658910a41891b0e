"""The trained operators and the search: inference against enumeration, odd inputs, time on malformed ones."""

import itertools
import math
import time

import numpy as np
import pytest

from facetgraph.llm import html_text, mixing, secrets, top_k, toxicity
from facetgraph.llm.labelled_pages import PAGES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def test_marginals_equal_enumeration():
    model = toxicity.ToxicityModel({"=bad": 2.0, "=worse": 3.5, "=mild": -1.0}, -1.5, [[0.4, -0.9], [-0.3, 0.8]], 1.0, 0.0)
    for text in ("bad", "a bad b c worse", "x y z mild bad q r", "worse worse w mild t u v bad k"):
        tokens = text.split()
        unary = [sum(model.weights.get(f, 0.0) for f in toxicity.features(t)) + model.bias for t in tokens]
        total, ones = 0.0, np.zeros(len(tokens))
        for labels in itertools.product((0, 1), repeat=len(tokens)):
            weight = math.exp(sum(u for u, y in zip(unary, labels) if y) + sum(model.moves[a][b] for a, b in itertools.pairwise(labels)))
            total += weight
            ones += weight * np.array(labels)
        got = dict(toxicity.Scorer(model).evidence(tokens)[1])
        assert set(got) == {i for i, t in enumerate(tokens) if t in ("bad", "worse", "mild")}
        assert all(abs(p - ones[i] / total) < 1e-9 for i, p in got.items())
        grid, _ = toxicity._posteriors(np.array([unary]), np.array(model.moves), np.ones(1))
        assert np.allclose(grid[0, :, 1], ones / total)


def test_nothing_is_toxic_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 9, 1.0, "x"), (1, None, None, None, 0, None, None), (None, "", "en", "a", 0, 1.0, "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.training_sample(docs, none))
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == 3 and all(0 <= r.score < 0.01 and r.spans == [] for r in rows)
    assert toxicity.score_documents(docs.limit(0), model).collect() == []


def test_toxic_spans_stand_in_the_text_itself(spark):
    rng = np.random.default_rng(1)
    pool = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    clean = [" ".join(rng.choice(pool, 12)) for _ in range(400)]
    rows = [(t, 0) for t in clean[:300]] + [(t.replace(" ", " lout ", 1), 1) for t in clean[300:]]
    model = toxicity.fit(rows, 0.2)
    docs = spark.createDataFrame([(1, "İİİ lout", "en", "a", 8, 0.0, ""), (2, clean[0], "en", "a", 11, 0.0, ""), (3, "well " * 40_000 + "LOUT", "en", "a", 1, 0.0, "")], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert [tuple(s) for s in got[1].spans] == [(4, 8)] and got[1].score > 0.5 > got[2].score
    assert tuple(got[3].spans[-1]) == (200_000, 200_004)


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a ="' * 200_000, '<a =">"' * 150_000, "<!" * 400_000, "<script>" * 100_000, "<div>" * 20_000 + "</p>" * 20_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<" * 500_000])
def test_malformed_pages_take_linear_time(page):
    start = time.process_time()
    html_text.parse(page)
    assert time.process_time() - start < 10


def test_main_text_keeps_formulas_and_odd_pages(spark):
    model = html_text.train(PAGES)
    page = '<article><h1>A &amp; B</h1><p>that <math>x = 2</math> holds, it is so.</p><p title="a > b">The <object>other</object> one, too.</p></article>'
    pages = spark.createDataFrame([(1, "u", page, "t", 3), (1, "u", page, "t", 3), (None, None, None, None, None), (2, "v", "", "t", 0), (3, "w", "no tag at all", "t", 0)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract_main_text(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(((r.page_id or 0, r.text, r.n_chars) for r in got.collect()))
    want = "A & B\nthat x = 2 holds, it is so.\nThe other one, too."
    assert rows[0] == (0, "", 0) and rows[1:3] == [(1, want, len(want))] * 2 and rows[3] == (2, "", 0)
    assert html_text.extract_main_text(pages.limit(0), model).collect() == []


def test_search_over_many_shards_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 40)
    monkeypatch.setattr(top_k, "BLOCK", 3)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)] + [(300 + i, [1.0] * 6) for i in range(12)]
    vectors = top_k.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4)
    got = {}
    for r in top_k.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    matrix = np.array([v for _, v in rows]).astype(int) * 4
    for q in range(0, 312, 50):
        scores = matrix @ matrix[q]
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(want)}
    assert top_k.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_a_blob_that_the_ledger_lists_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "xx password = abcdefghijklmnop token: qwertyuiopasdf", "en", "a", 1, 0.0, "")], SCHEMA)
    ledger = str(tmp_path / "ledger")
    once = secrets.findings(secrets.scan_new_blobs(docs, ledger)).collect()
    spark.read.parquet(ledger).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(ledger)
    assert len(once) == 2 and sorted(secrets.findings(spark.read.parquet(ledger)).collect()) == sorted(once)


def test_mix_of_rows_alike_at_the_cut(spark):
    rows = [(7, "one two three", "en", "a", 13, 0.5, "s")] * 9 + [(8, "four five", "en", "b", 9, 0.5, "s"), (9, " ", "en", "a", 1, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_sources(docs)
    taken = {r.source_size: r.t for r in plan.groupBy("source_size").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    out = mixing.mixed_documents(docs).collect()
    words = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in ("a", "b")}
    assert words == {"a": taken[27], "b": taken[2]} and out[0].asDict().keys() == set(docs.columns)
    parts = [len(r.text.split()) for r in out if r.source == "a" and r.text.split()]
    assert sum(n < 3 for n in parts) <= 1 and sum(r.doc_id == 9 for r in out) == 1
