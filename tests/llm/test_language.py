from __future__ import annotations

import numpy as np

from termlake.llm import language

from ..conftest import SMALL


def test_chain_equals_brute_force():
    g = np.random.default_rng(0)
    n, k = 700, 3
    e, move, reset = g.random((n, k)) + 0.01, g.random((k, k)) + 0.01, g.random(n) < 0.05
    reset[0] = True
    alpha, beta = language.forward_backward(e, move, reset)
    v = None
    for t in range(n):
        v = (np.full(k, 1 / k) if reset[t] else v @ move) * e[t]
        v = v / v.sum()
        assert np.allclose(v, alpha[t])
    v = np.full(k, 1 / k)
    for t in range(n - 1, -1, -1):
        assert np.allclose(v, beta[t])
        v = np.full(k, 1.0) if reset[t] else move @ (e[t] * v)
        v = v / v.sum()


def test_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = [r for r in language.query(spark, SMALL).collect() if r.held_out]
    assert np.mean([want[r.doc_id] == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_switches_inside_a_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train_on(docs)
    one = {r.lang: r.text for r in docs.where("n_chars between 300 and 2000").collect()}
    en, de = " ".join(one["en"].split()[:40]), " ".join(one["de"].split()[:40])
    tags = [y for _, y, _ in language.word_languages(model, f"{en} {de}") if y != "und"]
    assert tags[: len(tags) // 3].count("en") > 0.8 * (len(tags) // 3) and tags[-(len(tags) // 3) :].count("de") > 0.8 * (len(tags) // 3)


def test_edges(spark, edges, nothing):
    model = language.train_on(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {(r.doc_id, r.lang_pred) for r in language.predict(edges, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (10, "und")} <= got and language.predict(edges, model).count() == edges.count()
    assert language.predict(nothing, language.train_on(nothing)).count() == 0
    assert {r.lang_pred for r in language.predict(edges, language.train_on(nothing)).collect()} == {"und"}
    kept = language.keep(edges, model)
    assert kept.columns == edges.columns and not {4, 5, 6, 10} & {r.doc_id for r in kept.collect()}
