"""Retrieval queries against brute force over all rows of the smallest embeddings table."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from termlake.plans import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def bank():
    """ids, labels and the scores of all pairs, -inf of a row with itself."""
    rows = duckdb.sql(f"SELECT vec_id, label, embedding::DOUBLE[] FROM '{SMALL}/embeddings.parquet' ORDER BY 1").fetchall()
    x = np.array([r[2] for r in rows])
    score = np.round(np.einsum("qd,nd->qn", x, x), 12)
    np.fill_diagonal(score, -np.inf)
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), score


def test_top_k_of_all_rows(spark, bank):
    ids, _, score = bank
    got = {(r.query_id, r["rank"]): r.term_id for r in catalog.QUERIES["t01_t02_j25_top_k"](spark, SMALL).collect()}
    want = {(int(q), k + 1): int(ids[n]) for q, row in zip(ids, score, strict=True) for k, n in enumerate(np.argsort(-row, kind="stable")[:10])}
    assert got == want


def test_hard_negatives_of_all_rows(spark, bank):
    ids, label, score = bank
    got = {(r.query_id, r["rank"]): r.term_id for r in catalog.QUERIES["t06_hard_negatives_masked"](spark, SMALL).collect()}
    other = np.where(label[:, None] != label[None, :], score, -np.inf)
    assert got == {(int(q), k + 1): int(ids[n]) for q, row in zip(ids, other, strict=True) for k, n in enumerate(np.argsort(-row, kind="stable")[:5])}


def test_every_row_is_found_and_counted(spark, bank):
    got = {r.query_id: r.n for r in catalog.QUERIES["t09_answers_of_each_query"](spark, SMALL).collect()}
    assert got == {int(q): len(bank[0]) - 1 for q in bank[0]}


def test_recall_of_all_rows(spark, bank):
    ids, label, score = bank
    first = [next((k + 1 for k, n in enumerate(np.argsort(-row, kind="stable")[:50]) if label[n] == label[i]), None) for i, row in enumerate(score)]
    got = catalog.QUERIES["a25_recall_at_k"](spark, SMALL).first()
    assert got.queries == len(ids) and abs(got.recall_1 - np.mean([r == 1 for r in first])) < 2e-6
    assert abs(got.recall_10 - np.mean([r is not None and r <= 10 for r in first])) < 2e-6 and abs(got.mrr - np.mean([1 / r if r else 0 for r in first])) < 2e-6


def test_modes_over_all_windows(spark, bank):
    ids, _, score = bank
    got = {(r.stream, r.term_id): (r.soft, r.lse) for r in catalog.QUERIES["t07_similarity_modes"](spark, SMALL).collect()}
    assert len(got) == len({q // 100 for q in ids}) * len(ids)
    late = {}
    for stream in sorted({int(q) // 100 for q in ids}):
        for n, term in enumerate(ids.tolist()):
            s = score[ids // 100 == stream, n]
            s = s[s > -np.inf]
            e = np.exp(s / 0.1)
            assert abs(got[stream, term][0] - (e * s).sum() / e.sum()) < 2e-6 and abs(got[stream, term][1] - 0.1 * np.log(e.sum())) < 2e-6
            late.setdefault((stream, term % 7), []).append(s.max())
    rows = catalog.QUERIES["t07_late_interaction"](spark, SMALL).collect()
    assert len(rows) == len(late) and all(abs(r.score - np.mean(late[r.stream, r.term])) < 2e-6 for r in rows)


def test_distribution_over_the_whole_bank(spark, bank):
    _, label, score = bank
    same = label[:, None] == label[None, :]
    pos, neg = np.where(same, score, -np.inf).max(1), np.where(~same, score, -np.inf).max(1)
    got = catalog.QUERIES["a38_similarity_distribution"](spark, SMALL).first()
    want = {"n": len(label), "pos_mean": pos.mean(), "neg_median": np.median(neg), "gap_mean": (pos - neg).mean(), "gap_p10": np.quantile(pos - neg, 0.1)}
    assert all(abs(got[k] - v) < 2e-6 for k, v in want.items())


def test_ranks_in_the_whole_bank(spark, bank):
    from termlake.operators import vector as V

    ids, _, score = bank
    got = {(r.query_id, r.term_id): r["shift"] for r in catalog.QUERIES["l12_rank_shift"](spark, SMALL).collect()}
    want = {}
    for q, row in zip(ids.tolist(), score, strict=True):
        even = np.where(ids % 2 == 0, row, -np.inf)
        for n in np.argsort(-even, kind="stable")[:10]:
            want[q, int(ids[n])] = int((row > row[n]).sum() - (even > row[n]).sum())
    assert got == want
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id", "embedding AS vec")
    last = [(int(q), int(ids[n]), float(row[n])) for q, row in zip(ids[:5], score[:5], strict=True) for n in [np.argsort(-row, kind="stable")[400]]]
    ranks = V.ranks_of(spark.createDataFrame(last, "query_id long, term_id long, score double"), e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "term_id"), 2, 3)
    assert {r["rank"] for r in ranks.collect()} == {401}


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e18])
def test_tiles_leave_every_answer(spark, monkeypatch, scale):
    """Many copies, scores that differ in the last places only, values that single precision can't hold; tiles smaller than a block."""
    from termlake.operators import vector as V

    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(90, 6)), np.repeat(g.normal(size=(1, 6)), 60, 0), np.zeros((2, 6))])
    x[90:120, 0] += np.arange(30) * 1e-9
    x[150:] *= scale
    x[:3] *= scale
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = V.top_similar(rows.selectExpr("id AS query_id", "vec"), rows.selectExpr("id AS term_id", "vec"), 12, 2, 2, itself=False)
    score = np.round(np.einsum("qd,nd->qn", x, x), 12)
    np.fill_diagonal(score, -np.inf)
    want = {(i, k + 1): int(j) for i, row in enumerate(score) for k, j in enumerate(np.argsort(-row, kind="stable")[:12])}
    assert {(r.query_id, r["rank"]): r.term_id for r in got.collect()} == want


def test_few_pairs_are_scored_twice():
    from termlake.operators import vector as V

    x = np.random.default_rng(6).normal(size=(20_000, 16))
    rows, slack, products = next(V.rough_tiles(x, x, lambda *_: None))
    for at, rough in products:
        true = x[rows] @ x[at : at + rough.shape[1]].T
        assert rough.dtype == np.float32 and np.abs(rough - true).max(1).max() <= slack.min() and slack.max() < 1e-3


def test_counts_of_answers_score_nothing(spark):
    plan = catalog.QUERIES["t09_answers_of_each_query"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Join" in plan


def test_blocks_are_shuffled_once(spark, monkeypatch):
    """A row is written as one row, however many blocks of the other side its own meets; blocks merge in a task."""
    from termlake.operators import vector as V

    monkeypatch.setattr(V, "TOGETHER", 2)
    x = np.round(np.random.default_rng(5).normal(size=(90, 6)), 2)
    rows = spark.createDataFrame([(i, v.tolist(), i // 10) for i, v in enumerate(x)], "id long, vec array<double>, stream long")
    q, b = rows.selectExpr("id AS query_id", "vec", "stream"), rows.selectExpr("id AS term_id", "vec")
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    out = V.top_similar(q.drop("stream"), b, 4, 3, 5, itself=False)
    assert sorted((r.query_id, r["rank"], r.term_id) for r in out.collect()) == [(i, k + 1, j) for i in range(90) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:4].tolist())]
    modes = V.window_scores(q, b, 3, 5)
    got = {(r.stream, r.term_id): r.best for r in modes.collect()}
    assert len(got) == 9 * 90 and all(abs(v - s[i * 10 : i * 10 + 10, j].max()) < 1e-9 for (i, j), v in got.items())
    plan = modes._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
