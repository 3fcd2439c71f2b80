from __future__ import annotations

import numpy as np

from termlake.llm import vectors

from ..conftest import SMALL


def brute(rows, asked, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in asked:
        s = x @ x[ids == q][0]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = ids[keep][order].tolist()
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = found(vectors.query(spark, SMALL))
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.98


def test_ties_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 20)
    monkeypatch.setattr(vectors, "BLOCK", 2)
    g = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5, 0.0] if i % 3 == 0 else g.normal(size=4).round(2).tolist()) for i in range(90)]
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, float("nan"), 0.0, 0.0]), (160, [1.0, None, 0.0, 0.0]), (180, [float("inf"), 0.0, 0.0, 0.0]), (200, [1.0]), (220, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    assert found(vectors.search(df, df.where("vec_id % 20 = 0"), k=7)) == brute(rows, [0, 20, 40, 60, 80], 7)
    assert vectors.search(df, df.limit(0)).count() == 0 and vectors.search(df.limit(0), df).count() == 0
    few = df.where("vec_id < 3")
    assert [len(v) for v in found(vectors.search(few, few, k=20)).values()] == [2, 2, 2]


def test_anisotropic_codes_lower_parallel_error():
    x = np.random.default_rng(3).normal(size=(800, 8))
    error = lambda t: np.abs(np.einsum("nd,nd->n", x - (b := vectors.fit(x, t)).decode(vectors.pack(b.assign(x))), x / np.linalg.norm(x, axis=1, keepdims=True))).mean()
    assert error(0.6) < error(0.0)


def test_rows_of_one_id_count_once(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [1.0, 0.5]), (1, [5.0, 5.0]), (5, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score double, rank int")
    least = sorted({i: min(v for j, v in rows if j == i) for i, _ in rows}.items())
    assert found(vectors.search(df, df.where("vec_id % 20 = 0"), k=20)) == brute(least, [0, 20], 20)
    assert vectors.search(df, df.where("vec_id % 20 = 0"), k=20).columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_at_sf01(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(SMALL.replace("sf0.001", "sf0.1") + "/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = found(vectors.query(spark, SMALL.replace("sf0.001", "sf0.1")))
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.98
