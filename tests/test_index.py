"""The stored neighbour index: exactness with eight bits, recall and volume with four, copies, hot cells, short banks."""

from __future__ import annotations

import numpy as np
import pytest

from termlake.operators import index as I
from termlake.session import shared_path

from .conftest import SMALL


def frames(spark, x, ids=None):
    rows = [(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    return df.selectExpr("id AS query_id", "vec"), df.selectExpr("id AS term_id", "vec")


def brute(x, k, itself):
    s = np.round(np.einsum("qd,nd->qn", x, x), 12)
    if not itself:
        np.fill_diagonal(s, -np.inf)
    return {i: [j for j in np.argsort(-row, kind="stable").tolist() if row[j] > -np.inf][:k] for i, row in enumerate(s)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.term_id)
    return out


@pytest.mark.parametrize("itself", [True, False])
def test_eight_bits_are_exact(spark, monkeypatch, itself):
    monkeypatch.setattr(I, "CELL_ROWS", 60)
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(size=(260, 5)), np.repeat(g.normal(size=(1, 5)), 140, 0), np.zeros((3, 5))])  # a third are copies
    q, b = frames(spark, x)
    index = I.build(b, shared_path(spark, "index"), bits=8)
    assert index.groups[:, 1].max() >= 2 and len(np.unique(index.groups[:, 0])) < len(index.groups)
    assert found(I.search(index, q, b, 7, itself=itself)) == brute(x, 7, itself)


def test_small_banks_and_no_queries(spark):
    x = np.random.default_rng(2).normal(size=(3, 4))
    q, b = frames(spark, x)
    index = I.build(b, shared_path(spark, "index"))
    assert found(I.search(index, q, b, 20, itself=False)) == brute(x, 20, False)
    assert found(I.search(index, q.limit(0), b, 20)) == {}
    with pytest.raises(ValueError, match="empty"):
        I.build(b.limit(0), shared_path(spark, "index"))


@pytest.mark.parametrize("bits", [4, 8])
def test_codes_stand_near_their_vectors(bits):
    x = np.random.default_rng(3).normal(size=(500, 7))
    centroids, low, step = I._fit(x, 9, bits)
    index = I.Index("", centroids, low, step, bits, np.zeros((9, 2), int))
    cell = index.nearest(x, 1)[:, 0]
    assert np.abs(x - index.decode(index.encode(x, cell), cell)).max() <= step.max() / 2 + 1e-9


def test_recall_and_volume_at_sf01(spark):
    """All rows as queries; what a query meets are codes of an eighth of a vector's bytes, in five of eight cells."""
    df = spark.read.parquet(SMALL.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    q, b = df.selectExpr("vec_id AS query_id", "embedding AS vec"), df.selectExpr("vec_id AS term_id", "embedding AS vec")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    want = brute(x, 10, False)
    index = I.build(b, shared_path(spark, "index"), bits=4)
    probes = -(-5 * len(index.centroids) // 8)
    got = found(I.search(index, q, b, 10, probes, itself=False))
    recall = np.mean([len(set(got.get(i, [])) & set(w)) / 10 for i, w in want.items()])
    codes = spark.read.parquet(f"{index.path}/codes")
    assert codes.count() == len(x)
    sizes = {r.cell: r["count"] for r in codes.groupBy("cell").count().collect()}
    met = np.mean([sum(sizes.get(int(c), 0) for c in cells) for cells in index.nearest(x, probes)]) / len(x)
    bytes_met = met * len(codes.first().code) / (4 * x.shape[1])
    reread = I._candidates(index, spark, q, 10, probes, False).count() / len(x) ** 2
    print(f"recall {recall:.3f}, rows met {met:.3f}, bytes met {bytes_met:.3f}, candidates {reread:.3f}")
    assert recall >= 0.9 and bytes_met + reread < 0.2


def test_queries_meet_codes_by_blocks(spark, monkeypatch):
    """No group of a task holds all queries; candidates of hot copies leave it tile by tile."""
    monkeypatch.setattr(I, "QUERY_ROWS", 50)
    monkeypatch.setattr(I, "QUERY_TILE", 7)
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(size=(150, 5)), np.repeat(g.normal(size=(1, 5)), 70, 0)])
    q, b = frames(spark, x)
    index = I.build(b, shared_path(spark, "index"), bits=8)
    near = I._candidates(index, spark, q, 7, None, False)
    assert "block" in near._jdf.queryExecution().optimizedPlan().toString()
    assert found(I.search(index, q, b, 7, itself=False)) == brute(x, 7, False)


def test_candidates_are_scored_where_their_codes_are(spark, monkeypatch):
    """What leaves a task are its best answers, not candidates; no query has a row for each group of codes."""
    monkeypatch.setattr(I, "CELL_ROWS", 60)
    monkeypatch.setattr(I, "TOGETHER", 3)
    monkeypatch.setattr(I, "QUERY_ROWS", 100)
    x = np.random.default_rng(6).normal(size=(400, 5))
    q, b = frames(spark, x)
    index = I.build(b, shared_path(spark, "index"), bits=4)
    groups = int(index.groups.sum(1).max())
    near = I._candidates(index, spark, q, 7, None, False, b)
    assert groups > 3 and near.count() <= len(x) * 7 * -(-groups // 3) < I._candidates(index, spark, q, 7, None, False).count()
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    got = found(I.search(index, q, b, 7, itself=False))
    assert np.mean([len(set(got[i]) & set(w)) / 7 for i, w in brute(x, 7, False).items()]) > 0.99
