from __future__ import annotations

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termlake.llm import centroids

from ..conftest import SMALL, rows_of


def brute(rows, k=8, rounds=10):
    """Rows of the query by Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    mark = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=mark)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        sums = {n: [sum(x) // own.count(n) for x in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == n], strict=True)] for n in set(own)}
        cents = [sums.get(n, c) for n, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), marks[c]) for i, d, c in found), key=str)


def got(df):
    return sorted(map(tuple, centroids.cluster(df).collect()), key=str)


def test_oracle(spark, duck):
    assert rows_of(centroids.query(spark, SMALL).toPandas()) == rows_of(duck.execute(centroids.ORACLE).df())


def test_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert got(rows) == brute([(r.vec_id, r.embedding) for r in rows.collect()])


def test_copies_ties_and_unusable_vectors(spark):
    g = np.random.default_rng(0)
    same, zero = [0.5] * 64, [0.0] * 64
    rows = [(i, same if i % 3 == 0 else g.integers(-2, 3, 64).astype(float).tolist()) for i in range(60)] + [(3, same), (3, zero), (None, zero), (None, same)]
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [1.0] * 63 + [float("nan")]), (106, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, cluster int, v string, n int").repartition(4)
    assert got(df) == brute(rows)
    assert got(df.where("vec_id >= 100")) == [] and got(df.limit(0)) == []
    few = [(7, same), (8, zero), (9, zero)]
    assert got(spark.createDataFrame(few, "vec_id long, embedding array<double>")) == brute(few)
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toPandas())
    assert len(con.execute(centroids.ORACLE).fetchall()) == len(brute(rows))


def test_huge_components_count_as_the_bound(spark):
    df = spark.createDataFrame([(1, [1e30] + [0.0] * 63), (2, [-1e30] * 64), (3, [0.1] * 64)], "vec_id long, embedding array<double>")
    assert {r[0]: r[2] for r in got(df)} == {1: 0, 2: 0, 3: 0}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 40))
def test_partial_distances_give_up_no_winner(seed, k, n):
    g = np.random.default_rng(seed)
    x, c = g.integers(-3, 4, (n, 64)), g.integers(-3, 4, (k, 64))
    c[k // 2] = c[0]  # a tie
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    best, d = centroids.nearest(x, c, g.permutation(64))
    assert best.tolist() == every.argmin(1).tolist() and d.tolist() == every.min(1).tolist()
