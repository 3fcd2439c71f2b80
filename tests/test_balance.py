"""Loads against those of the sequential greedy rule."""

from __future__ import annotations

import numpy as np
import pytest

from termlake.operators import balance as B


def greedy(groups):
    loads = {}
    for _, options, n in groups:
        if options:
            best = min(sorted(options), key=lambda o: (loads.get(o, 0) + n, loads.get(o, 0)))
            loads[best] = loads.get(best, 0) + n
    return loads


@pytest.mark.parametrize("seed", range(4))
def test_spread_is_within_one_group_of_the_sequential_rule(spark, seed):
    g = np.random.default_rng(seed)
    every = [1.92, 2.88, 3.84, 4.8]
    groups = [(k, sorted(g.choice(every, int(g.integers(1, 5)), replace=False).tolist()) if g.random() < 0.9 else every[:1], int(g.integers(1, 9))) for k in range(600)] + [(1000, [], 5), (1001, None, 5)]
    df = spark.createDataFrame(groups, "key int, options array<double>, n int").repartition(5)
    out = B.balanced(df, "key", "options", "n", "s").collect()
    assert len(out) == len(groups) and all((r.option in r.options) if r.options else r.option is None for r in out)
    loads = {}
    for r in out:
        if r.options:
            loads[r.option] = loads.get(r.option, 0) + r.n
    want, spread = greedy(groups), lambda x: max(x.values()) - min(x.values())
    assert spread(loads) <= spread(want) + 8
    again = {r.key: r.option for r in B.balanced(df.repartition(2), "key", "options", "n", "s").collect()}
    assert again == {r.key: r.option for r in out}


def test_quotas_are_even_where_sets_allow():
    q = B.even_quotas({("a",): 10.0, ("a", "b"): 10.0, ("a", "b", "c"): 10.0})
    loads = {o: sum(x.get(o, 0) for x in q.values()) for o in "abc"}
    assert all(abs(v - 10) < 1e-6 for v in loads.values())
    q = B.even_quotas({("a",): 30.0, ("a", "b"): 4.0})
    assert q["a", "b"] == {"a": 0.0, "b": 4.0}


def test_one_option_and_nothing(spark):
    df = spark.createDataFrame([(1, ["x"], 3), (2, ["x"], 4)], "key int, options array<string>, n int")
    assert {r.key: r.option for r in B.balanced(df, "key", "options", "n", "s").collect()} == {1: "x", 2: "x"}
    assert B.balanced(df.limit(0), "key", "options", "n", "s").count() == 0
