"""Ranks and running sums over a whole table against plain Python, and that no plan has a window over one partition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.operators import ranks
from termlake.plans import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(0)
    data = [(i, int(g.integers(50)), "hot" if g.random() < 0.6 else str(g.integers(9)), None if i % 17 == 0 else int(g.integers(100))) for i in range(800)] + [(801, 1, None, 5), (802, 0, None, 6)]
    return data, spark.createDataFrame(data, "id int, a int, key string, v int").repartition(7)


def test_numbers_and_sums(spark, rows):
    data, df = rows
    got = {r.id: (r.n, r.s) for r in ranks.in_order(df, [F.desc("a"), F.col("id")], "n", {"v": "s"}).collect()}
    upto, want = 0, {}
    for k, r in enumerate(sorted(data, key=lambda r: (-r[1], r[0]))):
        upto += r[3] or 0
        want[r[0]] = (k + 1, upto)
    assert got == want


def test_numbers_within_keys(spark, rows):
    data, df = rows
    got = {r.id: r.n for r in ranks.in_order_within(df, ["key"], [F.col("a"), F.col("id")], "n").collect()}
    want = {r[0]: k + 1 for key in {r[2] for r in data} for k, r in enumerate(sorted((r for r in data if r[2] == key), key=lambda r: (r[1], r[0])))}
    assert got == want


def test_empty(spark, rows):
    out = ranks.in_order(rows[1].limit(0), [F.col("id")], "n", {"v": "s"})
    assert out.columns == ["id", "a", "key", "v", "n", "s"] and out.count() == 0
    assert ranks.in_order_within(rows[1].limit(0), ["key"], [F.col("id")], "n").count() == 0


@pytest.mark.parametrize("name", ["u05_u06_ordered_concat", "j03_j20_positive_ids_masked", "a24_w11_ranking_measures"])
def test_no_window_over_one_partition(spark, name):
    import contextlib
    import io

    df = catalog.QUERIES[name](spark, SMALL)
    df.count()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    tree = out.getvalue().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    for i, line in enumerate(tree):
        if "Window [" in line:
            below = [x for x in tree[i + 1 : i + 4] if depth(x) > depth(line)]
            assert not any("SinglePartition" in x for x in below), "\n".join(tree[i : i + 4])
