from __future__ import annotations

from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termlake.llm import shingles
from termlake.llm.components import components

from ..conftest import SMALL


def brute(rows):
    """(n, component) of each row place by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 75 * len(sets[i] | sets[j]):
            a, b = part[i], part[j]
            part = [a if p == b else p for p in part]
    low = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in set(part)}
    return sorted(((r[0], len(s), low[p]) for r, s, p in zip(rows, sets, part, strict=True)), key=str)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingles.join(df).collect()), key=str)


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert joined(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_families_of_near_copies(spark):
    """Copies of a base that reach each other only through it, chains, boundary similarities and repeated rows."""
    g = np.random.default_rng(5)
    word = lambda: f"w{g.integers(10**9)}"
    rows = []
    for _ in range(4):
        base = [word() for _ in range(int(g.integers(40, 90)))]
        family = [base]
        for _ in range(25):
            w = list(family[0] if g.random() < 0.6 else family[int(g.integers(len(family)))])
            for _ in range(int(g.integers(0, 3))):
                w[int(g.integers(len(w)))] = word()
            family.append(w[: len(w) - int(g.integers(0, 4))])
        rows += [" ".join(w) for w in family]
    rows += ["a b c", "A B c", "a b", "", None]
    data = [(int(i), t) for i, t in zip(g.permutation(len(rows)), rows, strict=True)]
    assert joined(spark.createDataFrame(data, "doc_id long, text string").repartition(5)) == brute(data)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(0, 300), st.integers(0, 300))
def test_signatures_rule_out_no_link(seed, both, left, right):
    x = np.random.default_rng(seed).integers(0, 2**63, both + left + right, dtype=np.uint64)
    a, b = x[: both + left], np.concatenate((x[:both], x[both + left :]))
    if 100 * both >= 75 * (both + left + right):
        assert shingles.may_link(len(a), shingles.signature(a), len(b), shingles.signature(b))
    if both == 1 and min(left, right) > 60:
        assert not shingles.may_link(len(a), shingles.signature(a), len(b), shingles.signature(b))


def test_edges(edges, nothing):
    assert joined(edges) == brute([(r.doc_id, r.text) for r in edges.collect()])
    assert shingles.join(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a int, b int"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
