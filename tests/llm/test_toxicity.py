from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termlake.llm import toxicity

from ..conftest import SMALL


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=5, unique=True), st.lists(st.text("abcd", max_size=9), max_size=20))
def test_automaton_equals_brute_force(terms, words):
    allowed = lambda n: 0 if n < 3 else 1 if n < 6 else 2
    term, dist = toxicity.build_automaton(terms, allowed).match(words)
    for w, t, d in zip(words, term, dist, strict=True):
        near = [(distance(w, x), k) for k, x in enumerate(terms) if distance(w, x) <= allowed(len(x))] if w else []
        assert (t >= 0) == bool(near) and (not near or d == min(near)[0])


def test_states_are_met_anew_beyond_their_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 3)
    a = toxicity.build_automaton(["stupid", "worthless"], swaps=True)
    for _ in range(3):
        assert a.match(["stupid", "stpuid", "worthles", "tree"])[0].tolist() == [0, 0, 1, -1]
        assert a.match(["wortless", "stone"])[1].tolist() == [1, 0]


def test_held_out_quality(spark):
    """On the largest table of the tests: documents that the fit has not seen."""
    sf = SMALL.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(truth[r.doc_id], r.predicted) for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in truth]
    hit = sum(y and p for y, p in got)
    assert len(got) > 500 and hit >= 0.8 * sum(y for y, _ in got) and hit >= 0.8 * sum(p for _, p in got)


def planted():
    rng = np.random.default_rng(1)
    words = ["tree", "house", "river", "stone", "cloud", "green", "happy", "morning", "window", "garden"]
    texts, y = [], []
    for i in range(300):
        w = list(rng.choice(words, 30))
        if i % 3 == 0:
            w.insert(int(rng.integers(30)), "idiot")
            w.insert(int(rng.integers(30)), "moron")
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    return texts, y


def test_misspelled_and_quoted():
    model = toxicity.train(*planted())
    used, fuzzy, quoted, clean, empty = model.scores(pa.array(["you idiot moron river stone", "you idiott maron river stone", 'the word "idiot" and the word "moron" here', "river stone cloud", None]))
    assert used > 0.5 > quoted and used >= fuzzy > clean and clean < 0.5 and empty < 0.5


def test_held_out_and_edges(spark, edges, nothing):
    got = toxicity.query(spark, SMALL).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.predict(edges, toxicity.train_on(edges, labels)).count() == edges.count()
    assert toxicity.predict(nothing, toxicity.train_on(nothing, labels.limit(0))).count() == 0


def swapped_distance(a, b):
    """Edits, a swap of neighbours being one; no letter is edited twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=5, unique=True), st.lists(st.text("abcd", max_size=11), max_size=20))
def test_swaps_equal_brute_force(terms, words):
    term, dist = toxicity.build_automaton(terms, swaps=True).match(words)
    for w, t, d in zip(words, term, dist, strict=True):
        near = [(swapped_distance(w, x), k) for k, x in enumerate(terms) if swapped_distance(w, x) <= toxicity.edits(len(x))] if w else []
        assert (t >= 0) == bool(near) and (not near or d == min(near)[0])


def test_production_finds_swaps_and_two_edits():
    automaton = toxicity.train(*planted()).automaton
    assert (automaton.match(["idoit", "diiot", "mroon"])[0] >= 0).all()
    long = toxicity.build_automaton(["worthless", "stupid"], swaps=True)
    assert long.match(["worhtless", "wortlhess", "wurthlass", "stpuid", "wurthlasz"])[0].tolist() == [0, 0, 0, 1, -1]
