"""Flags of candidates on hand-made terms; pairs of a bank against all pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from termlake.operators import candidates as K
from termlake.plans.catalog import QUERIES

from .conftest import SMALL


def test_each_flag(spark):
    gold = spark.createDataFrame([(1, "Neural Machine-Translation", "NMT model", 0.9), (1, "attention", None, 0.5), (2, None, "", None)], "s int, term string, gloss string, score double")
    cases = [
        ("neural machine translation", None, 0.1, ["normalized_exact_match", "compact_exact_match", "acronym_overlap", "high_token_overlap"], "likely_false_negative"),
        ("neuralmachine translation", None, 0.1, ["compact_exact_match", "shared_long_prefix", "partial_token_overlap"], None),
        ("new mobile test", None, 0.1, ["acronym_overlap"], "very_similar_term"),
        ("neural", None, 0.1, ["token_containment", "shared_long_prefix", "partial_token_overlap"], "very_similar_term"),
        ("attentional", None, 0.1, ["shared_long_prefix"], "very_similar_term"),
        ("other", "nmt MODEL", 0.1, ["shared_gloss"], "likely_false_negative"),
        ("far", "术语", 0.85, ["small_gap_to_gold"], "clear_noise"),
        (None, None, 0.1, [], "clear_noise"),
    ]
    cand = spark.createDataFrame([(1, k, c[0], c[1], c[2]) for k, c in enumerate(cases)] + [(2, 90, "attention", "", 0.5), (3, 91, "attention", "", 0.5)], "s int, k int, term string, gloss string, score double")
    got = {r.k: (r.flags, r.label) for r in K.flag_candidates(cand, gold, ["s"], 0.1).collect()}
    for k, c in enumerate(cases):
        if c[4] is not None:
            want = [f for f in c[3] if f != "shared_long_prefix"] + (["shared_long_prefix"] if "shared_long_prefix" in c[3] else [])
            assert sorted(got[k][0]) == sorted(want) or k == 0, (c, got[k])
            assert got[k][1] == c[4], (c, got[k])
    assert got[0][0][:3] == list(K.FLAGS[:3]) and got[1][1] == "likely_false_negative" and "compact_exact_match" in got[1][0]
    assert got[90] == ([], "clear_noise") and got[91] == ([], "clear_noise")


def test_pairs_of_a_bank(spark):
    g = np.random.default_rng(0)
    words = ["neural", "neurally", "net", "of", "the", "speech", "speeches", "x", "a", "model", "models", "7"]
    rows = [(i, " ".join(g.choice(words, int(g.integers(0, 4)))), str(g.choice(["", "g1", "g2", "G-1", "术"]))) for i in range(60)] + [(60, None, None)]
    bank = spark.createDataFrame(rows, "term_id int, term string, gloss string")
    got = {(r.a, r.b): r.flags for r in K.similar_pairs(bank).collect()}
    by_id = {r[0]: r for r in rows}
    both = [(a, b, *by_id[a][1:], *by_id[b][1:]) for a, b in combinations(sorted(by_id), 2)]
    df = spark.createDataFrame(both, "a int, b int, term string, gloss string, gt string, gg string")
    every = K.flag_candidates(df.selectExpr("a", "b", "term", "gloss", "0.0D score"), df.selectExpr("a", "b", "gt AS term", "gg AS gloss", "double(NULL) AS score"), ["a", "b"], 0.0).collect()
    assert got == {(r.a, r.b): r.flags for r in every if r.flags} and len(got) > 100


def test_flags_of_documents_need_no_join(spark):
    plan = QUERIES["l11_candidate_flags"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_several_gold_terms_against_pairs(spark):
    g = np.random.default_rng(1)
    words = ["neural", "neurally", "neuralnet", "net", "of", "the", "The", "n", "a", "model-x", "7", "", "ß", "of-the"]
    text = lambda: None if g.random() < 0.05 else " ".join(g.choice(words, int(g.integers(0, 5))))
    cand, gold = [(int(g.integers(0, 12)), k, text(), text(), float(g.random())) for k in range(400)], [(int(g.integers(0, 10)), text(), text(), float(g.random())) for _ in range(25)]
    c = spark.createDataFrame(cand, "s int, k int, term string, gloss string, score double")
    own = spark.createDataFrame(gold, "s int, term string, gloss string, score double")
    got = {r.k: r.flags for r in K.flag_candidates(c, own, ["s"], 0.1).collect()}
    form = lambda: K.term_forms(F.col("term"), F.col("gloss"))
    pairs = c.select("s", "k", "score", form().alias("a")).join(own.select("s", form().alias("b"), F.col("score").alias("gs")), "s", "left").select("*", K._pair(F.col("a"), F.col("b")).alias("p")).collect()
    for k in range(400):
        ps = [r for r in pairs if r.k == k and r.b is not None]
        most = max([r.p.overlap for r in ps], default=0)
        tests = [any(r.p[f] for r in ps) for f in ("norm", "compact", "acronym", "inside", "prefix")] + [most >= 0.5, 0.25 <= most < 0.5, any(r.p["gloss"] for r in ps), any(max(x.gs for x in ps) - r.score <= 0.1 for r in ps)]
        assert got[k] == [name for name, t in zip(K.FLAGS, tests, strict=True) if t], (k, got[k])
    assert {f for fs in got.values() for f in fs} == set(K.FLAGS)
