"""The ladder of causes, audits that do not fit, and alignment in little memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from termlake.operators import attribution as A
from termlake.operators import sequential as Q


def test_ladder(spark):
    rows = [("de", 1, True, "retrieved_on_time"), ("de", 2, False, "never_retrieved"), ("de", 3, False, "never_retrieved"), ("de", 4, False, "retrieved_late"), ("de", 5, False, "retrieved_on_time"), ("de", 6, False, "retrieved_on_time"),
            ("de", 7, False, "retrieved_on_time"), ("de", 8, False, "retrieved_late"), ("zh", 1, None, "retrieved_late"), ("zh", 2, True, "never_retrieved")]
    audit = [(2, "wrong_translation"), (3, "valid_paraphrase"), (4, "uncertain"), (5, "omitted_term"), (6, "wrong_translation"), (7, "uncertain"), (8, "valid_morphology"), (99, "uncertain")]
    gold = spark.createDataFrame(rows, "lang string, k int, exact_correct boolean, retrieval_status string")
    labels = spark.createDataFrame(audit, "k int, audit_label string").where("k <> 1")
    got = {r.lang: r.asDict() for r in A.attribution(A.with_audit(gold, labels, ["k"]), ["lang"]).collect()}
    de = got["de"]
    assert (de["gold"], de["correct"], de["accuracy"], de["morphology_accuracy"], de["semantic_accuracy"]) == (8, 1, 0.125, 0.25, 0.375)
    assert [de[f"stage_{x}"] for x in A.STAGES] == [2, 2, 3]
    assert {x: de[f"cause_{x}"] for x in A.CAUSES} == {"metric_false_negative": 2, "unaudited_exact_miss": 0, "retriever_miss": 1, "retrieved_late": 1, "retrieved_on_time_but_unused": 1, "retrieved_on_time_wrong_translation": 1, "uncertain": 1}
    assert got["zh"]["correct"] == 1 and got["zh"]["never_retrieved_correct"] == 1


@pytest.mark.parametrize(("audit", "says"), [([(1, "not_a_label")], "unsupported audit label"), ([(1, "uncertain"), (1, "uncertain")], "two audit rows")])
def test_audits_that_do_not_fit(spark, audit, says):
    gold = spark.createDataFrame([(1, False, "retrieved_late", "x")], "k int, exact_correct boolean, retrieval_status string, lang string")
    with pytest.raises(Exception, match=says):
        A.attribution(A.with_audit(gold, spark.createDataFrame(audit, "k int, audit_label string"), ["k"]), ["lang"]).collect()


def test_unknown_status(spark):
    gold = spark.createDataFrame([(False, "sometimes", "", "x")], "exact_correct boolean, retrieval_status string, audit_label string, lang string")
    with pytest.raises(Exception, match="unknown retrieval status"):
        A.attribution(gold, ["lang"]).collect()


def whole_table(ref, hyp):
    """Ends by the whole table of costs."""
    n, m = len(ref), len(hyp)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[-1][j] + 1, row[-1] + 1, cost[-1][j - 1] + (ref[i - 1] != hyp[j - 1])))
        cost.append(row)
    ends, j = [0] * n + [m], m
    for i in range(n, 0, -1):
        while j and cost[i][j] == cost[i][j - 1] + 1:
            j -= 1
        if j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            j -= 1
        ends[i - 1] = j
    return ends


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_the_whole_table(seed):
    g = np.random.default_rng(seed)
    ref, hyp = (g.integers(0, int(g.integers(2, 9)), int(g.integers(0, 40))) for _ in range(2))
    assert Q._alignment_ends(ref, hyp).tolist() == whole_table(ref.tolist(), hyp.tolist())


def test_long_talks_take_little_memory():
    g = np.random.default_rng(0)
    ref = g.integers(0, 500, 20_000).astype(np.int32)
    hyp = np.delete(ref, g.choice(20_000, 900, replace=False))
    tracemalloc.start()
    ends = Q._alignment_ends(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and ends[-1] == len(hyp) and (np.diff(ends) >= 0).all()


def test_resegment_rows(spark):
    df = spark.createDataFrame([("t", 0, "a b c", "a b"), ("t", 1, "d e", "c d"), ("t", 2, "", None), ("t", 3, "f", "e x f"), ("u", 0, None, None)], "talk string, sent_idx long, reference string, hypothesis string")
    assert {(r.talk, r.sent_idx): r.segment for r in Q.resegment(df).collect()} == {("t", 0): "a b c", ("t", 1): "d e x", ("t", 2): "", ("t", 3): "f", ("u", 0): ""}
