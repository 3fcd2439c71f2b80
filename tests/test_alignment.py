"""Term spans in word alignments: order of fallbacks, variants, anchors, chunk starts, even spread."""

from __future__ import annotations

import pytest

from termlake.operators import alignment as A
from termlake.plans import catalog

from .conftest import SMALL


def words(spark, *segs):
    rows = [(seg, i * 1.0, i + 0.5, w) for seg, line in segs for i, w in enumerate(line.split(" "))]
    return spark.createDataFrame(rows, "seg string, start double, end double, word string").repartition(3)


def spans(df):
    return {(r.seg, r.phrase): (r.how, r.first, r.last, r.start, r.end) for r in df.collect()}


def test_order_of_fallbacks(spark):
    al = words(spark, ("a", "The Trade offs of <eps> trade-offs, today's"), ("b", "a <unk> model ... runs"), ("c", "one two"), ("d", " . "))
    terms = [("a", 1, "trade-offs"), ("a", 2, "today"), ("a", 3, "absent"), ("a", 4, None), ("a", 5, "..."), ("b", 1, "zebra Model"), ("c", 1, "three"), ("d", 1, "x"), ("e", 1, "x")]
    t = spark.createDataFrame(terms, "seg string, phrase int, term string")
    said = spark.createDataFrame([("b", "A zebra model runs."), ("c", "one two three"), ("d", None), ("d", "")], "seg string, utterance string")
    # the whole variant tradeoffs stands later than the split one, but comes first
    assert spans(A.term_spans(al, t, said)) == {("a", 1): ("words", 5, 5, 5.0, 5.5), ("a", 2): ("words", 6, 6, 6.0, 6.5), ("b", 1): ("positional", 1, 2, 1.0, 2.5)}
    assert ("b", 1) not in spans(A.term_spans(al, t))


def test_anchors(spark):
    line = "x y z " + "w " * 10 + "x y z q " + "w " * 10 + "x y end"
    al = words(spark, ("a", line))
    t = spark.createDataFrame([("a", 0, "x y", "y z", 0), ("a", 1, "x y", "y z", 1), ("a", 2, "x y", "y z", 9), ("a", 3, "x y", "not here", 1), ("a", 4, "end", "y z", 0), ("a", 5, "x y", "z q", -3), ("a", 6, "x y", None, 2)], "seg string, phrase int, term string, chunk_text string, chunk_idx int")
    got = spans(A.term_spans(al, t, expand=2))
    assert {k[1]: v[:2] for k, v in got.items()} == {0: ("anchored", 0), 1: ("anchored", 13), 2: ("anchored", 13), 3: ("words", 0), 4: ("words", 29), 5: ("anchored", 13), 6: ("words", 0)}


def test_no_length_does_not_count_beside_an_anchor(spark):
    al = spark.createDataFrame([("a", 1.0, 1.0, "x"), ("a", 2.0, 2.5, "y")], "seg string, start double, end double, word string")
    t = spark.createDataFrame([("a", 0, "x", "x y", 0), ("a", 1, "y", "x y", 0)], "seg string, phrase int, term string, chunk_text string, chunk_idx int")
    assert spans(A.term_spans(al, t)) == {("a", 1): ("anchored", 1, 1, 2.0, 2.5)}
    assert set(spans(A.term_spans(al, t.drop("chunk_text")))) == {("a", 0), ("a", 1)}


def test_repeated_tokens_do_not_add_up(spark):
    al = words(spark, ("a", "b a b a a b c"))
    t = spark.createDataFrame([("a", 0, "a a"), ("a", 1, "a b a"), ("a", 2, "a b c"), ("a", 3, "b b"), ("a", 4, "b a b a a b c d")], "seg string, phrase int, term string")
    assert {k[1]: v[1:3] for k, v in spans(A.term_spans(al, t)).items()} == {0: (3, 4), 1: (1, 3), 2: (4, 6)}


def test_chunk_starts_and_places_in_chunks(spark):
    al = words(spark, ("a", "s t u v w x"))
    chunks = spark.createDataFrame([("a", 0, "S, t"), ("a", 1, "u v w x"), ("a", 2, "none"), ("a", 3, None)], "seg string, phrase int, chunk_text string")
    starts = A.chunk_starts(al, chunks, 2.0)
    # s t: middles 0.25 and 1.25, so [0, 0.25]; u..x: last middle 5.25 - 2 lies after the first middle 2.25
    assert {r.phrase: r.chunk_start for r in starts.collect()} == {0: 0.125, 1: 3.25}
    t = spark.createDataFrame([("a", 0, "t"), ("a", 1, "u"), ("a", 2, "v")], "seg string, phrase int, term string")
    got = {r.phrase: (r.duration, r.start_in_chunk, r.end_in_chunk) for r in A.spans_in_chunks(A.term_spans(al, t), starts, 2.0).collect()}
    assert got == {0: (0.5, 0.875, 1.375), 1: (0.5, None, None), 2: (0.5, None, None)}


def test_even_spread(spark):
    def split(n, chunks):
        each = max(1, n // chunks)
        parts = [list(range(n))[i * each : (i + 1) * each if i < chunks - 1 else n] for i in range(chunks)]
        return {k: i for i, part in enumerate(parts) for k in part}

    cases = [(n, c) for n in (1, 2, 5, 7, 12) for c in (1, 2, 3, 5, 9)]
    rows = spark.createDataFrame([(n * 100 + c, k) for n, c in cases for k in range(n)] + [(9999, 0), (9998, 0)], "key int, k int")
    chunks = spark.createDataFrame([(n * 100 + c, c) for n, c in cases] + [(9998, 0)], "key int, n_chunks int")
    got = {}
    for r in A.spread_evenly(rows, chunks, ["key"], "k").collect():
        got.setdefault(r.key, {})[r.k] = r.chunk_idx
    assert got == {n * 100 + c: split(n, c) for n, c in cases}


def test_one_shuffle_and_segments_over_several_batches(spark):
    al = words(spark, *[(seg, "a b " * 40 + "c") for seg in ("p", "q", "r")])
    chunks = spark.createDataFrame([(seg, k, "b a " * k + "b c") for seg in ("p", "q", "r", "s") for k in range(3)], "seg string, phrase int, chunk_text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        starts = A.chunk_starts(al, chunks, 2.0)
        got = {(r.seg, r.phrase): r.chunk_start for r in starts.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # 80.25 - 2 lies before the first word's middle for the phrase of two words only
    assert got == {(seg, k): 78.25 if k else 78.75 for seg in ("p", "q", "r") for k in range(3)}
    plan = starts._jdf.queryExecution().sparkPlan().toString() + starts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_whole_segments_are_as_their_rows(spark):
    """Several rows of one seg are one segment, also over batches; words, utterances and phrases may be null or empty."""
    rows = "seg string, words array<struct<start: double, end: double, word: string>>, phrases array<struct<phrase: int, term: string, chunk_text: string, chunk_idx: int>>, utterance string"
    said = lambda at, line: [(at + i, at + i + 0.5, w) for i, w in enumerate(line.split(" "))]
    data = [
        ("a", said(6.0, "d E's ... f"), [(2, "e f", "d e's f", 1)], "a b b c d e f"),
        ("a", said(0.0, "a b  b c"), [(0, "b-c", "b c d", None), (1, "b", "a b b", 0)], None),
        ("b", [(0.0, 0.5, None), (1.0, 1.5, "<unk>"), (2.0, 2.5, "y")], [(0, "X y", None, None), (1, None, "y", 2)], "x y"),
        ("c", None, [(0, "x", "x", 0)], "x"), ("d", said(0.0, "x"), None, "x"), ("e", said(0.0, "’ ."), [(0, "x", "x", 0)], ""), (None, said(0.0, "x"), [(0, "x", "x", 0)], "x"),
    ]
    whole = spark.createDataFrame(data, rows).coalesce(1).sortWithinPartitions("seg")
    al = whole.selectExpr("seg", "inline(words)").repartition(3)
    t = whole.selectExpr("seg", "inline(phrases)").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got, starts = spans(A.term_spans_of(whole)), A.chunk_starts_of(whole, 2.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == spans(A.term_spans(al, t, whole.select("seg", "utterance"))) and {k[0] for k in got} == {"a", "b"}
    assert got["a", 0][:3] == ("anchored", 2, 3) and got["a", 2][:3] == ("anchored", 5, 6) and got["b", 0][0] == "positional"
    assert sorted(starts) == sorted(A.chunk_starts(al, t, 2.0).collect()) and len(starts) == 4


@pytest.mark.parametrize("name", ["l14_alignment_term_spans", "l15_chunk_start_estimates"])
def test_only_texts_are_dealt(spark, name):
    """One shuffle of seg and text; no word or chunk has a row there."""
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution()
    physical = plan.sparkPlan().toString()
    assert "Generate" not in physical and "Join" not in physical and "Union" not in physical
    plan = plan.executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "transform" not in plan[plan.index("Exchange") :]
