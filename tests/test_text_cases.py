"""Cases of text functions with their expected results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termlake.functions import text as X

CASES = {}


def _cases(name, kinds, cases, column):
    CASES[name] = (kinds, cases, column)


_cases(
    "term_key", {"s": "string", "key": "string"},
    [("  Straße ", "strasse"), ("STRASSE", "strasse"), ("ΣΊΣΥΦΟΣ", "σίσυφοσ"), ("ﬁne", "fine"), ("İz", "i̇z"), ("ÀÉ\tx\u3000", "àé\tx"), ("ſ", "s"), ("", "")],
    lambda: X.term_key(F.col("s")),
)
_cases(
    "source_contains", {"text": "string", "term": "string", "found": "int"},
    [("Die  STRASSE dort", "straße", 1), ("Hauptstraße", "Straße", 0), ("our R&D here", "r&d", 1), ("our BR&D here", "R&D", 1), ("C++11 code", "c++", 0), ("C++ code", "c++", 1), ("a .NET app", ".net", 1),
     ("x", " ", 0), ("机器学习模型", "学习", 1), ("Neural\n model", "neural  model", 1), ("neural models", "neural model", 0)],
    lambda: X.source_contains(F.col("text"), F.col("term")).cast("int"),
)
_cases(
    "strip_output_tags", {"text": "string", "mode": "string", "unit": "string", "out": "string"},
    [("Das <term>Fachwort</term> ist <TERM>korrekt</term >", "term", "char", "4 Das Fachwort ist korrekt"), ("Das < term >Fachwort</ TERM > ist  x", "term", "char", "2 Das Fachwort ist  x"),
     ("Das < term >Fachwort</ TERM > ist", "term", "word", "0 Das < term >Fachwort</ TERM > ist"), ("ein <term>Wort</term>  <term>", "term", "word", "3 ein Wort"), ("a <t>b</t> <term>c</term>", "term", "word", "2 a <t>b</t> c"),
     ("a <t>b</t> <term>c</term>", "term_t", "word", "4 a b c"), ("<term>KI</term> -Modell und <term>x</term> , y ( <term>z</term> )", "term", "char", "6 KI-Modell und x, y (z)"), ("这是<term>术语</term> 。", "term", "char", "2 这是术语。"),
     ("cut <term off <termx>", "term", "char", "2 cut  off x>"), ("keep <term>", "none", "char", "0 keep <term>"), (None, "term", "char", "0 ")],
    lambda: F.concat_ws(" ", *(F.when(F.col("mode") == m, F.when(F.col("unit") == "word", X.strip_output_tags(F.col("text"), m, "word")[f].cast("string")).otherwise(X.strip_output_tags(F.col("text"), m)[f].cast("string"))) for f in ("removed", "text") for m in ("none", "term", "term_t"))),
)
_cases(
    "mask", {"text": "string", "terms": "array<string>", "out": "string"},
    [("our R&D and BR&D budget", ["R&D"], "1 our and BR&D budget"), ("top-5% and p95%", ["5%"], "1 top- and p95%"), ("New  York and Yorkshire, york", ["new york", "York"], "2 and Yorkshire,"), ("f(x) and f(x)y", ["f(x)"], "1 and f(x)y"),
     ("和平 和 平和", ["和"], "1 和平 平和"), ("术语和模型", ["术语", "模型"], "2 和"), ("Ärger ärger", ["ÄRGER"], "2 "), ("no such thing", ["absent"], "0 no such thing")],
    lambda: F.concat_ws(" ", *(X.mask_terms(F.col("text"), F.transform("terms", X.mask_pattern))[f].cast("string") for f in ("removed", "text"))),
)
_cases(
    "term_class", {"term": "string", "kind": "string"},
    [("GPU-based", "acronym_or_symbolic_name"), ("state-of-the-art", "multiword_expression"), ("McDonald", "acronym_or_symbolic_name"), ("BERT2", "acronym_or_symbolic_name"), ("Neural", "single_word_term"), ("A", "single_word_term"),
     ("x²", "acronym_or_symbolic_name"), ("术语", "single_word_term"), ("machine learning", "multiword_expression"), ("A b", "multiword_expression"), ("n-Gram", "multiword_expression")],
    lambda: X.term_class(F.col("term")),
)


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    kinds, cases, column = CASES[name]
    schema = ", ".join(["k int", *(f"{c} {kind}" for c, kind in list(kinds.items())[:-1])])
    rows = spark.createDataFrame([(k, *c[:-1]) for k, c in enumerate(cases)], schema).select("k", column().alias("out")).collect()
    assert {r.k: r.out for r in rows} == {k: c[-1] for k, c in enumerate(cases)}
