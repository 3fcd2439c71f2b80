"""Golden cases of scalar functions, spans, masks, folds and plans."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from termlake.functions import text as X
from termlake.operators import bleu, conversation, interval, match, sequential


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def all_pairs(texts, terms, text="line", term="term"):
    """What ``term_match`` must give, by testing all pairs."""
    return texts.join(terms, X.source_contains(F.col(text), F.col(term)))


def test_casefold_of_all_letters(spark):
    letters = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x20000))) if c.casefold() != c or c in "ßıſς"]
    data = [(f"a{c}b",) for c in letters] + [("Straße ﬁx ΣΑΣ",), ("GROẞ",), ("İz",), (None,), ("",)]
    got = spark.createDataFrame(data, "s string").select("s", X.casefold(F.col("s")).alias("f")).collect()
    differ = [r.s for r in got if r.f != (None if r.s is None else r.s.casefold())]
    assert not [s for s in differ if s.lower().casefold() == s.casefold()], differ[:9]  # Java's and Python's lower case may differ


def test_containment(spark):
    c = lambda a, b: one(spark, X.source_contains(F.lit(a), F.lit(b)))
    assert c("The  Neural Model.", "neural model") and not c("neuralmodels", "neural model")
    assert c("use C++ now", "c++") and not c("anything", "") and c("术语学", "术语")
    assert not one(spark, X.text_contains(F.lit("abc"), F.lit("ABC")))


def test_token_spans(spark):
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    spans = lambda a, b: [(r.start, r.end) for r in one(spark, X.find_token_spans(a, b))]
    assert spans(arr("A", "Neural", "Model"), arr("neural", "model")) == [(1, 3)]
    assert spans(arr("neuralnet", "x"), arr("net")) == [(0, 1)]
    assert spans(arr("a", "b"), F.array().cast("array<string>")) == []


def test_mask_longest_first(spark):
    patterns = F.transform(F.array(F.lit("New York"), F.lit("York")), X.mask_pattern)
    r = one(spark, X.mask_terms(F.lit("new york and yorkshire meet York"), patterns))
    assert (r.text, r.removed) == ("and yorkshire meet", 2)
    r = one(spark, X.mask_terms(F.lit("术语和模型"), F.transform(F.array(F.lit("术语"), F.lit("模型")), X.mask_pattern)))
    assert (r.text, r.removed) == ("和", 2)


def test_term_map_round_trip(spark):
    block = "<audio>\n\nterm_map:\na=1\nA=2\n=x\nb=\nc=3=4"
    pairs = X.parse_term_map(F.lit(block))
    assert [(p.term, p.translation) for p in one(spark, pairs)] == [("a", "1"), ("A", "2"), ("c", "3=4")]
    assert one(spark, X.format_term_map(pairs)) == "term_map:\na=1\nc=3=4"
    assert [(p.term, p.translation) for p in one(spark, X.dedup_pairs(pairs, last=True))] == [("A", "2"), ("c", "3=4")]
    assert one(spark, X.format_term_map(X.parse_term_map(F.lit("term_map:NONE")), "none_block")) == "term_map:NONE"


def test_strip_tags(spark):
    for unit, text in (("word", "Das <term>Fachwort</term> ist korrekt"), ("char", "这是<term>术语</term>。")):
        r = one(spark, X.strip_output_tags(F.lit(text), "term", unit))
        assert (r.text, r.removed) == (text.replace("<term>", "").replace("</term>", ""), 2)


def test_casefold_equals_python(spark):
    import unicodedata

    chars = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if unicodedata.category(c) != "Cn"]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", X.casefold(F.col("c")).alias("f")).collect()
    assert sum(r.f != r.c.casefold() for r in got) == 0
    assert one(spark, X.term_key(F.lit(" ΟΔΟΣ Straße\n"))) == "οδοσ strasse"


def test_words_by_pattern_equal_words_one_by_one(spark):
    import random

    rng = random.Random(4)
    words = ["biases", "boxes", "ties", "cities", "gases", "glass", "bus", "is", "cats", "it's", "it's,", "xies", "churches", "as", "ses", "ABCs", "o'neils", "--", "es", "aes", "series", "1990s"]
    words += ["".join(rng.choices("aeishxzcy's", k=rng.randint(1, 7))) for _ in range(3000)]
    lines = [" ".join(rng.choices(words, k=8)) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    singly = F.transform(F.split(F.lower(X.normalise_space(F.col("s"))), " "), lambda w: X.singular(F.regexp_replace(F.regexp_replace(w, "'s$", ""), "[^a-z0-9']", "")))
    assert df.where(X.match_words(F.col("s")) != F.filter(singly, lambda w: w != "")).count() == 0


def test_term_match_equals_nested_loop(spark):
    lines = ["Die Straße in C++ und .NET", "our R&D, BR&D", "机器学习 模型", "naïve Ärger STRASSE", "x ÄRGER", "", "a-b c"]
    terms = ["strasse", "c++", ".net", "R&D", "学习", "学", "ärger", "Ä", "a-b", "&", "naïve ärger", "b"]
    rows, bank = spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([(x,) for x in terms], "term string")
    pairs = lambda df: sorted((r.line, r.term) for r in df.collect())
    assert pairs(match.term_match(rows, bank)) == pairs(all_pairs(rows, bank)) != []


def test_formatting_rounds_by_exact_value(spark):
    import random

    rng = random.Random(3)
    values = [0.5, 2.5, 0.00005, 0.03125, -0.03125, 0.09375, 247666.39125, 281618.51875, 1e15, 1.00005] + [rng.randrange(10**9) / 32 for _ in range(500)] + [rng.randrange(10**10) / 10**5 for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.format_metric(F.col("v")).alias("f"), X.format_metric(F.col("v"), 2, True).alias("g")).collect()
    assert [(r.f, r.g) for r in got] == [(f"{v:.4f}", f"{v:+.2f}") for v in values]


def test_alignment_over_windows_of_candidates():
    assert sequential.aligned(["a", "b", "a"], [{"a"}]) == 2
    assert sequential.aligned(["a", "b", "c"], [{"b", "c"}, {"a"}]) == 2 and sequential.aligned(["a"], []) == 0 == sequential.aligned([], [{"a"}])
    assert sequential.aligned(["a", "b", "c"], [{"x"}, {"a", "c"}, {"b"}, {"c"}]) == 3


def test_bleu_of_four_orders(spark):
    from collections import Counter
    from math import exp, log

    pairs = [("the cat sat on the mat today", "the cat sat on a mat"), ("a a a b", "a a b"), ("x", "x y z"), ("", "empty side")]
    grams = lambda w, n: Counter(zip(*(w[k:] for k in range(n))))
    m = [sum(sum((grams(h.split(), n) & grams(r.split(), n)).values()) for h, r in pairs) for n in (1, 2, 3, 4)]
    t = [sum(sum(grams(h.split(), n).values()) for h, _ in pairs) for n in (1, 2, 3, 4)]
    h, r = sum(len(a.split()) for a, _ in pairs), sum(len(b.split()) for _, b in pairs)
    want = 100 * min(1, exp(1 - r / h)) * exp(sum(log(a / b) for a, b in zip(m, t, strict=True)) / 4)
    df = spark.createDataFrame([("x", a.split(), b.split()) for a, b in pairs], "lang string, hyp array<string>, ref array<string>")
    assert abs(bleu.bleu(df, ["lang"]).first().bleu - want) < 1e-3


def test_stable_draw_equals_python(spark):
    import hashlib

    want = int(hashlib.sha256("\x1f".join(["s", "7", "é"]).encode()).hexdigest()[:16], 16)
    assert int(one(spark, X.stable_uint64(F.lit("s"), F.lit(7), F.lit("é")))) == want


def test_rounding_is_half_even(spark):
    assert one(spark, X.multiplier(F.lit(2.5 * 0.96))) == 2
    assert one(spark, X.multiplier(F.lit(0.1))) == 1


def test_match_equals_nested_loop(spark):
    texts = spark.createDataFrame([(1, "the neural model"), (2, "c++ and 术语"), (3, ""), (4, None)], "id int, line string")
    terms = spark.createDataFrame([("neural model",), ("the",), ("c++",), ("术语",), ("mode",)], "term string")
    key = lambda df: sorted((r.id, r.term) for r in df.collect())
    assert key(match.term_match(texts, terms)) == key(all_pairs(texts, terms)) == [(1, "neural model"), (1, "the"), (2, "c++"), (2, "术语")]


def test_overlap_join_has_no_doubles(spark):
    a = spark.createDataFrame([(1, 0.0, 100.0), (1, 5.0, 6.0)], "k int, a0 double, a1 double")
    b = spark.createDataFrame([(1, -3.0, 50.0), (1, 100.0, 101.0), (2, 0.0, 9.0)], "k int, b0 double, b1 double")
    assert sorted((r.a0, r.b0) for r in interval.overlap_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 3.0).collect()) == [(0.0, -3.0), (5.0, -3.0)]


def test_degradation_extremes(spark):
    h = spark.createDataFrame([(1, "a", True, 1), (1, "b", True, 2), (1, "c", False, 3)], "e int, term string, relevant boolean, pos int")
    for rate, want in ((0.0, 0), (1.0, 2)):
        rows = conversation.degrade(h, ["e"], rate, "s").collect()
        assert sum(r.replaced for r in rows) == want and len(rows) == 3


def test_history_boundary(spark):
    rows = spark.createDataFrame([(1, t) for t in range(9)], "c int, t int")
    loose, strict = (sorted(r.t for r in conversation.trim_history(rows, ["c"], "t", 4, 2, s).collect()) for s in (False, True))
    assert loose == strict == [6, 7, 8]


def test_bleu_identity(spark):
    rows = spark.createDataFrame([(1, "x", "a b c d e"), (2, "x", "f g h i j")], "id int, lang string, s string")
    t = rows.select("id", "lang", bleu.tokenize(F.col("s")).alias("hyp"), bleu.tokenize(F.col("s")).alias("ref"))
    assert bleu.bleu(t, ["lang"]).first().bleu == 100.0


def test_folds():
    assert sequential.aligned(["a", "b", "c"], [{x} for x in ["a", "c"]]) == 2
    assert sequential.aligned(["a", "b"], [{x} for x in ["b", "a"]]) == 1
    assert sequential.best_span("model", "a modle here")[0] > 0.7


def test_plans_push_down(spark):
    from .conftest import SMALL

    plan = spark.read.parquet(f"{SMALL}/lineitem.parquet").where("l_quantity > 40").groupBy("l_returnflag").count()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_overlap_free_occurrences(spark):
    both = F.concat(X.char_spans(F.lit("The of x the, others"), F.lit("the")), X.char_spans(F.lit("The of x the, others"), F.lit("the of")))
    assert [(r.start, r.end) for r in one(spark, X.pick_spans(both))] == [(0, 6), (9, 12)]
    assert one(spark, X.char_spans(F.lit("ab ab"), F.lit("ab"))) == []


def test_singular_words_are_found_from_their_ends(spark):
    rules = [(r"(?=[a-z0-9']{3,}s$)(?![a-z0-9']{2,}ies$)(?!(?=[a-z0-9']{5,}$)[a-z0-9']*(?:s|x|z|ch|sh)es$)([a-z0-9']{2,}[^sui])s$", r"\1"), (r"([a-z0-9']{2,})ies$", r"\1y"), (r"((?=[a-z0-9']{5,}$)[a-z0-9']*(?:s|x|z|ch|sh))es$", r"\1")]
    rng = random.Random(3)
    words = ["".join(rng.choice("sexizchua'1") for _ in range(rng.randint(1, 7))) + rng.choice(["", "s", "es", "ies", "ches", "xes", "ss"]) for _ in range(4000)]

    def plain(w):
        w = re.sub("'s$", "", w)
        for pattern, by in rules:
            w = re.sub(f"^{pattern}", by, w)
        return w

    df = spark.createDataFrame([(" ".join(words[i : i + 40]),) for i in range(0, 4000, 40)], "s string").select("s", X.match_words(F.col("s")).alias("w"))
    assert [w for r in df.collect() for w in r.w] == [x for x in map(plain, words) if x]
    assert "(?<![^ ])" not in df._jdf.queryExecution().optimizedPlan().toString()  # no pattern tries every word from its start
