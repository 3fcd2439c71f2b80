"""Labels of retrieved candidates by what they share with their sample's gold terms, and all pairs of a bank that share something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Words that an acronym leaves out, and flags in order.
STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
FLAGS = ("normalized_exact_match", "compact_exact_match", "acronym_overlap", "token_containment", "shared_long_prefix", "high_token_overlap", "partial_token_overlap", "shared_gloss", "small_gap_to_gold")
SAME, NEAR = ("normalized_exact_match", "compact_exact_match", "shared_gloss"), ("high_token_overlap", "token_containment", "shared_long_prefix", "acronym_overlap", "partial_token_overlap")
#: Least length of a shared prefix of terms without spaces, and its least share of the shorter.
PREFIX, PREFIX_SHARE = 6, 0.7
HIGH, PARTIAL = 0.5, 0.25


def _words(text: Column) -> Column:
    """The words of a text (runs of a-z and digits, in lower case), with one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _own(norm: Column) -> Column:
    """A term's words without stop words."""
    return F.trim(F.regexp_replace(norm, f"(?<![^ ])(?:{'|'.join(STOP_WORDS)})(?: |$)", ""))


def _acronym(own: Column) -> Column:
    """The first letters of several words; one word as it is."""
    return F.when(F.contains(own, F.lit(" ")), F.regexp_replace(own, "([a-z0-9])[a-z0-9]*(?: |$)", "$1")).otherwise(own)


def _compact(norm: Column) -> Column:
    return F.replace(norm, F.lit(" "), F.lit(""))


def term_forms(term: Column, gloss: Column) -> Column:
    """struct<norm, compact, acronym, tokens, gloss>: what flags compare."""
    return let(_words(term), lambda norm: F.struct(norm.alias("norm"), _compact(norm).alias("compact"), _acronym(_own(norm)).alias("acronym"), F.array_remove(F.array_distinct(F.split(norm, " ")), "").alias("tokens"), _words(gloss).alias("gloss")))


def _long_prefix(a: Column, b: Column) -> Column:
    """Whether two terms without spaces begin alike for long enough."""
    least = F.least(F.length(a), F.length(b))
    need = F.greatest(F.lit(PREFIX), F.ceil(least * PREFIX_SHARE - 1e-9).cast("int"))
    return (least >= PREFIX) & (F.substring(a, F.lit(1), need) == F.substring(b, F.lit(1), need))


def _pair(a: Column, b: Column) -> Column:
    """Which of the flags two terms have, and the overlap of their tokens."""
    same = lambda f: (a[f] != "") & (a[f] == b[f])
    shared, both = F.size(F.array_intersect(a["tokens"], b["tokens"])), F.size(F.array_union(a["tokens"], b["tokens"]))
    some = (F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0)
    inside = some & (shared < both) & ((shared == F.size(a["tokens"])) | (shared == F.size(b["tokens"])))
    prefix = _long_prefix(a["compact"], b["compact"])
    overlap = F.when(some, shared / both).otherwise(0.0)
    return F.struct(same("norm").alias("norm"), same("compact").alias("compact"), same("acronym").alias("acronym"), inside.alias("inside"), prefix.alias("prefix"), overlap.alias("overlap"), same("gloss").alias("gloss"))


def _named(tests: tuple[Column, ...]) -> Column:
    """Names of the flags whose tests hold, in their order."""
    names = F.concat_ws(",", *[F.when(t, F.lit(name)) for name, t in zip(FLAGS, tests, strict=True)])
    return F.array_remove(F.split(names, ","), "")


def _flags(p: Column) -> Column:
    """Names of the flags that a pair has."""
    return _named((p["norm"], p["compact"], p["acronym"], p["inside"], p["prefix"], p["overlap"] >= HIGH, (p["overlap"] >= PARTIAL) & (p["overlap"] < HIGH), p["gloss"], F.lit(False)))


def _label(flags: Column) -> Column:
    has = lambda names: F.arrays_overlap(flags, F.array(*[F.lit(x) for x in names]))
    return F.when(has(SAME), "likely_false_negative").when(has(NEAR), "very_similar_term").otherwise("clear_noise")


def gold_lists(forms: Column) -> Column:
    """What candidates are looked up in, of an array of ``term_forms``; to be made once for a sample."""
    start = lambda f, n: F.transform(forms[f], lambda x: F.substring(x, 1, n))
    terms = F.transform(forms, lambda g: F.struct(g["compact"].alias("compact"), g["tokens"].alias("tokens")))
    own = [forms[f].alias(f) for f in ("norm", "compact", "acronym", "gloss")]
    return F.struct(*own, F.array_distinct(F.flatten(forms["tokens"])).alias("tokens"), start("acronym", 1).alias("initial"), start("compact", PREFIX).alias("first"), terms.alias("terms"))


def flag_candidates(candidates: DataFrame, gold: DataFrame, by: list[str], gap: float) -> DataFrame:
    """``candidates`` (by, term, gloss, score) with flags and label, by the gold terms (by, term, gloss, score) of their sample.

    Any gold term may raise a flag; a score at most ``gap`` below the best gold score raises one too, if gold has scores.
    Null terms and glosses are empty and share nothing; a candidate without gold terms is noise.  A sample's gold terms are
    few and go to its candidates as one row.
    """
    own = gold.groupBy(*by).agg(F.collect_list(term_forms(F.col("term"), F.col("gloss"))).alias("gold"), F.max("score").alias("__best"))
    own = own.select(*by, "__best", gold_lists(F.col("gold")).alias("__gold"))
    return flag_beside_gold(candidates.join(own, by, "left"), gap)


def flag_beside_gold(rows: DataFrame, gap: float) -> DataFrame:
    """``flag_candidates`` of rows (term, gloss, score) that have the ``gold_lists`` and the best score of their sample as __gold, __best.

    Only candidates with a token or first characters of a gold term are compared with each of these; the other flags are lookups.
    """
    start = lambda text, n: F.substring(text, 1, n)
    columns = [c for c in rows.columns if c not in ("__gold", "__best")]
    rows = rows.withColumns({"__norm": _words(F.col("term")), "__gloss": _words(F.col("gloss"))})
    rows = rows.withColumns({"__compact": _compact(F.col("__norm")), "__own": _own(F.col("__norm")), "__words": F.split("__norm", " ")})
    among = lambda x, f: (x != "") & F.array_contains(f"__gold.{f}", x)
    # an acronym begins as the words that are not stop words
    rows = rows.withColumns({
        "__same": among(F.col("__norm"), "norm"), "__joined": among(F.col("__compact"), "compact"), "__glossed": among(F.col("__gloss"), "gloss"), "__short": among(start(F.col("__own"), 1), "initial") & among(_acronym(F.col("__own")), "acronym"),
        "__shares": F.arrays_overlap("__words", "__gold.tokens"), "__begins": (F.length("__compact") >= PREFIX) & among(start(F.col("__compact"), PREFIX), "first"), "__small": F.col("__best") - F.col("score") <= gap,
        "__terms": F.col("__gold.terms"),
    }).drop("__gold", "__best", "__norm", "__gloss", "__own")
    shared = F.transform("__terms", lambda g: F.struct(F.size(F.array_intersect("__words", g["tokens"])).alias("shared"), F.size(g["tokens"]).alias("n")))
    prefix = F.exists("__terms", lambda g: _long_prefix(F.col("__compact"), g["compact"]))
    rows = rows.withColumns({"__near": F.when(F.col("__shares"), shared), "__size": F.when(F.col("__shares"), F.size(F.array_distinct("__words"))), "__prefix": F.when(F.col("__begins"), prefix)}).drop("__terms", "__words", "__compact")
    inside = F.exists("__near", lambda x: (x["shared"] > 0) & ((x["shared"] == F.col("__size")) != (x["shared"] == x["n"])))
    most = F.array_max(F.transform("__near", lambda x: x["shared"] / (F.col("__size") + x["n"] - x["shared"])))
    rows = rows.withColumns({"__inside": F.when(F.col("__shares"), inside), "__most": F.when(F.col("__shares"), most)})
    same, joined, short, within, begins, overlap, glossed = (F.col(f"__{f}") for f in ("same", "joined", "short", "inside", "prefix", "most", "glossed"))
    tests = (same, joined, short, within, begins, overlap >= HIGH, (overlap >= PARTIAL) & (overlap < HIGH), glossed, F.col("__small"))
    label = F.when(same | joined | glossed, "likely_false_negative").when((overlap >= PARTIAL) | short | within | begins, "very_similar_term").otherwise("clear_noise")
    return rows.select(*columns, _named(tests).alias("flags"), label.alias("label"))


def similar_pairs(bank: DataFrame, key: str = "term_id") -> DataFrame:
    """a, b, flags, label: all pairs of a bank (key, term, gloss) that share a flag, a < b.

    Pairs come from posting lists of what a flag needs two terms to share: tokens, acronym, gloss, the first characters of
    the term without spaces.  Of a term's tokens the rarest are listed, as many as leave too few for a partial overlap.
    """
    forms = bank.select(F.col(key).alias("id"), term_forms(F.col("term"), F.col("gloss")).alias("f"))
    counts = forms.select(F.explode("f.tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ordered = forms.select("id", F.explode("f.tokens").alias("token")).join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ts"))
    first = F.slice("ts", F.lit(1), F.size("ts") - F.ceil(F.size("ts") * PARTIAL - 1e-9).cast("int") + 1)
    lists = ordered.select("id", F.explode(F.transform(first, lambda t: F.concat(F.lit("t"), t["token"]))).alias("key"))
    others = F.array(F.concat(F.lit("a"), "f.acronym"), F.concat(F.lit("g"), "f.gloss"), F.concat(F.lit("p"), F.when(F.length("f.compact") >= PREFIX, F.substring("f.compact", 1, PREFIX)).otherwise("")), F.concat(F.lit("c"), "f.compact"))
    lists = lists.unionByName(forms.select("id", F.explode(F.filter(others, lambda x: F.length(x) > 1)).alias("key")))
    met = lists.alias("x").join(lists.alias("y"), "key").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = met.join(forms.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a").join(forms.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
    flags = let(_pair(F.col("fa"), F.col("fb")), _flags)
    return both.select("a", "b", flags.alias("flags")).where(F.size("flags") > 0).select("a", "b", "flags", _label(F.col("flags")).alias("label"))
