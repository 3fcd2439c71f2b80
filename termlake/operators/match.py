"""Joins of texts and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_ODD = "[^a-z0-9 ]"
#: Keys of terms up to this number are looked for in the texts before these meet the terms.
FEW_KEYS = 1000


def _odd_keys(key: Column) -> Column:
    """Characters that are no a-z, digit or space, and pairs of neighbours with one: a term that is not plain has such a key."""
    pairs = F.regexp_extract_all(key, F.lit(f"(?s)(?=({_ODD}.|.{_ODD}))"), F.lit(1))
    return F.concat(F.regexp_extract_all(key, F.lit(_ODD), F.lit(0)), pairs)


def _one_of(values: list[str]):
    return lambda x: x.isin(values)


def term_match(texts: DataFrame, terms: DataFrame, text: str = "line", term: str = "term") -> DataFrame:
    """All pairs of a text and a term that ``source_contains`` accepts.

    Terms of one plain token are an equi join with the distinct tokens of each text and need no test.  Plain terms of
    several tokens are looked up by their first one, others by a character that is no letter of a-z, digit or space with its
    neighbour; only candidates are tested, so all joins are hash joins.  The kinds of terms and, if they are at most
    ``FEW_KEYS``, their keys are read when the plan is made: texts are exploded only to keys that terms have.
    """
    key = F.col("__key")
    keyed = terms.withColumn("__key", X.contains_key(F.col(term))).where("__key <> ''")
    kind = F.when(F.regexp_like(key, F.lit("^[a-z0-9]+$")), "one").when(X.is_plain(key), "plain").otherwise("odd")
    pair = F.when(F.length(key) == 1, key).otherwise(F.element_at(_odd_keys(key), -1))  # a pair, where there is one
    keyed = keyed.withColumn("__kind", kind).withColumn("__tok", F.when(F.col("__kind") == "odd", pair).otherwise(X.alnum_tokens(key)[0]))
    rare = keyed.where("__kind <> 'one'").select("__kind", "__tok").distinct().limit(FEW_KEYS + 1).collect()
    rows = texts.withColumn("__text", X.contains_key(F.col(text)))
    folded = F.regexp_extract_all(X.casefold(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))  # white space is in no token
    tokens = {"one": folded, "plain": folded, "odd": _odd_keys(F.col("__text"))}
    test = {"plain": X.key_in(F.col("__text"), key), "odd": F.contains("__text", key)}
    out = None
    for name, found in tokens.items():
        own = [r["__tok"] for r in rare if r["__kind"] == name]
        if name != "one" and len(rare) <= FEW_KEYS:
            if not own:
                continue
            found = F.filter(found, _one_of(own))
        near = rows.withColumn("__tok", F.explode(F.array_distinct(found))).join(keyed.where(F.col("__kind") == name), "__tok")
        near = (near.where(test[name]) if name in test else near).drop("__tok", "__text", "__key", "__kind")
        out = near if out is None else out.unionByName(near)
    return out


def word_grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(n)]))


def ngram_match(texts: DataFrame, terms: DataFrame, text: str = "line", term: str = "term", sizes: tuple[int, ...] = (1, 2, 3, 4), normalised: bool = False) -> DataFrame:
    """Pairs of a text and a term whose normalised words, in number one of ``sizes``, stand in the text's words in a row.

    An equi join of the texts' distinct n-grams with the terms as n-grams: nothing is tested after it, and no text is copied
    to its n-grams but the columns that the caller passes.  With ``normalised`` the terms are such words already.
    """
    words = texts.withColumn("__words", X.match_words(F.col(text)))
    grams = F.array_distinct(F.concat(*[word_grams(F.col("__words"), n) for n in sizes]))
    left = words.withColumn("__gram", F.explode(grams)).drop("__words")
    needle = F.split(term, " ") if normalised else X.match_tokens(F.col(term), max(sizes))
    right = terms.withColumn("__needle", needle).where(F.size("__needle").isin(list(sizes))).withColumn("__gram", F.array_join("__needle", " ")).drop("__needle")
    return left.join(right, "__gram").drop("__gram")


def spans(texts: DataFrame, terms: DataFrame, text: str = "line", term: str = "term", most: int = 8) -> DataFrame:
    """Token spans [start, end) of every match of plain terms of at most ``most`` tokens; the text itself is not returned.

    Each token meets the terms that start with it; what follows it is carried along for terms of several tokens only.
    """
    needles = terms.withColumn("__needle", X.alnum_tokens(F.col(term))).where(F.size("__needle").between(1, most)).withColumn("__tok", F.col("__needle")[0])
    tokens = texts.withColumn("__tokens", X.alnum_tokens(F.col(text))).drop(text)
    each = tokens.select("*", F.posexplode(F.transform("__tokens", lambda x, i: F.struct(x.alias("tok"), F.slice("__tokens", i + 1, most).alias("run")))).alias("start", "__at")).drop("__tokens")
    found = each.withColumn("__tok", F.col("__at.tok")).join(needles, "__tok")
    found = found.where((F.size("__needle") == 1) | (F.slice("__at.run", F.lit(1), F.size("__needle")) == F.col("__needle")))
    return found.withColumn("end", F.col("start") + F.size("__needle")).drop("__tok", "__at", "__needle")
