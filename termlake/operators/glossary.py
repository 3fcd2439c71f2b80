"""Glossaries: which entry wins, merging, overlaying, scaling and comparing.  Winners never depend on physical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_key


def dedup(rows: DataFrame, keys: list[Column | str], order: Column | str, last: bool = False) -> DataFrame:
    """One row for each key, the first by ``order`` or the last; aggregates, so equal keys are combined before the shuffle."""
    pick = F.max_by if last else F.min_by
    whole = F.struct(*rows.columns)
    out = rows.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick(whole, order).alias("__r"))
    return out.select("__r.*")


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, columns of ``over`` that are not null win."""
    names = [c for c in base.columns if c != key]
    joined = base.alias("b").join(over.alias("o"), F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"b.{key}").alias(key), *[F.coalesce(f"o.{c}", f"b.{c}").alias(c) for c in names], F.when(F.col(f"o.{key}").isNull(), "base").when(F.col(f"b.{key}").isNull(), "over").otherwise("both").alias("origin"))


def scale_up(gold: DataFrame, filler: DataFrame, size: int, key: str, order: Column | str) -> DataFrame:
    """All of gold and the first of filler that gold lacks, to ``size`` rows."""
    need = max(0, size - gold.count())
    extra = filler.join(gold.select(key), key, "left_anti").orderBy(order, key).limit(need)
    return gold.withColumn("is_gold", F.lit(True)).unionByName(extra.withColumn("is_gold", F.lit(False)), allowMissingColumns=True)


def merge_fields(rows: DataFrame, key: Column, order: str, flags: list[str], texts: list[str], longest: list[str], sources: str) -> DataFrame:
    """Entries of one key as one: flags by or, texts by the first that is not empty, some by the longest, sources in order."""
    agg = [F.bool_or(c).alias(c) for c in flags]
    agg += [F.min_by(F.nullif(F.trim(c), F.lit("")), F.when(F.trim(c) != "", F.col(order))).alias(c) for c in texts]
    agg += [F.max_by(c, F.struct(F.length(c), -F.col(order))).alias(c) for c in longest]
    first = F.sort_array(F.collect_list(F.struct(order, sources)))
    agg += [F.array_join(F.array_distinct(F.transform(first, lambda x: x[sources])), "|").alias(sources), F.greatest(F.lit(0), F.countDistinct(F.nullif(F.trim(texts[0]), F.lit(""))) - 1).cast("long").alias("conflicts")]
    return rows.groupBy(key.alias("key")).agg(*agg)


def exclude_leakage(train: DataFrame, *evals: DataFrame, term: str = "term") -> DataFrame:
    """Training rows whose term key is in no evaluation glossary."""
    keys = evals[0].select(term_key(F.col(term)).alias("__key"))
    for e in evals[1:]:
        keys = keys.union(e.select(term_key(F.col(term))))
    return train.join(keys.distinct(), term_key(F.col(term)) == F.col("__key"), "left_anti")
