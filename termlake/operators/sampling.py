"""Samples by keyed hashes: the same rows in every run, however the table is split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_draw


def hash_order(key: str, seed: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string")), 256)


def hash_sample(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows uniformly: those whose hashes are smallest."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def class_ratio(rows: DataFrame, positive: Column, share: float, key: str, seed: str) -> DataFrame:
    """All positives and as many negatives as make up ``share`` of the result, as column class."""
    pos, neg = rows.where(positive), rows.where(~positive)
    n = int(pos.count() * share / (1 - share))
    return pos.withColumn("class", F.lit("pos")).unionByName(hash_sample(neg, n, key, seed).withColumn("class", F.lit("neg")))


def one_per_key(rows: DataFrame, by: str, key: str, seed: str) -> DataFrame:
    """One uniformly chosen row of each key; rows without a key all stay."""
    group = F.coalesce(F.col(by).cast("string"), F.concat(F.lit("\x00"), F.col(key).cast("string")))
    return rows.groupBy(group.alias("__g")).agg(F.min_by(F.struct(*rows.columns), F.struct(hash_order(key, seed), key)).alias("r")).select("r.*")


def weighted_order(weight: Column, key: str, seed: str) -> Column:
    """Order by this, descending, draws without replacement in proportion to weight."""
    return F.log(F.greatest(stable_draw(F.lit(seed), F.col(key)), F.lit(1e-18))) / weight
