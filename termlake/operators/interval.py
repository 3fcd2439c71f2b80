"""Joins on intervals, as equi joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    low = F.floor(F.col(start) / width)
    return df.withColumn(name, F.explode(F.sequence(low, F.greatest(low, F.floor(F.col(end) / width)))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float, how: str = "inner") -> DataFrame:
    """Pairs with a0 < b1 and a1 > b0 under equal keys.

    Both sides go to all buckets that they touch; a pair is kept in the bucket of its later start only, so none comes twice.
    ``width`` should be near the usual length of an interval.
    """
    x, y = _bucketed(left, *a, width, "__bucket"), _bucketed(right, *b, width, "__bucket")
    hit = (F.col(a[0]) < F.col(b[1])) & (F.col(a[1]) > F.col(b[0])) & (F.col("__bucket") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width))
    return x.join(y, [*keys, "__bucket"]).where(hit).drop("__bucket")


def covering_join(windows: DataFrame, points: DataFrame, keys: list[str], w: tuple[str, str], p: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose window holds the whole span: equi join on the bucket of the span's start."""
    x = _bucketed(windows, *w, width, "__bucket")
    y = points.withColumn("__bucket", F.floor(F.col(p[0]) / width))
    return x.join(y, [*keys, "__bucket"]).where((F.col(w[0]) <= F.col(p[0])) & (F.col(w[1]) >= F.col(p[1]))).drop("__bucket")


def largest_overlap(pairs: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], ties: list[Column | str], keep: int = 1) -> DataFrame:
    """Of each group the pairs that overlap longest."""
    length = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    w = Window.partitionBy(*by).orderBy(F.desc("overlap"), *ties)
    return pairs.withColumn("overlap", length).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: one sort by key and time, no pairs."""
    l = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(_struct(right, values)))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def _struct(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"`{v}`:{dict(df.dtypes)[v]}" for v in values) + ">"
