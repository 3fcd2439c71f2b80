"""Row numbers and running sums over one order of a whole table, without a task that sees the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def in_order(rows: DataFrame, order: list[Column], number: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``number``, from 1 in ``order``, and for each (column, name) of ``sums`` the running sum, the row's own included.

    The rows are dealt by ranges of the order and written; each range counts and sums for itself, and the totals of the
    ranges before it, a number for each range, are added.  Rows of equal order stand in any order among themselves: make it
    total where that matters.  Nulls stand where ``order`` puts them and add nothing; an empty table stays empty.
    """
    sums, spark = sums or {}, rows.sparkSession
    path = shared_path(spark, "ranges")
    rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    if dealt.isEmpty():
        return dealt.drop("__range").select("*", *[F.lit(None).cast("long").alias(n) for n in ([number] if number else []) + list(sums.values())])
    total = {c: F.sum(c).alias(c) for c in sums}
    found = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *total.values()).collect()  # one row for each range
    last = max(r["__range"] for r in found)

    def before(column: str) -> Column:
        by_range, upto, out = {r["__range"]: r[column] or 0 for r in found}, 0, []
        for k in range(last + 1):
            out.append(F.lit(upto))
            upto += by_range.get(k, 0)
        return F.element_at(F.array(*out), F.col("__range") + 1)

    own = Window.partitionBy("__range").orderBy(*order)
    out = dealt
    if number:
        out = out.withColumn(number, F.row_number().over(own) + before("__n"))
    for column, name in sums.items():
        upto = F.sum(column).over(own.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(name, F.coalesce(upto, F.lit(0)) + before(column))
    return out.drop("__range")


def in_order_within(rows: DataFrame, by: list[str], order: list[Column], number: str) -> DataFrame:
    """``rows`` with ``number``, from 1 in ``order`` within each value of ``by``, of which one may have most of the rows.

    A row's number in the whole table less the least one of its key.  The keys' least numbers are a table that is joined by
    its size; a key without a value is one too.
    """
    placed = in_order(rows, [*[F.col(c) for c in by], *order], "__at")
    least = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__at").alias("__least"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return placed.join(least, same).withColumn(number, F.col("__at") - F.col("__least") + 1).drop("__at", "__least", *[f"__{c}" for c in by])
