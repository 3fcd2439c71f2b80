"""Comparisons of systems, summaries of outcomes and checks of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-12


def paired(a: DataFrame, b: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Strict pairs of two systems: a and b side by side, with ``side`` naming rows that lack a partner."""
    x, y = a.select(*keys, F.col(score).alias("a")), b.select(*keys, F.col(score).alias("b"))
    both = x.join(y, keys, "full_outer")
    return both.withColumn("delta", F.col("a") - F.col("b")).withColumn("side", F.when(F.col("a").isNull(), "b_only").when(F.col("b").isNull(), "a_only").otherwise("both"))


def paired_summary(pairs: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Means, mean and sample deviation of the difference (0 for one pair), wins, ties and losses."""
    r = lambda c: F.round(c, digits)
    d = F.col("delta")
    return pairs.where("side = 'both'").groupBy(*by).agg(
        F.count("*").alias("n"), r(F.avg("a")).alias("mean_a"), r(F.avg("b")).alias("mean_b"), r(F.avg("delta")).alias("mean_delta"),
        r(F.coalesce(F.stddev_samp("delta"), F.lit(0.0))).alias("sd"), F.count_if(d > TIE).alias("wins"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count_if(d < -TIE).alias("losses"),
    )


def macro_mean(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Mean of all rows, and mean of the groups' means."""
    per = rows.groupBy(*by, group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.groupBy(*by).agg(F.round(F.sum("s") / F.sum("c"), 6).alias("mean"), F.round(F.avg("m"), 6).alias("macro_mean"))


def named_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Each row once for every named group whose condition it meets; groups may overlap."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda x: x.isNotNull())
    return rows.withColumn("group", F.explode(names))


def config_differences(rows: DataFrame, cell: str, fields: list[str]) -> DataFrame:
    """Fields with more than one distinct value, and the cells of each value."""
    long = rows.select(cell, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))).alias("field", "value"))
    values = long.groupBy("field", "value").agg(F.count("*").alias("cells"), F.min(cell).alias("first_cell"))
    return values.withColumn("n", F.count("*").over(Window.partitionBy("field"))).where("n > 1").drop("n")


def compare_metrics(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tolerance: float = 1e-4) -> DataFrame:
    """Expected cells with their actual value: ok, differs or missing."""
    joined = expected.select(*keys, F.col(value).alias("want")).join(actual.select(*keys, F.col(value).alias("got")), keys, "left")
    status = F.when(F.col("got").isNull(), "missing").when(F.abs(F.col("got") - F.col("want")) > tolerance, "differs").otherwise("ok")
    return joined.withColumn("status", status)


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key and rule of every broken rule, one row each; a rule is the condition that must hold."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).count().where("count > 1")


def missing_cells(rows: DataFrame, key: list[str], *axes: DataFrame) -> DataFrame:
    """Cells of the product of the axes, each a short list of values, that no row has."""
    full = axes[0]
    for a in axes[1:]:
        full = full.crossJoin(a)
    return full.join(rows.select(*key).distinct(), key, "left_anti")


def eav_filter(config: DataFrame, wanted: dict[str, str], run: str = "run_id") -> DataFrame:
    """Runs that have every wanted value: one aggregation, however many filters."""
    flags = [F.bool_or((F.col("k") == k) & (F.col("v") == v)) for k, v in wanted.items()]
    keep = flags[0]
    for f in flags[1:]:
        keep = keep & f
    return config.where(F.col("k").isin(list(wanted))).groupBy(run).agg(keep.alias("ok")).where("ok").select(run)
