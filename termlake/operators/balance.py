"""Groups dealt over options (durations, shards) that each may take some of, so that the loads of the options are even."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_draw
from .ranks import in_order

#: Different sets of options that groups may have; options are few, so their subsets are too.
MOST_SETS = 4096


def rotated_first(options: Column, order: list, seed: str, *key: Column) -> Column:
    """The first of a group's options in ``order``, begun at a place that the key draws; null if it has none of them."""
    begin = F.floor(stable_draw(F.lit(seed), *key) * len(order)).cast("int")
    every = F.array(*[F.lit(x) for x in order])
    turned = F.concat(F.slice(every, begin + 1, F.lit(len(order))), F.slice(every, F.lit(1), begin))
    return F.get(F.filter(turned, lambda x: F.array_contains(options, x)), F.lit(0))


def even_quotas(totals: dict[tuple, float], rounds: int = 500) -> dict[tuple, dict]:
    """How much of each set's total each of its options gets, so that the sum of squared loads is least.

    The sets are filled anew in turn, each to an even level over the loads that the others leave, until nothing moves.
    """
    quota = {s: dict.fromkeys(s, 0.0) for s in totals}
    load = dict.fromkeys({o for s in totals for o in s}, 0.0)
    for _ in range(rounds):
        moved = 0.0
        for s, total in sorted(totals.items(), key=lambda x: (len(x[0]), x[0])):
            base = {o: load[o] - quota[s][o] for o in s}
            level, rest = sorted(base.values()), total
            for k in range(len(level)):  # raise the k + 1 lowest to the next one while the total lasts
                room = (level[k + 1] - level[k]) * (k + 1) if k + 1 < len(level) else np.inf
                if rest <= room:
                    top = level[k] + rest / (k + 1)
                    break
                rest -= room
            for o in s:
                new = max(0.0, top - base[o])
                moved += abs(new - quota[s][o])
                load[o], quota[s][o] = base[o] + new, new
        if moved <= 1e-9 * max(1.0, sum(totals.values())):
            break
    return quota


def balanced(groups: DataFrame, key: str, options: str, rows: str, seed: str) -> DataFrame:
    """``groups`` with the column option: one of each group's options, the sums of ``rows`` by option as even as one group allows.

    Groups without options, or null ones, get none.  Counts of each set of options come first and give every set its quotas;
    a set's groups stand in an order that the key draws, and take the option in whose quota they lie by a running sum over
    ranges, not over one task.  Those that lie across two quotas, fewer than options for each set, go to the least load in
    turn, as all would in one sequence.
    """
    own = F.array_sort(F.array_distinct(F.coalesce(options, F.array().cast(groups.schema[options].dataType))))
    marked = groups.withColumn("__set", own).withColumn("__draw", stable_draw(F.lit(seed), F.col(key)))
    totals = marked.where(F.size("__set") > 0).groupBy("__set").agg(F.sum(rows).alias("total")).limit(MOST_SETS + 1).collect()
    if len(totals) > MOST_SETS:
        raise ValueError(f"groups have more than {MOST_SETS} sets of options")
    kind = groups.schema[options].dataType.elementType
    if not totals:
        return groups.withColumn("option", F.lit(None).cast(kind))
    quota = even_quotas({tuple(r["__set"]): float(r.total or 0) for r in totals})
    placed = in_order(marked.where(F.size("__set") > 0), [F.col("__set"), F.col("__draw"), F.col(key)], sums={rows: "__upto"})
    before, begin, bounds = 0.0, {}, []
    for s in sorted(quota):  # the order of the running sum
        begin[s] = before
        at = before
        for o in s:
            bounds.append((list(s), at, at + quota[s][o], o))
            at += quota[s][o]
        before += float(next(r.total or 0 for r in totals if tuple(r["__set"]) == s))
    spark = groups.sparkSession
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    table = spark.createDataFrame(bounds, StructType([StructField("__set", ArrayType(kind)), StructField("__low", DoubleType()), StructField("__high", DoubleType()), StructField("option", kind)]))
    fits = (F.col("__upto") - F.coalesce(F.col(rows), F.lit(0)) >= F.col("__low") - 1e-6) & (F.col("__upto") <= F.col("__high") + 1e-6)
    inside = placed.join(table, "__set").where(fits).groupBy(key).agg(F.min("option").alias("option"))
    free = placed.join(inside, key, "left_anti").select(key, "__set", F.coalesce(F.col(rows), F.lit(0)).alias("n")).orderBy("__draw", key).collect()  # fewer than options for each set
    loads = {r.option: float(r.n) for r in placed.join(inside, key).groupBy("option").agg(F.sum(rows).alias("n")).collect()}
    chosen = []
    for r in sorted(free, key=lambda r: -r.n):
        best = min(r["__set"], key=lambda o: (loads.get(o, 0.0) + float(r.n), o))
        loads[best] = loads.get(best, 0.0) + float(r.n)
        chosen.append((r[key], best))
    rest = spark.createDataFrame(chosen, StructType([groups.schema[key], StructField("option", kind)]))
    return groups.join(inside.unionByName(rest), key, "left")
