"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; edges are (smaller, larger)."""
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    near = edges.join(low, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b")
    return near.union(low.select(F.col("m").alias("a"), F.col("v").alias("b"))).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (the smallest node) of every node that has an edge to another.

    Each round writes its edges to the shared folder, where those of the round before then go; the number of rounds grows
    with the logarithm of the longest path.
    """
    rounds = Scratch(edges.sparkSession)
    now = cut(edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).where("u <> v").distinct(), rounds)
    state = None
    for _ in range(MOST_ROUNDS):
        size, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (size, mark) == state or not size:
            break
        state = (size, mark)
        now = cut(_small(_large(now)), rounds)
        rounds.clear(keep=1)
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u"), F.col("u")).distinct())
