"""Term maps of conversation chunks: building, budgets, degradation, gold terms.  Randomness is keyed, so order-free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_draw


def chunks(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """User turns with their chunk index."""
    w = Window.partitionBy(conv).orderBy(turn)
    return rows.where(F.col(role) == "user").withColumn("chunk_idx", F.row_number().over(w) - 1)


def cap_gold_first(entries: DataFrame, by: list[str], most: int | Column, pos: str = "pos") -> DataFrame:
    """Entries with distinct keys, gold ones first in their order, then the others, at most ``most``."""
    key = Window.partitionBy(*by, "term_key").orderBy(F.desc("is_gold"), pos)
    order = Window.partitionBy(*by).orderBy(F.desc("is_gold"), pos)
    return entries.withColumn("__d", F.row_number().over(key)).where("__d = 1").withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= most).drop("__d")


def trim_to_budget(entries: DataFrame, by: list[str], budget: int, pos: str = "pos") -> DataFrame:
    """All gold entries and the first others while the budget lasts: what dropping the last others one by one leaves."""
    gold = F.sum(F.when(F.col("is_gold"), 1).otherwise(0)).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by, "is_gold").orderBy(pos))
    return entries.withColumn("__g", gold).withColumn("__p", place).where(F.col("is_gold") | (F.col("__p") <= F.lit(budget) - F.col("__g"))).drop("__g", "__p")


def build_term_map(entries: DataFrame, by: list[str], seed: str, empty: tuple[float, float], budgets: list[tuple[int, float]], keep: Column, most_without_gold: int) -> DataFrame:
    """The kept entries of each chunk in a random order (column place).

    A chunk draws whether it stays empty (with gold, without gold), and its budget by weight; other entries than gold draw
    whether they stay, with probability ``keep``; gold always stays.  Then the budget is trimmed.
    """
    w = Window.partitionBy(*by)
    draw = lambda what, *more: stable_draw(F.lit(seed), F.lit(what), *[F.col(c) for c in by], *more)
    has_gold = F.max(F.col("is_gold").cast("int")).over(w) == 1
    blank = draw("empty") < F.when(F.col("__has"), empty[0]).otherwise(empty[1])
    total, upto, budget = sum(x for _, x in budgets), 0.0, None
    for size, weight in budgets[:-1]:
        upto += weight / total
        budget = (F.when if budget is None else budget.when)(F.col("__b") < upto, size)
    budget = F.lit(budgets[-1][0]) if budget is None else budget.otherwise(budgets[-1][0])
    rows = entries.withColumn("__has", has_gold).where(~blank)
    rows = rows.withColumn("__b", draw("budget")).withColumn("__most", F.when(F.col("__has"), budget).otherwise(F.lit(most_without_gold)))
    rows = rows.where(F.col("is_gold") | (draw("keep", F.col("term_key")) < keep))
    order = Window.partitionBy(*by).orderBy(F.desc("is_gold"), "pos")
    gold = F.sum(F.when(F.col("is_gold"), 1).otherwise(0)).over(w)
    rows = rows.withColumn("__r", F.row_number().over(order)).withColumn("__g", gold).where(F.col("__r") <= F.greatest("__most", "__g"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(draw("place", F.col("term_key")), "term_key"))
    return rows.withColumn("place", place).drop("__has", "__b", "__most", "__r", "__g")


def backfill(retrieved: DataFrame, gold: DataFrame, by: list[str], most: int) -> DataFrame:
    """Retrieved entries in their order, gold ones with the gold translation; gold that was not retrieved is added; gold-first cap."""
    g = gold.select(*by, "term_key", F.col("translation").alias("gold_translation"), F.lit(True).alias("g"))
    joined = retrieved.join(g, [*by, "term_key"], "full_outer")
    rows = joined.select(*by, "term_key", F.coalesce("gold_translation", "translation").alias("translation"), F.coalesce("g", F.lit(False)).alias("is_gold"), F.coalesce("pos", F.lit(2**31)).alias("pos"))
    w = Window.partitionBy(*by).orderBy(F.desc("is_gold"), "pos", "term_key")
    return rows.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= most)


def degrade(hints: DataFrame, event: list[str], rate: float, seed: str) -> DataFrame:
    """Relevant hints marked as replaced with probability ``rate``, and the number of the distractor that takes their place.

    The draw is keyed by event and term.  Distractors are taken without replacement: the k-th replaced hint of an event
    takes the k-th distractor of that event's keyed order.
    """
    u = stable_draw(F.lit(seed), *[F.col(c) for c in event], F.col("term"))
    rows = hints.withColumn("replaced", F.col("relevant") & (u < rate))
    nth = F.row_number().over(Window.partitionBy(*event, "replaced").orderBy("pos"))
    return rows.withColumn("distractor", F.when(F.col("replaced"), nth))


def trim_history(rows: DataFrame, by: list[str], order: str, most: int, keep: int, strict: bool = False) -> DataFrame:
    """What a bounded history holds after all turns: whenever more than ``most`` are held (or, not strict, as many) all but ``keep`` go."""
    n = F.count("*").over(Window.partitionBy(*by))
    limit = most + 1 if strict else most
    step = max(1, limit - keep)
    held = F.when(n < limit, n).otherwise(F.lit(keep) + F.pmod(n - F.lit(limit), F.lit(step)))
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("__h", held).withColumn("__b", back).where("__b <= __h").drop("__h", "__b")
