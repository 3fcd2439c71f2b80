"""Queries of groups dealt over durations (T-19, T-20), over the orders of ``lineitem`` with their lines as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from .fixtures import draw_sql, t
from .registry import query

_DURATIONS = [192, 288, 384, 480]


def _groups(s, d):
    """An order may go to the durations k with l_orderkey % (k + 2) not 1; lines are its rows."""
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return g.withColumn("options", F.filter(F.array(*[F.when(F.col("l_orderkey") % (k + 2) != 1, x) for k, x in enumerate(_DURATIONS)]), lambda x: x.isNotNull()))


_SQL = f"""WITH g AS (SELECT l_orderkey, count(*) AS n, list_filter([{", ".join(f"CASE WHEN l_orderkey % {k + 2} <> 1 THEN {x} END" for k, x in enumerate(_DURATIONS))}], lambda x: x IS NOT NULL) AS options FROM lineitem GROUP BY 1)"""


@query("t19_rotated_durations", f"""{_SQL}, r AS (SELECT *, floor({draw_sql("'19'", "l_orderkey")} * 4)::INT AS b FROM g) SELECT l_orderkey, list_filter({_DURATIONS}[b + 1:] || {_DURATIONS}[:b], lambda x: list_contains(options, x))[1] AS duration FROM r""")
def _(s, d):
    return _groups(s, d).select("l_orderkey", B.rotated_first(F.col("options"), _DURATIONS, "19", F.col("l_orderkey")).alias("duration"))


@query(
    "t19_balanced_loads",
    f"""{_SQL}, total AS (SELECT sum(n) AS n, max(n) AS most FROM g WHERE len(options) > 0) SELECT unnest({_DURATIONS}) AS duration, true AS even FROM total""",
)
def _(s, d):
    """Each duration's load is within one order's lines of a fourth of all."""
    g = _groups(s, d)
    dealt = B.balanced(g, "l_orderkey", "options", "n", "19").where("option IS NOT NULL")
    total = g.where(F.size("options") > 0).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    loads = dealt.groupBy(F.col("option").alias("duration")).agg(F.sum("n").alias("load"))
    return loads.join(total).select("duration", (F.abs(F.col("load") - F.col("total") / len(_DURATIONS)) <= F.col("most")).alias("even"))
