"""Batch twins of the streaming operators (ST), of which tests run the same functions on streams, and a replay of the agent's stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_path
from ..streaming import agent as G
from ..streaming import sessions as ST
from .fixtures import t
from .registry import query


def _events(s, d):
    return t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st01_tumbling", "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    return ST.tumbling(_events(s, d), ["user_id"], "1 hour", "2 hours").select("user_id", F.unix_micros("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("st03_sliding_best", "WITH w AS (SELECT user_id, event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT user_id, event_type, epoch_us(start) AS start, max(value) AS best FROM w GROUP BY ALL")
def _(s, d):
    return ST.sliding_best(_events(s, d), ["user_id"], "event_type", "2 hours", "1 hour", "2 hours").select("user_id", "event_type", F.unix_micros("start").alias("start"), "best")


@query("st04_lookback_join", "SELECT a.user_id AS stream, a.event_id AS chunk_id, b.event_id AS evidence_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 7200 SECOND")
def _(s, d):
    e = _events(s, d)
    return ST.lookback_join(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", 7200.0, "2 hours")


@query(
    "st10_oracle_references",
    """WITH w AS (SELECT user_id, event_id * 1.0 AS w0, event_id + 300.0 AS w1 FROM events WHERE event_type = 'click'), g AS (SELECT user_id, event_id * 1.0 AS g0, event_id + 100.0 AS g1, event_type AS term, event_id AS pos FROM events WHERE event_type <> 'click'),
    h AS (SELECT w.user_id, w0, w1, term, max(pos) AS pos FROM w JOIN g ON w.user_id = g.user_id AND g0 < w1 AND g1 > w0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, w0 ORDER BY pos) AS r FROM h)
    SELECT user_id, w0, count(*) AS n, min(pos) AS first_pos FROM r WHERE r <= 3 GROUP BY ALL""",
)
def _(s, d):
    e = t(s, d, "events")
    w = e.where("event_type = 'click'").select("user_id", (F.col("event_id") * 1.0).cast("double").alias("w0"), (F.col("event_id") + 300.0).cast("double").alias("w1"))
    g = e.where("event_type <> 'click'").select("user_id", (F.col("event_id") * 1.0).cast("double").alias("g0"), (F.col("event_id") + 100.0).cast("double").alias("g1"), F.col("event_type").alias("term"), F.col("event_id").alias("pos"), F.lit("x").alias("translation"))
    return ST.oracle_references(w, g, "user_id", 3).select("user_id", "w0", F.size("references").cast("long").alias("n"), F.col("references")[0]["pos"].alias("first_pos"))


@query(
    "st02_st07_st11_agent_replay",
    """WITH RECURSIVE r AS (SELECT *, conv_id % 3 = 0 AND turn >= 4 AS again, length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')) AS n FROM conversations),
    p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, sum(n) OVER (PARTITION BY conv_id, again ORDER BY turn) AS total, turn = max(turn) OVER (PARTITION BY conv_id) AS fin FROM r),
    f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS seen, 0::BIGINT AS dropped, 0::BIGINT AS sent, 0::BIGINT AS segment, NULL::STRUCT(a BIGINT, first BIGINT, last BIGINT, held BIGINT, fin BOOLEAN) AS e FROM p UNION ALL
      SELECT conv_id, k, total, CASE WHEN act = 1 THEN d2 ELSE d END, CASE WHEN act = 1 THEN total ELSE s END, segment + (act > 0)::INT, {'a': act, 'first': CASE WHEN act = 1 THEN greatest(s, d2) ELSE s END, 'last': CASE WHEN act = 1 THEN total ELSE s END, 'held': total - CASE WHEN act = 1 THEN d2 ELSE d END, 'fin': fin}
      FROM (SELECT *, greatest(d, total - 400)::BIGINT AS d2, CASE WHEN NOT fin AND total - d < 100 THEN 0 WHEN fin AND total - d < 40 THEN 2 WHEN NOT fin AND total - s < 200 THEN 0 ELSE 1 END::BIGINT AS act
        FROM (SELECT p.conv_id, p.k, p.total::BIGINT AS total, p.fin, f.segment, CASE WHEN p.total < f.seen THEN 0 ELSE f.sent END AS s, CASE WHEN p.total < f.seen THEN 0 ELSE f.dropped END AS d FROM f JOIN p ON f.conv_id = p.conv_id AND p.k = f.k + 1)))
    SELECT conv_id::VARCHAR AS stream, segment - 1 AS segment, e.first AS first, e.last AS last, e.last - e.first AS size, CASE WHEN e.a = 1 THEN greatest(0, 120 - (e.last - e.first)) ELSE 0 END::BIGINT AS padding, e.held AS held, e.fin AS finished FROM f WHERE e.a > 0""",
)
def _(s, d):
    rows = t(s, d, "conversations").withColumn("again", (F.col("conv_id") % 3 == 0) & (F.col("turn") >= 4))
    data = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?").cast("binary")
    upto = Window.partitionBy("conv_id", "again").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("data", data).withColumn("at", F.coalesce(F.sum(F.octet_length("data")).over(upto), F.lit(0)).cast("long"))
    finished = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    reads = rows.select(F.col("conv_id").cast("string").alias("stream"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 7 + F.col("conv_id") % 5).alias("ts"), "at", "data", finished.alias("finished"))
    out = G.replay(reads, G.Rules(segment=200, start=100, tail=40, ring=400, least=120), shared_path(s, "agent"), 4)
    return out.select("stream", "segment", "first", "last", F.octet_length("data").cast("long").alias("size"), "padding", "held", "finished")
