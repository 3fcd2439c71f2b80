"""Queries of interval joins and window operators (J-04 to J-09, J-22, J-23, W, A-34, L-08, L-14, L-15)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import interval as I  # noqa: E741
from ..operators import windows as W
from .fixtures import SENTENCES, sentences, t, with_ctes
from .registry import query

_EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg FROM events)"


def _ev(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"), (F.row_number().over(w) - 1).alias("seg"))


def _windows(s, d, kind, length, name):
    return _ev(s, d).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("sec").alias(f"{name}0"), (F.col("sec") + F.lit(length) * (1 + F.col("event_id") % 3)).alias(f"{name}1"))


_AB = f"""{_EV}, a AS (SELECT user_id, event_id AS a_id, sec AS a0, sec + 40000.0 * (1 + event_id % 3) AS a1 FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS b_id, sec AS b0, sec + 25000.0 * (1 + event_id % 3) AS b1 FROM ev WHERE event_type = 'view')"""


def _ab(s, d):
    return _windows(s, d, "click", 40000.0, "a"), _windows(s, d, "view", 25000.0, "b")


@query("j04_j07_overlap_join", f"WITH {_AB} SELECT a_id, b_id FROM a JOIN b ON a.user_id = b.user_id AND a0 < b1 AND a1 > b0")
def _(s, d):
    a, b = _ab(s, d)
    return I.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 60000.0).select("a_id", "b_id")


@query(
    "j05_largest_overlap",
    f"""WITH {_AB}, p AS (SELECT a_id, b_id, round(least(a1, b1) - greatest(a0, b0), 4) AS overlap, row_number() OVER (PARTITION BY a_id ORDER BY least(a1, b1) - greatest(a0, b0) DESC, b_id) AS r FROM a JOIN b ON a.user_id = b.user_id AND a0 < b1 AND a1 > b0) SELECT a_id, b_id, overlap FROM p WHERE r = 1""",
)
def _(s, d):
    a, b = _ab(s, d)
    pairs = I.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 60000.0)
    return I.largest_overlap(pairs, ["a_id"], ("a0", "a1"), ("b0", "b1"), ["b_id"]).select("a_id", "b_id", F.round("overlap", 4).alias("overlap"))


@query(
    "j06_t08_covering_window",
    f"""WITH {_AB}, p AS (SELECT b_id, a_id, a1 - a0 AS len, exp((a1 - a0) / 1e5) AS e FROM b JOIN a ON a.user_id = b.user_id AND a0 <= b0 AND a1 >= b1)
    SELECT b.b_id, count(p.a_id) AS covering, arg_min(p.a_id, (len, p.a_id)) AS smallest, round(ln(sum(e)), 6) AS lse FROM b LEFT JOIN p USING (b_id) GROUP BY 1""",
)
def _(s, d):
    a, b = _ab(s, d)
    p = I.covering_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 60000.0).withColumn("len", F.col("a1") - F.col("a0"))
    per = p.groupBy("b_id").agg(F.count("*").alias("c"), F.min_by("a_id", F.struct("len", "a_id")).alias("smallest"), F.round(F.log(F.sum(F.exp(F.col("len") / 1e5))), 6).alias("lse"))
    return b.select("b_id").join(per, "b_id", "left").select("b_id", F.coalesce("c", F.lit(0)).alias("covering"), "smallest", "lse")


@query(
    "j08_segment_join_checked",
    f"""WITH {_EV} SELECT a.event_id, b.event_id AS next_id, b.event_id IS NULL AS missing FROM ev a LEFT JOIN ev b ON a.user_id = b.user_id AND b.seg = a.seg + 1 WHERE a.event_type = 'click'""",
)
def _(s, d):
    e = _ev(s, d)
    a, b = e.where("event_type = 'click'").alias("a"), e.alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.seg") == F.col("a.seg") + 1)
    return a.join(b, on, "left").select("a.event_id", F.col("b.event_id").alias("next_id"), F.col("b.event_id").isNull().alias("missing"))


@query(
    "j09_w12_earliest_hit",
    f"""WITH {_AB} SELECT a_id, arg_min(b_id, (b1, b_id)) AS first_b FROM (SELECT a_id, b_id, b1 FROM a JOIN b ON a.user_id = b.user_id AND a0 < b1 AND a1 > b0) GROUP BY 1""",
)
def _(s, d):
    a, b = _ab(s, d)
    return I.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 60000.0).groupBy("a_id").agg(F.min(F.struct("b1", "b_id")).alias("m")).select("a_id", F.col("m.b_id").alias("first_b"))


@query("as_of_join", f"WITH {_EV} SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM ev WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.sec >= b.sec")
def _(s, d):
    e = _ev(s, d)
    right = e.where("event_type = 'view'").select("user_id", "sec", F.col("value").alias("last_value"))
    return I.as_of(e.where("event_type = 'purchase'"), right, ["user_id"], "sec", "sec", ["last_value"]).select("event_id", "last_value")


@query(
    "j22_window_text_by_midpoint",
    f"""WITH {_AB} SELECT a_id, count(*) AS n, string_agg(b_id::VARCHAR, ' ' ORDER BY (b0 + b1) / 2, b_id) AS text FROM a JOIN b ON a.user_id = b.user_id AND a0 <= (b0 + b1) / 2 AND (b0 + b1) / 2 < a1 GROUP BY 1""",
)
def _(s, d):
    a, b = _ab(s, d)
    points = b.withColumn("m", (F.col("b0") + F.col("b1")) / 2).withColumn("m1", F.col("m"))
    p = I.covering_join(a, points, ["user_id"], ("a0", "a1"), ("m", "m1"), 60000.0).where("m < a1")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "b_id"))), lambda x: x["b_id"].cast("string")), " ")
    return p.groupBy("a_id").agg(F.count("*").alias("n"), text.alias("text"))


@query(
    "j23_locate_term_chunk",
    with_ctes(
        """SELECT doc_id, coalesce(min(sent_idx) FILTER (contains(line, 'that the')), min(sent_idx + 1) FILTER (contains(line || ' ' || after, 'that the')), 0) AS chunk
        FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS after FROM sentences) GROUP BY 1""",
        SENTENCES,
    ),
)
def _(s, d):
    n = sentences(s, d).withColumn("after", F.lead("line").over(Window.partitionBy("doc_id").orderBy("sent_idx")))
    whole = F.min(F.when(F.contains("line", F.lit("that the")), F.col("sent_idx")))
    pair = F.min(F.when(F.contains(F.concat_ws(" ", "line", "after"), F.lit("that the")), F.col("sent_idx") + 1))
    return n.groupBy("doc_id").agg(F.coalesce(whole, pair, F.lit(0)).alias("chunk"))


@query(
    "w01_m07_running_offset",
    """WITH d AS (SELECT user_id, event_id, value, CASE WHEN event_id % 11 = 0 THEN value * 2 END AS off, sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT event_id, round(coalesce(first_value(off) OVER w, 0) + coalesce(sum(value) OVER (PARTITION BY user_id, i ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start FROM d WINDOW w AS (PARTITION BY user_id, i ORDER BY event_id)""",
)
def _(s, d):
    rows = t(s, d, "events").withColumn("off", F.when(F.col("event_id") % 11 == 0, F.col("value") * 2))
    return W.running_offset(rows, ["user_id"], "event_id", "value", "off").select("event_id", F.round("start", 4).alias("start"))


@query(
    "w02_prompt_windows",
    f"""WITH {_EV}, p AS (SELECT event_id, seg, value, lag(value) OVER (PARTITION BY user_id ORDER BY seg) AS before FROM ev) SELECT event_id, CASE WHEN seg = 0 OR before IS NULL OR value < before THEN 0 ELSE before END AS window_start FROM p""",
)
def _(s, d):
    return W.prompt_windows(_ev(s, d), ["user_id"], "seg", "value", "seg").select("event_id", "window_start")


@query(
    "w03_split_instances",
    """WITH m AS (SELECT event_id, user_id, CASE WHEN event_id % 5 > 0 THEN 'P' WHEN event_type IN ('click', 'view') THEN 'Z' END AS m FROM events), b AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m)
    SELECT event_id, sum(CASE WHEN m = 'Z' AND p = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS instance FROM b""",
)
def _(s, d):
    rows = t(s, d, "events").withColumn("segment", F.col("event_id") % 5)
    return W.split_instances(rows, ["user_id"], "event_id", F.col("event_type").isin("click", "view"), "segment").select("event_id", "instance")


@query(
    "w04_last_wins_segment",
    """SELECT user_id, event_id % 7 AS segment, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)) AS winner FROM events GROUP BY ALL""",
)
def _(s, d):
    order = F.struct(F.when(F.col("event_type") == "purchase", 1).otherwise(0), "event_id")
    return t(s, d, "events").groupBy("user_id", (F.col("event_id") % 7).alias("segment")).agg(F.max_by("event_id", order).alias("winner"))


@query(
    "w05_future_text",
    """SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS future FROM conversations""",
)
def _(s, d):
    said = F.when(F.col("role") == "assistant", F.col("text"))
    return W.future_text(t(s, d, "conversations"), ["conv_id"], "turn", said, "\n").select("conv_id", "turn", "future")


@query(
    "w06_w08_window_grid",
    """WITH f AS (SELECT doc_id, least(n_chars // 100, 40) AS frames FROM documents), w AS (SELECT doc_id, frames, unnest([2, 4, 8, 12]) AS width FROM f), g AS (SELECT doc_id, frames, width, unnest(CASE WHEN width >= frames THEN [0] ELSE range(0, frames - width + 1, 2) END) AS first FROM w)
    SELECT doc_id, width, first::INT AS first, round(first * 0.08, 6) AS win_start, round(least(first + width, frames) * 0.08, 6) AS win_end FROM g""",
)
def _(s, d):
    f = t(s, d, "documents").select("doc_id", F.least(F.floor(F.col("n_chars") / 100), F.lit(40)).alias("frames"))
    return W.window_grid(f, "frames", [2, 4, 8, 12], 2, 0.08).select("doc_id", "width", F.col("first").cast("int").alias("first"), F.round("win_start", 6).alias("win_start"), F.round("win_end", 6).alias("win_end"))


@query(
    "w10_rank_of_positives",
    """SELECT l_orderkey, l_linenumber, 1 + (SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_extendedprice > a.l_extendedprice) AS rank FROM lineitem a WHERE l_returnflag = 'R'""",
)
def _(s, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.rank().over(w).alias("rank")).where("l_returnflag = 'R'").drop("l_returnflag")


@query(
    "w13_chunk_timings",
    """WITH c AS (SELECT conv_id, turn, length(text) AS n, count(*) OVER (PARTITION BY conv_id) AS k, sum(length(text)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
    SELECT conv_id, turn, ((r - 1) * (total // k))::BIGINT AS start, (CASE WHEN r = k THEN total ELSE r * (total // k) END)::BIGINT AS stop FROM c""",
)
def _(s, d):
    one, w = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    c = t(s, d, "conversations").select("conv_id", "turn", F.count("*").over(one).alias("k"), F.sum(F.length("text")).over(one).alias("total"), F.row_number().over(w).alias("r"))
    per = F.floor(F.col("total") / F.col("k"))
    return c.select("conv_id", "turn", ((F.col("r") - 1) * per).alias("start"), F.when(F.col("r") == F.col("k"), F.col("total")).otherwise(F.col("r") * per).alias("stop"))


@query(
    "a34_laal",
    """WITH u AS (SELECT user_id, list(value * 1.0 ORDER BY event_id) AS delays FROM events GROUP BY 1)
    SELECT user_id, round(list_sum(list_transform(delays, lambda d, i: d - 5.0 - i * 60.0 / greatest(len(delays), 8))) / len(delays), 4) AS laal FROM u""",
)
def _(s, d):
    u = t(s, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("delays"))
    return u.select("user_id", F.round(W.laal(u, "delays", F.lit(5.0), F.lit(60.0), F.lit(8)), 4).alias("laal"))


@query(
    "l08_assign_chunk",
    f"""WITH {_AB}, c AS (SELECT user_id, i::INT AS chunk_idx, lo + i * (hi - lo) / 4 AS c0, lo + (i + 1) * (hi - lo) / 4 AS c1 FROM (SELECT user_id, min(a0) AS lo, max(a1) AS hi FROM a GROUP BY 1), (SELECT unnest(range(4)) AS i)),
    p AS (SELECT b_id, chunk_idx, greatest(0, least(b1, c1) - greatest(b0, c0)) AS o, abs((b0 + b1) / 2 - (c0 + c1) / 2) AS dist FROM b JOIN c USING (user_id))
    SELECT b_id, arg_min(chunk_idx, (-o, CASE WHEN o > 0 THEN 0 ELSE dist END, chunk_idx)) AS chunk_idx FROM p GROUP BY 1""",
)
def _(s, d):
    a, b = _ab(s, d)
    span = a.groupBy("user_id").agg(F.min("a0").alias("lo"), F.max("a1").alias("hi")).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    step = (F.col("hi") - F.col("lo")) / 4
    chunks = span.select("user_id", "chunk_idx", (F.col("lo") + F.col("chunk_idx") * (F.col("hi") - F.col("lo")) / 4).alias("c0"), (F.col("lo") + (F.col("chunk_idx") + 1) * (F.col("hi") - F.col("lo")) / 4).alias("c1"))
    return W.assign_chunk(b.select("user_id", "b_id", F.col("b0").alias("s0"), F.col("b1").alias("s1")), chunks, ["user_id"], ["b_id"]).select("b_id", "chunk_idx")


@query("st12_session_gap", f"""WITH {_EV}, g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w > 36000 OR lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS sid FROM g)
    SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min(sec) AS first_sec FROM n GROUP BY user_id, sid""")
def _(s, d):
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "10 hours 1 microsecond")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", "n", "total", (F.unix_micros("session_window.start") / 1e6).alias("first_sec"))
