"""Queries of aggregations, comparisons and validation (A, F, J-10 to J-24, K, W-09)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import stats as S
from .fixtures import t
from .registry import query

_LINE = "line AS (SELECT l_returnflag AS method, l_suppkey % 20 AS talk, l_orderkey, l_linenumber, l_discount AS score, l_tax FROM lineitem)"


def _line(s, d):
    return t(s, d, "lineitem").select(F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 20).alias("talk"), "l_orderkey", "l_linenumber", F.col("l_discount").alias("score"), "l_tax")


def _systems(s, d):
    rows = _line(s, d).withColumn("even", F.col("l_linenumber") % 2).withColumn("k", F.floor((F.col("l_linenumber") + 1) / 2))
    return rows.where("even = 1").select("talk", "l_orderkey", "k", "score"), rows.where("even = 0").select("talk", "l_orderkey", "k", "score")


_PAIRS = f"""WITH {_LINE}, a AS (SELECT l_orderkey, (l_linenumber + 1) // 2 AS k, talk, score FROM line WHERE l_linenumber % 2 = 1), b AS (SELECT l_orderkey, (l_linenumber + 1) // 2 AS k, talk, score FROM line WHERE l_linenumber % 2 = 0),
pairs AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.talk, a.score AS a, b.score AS b, a.score - b.score AS delta, CASE WHEN a.score IS NULL THEN 'b_only' WHEN b.score IS NULL THEN 'a_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k)"""


@query("j10_a11_paired_delta", f"""{_PAIRS} SELECT l_orderkey % 10 AS g, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(delta), 6) AS mean_delta, round(coalesce(stddev_samp(delta), 0), 6) AS sd,
count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses FROM pairs WHERE side = 'both' GROUP BY 1""")
def _(s, d):
    a, b = _systems(s, d)
    return S.paired_summary(S.paired(a, b, ["l_orderkey", "k"], "score").withColumn("g", F.col("l_orderkey") % 10), ["g"])


@query("j24_reconcile_sides", f"{_PAIRS} SELECT side, count(*) AS n FROM pairs GROUP BY 1")
def _(s, d):
    a, b = _systems(s, d)
    return S.paired(a, b, ["l_orderkey", "k"], "score").groupBy("side").agg(F.count("*").alias("n"))


@query("a12_a35_talk_macro_mean", f"WITH {_LINE}, p AS (SELECT method, talk, avg(score) AS m, sum(score) AS s, count(*) AS c FROM line GROUP BY ALL) SELECT method, round(sum(s) / sum(c), 6) AS mean, round(avg(m), 6) AS macro_mean FROM p GROUP BY 1")
def _(s, d):
    return S.macro_mean(_line(s, d), ["method"], "talk", "score")


@query("a13_delta_groups", f"WITH {_LINE} SELECT talk, count(*) AS n, round(avg(score - l_tax), 6) AS mean, round(median(score - l_tax), 6) AS med, count(*) FILTER (score < l_tax) AS negatives, round(sum(score - l_tax), 6) AS total FROM line GROUP BY 1")
def _(s, d):
    x = F.col("score") - F.col("l_tax")
    return _line(s, d).groupBy("talk").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("med"), F.count_if(F.col("score") < F.col("l_tax")).alias("negatives"), F.round(F.sum(x), 6).alias("total"))


@query(
    "a08_outcome_rollup",
    f"""WITH {_LINE}, o AS (SELECT method, talk % 4 AS kind, score >= 0.05 AS ours, l_tax >= 0.04 AS base FROM line)
    SELECT method, kind, count(*) AS n, round(count(*) FILTER (ours) / count(*), 6) AS rate, count(*) FILTER (ours AND NOT base) AS gains, count(*) FILTER (NOT ours AND base) AS losses FROM o GROUP BY GROUPING SETS ((method, kind), (kind))""",
)
def _(s, d):
    o = _line(s, d).select("method", (F.col("talk") % 4).alias("kind"), (F.col("score") >= 0.05).alias("ours"), (F.col("l_tax") >= 0.04).alias("base"))
    out = o.groupingSets([["method", "kind"], ["kind"]], "method", "kind")
    return out.agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if("ours"), F.count("*")), 6).alias("rate"), F.count_if(F.col("ours") & ~F.col("base")).alias("gains"), F.count_if(~F.col("ours") & F.col("base")).alias("losses"))


@query("a08_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("a09_loss_pivot", f"WITH {_LINE} SELECT talk, count(*) FILTER (method = 'A') AS \"A\", count(*) FILTER (method = 'N') AS \"N\", count(*) FILTER (method = 'R') AS \"R\" FROM line WHERE score < l_tax GROUP BY 1")
def _(s, d):
    return _line(s, d).where("score < l_tax").groupBy("talk").pivot("method", ["A", "N", "R"]).count().na.fill(0)


@query(
    "a10_term_outcomes",
    f"""WITH {_LINE}, o AS (SELECT l_orderkey % 500 AS term, method, CASE WHEN score >= 0.05 AND l_tax < 0.04 THEN 1 WHEN score < 0.05 AND l_tax >= 0.04 THEN -1 ELSE 0 END AS net FROM line)
    SELECT term, count(*) AS n, sum(net)::BIGINT AS net_gain, string_agg(DISTINCT method, ',' ORDER BY method) AS langs FROM o GROUP BY 1""",
)
def _(s, d):
    net = F.when((F.col("score") >= 0.05) & (F.col("l_tax") < 0.04), 1).when((F.col("score") < 0.05) & (F.col("l_tax") >= 0.04), -1).otherwise(0)
    out = _line(s, d).groupBy((F.col("l_orderkey") % 500).alias("term")).agg(F.count("*").alias("n"), F.sum(net).alias("net_gain"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("langs"))
    return out.orderBy(F.desc("net_gain"), F.desc("n"), "term")


@query(
    "a14_a15_failure_chain",
    """WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'on_time' WHEN 'O' THEN 'late' ELSE 'never' END AS status, o_totalprice > 150000 AS correct, o_orderpriority LIKE '1%' AS audited FROM orders)
    SELECT status, count(*) AS gold, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS p_correct, count(*) FILTER (NOT correct AND audited) AS audited_errors,
    count(*) FILTER (NOT correct AND NOT audited) AS retrieval_errors FROM c GROUP BY 1""",
)
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "on_time").when(F.col("o_orderstatus") == "O", "late").otherwise("never")
    c = t(s, d, "orders").select(status.alias("status"), (F.col("o_totalprice") > 150000).alias("correct"), F.col("o_orderpriority").like("1%").alias("audited"))
    return c.groupBy("status").agg(
        F.count("*").alias("gold"), F.count_if("correct").alias("n_correct"), F.count_if(~F.col("correct") & F.col("audited")).alias("audited_errors"), F.count_if(~F.col("correct") & ~F.col("audited")).alias("retrieval_errors")
    ).select("status", "gold", F.col("n_correct").alias("correct"), F.round(F.col("n_correct") / F.col("gold"), 6).alias("p_correct"), "audited_errors", "retrieval_errors")


@query(
    "a16_quality_groups",
    f"""WITH {_LINE} SELECT 'all' AS "group", count(*) AS n, round(avg(score), 4) AS mean FROM line UNION ALL SELECT 'flagged', count(*), round(avg(score), 4) FROM line WHERE method = 'R' UNION ALL
    SELECT 'gain', count(*), round(avg(score), 4) FROM line WHERE score > l_tax UNION ALL SELECT 'tie', count(*), round(avg(score), 4) FROM line WHERE score = l_tax UNION ALL SELECT 'loss', count(*), round(avg(score), 4) FROM line WHERE score < l_tax""",
)
def _(s, d):
    a, b = F.col("score"), F.col("l_tax")
    rows = S.named_groups(_line(s, d), {"all": F.lit(True), "flagged": F.col("method") == "R", "gain": a > b, "tie": a == b, "loss": a < b})
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query(
    "a19_ratio_of_sums",
    """SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS relevant, count(*) AS hints, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 6) AS prec, count(DISTINCT user_id % 1) = 1 AS single_config FROM events GROUP BY 1""",
)
def _(s, d):
    hit = F.sum(F.when(F.col("value") > 50, 1).otherwise(0))
    return t(s, d, "events").groupBy("event_type").agg(hit.alias("relevant"), F.count("*").alias("hints"), F.round(hit / F.count("*"), 6).alias("prec"), (F.countDistinct(F.col("user_id") % 1) == 1).alias("single_config"))


@query("a28_a32_histogram_merge", "SELECT least(floor(n_chars / 500), 20)::BIGINT AS bin, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    binned = t(s, d, "documents").select((F.col("doc_id") % 8).alias("shard"), F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).alias("bin"), "n_chars")
    shards = binned.groupBy("shard", "bin").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return shards.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query(
    "a29_a38_quantile_stats",
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1""",
)
def _(s, d):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("a30_pair_frequency", "SELECT l_suppkey, l_partkey % 50 AS part, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 12")
def _(s, d):
    out = t(s, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("part")).agg(F.count("*").alias("n")).where("n >= 12")
    return out.orderBy(F.desc("n"), "l_suppkey", "part")


@query(
    "a31_majority_translation",
    "WITH c AS (SELECT p_brand AS term, p_type AS tr, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, tr) AS r FROM c) SELECT term, tr, n FROM m WHERE r = 1",
)
def _(s, d):
    c = t(s, d, "part").groupBy(F.col("p_brand").alias("term"), F.col("p_type").alias("tr")).agg(F.count("*").alias("n"))
    return c.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("m"), "tr")).alias("b")).select("term", "b.tr", (-F.col("b.m")).alias("n"))


@query(
    "a33_config_differences",
    """WITH u AS (SELECT p_partkey, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part), v AS (SELECT field, value, count(*) AS cells, min(p_partkey) AS first_cell FROM u GROUP BY ALL)
    SELECT field, value, cells, first_cell FROM (SELECT *, count(*) OVER (PARTITION BY field) AS n FROM v) WHERE n > 1""",
)
def _(s, d):
    return S.config_differences(t(s, d, "part"), "p_partkey", ["p_brand", "p_size"])


@query(
    "a37_f10_duration_domain_counts",
    """SELECT floor(value / 25)::BIGINT AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) FILTER (props IS NULL) AS missing, count(*) FILTER (value < 0) AS invalid FROM events GROUP BY 1""",
)
def _(s, d):
    g = t(s, d, "events").groupBy(F.floor(F.col("value") / 25).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("props").isNull()).alias("missing"), F.count_if(F.col("value") < 0).alias("invalid"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(
    "a39_primary_type",
    """WITH f AS (SELECT p_type AS ty, count(*) AS freq FROM part GROUP BY 1), e AS (SELECT p_brand AS entity, p_type AS ty, min(p_partkey) AS pos FROM part GROUP BY ALL), r AS (SELECT entity, ty, freq, row_number() OVER (PARTITION BY entity ORDER BY freq, pos) AS k FROM e JOIN f USING (ty))
    SELECT entity, ty, freq FROM r WHERE k = 1""",
)
def _(s, d):
    part = t(s, d, "part")
    f = part.groupBy(F.col("p_type").alias("ty")).agg(F.count("*").alias("freq"))
    e = part.groupBy(F.col("p_brand").alias("entity"), F.col("p_type").alias("ty")).agg(F.min("p_partkey").alias("pos"))
    best = e.join(f, "ty").groupBy("entity").agg(F.min(F.struct("freq", "pos", "ty")).alias("b"))
    return best.select("entity", "b.ty", "b.freq")


@query("a40_multi_term_groups", "WITH g AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS grps, count(*) FILTER (n > 1) AS multi, round(count(*) FILTER (n > 1) / count(*), 6) AS rate, max(n) AS largest FROM g")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n"))
    return g.agg(F.count("*").alias("grps"), F.count_if(F.col("n") > 1).alias("multi"), F.round(F.count_if(F.col("n") > 1) / F.count("*"), 6).alias("rate"), F.max("n").alias("largest"))


@query(
    "a41_j16_store_doctor",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'no_orders' END AS issue FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'no_orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(s, d):
    c = t(s, d, "customer")
    none = c.join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("no_orders").alias("issue"))
    return c.where("c_acctbal < 0").select("c_custkey", F.lit("negative").alias("issue")).union(none)


@query("j16_eav_filter", "SELECT l_orderkey AS run_id FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 1 AND l_returnflag = 'R') AND bool_or(l_linenumber = 2 AND l_returnflag = 'A')")
def _(s, d):
    config = t(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("k"), F.col("l_returnflag").alias("v"))
    return S.eav_filter(config, {"1": "R", "2": "A"})


_CELLS = """cells AS (SELECT c_mktsegment AS domain, o_orderpriority AS lang, o_orderstatus AS lm, (sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100 * count(*))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _cells(s, d):
    return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("domain"), F.col("o_orderpriority").alias("lang"), F.col("o_orderstatus").alias("lm")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / (100 * F.count("*"))).alias("v"))


@query("j11_a42_baseline_deltas", f"WITH {_CELLS} SELECT a.domain, a.lang, round(a.v - b.v, 4) AS delta, a.v > b.v AS win FROM cells a LEFT JOIN cells b ON a.domain = b.domain AND a.lang = b.lang AND b.lm = 'O' WHERE a.lm = 'F'")
def _(s, d):
    c = _cells(s, d)
    p = c.groupBy("domain", "lang").pivot("lm", ["F", "O"]).agg(F.first("v")).where("F IS NOT NULL")
    return p.select("domain", "lang", F.round(F.col("F") - F.col("O"), 4).alias("delta"), (F.col("F") > F.col("O")).alias("win"))


@query("j12_f09_compare_metrics", f"WITH {_CELLS} SELECT domain, lang, lm, CASE WHEN lm = 'P' THEN 'missing' WHEN lm = 'O' THEN 'differs' ELSE 'ok' END AS status FROM cells")
def _(s, d):
    c = _cells(s, d)
    actual = c.where("lm <> 'P'").withColumn("v", F.when(F.col("lm") == "O", F.col("v") + 1).otherwise(F.col("v") + 1e-6))
    return S.compare_metrics(c, actual, ["domain", "lang", "lm"], "v").select("domain", "lang", "lm", "status")


@query(
    "f06_f07_f11_row_audit",
    """SELECT o_orderkey, 'priced' AS rule FROM orders WHERE NOT o_totalprice >= 5000 UNION ALL SELECT o_orderkey, 'known_status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'urgent_open' FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'O'""",
)
def _(s, d):
    rules = {"priced": F.col("o_totalprice") >= 5000, "known_status": F.col("o_orderstatus").isin("F", "O"), "urgent_open": ~F.col("o_orderpriority").like("1%") | (F.col("o_orderstatus") == "O")}
    return S.violations(t(s, d, "orders"), ["o_orderkey"], rules)


@query(
    "f08_manifest_completeness",
    """SELECT n.n_name, s.seg FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) s WHERE (n.n_nationkey, s.seg) NOT IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 7 = 0)""",
)
def _(s, d):
    c = t(s, d, "customer")
    have = c.where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"))
    names = t(s, d, "nation").select("n_nationkey", "n_name")
    gaps = S.missing_cells(have, ["n_nationkey", "seg"], names.select("n_nationkey"), c.select(F.col("c_mktsegment").alias("seg")).distinct())
    return gaps.join(names, "n_nationkey").select("n_name", "seg")


@query("f04_f12_cell_filters", f"WITH {_CELLS} SELECT domain, count(*) AS n FROM cells WHERE lang LIKE '1%' GROUP BY 1")
def _(s, d):
    return _cells(s, d).where(F.col("lang").startswith("1")).groupBy("domain").agg(F.count("*").alias("n"))


@query(
    "f02_f03_rank_and_class_ratio",
    """WITH r AS (SELECT *, p_size - 1 AS rank FROM part), k AS (SELECT * FROM r WHERE rank < 0 OR rank < 30), pos AS (SELECT * FROM k WHERE p_size <= 10), neg AS (SELECT *, row_number() OVER (ORDER BY sha256('5' || chr(31) || p_partkey), p_partkey) AS h FROM k WHERE p_size > 10)
    SELECT p_partkey, 'pos' AS class FROM pos UNION ALL SELECT p_partkey, 'neg' FROM neg WHERE h <= (SELECT floor(count(*) * 0.25 / 0.75) FROM pos)""",
)
def _(s, d):
    from ..operators.sampling import class_ratio

    kept = t(s, d, "part").withColumn("rank", F.col("p_size") - 1).where("rank < 0 OR rank < 30")
    return class_ratio(kept, F.col("p_size") <= 10, 0.25, "p_partkey", "5").select("p_partkey", "class")


@query("w09_round_robin", "SELECT o_orderkey, row_number() OVER (ORDER BY rn, o_orderpriority) - 1 AS slot, (row_number() OVER (ORDER BY rn, o_orderpriority) - 1) % 4 AS worker FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)")
def _(s, d):
    rn = t(s, d, "orders").select("o_orderkey", "o_orderpriority", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")).alias("rn"))
    # slots without one global sort: rows of the rounds before (from counts by profile) and profiles before it in the round
    counts = F.broadcast(rn.groupBy(F.col("o_orderpriority").alias("q")).agg(F.count("*").alias("c")))
    before = rn.join(counts, how="cross").groupBy("o_orderkey", "rn").agg(F.sum(F.least("c", F.col("rn") - F.when(F.col("q") < F.col("o_orderpriority"), 0).otherwise(1))).alias("slot"))
    return before.select("o_orderkey", "slot", F.pmod("slot", F.lit(4)).alias("worker"))


@query("k05_formatted_cells", f"WITH {_CELLS} SELECT domain, lang, lm, printf('%.4f', v) AS cell, printf('%+.4f', v - 150000) AS delta, NULL::DOUBLE AS parsed FROM cells")
def _(s, d):
    return _cells(s, d).select("domain", "lang", "lm", X.format_metric(F.col("v")).alias("cell"), X.format_metric(F.col("v") - 150000, signed=True).alias("delta"), X.parse_number(F.lit("NA")).alias("parsed"))


@query("k06_k07_upsert_winners", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def _(s, d):
    from ..operators.glossary import dedup

    o = t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = F.struct("o_orderdate", "o_orderkey")
    return dedup(o, ["o_custkey"], order).select("o_custkey", F.col("o_orderkey").alias("first_key")).join(dedup(o, ["o_custkey"], order, last=True).select("o_custkey", F.col("o_orderkey").alias("last_key")), "o_custkey")


@query("l13_acceptance_rules", """SELECT event_id, CASE WHEN value < 10 THEN 'low' || CASE WHEN event_type = 'error' THEN ',error' ELSE '' END WHEN event_type = 'error' THEN 'error' ELSE '' END AS reasons, value >= 10 AND event_type <> 'error' AS accepted FROM events""")
def _(s, d):
    why = F.filter(F.array(F.when(F.col("value") < 10, "low"), F.when(F.col("event_type") == "error", "error")), lambda x: x.isNotNull())
    return t(s, d, "events").select("event_id", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("accepted"))


@query("a43_real_time_factor", "SELECT event_type, user_id % 4 + 1 AS lm, count(*) AS n, round(avg(value / (0.96 * (user_id % 4 + 1))), 6) AS mean, round(median(value / (0.96 * (user_id % 4 + 1))), 6) AS med, round(quantile_cont(value / (0.96 * (user_id % 4 + 1)), 0.95), 6) AS p95 FROM events GROUP BY ALL")
def _(s, d):
    rows = t(s, d, "events").withColumn("lm", F.col("user_id") % 4 + 1).withColumn("r", F.col("value") / (F.lit(0.96) * F.col("lm")))
    return rows.groupBy("event_type", "lm").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.median("r"), 6).alias("med"), F.round(F.percentile("r", 0.95), 6).alias("p95"))
