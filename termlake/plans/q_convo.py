"""Queries of conversations, term maps, sampling and text measures (N, T-11 to T-20, A-26, ST batch twins, Z)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bleu as B
from ..operators import conversation as C
from ..operators import sampling as P
from ..operators import sequential as Q
from .fixtures import SENTENCES, draw_sql, sentences, t
from .registry import query

_ENT = """chunk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_idx FROM conversations WHERE role = 'user'),
tok AS (SELECT conv_id, chunk_idx, w, generate_subscripts(w, 1) AS p, unnest(w) AS term_key FROM (SELECT conv_id, chunk_idx, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM chunk)),
ent AS (SELECT conv_id, chunk_idx, term_key, min(p) AS pos, length(term_key) % 3 = 0 AS is_gold FROM tok GROUP BY ALL)"""


def _entries(s, d):
    c = C.chunks(t(s, d, "conversations"))
    tok = c.select("conv_id", "chunk_idx", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("p", "term_key"))
    return tok.groupBy("conv_id", "chunk_idx", "term_key").agg((F.min("p") + 1).alias("pos")).withColumn("is_gold", F.length("term_key") % 3 == 0)


@query("n01_chunk_index", f"WITH {_ENT} SELECT conv_id, turn, chunk_idx FROM chunk")
def _(s, d):
    return C.chunks(t(s, d, "conversations")).select("conv_id", "turn", "chunk_idx")


@query("t15_n05_gold_first_cap", f"WITH {_ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY is_gold DESC, pos) AS slot FROM ent) SELECT conv_id, chunk_idx, term_key, slot FROM r WHERE slot <= 6")
def _(s, d):
    return C.cap_gold_first(_entries(s, d), ["conv_id", "chunk_idx"], 6).select("conv_id", "chunk_idx", "term_key", "slot")


@query("t16_budget_trim", f"WITH {_ENT}, r AS (SELECT *, count(*) FILTER (is_gold) OVER (PARTITION BY conv_id, chunk_idx) AS g, row_number() OVER (PARTITION BY conv_id, chunk_idx, is_gold ORDER BY pos) AS p FROM ent) SELECT conv_id, chunk_idx, term_key FROM r WHERE is_gold OR p <= 8 - g")
def _(s, d):
    return C.trim_to_budget(_entries(s, d), ["conv_id", "chunk_idx"], 8).select("conv_id", "chunk_idx", "term_key")


@query(
    "n02_n04_n13_build_term_map",
    f"""WITH {_ENT}, h AS (SELECT *, bool_or(is_gold) OVER (PARTITION BY conv_id, chunk_idx) AS has, {draw_sql("'9'", "'empty'", "conv_id", "chunk_idx")} AS ue, {draw_sql("'9'", "'budget'", "conv_id", "chunk_idx")} AS ub, {draw_sql("'9'", "'keep'", "conv_id", "chunk_idx", "term_key")} AS uk,
      {draw_sql("'9'", "'place'", "conv_id", "chunk_idx", "term_key")} AS up FROM ent),
    k AS (SELECT *, CASE WHEN NOT has THEN 4 WHEN ub < 0.45 THEN 6 WHEN ub < 0.45 + 0.35 THEN 8 ELSE 10 END AS most FROM h WHERE NOT ue < CASE WHEN has THEN 0.15 ELSE 0.35 END AND (is_gold OR uk < 0.6)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY is_gold DESC, pos) AS r, count(*) FILTER (is_gold) OVER (PARTITION BY conv_id, chunk_idx) AS g FROM k)
    SELECT conv_id, chunk_idx, term_key, is_gold, row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY up, term_key) AS place FROM r WHERE r <= greatest(most, g)""",
)
def _(s, d):
    out = C.build_term_map(_entries(s, d), ["conv_id", "chunk_idx"], "9", (0.15, 0.35), [(6, 0.45), (8, 0.35), (10, 0.2)], F.lit(0.6), 4)
    return out.select("conv_id", "chunk_idx", "term_key", "is_gold", "place")


@query(
    "n03_n08_gold_backfill",
    f"""WITH {_ENT}, ret AS (SELECT conv_id, chunk_idx, term_key, reverse(term_key) AS tr, pos FROM ent WHERE pos % 2 = 1), gold AS (SELECT conv_id, chunk_idx, term_key, upper(term_key) AS tr FROM ent WHERE is_gold),
    j AS (SELECT coalesce(r.conv_id, g.conv_id) AS conv_id, coalesce(r.chunk_idx, g.chunk_idx) AS chunk_idx, coalesce(r.term_key, g.term_key) AS term_key, coalesce(g.tr, r.tr) AS translation, g.tr IS NOT NULL AS is_gold, coalesce(r.pos, 2147483648) AS pos FROM ret r FULL JOIN gold g ON r.conv_id = g.conv_id AND r.chunk_idx = g.chunk_idx AND r.term_key = g.term_key),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY is_gold DESC, pos, term_key) AS slot FROM j) SELECT conv_id, chunk_idx, term_key, translation, slot FROM k WHERE slot <= 10""",
)
def _(s, d):
    e = _entries(s, d)
    ret = e.where("pos % 2 = 1").select("conv_id", "chunk_idx", "term_key", F.reverse("term_key").alias("translation"), "pos")
    gold = e.where("is_gold").select("conv_id", "chunk_idx", "term_key", F.upper("term_key").alias("translation"))
    return C.backfill(ret, gold, ["conv_id", "chunk_idx"], 10).select("conv_id", "chunk_idx", "term_key", "translation", "slot")


_FUT = """fut AS (SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'assistant' THEN lower(text) END, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS future FROM conversations)"""


@query(
    "n06_derive_gold",
    f"""WITH {_ENT}, {_FUT}, hit AS (SELECT e.conv_id, e.chunk_idx, e.term_key, e.pos, row_number() OVER (PARTITION BY e.conv_id, e.chunk_idx ORDER BY e.pos) AS r FROM ent e JOIN chunk c ON e.conv_id = c.conv_id AND e.chunk_idx = c.chunk_idx JOIN fut f ON c.conv_id = f.conv_id AND c.turn = f.turn WHERE contains(f.future, e.term_key) AND length(e.term_key) >= 5)
    SELECT conv_id, chunk_idx, term_key FROM hit WHERE r <= 4""",
)
def _(s, d):
    from ..operators.windows import future_text

    rows = t(s, d, "conversations")
    fut = future_text(rows, ["conv_id"], "turn", F.when(F.col("role") == "assistant", F.lower("text")), "").select("conv_id", "turn", "future")
    c = C.chunks(rows).select("conv_id", "turn", "chunk_idx").join(fut, ["conv_id", "turn"])
    hit = _entries(s, d).join(c, ["conv_id", "chunk_idx"]).where(F.contains("future", "term_key") & (F.length("term_key") >= 5))
    return hit.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "chunk_idx").orderBy("pos"))).where("r <= 4").select("conv_id", "chunk_idx", "term_key")


@query("n07_x37_tag_terms")
def _(s, d):
    rows = t(s, d, "conversations").withColumn("targets", F.when(F.col("role") == "user", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[a-z]{5,}\b"), F.lit(0)))))
    return Q.tag_terms(rows)


@query("n09_proportional_negatives", f"WITH {_ENT}, n AS (SELECT conv_id, chunk_idx, term_key, pos, row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY pos) AS r, count(*) OVER (PARTITION BY conv_id, chunk_idx) AS c FROM ent WHERE NOT is_gold) SELECT conv_id, chunk_idx, term_key FROM n WHERE r <= least(12, ceil(c * 0.3))")
def _(s, d):
    one = Window.partitionBy("conv_id", "chunk_idx")
    n = _entries(s, d).where("NOT is_gold").withColumn("r", F.row_number().over(one.orderBy("pos"))).withColumn("c", F.count("*").over(one))
    return n.where(F.col("r") <= F.least(F.lit(12), F.ceil(F.col("c") * 0.3))).select("conv_id", "chunk_idx", "term_key")


@query("n10_n11_perturb_and_prompt", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'translate:' || conv_id WHEN role = 'assistant' AND turn % 2 = 0 AND contains(text, 'the') THEN replace(text, 'the', 'teh') ELSE text END AS text FROM conversations""")
def _(s, d):
    text = F.when(F.col("role") == "system", F.concat(F.lit("translate:"), "conv_id")).when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0) & F.contains("text", F.lit("the")), F.replace("text", F.lit("the"), F.lit("teh"))).otherwise(F.col("text"))
    return t(s, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query(
    "n12_degradation",
    f"""WITH {_ENT}, u AS (SELECT conv_id, chunk_idx, term_key, is_gold, pos, is_gold AND {draw_sql("'3'", "conv_id", "chunk_idx", "term_key")} < 0.25 AS replaced FROM ent)
    SELECT conv_id, chunk_idx, term_key, replaced, CASE WHEN replaced THEN row_number() OVER (PARTITION BY conv_id, chunk_idx, replaced ORDER BY pos) END AS distractor FROM u""",
)
def _(s, d):
    hints = _entries(s, d).withColumn("relevant", F.col("is_gold")).withColumn("term", F.col("term_key"))
    return C.degrade(hints, ["conv_id", "chunk_idx"], 0.25, "3").select("conv_id", "chunk_idx", "term_key", "replaced", "distractor")


@query("t11_t14_hash_sample", "SELECT o_orderkey FROM orders ORDER BY sha256('11' || chr(31) || o_orderkey), o_orderkey LIMIT 500")
def _(s, d):
    return P.hash_sample(t(s, d, "orders").select("o_orderkey"), 500, "o_orderkey", "11")


@query("t12_one_per_key", "WITH k AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(k::VARCHAR, chr(1) || o_orderkey) ORDER BY sha256('4' || chr(31) || o_orderkey)) AS r FROM k) SELECT o_orderkey FROM r WHERE r = 1")
def _(s, d):
    rows = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("k"))
    return P.one_per_key(rows, "k", "o_orderkey", "4").select("o_orderkey")


@query("t13_weighted_order", f"SELECT p_partkey FROM part ORDER BY ln(greatest({draw_sql(chr(39) + '8' + chr(39), 'p_partkey')}, 1e-18)) / (1.0 / p_size) DESC, p_partkey LIMIT 100")
def _(s, d):
    return t(s, d, "part").orderBy(F.desc(P.weighted_order(1.0 / F.col("p_size"), "p_partkey", "8")), "p_partkey").limit(100).select("p_partkey")


@query("t18_ordered_search", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY coalesce(o_orderdate, TIMESTAMP '1970-01-01') DESC, o_totalprice DESC, o_orderkey LIMIT 50")
def _(s, d):
    return t(s, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc(F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz"))), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey")


@query("t20_hash_split", f"""WITH g AS (SELECT l_partkey, {draw_sql("'6'", 'l_partkey')} < 0.2 AS unseen FROM lineitem GROUP BY l_partkey), bad AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN g USING (l_partkey) WHERE unseen)
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad)""")
def _(s, d):
    rows = t(s, d, "lineitem").withColumn("unseen", X.stable_draw(F.lit("6"), F.col("l_partkey")) < 0.2)
    return rows.join(rows.where("unseen").select("l_orderkey").distinct(), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query(
    "st05_bounded_history",
    """WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, turn FROM n WHERE b <= CASE WHEN n < 4 THEN n ELSE 2 + (n - 4) % 2 END""",
)
def _(s, d):
    return C.trim_history(t(s, d, "conversations"), ["conv_id"], "turn", 4, 2).select("conv_id", "turn")


@query("st01_st08_cursor_units", "SELECT doc_id, (len(string_split(text, ' ')) + 9) // 10 AS segments, round(list_sum(list_transform(range(1, (len(string_split(text, ' ')) + 9) // 10 + 1), lambda i: i * 0.96))::DOUBLE, 3) AS delay_sum FROM documents")
def _(s, d):
    n = F.floor((F.size(F.split("text", " ")) + 9) / 10)
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda a, i: a + i * 0.96)
    return t(s, d, "documents").select("doc_id", n.alias("segments"), F.round(total, 3).alias("delay_sum"))


def _gram_counts(side, name):
    return f"SELECT doc_id, sent_idx, lang, n, array_to_string({side}[i:i + n - 1], ' ') AS g, count(*) AS {name} FROM (SELECT *, unnest(range(1, len({side}) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM w)) GROUP BY ALL"


_13A = r"list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '([\{{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '')"


@query(
    "a26_z01_corpus_bleu_counts",
    f"""WITH {SENTENCES}, w AS (SELECT doc_id, sent_idx, lang, {_13A.format(c='line')} AS h, {_13A.format(c='reference')} AS r FROM sentences),
    hg AS ({_gram_counts('h', 'c')}), rg AS ({_gram_counts('r', 'd')}),
    m AS (SELECT hg.lang, n, sum(least(c, coalesce(d, 0)))::DOUBLE AS matches, sum(c)::DOUBLE AS total FROM hg LEFT JOIN rg USING (doc_id, sent_idx, n, g) GROUP BY ALL),
    e AS (SELECT lang, n, total, CASE WHEN matches = 0 THEN pow(0.5, count(*) FILTER (matches = 0) OVER (PARTITION BY lang ORDER BY n)) ELSE matches END AS matches FROM m),
    l AS (SELECT lang, sum(len(h))::BIGINT AS hl, sum(len(r))::BIGINT AS rl FROM w GROUP BY 1)
    SELECT lang, round(100 * CASE WHEN any_value(hl) < any_value(rl) THEN exp(1 - any_value(rl) / any_value(hl)) ELSE 1 END * exp(sum(ln(matches / total)) / 4), 4) AS bleu, any_value(hl) AS hyp_len, any_value(rl) AS ref_len
    FROM e JOIN l USING (lang) GROUP BY lang""",
)
def _(s, d):
    rows = sentences(s, d).select("lang", B.tokenize(F.col("line")).alias("hyp"), B.tokenize(F.col("reference")).alias("ref"))
    return B.bleu(rows, ["lang"], smooth="exp")


@query("z03_resegment")
def _(s, d):
    rows = t(s, d, "conversations").select(F.col("conv_id").alias("talk"), F.col("turn").alias("sent_idx"), F.lower("text").alias("reference"), "text")
    return Q.resegment(rows.select("talk", "sent_idx", "reference", F.regexp_replace(F.lower("text"), r"\bthe\b", "a").alias("hypothesis")))


@query("x35_morphology_ladder")
def _(s, d):
    rows = t(s, d, "benchmark").select("item_id", "text", F.regexp_extract("text", r"(\p{L}{4,})", 1).alias("term"))
    return rows.select("item_id", Q.morphology(F.concat("term", F.lit("x")), F.col("text")).alias("kind"))


@query("x36_fuzzy_best_span")
def _(s, d):
    rows = t(s, d, "benchmark").select("item_id", "text", F.regexp_extract("text", r"(\p{L}{4,})", 1).alias("term"))
    return rows.select("item_id", F.round(Q.fuzzy_score(F.concat("term", F.lit("x")), F.col("text")), 6).alias("score"))
