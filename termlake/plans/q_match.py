"""Queries of term matching, glossary algebra and accuracy (J, U, F and part of A, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import glossary as G
from ..operators import match as M
from ..operators import ranks as R
from .fixtures import BASE, GLOSSARY, SENTENCES, glossary, sentences, t
from .q_text import SINGULAR
from .registry import query


def hits(s, d):
    return M.term_match(sentences(s, d), glossary(s, d))


@query("j01_term_match", f"{BASE} SELECT doc_id, sent_idx, term FROM matches")
def _(s, d):
    return hits(s, d).select("doc_id", "sent_idx", "term")


def _words_sql(c):
    """Normalised words of a text column, not yet singular."""
    return f"list_filter(list_transform(string_split(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), ' '), lambda x: regexp_replace(regexp_replace(x, '''s$', ''), '[^a-z0-9'']', '', 'g')), lambda x: x <> '')"


def _grams_sql(cols, table):
    return f"SELECT DISTINCT {cols} array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS n FROM {table}))"


_SINGULARS = f"list_transform(r, lambda y: {SINGULAR.format(w='y')}) AS w"


@query(
    "j02_ngram_match",
    f"""WITH {SENTENCES}, bw AS (SELECT {_words_sql('text')} AS r, {_SINGULARS} FROM benchmark), bank AS ({_grams_sql('', 'bw')}),
    sw AS (SELECT doc_id, sent_idx, {_words_sql('line')} AS r, {_SINGULARS} FROM sentences), g AS ({_grams_sql('doc_id, sent_idx,', 'sw')})
    SELECT doc_id, sent_idx, gram AS term FROM g SEMI JOIN bank USING (gram)""",
)
def _(s, d):
    words = t(s, d, "benchmark").select(X.match_words(F.col("text")).alias("w"))
    bank = words.select(F.explode(F.concat(*[M.word_grams(F.col("w"), n) for n in (2, 3, 4)])).alias("term")).distinct()
    return M.ngram_match(sentences(s, d).select("doc_id", "sent_idx", "line"), bank, sizes=(2, 3, 4), normalised=True).select("doc_id", "sent_idx", "term")


@query(
    "j03_j20_positive_ids_masked",
    f"""{BASE}, ids AS (SELECT term, row_number() OVER (ORDER BY pos) AS term_id FROM glossary), p AS (SELECT DISTINCT m.doc_id, term_id FROM matches m JOIN ids USING (term)),
    n AS (SELECT doc_id, count(*) AS positives FROM p GROUP BY 1)
    SELECT doc_id, positives, (SELECT count(*) FROM ids) - positives AS negatives FROM n""",
)
def _(s, d):
    ids = R.in_order(glossary(s, d), [F.col("pos")], "term_id")
    total = ids.agg(F.count("*").alias("total"))
    positive = hits(s, d).select("doc_id", "term").distinct().join(ids.select("term", "term_id"), "term").groupBy("doc_id").agg(F.count("*").alias("positives"))
    return positive.join(total).select("doc_id", "positives", (F.col("total") - F.col("positives")).alias("negatives"))


_JUDGED = f"""{BASE}, judged AS (SELECT s.doc_id, s.talk, s.sent_idx, m.term, contains(lower(s.reference), m.term[1:4]) AS in_ref, contains(lower(s.hypothesis), m.term) AS in_hyp FROM matches m JOIN sentences s USING (doc_id, sent_idx))"""


def judged(s, d):
    return hits(s, d).select("doc_id", "talk", "sent_idx", "term", F.contains(F.lower("reference"), F.substring("term", 1, 4)).alias("in_ref"), F.contains(F.lower("hypothesis"), F.col("term")).alias("in_hyp"))


@query("exact_term_acc", f"{_JUDGED} SELECT talk, count_if(in_ref)::BIGINT AS total, count_if(in_ref AND in_hyp)::BIGINT AS correct, round(count_if(in_ref AND in_hyp) / nullif(count_if(in_ref), 0), 6) AS accuracy FROM judged GROUP BY talk")
def _(s, d):
    total, correct = F.count_if("in_ref"), F.count_if(F.col("in_ref") & F.col("in_hyp"))
    return judged(s, d).groupBy("talk").agg(total.alias("total"), correct.alias("correct"), F.round(F.try_divide(correct, total), 6).alias("accuracy"))


@query(
    "a02_adoption_macro_micro",
    f"""{_JUDGED}, per AS (SELECT talk, doc_id, sent_idx, count(*) AS n, count_if(in_hyp)::BIGINT AS k FROM judged WHERE in_ref GROUP BY ALL)
    SELECT talk, round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro, count(*) AS sents FROM per GROUP BY talk""",
)
def _(s, d):
    per = judged(s, d).where("in_ref").groupBy("talk", "doc_id", "sent_idx").agg(F.count("*").alias("n"), F.count_if("in_hyp").alias("k"))
    return per.groupBy("talk").agg(F.round(F.avg(F.col("k") / F.col("n")), 6).alias("macro"), F.round(F.sum("k") / F.sum("n"), 6).alias("micro"), F.count("*").alias("sents"))


@query(
    "a03_real_adoption",
    f"""{_JUDGED}, given AS (SELECT DISTINCT doc_id, term FROM matches WHERE pos % 2 = 0), per AS (SELECT talk, doc_id, sent_idx, count(*) AS n, count_if(in_hyp)::BIGINT AS k FROM judged SEMI JOIN given USING (doc_id, term) GROUP BY ALL)
    SELECT talk, round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro FROM per GROUP BY talk""",
)
def _(s, d):
    given = hits(s, d).where("pos % 2 = 0").select("doc_id", "term").distinct()
    per = judged(s, d).join(given, ["doc_id", "term"], "left_semi").groupBy("talk", "doc_id", "sent_idx").agg(F.count("*").alias("n"), F.count_if("in_hyp").alias("k"))
    return per.groupBy("talk").agg(F.round(F.avg(F.col("k") / F.col("n")), 6).alias("macro"), F.round(F.sum("k") / F.sum("n"), 6).alias("micro"))


@query(
    "a04_a05_false_copy_rate",
    f"""{_JUDGED}, per AS (SELECT talk, doc_id, sent_idx, bool_or(in_hyp) AS copied, count(DISTINCT CASE WHEN in_hyp THEN term END) AS false_terms FROM judged WHERE NOT in_ref GROUP BY ALL)
    SELECT talk, count(*) AS with_negative, count_if(copied)::BIGINT AS with_copy, round(count_if(copied) / count(*), 6) AS rate, sum(false_terms)::BIGINT AS false_terms, CASE WHEN count_if(copied) = 0 THEN 'clean' ELSE 'copies' END AS mode FROM per GROUP BY talk""",
)
def _(s, d):
    per = judged(s, d).where("NOT in_ref").groupBy("talk", "doc_id", "sent_idx").agg(F.bool_or("in_hyp").alias("copied"), F.countDistinct(F.when(F.col("in_hyp"), F.col("term"))).alias("false_terms"))
    n = F.count_if("copied")
    return per.groupBy("talk").agg(F.count("*").alias("with_negative"), n.alias("with_copy"), F.round(n / F.count("*"), 6).alias("rate"), F.sum("false_terms").alias("false_terms"), F.when(n == 0, "clean").otherwise("copies").alias("mode"))


@query(
    "a06_tcr",
    f"""{BASE}, out AS (SELECT doc_id, string_agg(lower(hypothesis), ' ' ORDER BY sent_idx) AS text FROM sentences GROUP BY 1), given AS (SELECT DISTINCT doc_id, term FROM matches)
    SELECT doc_id, count(*) AS provided, count_if(contains(text, term))::BIGINT AS adopted FROM given JOIN out USING (doc_id) GROUP BY 1""",
)
def _(s, d):
    out = sentences(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", F.lower("hypothesis").alias("h")))), lambda x: x["h"]), " ").alias("text"))
    given = hits(s, d).select("doc_id", "term").distinct()
    return given.join(out, "doc_id").groupBy("doc_id").agg(F.count("*").alias("provided"), F.count_if(F.contains("text", "term")).alias("adopted"))


@query(
    "a17_prevalence_union_mask",
    f"""{BASE}, tok AS (SELECT doc_id, talk, sent_idx, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM sentences), p AS (SELECT doc_id, talk, sent_idx, unnest(w) AS x FROM tok)
    SELECT talk, (SELECT count(*) FROM p q WHERE q.talk = p.talk) AS tokens, count(*) AS term_tokens, count(DISTINCT (doc_id, sent_idx)) AS term_sentences, count(DISTINCT x) AS types FROM p WHERE x IN (SELECT term FROM glossary) GROUP BY talk""",
)
def _(s, d):
    rows = sentences(s, d).select("doc_id", "talk", "sent_idx", "line")
    total = rows.groupBy("talk").agg(F.sum(F.size(X.alnum_tokens(F.col("line")))).alias("tokens"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("end") - 1)))))  # at most a sentence's tokens
    per = M.spans(rows, glossary(s, d).select("term")).groupBy("talk", "doc_id", "sent_idx").agg(covered.alias("covered"), F.collect_set("term").alias("terms"))
    each = per.select("talk", F.posexplode("terms").alias("k", "term"), "covered").groupBy("talk", "term").agg(F.sum(F.when(F.col("k") == 0, F.col("covered"))).alias("c"), F.count_if(F.col("k") == 0).alias("n"))
    return total.join(each.groupBy("talk").agg(F.sum("c").alias("term_tokens"), F.sum("n").alias("term_sentences"), F.count("*").alias("types")), "talk")


@query(
    "a18_j14_j15_coverage_scopes",
    f"""{BASE}, own AS (SELECT DISTINCT s.talk, m.term FROM matches m JOIN sentences s USING (doc_id, sent_idx) WHERE m.pos % 3 = 0), occ AS (SELECT s.talk, m.term FROM matches m JOIN sentences s USING (doc_id, sent_idx))
    SELECT o.talk, count(*) AS occurrences, count(w.term) AS covered, count(DISTINCT o.term) AS types, count(DISTINCT w.term) AS covered_types, printf('%.4f', count(w.term) / count(*)) AS share FROM occ o LEFT JOIN own w ON o.talk = w.talk AND o.term = w.term GROUP BY 1""",
)
def _(s, d):
    occ = hits(s, d).select("talk", "term", "pos")
    own = occ.where("pos % 3 = 0").select("talk", F.col("term").alias("own")).distinct()
    both = occ.alias("o").join(own.alias("w"), (F.col("o.talk") == F.col("w.talk")) & (F.col("term") == F.col("own")), "left")
    return both.groupBy("o.talk").agg(F.count("*").alias("occurrences"), F.count("own").alias("covered"), F.countDistinct("term").alias("types"), F.countDistinct("own").alias("covered_types"), X.format_metric(F.count("own") / F.count("*")).alias("share"))


@query("f01_leakage_exclusion", f"WITH {GLOSSARY} SELECT term FROM glossary WHERE term NOT IN (SELECT lower(trim(term)) FROM glossary WHERE pos % 3 = 0 UNION SELECT term FROM glossary WHERE pos % 5 = 0)")
def _(s, d):
    g = glossary(s, d)
    return G.exclude_leakage(g, g.where("pos % 3 = 0").select(F.upper("term").alias("term")), g.where("pos % 5 = 0")).select("term")


@query(
    "g_dedup_first_last_pair",
    """WITH p AS (SELECT p_partkey, lower(p_brand) AS k, p_type AS v FROM part)
    SELECT k, arg_min(v, p_partkey) AS first_v, arg_max(v, p_partkey) AS last_v, count(DISTINCT v) AS pairs FROM p GROUP BY k""",
)
def _(s, d):
    p = t(s, d, "part").select("p_partkey", F.col("p_brand").alias("b"), F.col("p_type").alias("v"))
    key = [X.term_key(F.col("b"))]
    first, last = G.dedup(p, key, "p_partkey"), G.dedup(p, key, "p_partkey", last=True)
    pairs = G.dedup(p, [*key, "v"], "p_partkey").groupBy(X.term_key(F.col("b")).alias("k")).agg(F.count("*").alias("pairs"))
    return pairs.join(first.select(X.term_key(F.col("b")).alias("k"), F.col("v").alias("first_v")), "k").join(last.select(X.term_key(F.col("b")).alias("k"), F.col("v").alias("last_v")), "k")


@query(
    "j17_j18_overlay",
    f"""WITH {GLOSSARY}, b AS (SELECT term, translation FROM glossary WHERE pos % 3 <> 0), o AS (SELECT term, term || '!' AS translation FROM glossary WHERE pos % 2 = 0)
    SELECT coalesce(o.term, b.term) AS term, coalesce(o.translation, b.translation) AS translation, CASE WHEN o.term IS NULL THEN 'base' WHEN b.term IS NULL THEN 'over' ELSE 'both' END AS origin FROM b FULL JOIN o ON b.term = o.term""",
)
def _(s, d):
    g = glossary(s, d)
    return G.overlay(g.where("pos % 3 <> 0").select("term", "translation"), g.where("pos % 2 = 0").select("term", F.concat("term", F.lit("!")).alias("translation")), "term")


@query(
    "t17_scale_up",
    f"""WITH {GLOSSARY}, gold AS (SELECT term, pos FROM glossary WHERE pos % 4 = 0), need AS (SELECT 300 - count(*) AS n FROM gold), f AS (SELECT term, pos, row_number() OVER (ORDER BY pos, term) AS r FROM glossary WHERE pos % 4 <> 0)
    SELECT term, pos, true AS is_gold FROM gold UNION ALL SELECT term, pos, false FROM f WHERE r <= greatest(0, (SELECT n FROM need))""",
)
def _(s, d):
    g = glossary(s, d).select("term", "pos")
    return G.scale_up(g.where("pos % 4 = 0"), g, 300, "term", "pos")


@query(
    "a27_merge_fields",
    """WITH f AS (SELECT lower(p_brand) AS key, 's' || (p_size % 3) AS src, min(p_partkey) AS m FROM part GROUP BY ALL), o AS (SELECT key, string_agg(src, '|' ORDER BY m) AS src FROM f GROUP BY 1)
    SELECT key, bool_or(p_size > 25) AS big, arg_min(p_type, p_partkey) AS p_type, arg_max(p_name, (length(p_name), -p_partkey)) AS p_name, any_value(o.src) AS src, count(DISTINCT p_type) - 1 AS conflicts
    FROM part JOIN o ON lower(p_brand) = key GROUP BY key""",
)
def _(s, d):
    rows = t(s, d, "part").withColumn("big", F.col("p_size") > 25).withColumn("src", F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")))
    return G.merge_fields(rows, F.lower("p_brand"), "p_partkey", ["big"], ["p_type"], ["p_name"], "src")


@query(
    "j13_lookup_enrichment",
    f"""WITH {GLOSSARY}, ranks AS (SELECT term, n AS rank FROM glossary WHERE n > 1), notes AS (SELECT term, 'note ' || pos AS note FROM glossary WHERE pos % 2 = 0)
    SELECT g.term, coalesce(rank, -1) AS rank, note FROM glossary g LEFT JOIN ranks USING (term) LEFT JOIN notes USING (term)""",
)
def _(s, d):
    g = glossary(s, d)
    ranks, notes = g.where("n > 1").select("term", F.col("n").alias("rank")), g.where("pos % 2 = 0").select("term", F.concat(F.lit("note "), "pos").alias("note"))
    return g.select("term").join(ranks, "term", "left").join(notes, "term", "left").select("term", F.coalesce("rank", F.lit(-1)).alias("rank"), "note")


@query(
    "j19_unrelated_pairs",
    """WITH a AS (SELECT p_brand, list_distinct(list(p_type)) AS ts FROM part WHERE p_size < 6 GROUP BY 1) SELECT x.p_brand AS a, y.p_brand AS b FROM a x JOIN a y ON x.p_brand < y.p_brand AND NOT list_has_any(x.ts, y.ts)""",
)
def _(s, d):
    a = t(s, d, "part").where("p_size < 6").groupBy("p_brand").agg(F.collect_set("p_type").alias("ts"))  # brands and types are few
    x, y = a.alias("x"), a.alias("y")
    return x.join(y, (F.col("x.p_brand") < F.col("y.p_brand")) & ~F.arrays_overlap("x.ts", "y.ts")).select(F.col("x.p_brand").alias("a"), F.col("y.p_brand").alias("b"))


@query(
    "j21_audit_labels",
    """SELECT 'unknown' AS kind, doc_id FROM labels WHERE doc_id % 7 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL
    SELECT 'missing', doc_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 7 = 0)""",
)
def _(s, d):
    gold, audit = t(s, d, "documents").where("n_chars > 500").select("doc_id"), t(s, d, "labels").where("doc_id % 7 = 0").select("doc_id")
    return audit.join(gold, "doc_id", "left_anti").select(F.lit("unknown").alias("kind"), "doc_id").union(gold.join(audit, "doc_id", "left_anti").select(F.lit("missing"), "doc_id"))


@query(
    "u01_u02_u03_u04_set_operations",
    f"""WITH {GLOSSARY}, a AS (SELECT term FROM glossary WHERE pos % 2 = 0), b AS (SELECT term FROM glossary WHERE pos % 3 = 0)
    SELECT 'all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
    SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'missing', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
    SELECT 'extra_all', count(*) FROM (SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region) UNION ALL SELECT 'both_all', count(*) FROM (SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey FROM region)""",
)
def _(s, d):
    g = glossary(s, d)
    a, b = g.where("pos % 2 = 0").select("term"), g.where("pos % 3 = 0").select("term")
    n, r = t(s, d, "nation").select("n_regionkey"), t(s, d, "region").select("r_regionkey")
    parts = {"all": a.unionByName(b), "distinct": a.union(b).distinct(), "both": a.intersect(b), "missing": a.subtract(b), "extra_all": n.exceptAll(r), "both_all": n.intersectAll(r)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n")).select("op", "n")
        out = row if out is None else out.union(row)
    return out


@query(
    "u05_u06_ordered_concat",
    f"WITH {SENTENCES} SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY talk ORDER BY doc_id, sent_idx) - 1 AS new_idx, max(sent_idx) OVER (PARTITION BY doc_id) + 1 = count(*) OVER (PARTITION BY doc_id) AS contiguous FROM sentences",
)
def _(s, d):
    one = Window.partitionBy("doc_id")
    rows = sentences(s, d).select("doc_id", "talk", "sent_idx", (F.max("sent_idx").over(one) + 1 == F.count("*").over(one)).alias("contiguous"))
    numbered = R.in_order_within(rows, ["talk"], [F.col("doc_id"), F.col("sent_idx")], "n")
    return numbered.select("doc_id", "sent_idx", (F.col("n") - 1).alias("new_idx"), "contiguous")


@query(
    "l06_unordered_match",
    f"""{BASE}, f AS (SELECT doc_id, term, min(sent_idx) AS first_idx, count(*) AS n FROM matches GROUP BY ALL) SELECT doc_id, count(*) AS matched, sum(n - 1)::BIGINT AS duplicates, min(first_idx) AS first_idx FROM f GROUP BY 1""",
)
def _(s, d):
    f = hits(s, d).groupBy("doc_id", "term").agg(F.min("sent_idx").alias("first_idx"), F.count("*").alias("n"))
    return f.groupBy("doc_id").agg(F.count("*").alias("matched"), F.sum(F.col("n") - 1).alias("duplicates"), F.min("first_idx").alias("first_idx"))


@query(
    "l09_no_term_mining",
    f"""{BASE}, w AS (SELECT doc_id, sent_idx, count(*) OVER p AS n FROM sentences WINDOW p AS (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)), bad AS (SELECT DISTINCT doc_id, sent_idx FROM matches)
    SELECT doc_id, sent_idx FROM w WHERE n = 2 AND (doc_id, sent_idx) NOT IN (SELECT doc_id, sent_idx FROM bad) AND (doc_id, sent_idx + 1) NOT IN (SELECT doc_id, sent_idx FROM bad)""",
)
def _(s, d):
    p = Window.partitionBy("doc_id").orderBy("sent_idx")
    grams = sentences(s, d).withColumn("after", F.lead("line").over(p)).where("after IS NOT NULL").withColumn("both", F.concat_ws(" ", "line", "after"))
    bad = M.term_match(grams.select("doc_id", "sent_idx", "both"), glossary(s, d), "both").select("doc_id", "sent_idx").distinct()
    return grams.select("doc_id", "sent_idx").join(bad, ["doc_id", "sent_idx"], "left_anti")


@query(
    "l10_inverted_index",
    f"""{BASE} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs, string_agg(doc_id || ':' || sent_idx, ',' ORDER BY doc_id, sent_idx) AS places FROM matches GROUP BY term""",
)
def _(s, d):
    places = F.sort_array(F.collect_list(F.struct("doc_id", "sent_idx")))
    return hits(s, d).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.array_join(F.transform(places, lambda p: F.concat_ws(":", p["doc_id"], p["sent_idx"])), ",").alias("places"))


@query(
    "l16_target_dedup_totals",
    f"{BASE}, u AS (SELECT DISTINCT translation[1:3] AS target, doc_id, sent_idx FROM matches) SELECT target, count(*) AS total FROM u GROUP BY target",
)
def _(s, d):
    return hits(s, d).select(F.substring("translation", 1, 3).alias("target"), "doc_id", "sent_idx").distinct().groupBy("target").agg(F.count("*").alias("total"))


@query(
    "l11_candidate_labels",
    f"""WITH {GLOSSARY}, p AS (SELECT a.term AS a, b.term AS b FROM glossary a JOIN glossary b ON a.term[1:3] = b.term[1:3] AND a.term < b.term)
    SELECT a, b, CASE WHEN a[1:-2] = b[1:-2] THEN 'false_negative' WHEN contains(a, b) OR contains(b, a) OR a[1:4] = b[1:4] THEN 'similar' ELSE 'noise' END AS label FROM p""",
)
def _(s, d):
    g = glossary(s, d).select("term", F.substring("term", 1, 3).alias("k"))
    cut = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    p = g.alias("x").join(g.alias("y"), "k").where("x.term < y.term").select(F.col("x.term").alias("a"), F.col("y.term").alias("b"))
    similar = F.contains("a", "b") | F.contains("b", "a") | (F.substring("a", 1, 4) == F.substring("b", 1, 4))
    return p.select("a", "b", F.when(cut("a") == cut("b"), "false_negative").when(similar, "similar").otherwise("noise").alias("label"))


@query(
    "l18_l19_clean_terms",
    f"""WITH {GLOSSARY}, f AS (SELECT term, pos FROM glossary WHERE NOT starts_with(term, 'th') AND length(term) <= 14), m AS (SELECT term, pos FROM f ORDER BY pos LIMIT 200) SELECT term FROM m WHERE length(term) >= 7""",
)
def _(s, d):
    first = glossary(s, d).where("NOT startswith(term, 'th') AND length(term) <= 14")
    return first.orderBy("pos").limit(200).where("length(term) >= 7").select("term")  # the cut stands between the two filters


@query(
    "l07_occurrences_without_overlap",
    """SELECT item_id, (len(regexp_extract_all(lower(text), '(^|[^a-z0-9])the of($|[^a-z0-9])')) + len(list_filter(regexp_extract_all(regexp_replace(lower(text), '(^|[^a-z0-9])the of($|[^a-z0-9])', ' # ', 'g'), '[a-z0-9]+'), lambda x: x = 'the')))::INT AS n FROM benchmark""",
)
def _(s, d):
    both = F.concat(X.char_spans(F.col("text"), F.lit("the")), X.char_spans(F.col("text"), F.lit("the of")))
    return t(s, d, "benchmark").select("item_id", F.size(X.pick_spans(both)).alias("n"))
