"""Queries of scalar functions on terms and texts (X) and of scans and sinks (S, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.match import term_match
from .fixtures import GLOSSARY, SENTENCES, draw_sql, glossary, sentences, t, with_ctes
from .registry import query

SINGULAR = (
    "CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN regexp_replace({w}, 'ies$', 'y') WHEN length({w}) > 4 AND regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN regexp_replace({w}, 'es$', '') "
    "WHEN length({w}) > 3 AND {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"
)


@query("x01_x02_x07_normalise", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm, lower(trim(source)) AS term_key, length(regexp_replace(text, '\\s', '', 'g')) AS norm_len FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", X.normalise_space(F.col("text")).alias("norm"), X.term_key(F.col("source")).alias("term_key"), X.norm_len(F.col("text")).alias("norm_len"))


@query(
    "x03_nfkc_normalise",
    "SELECT item_id, replace(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))), 'ß', 'ss') AS norm FROM benchmark",
)
def _(s, d):
    from ..functions.unicode import nfkc_key

    return t(s, d, "benchmark").select("item_id", nfkc_key("text").alias("norm"))


@query(
    "x04_x05_x06_containment",
    with_ctes(
        """SELECT doc_id, sent_idx, regexp_matches(lower(line), '(^|[^a-z0-9])the($|[^a-z0-9])') AS has_boundary, contains(trim(regexp_replace(line, '\\s+', ' ', 'g')), 'the o') AS has_text,
        contains(line, reference) AS has_raw, contains(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), 'é') AS has_plain FROM sentences""",
        SENTENCES,
    ),
)
def _(s, d):
    line = F.col("line")
    return sentences(s, d).select(
        "doc_id", "sent_idx", X.source_contains(line, F.lit("The")).alias("has_boundary"), X.text_contains(line, F.lit(" the  o")).alias("has_text"),
        F.contains(line, F.col("reference")).alias("has_raw"), X.source_contains(line, F.lit("é")).alias("has_plain"),
    )


@query("x08_source_tokens", "SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+(?:''[a-zA-Z]+)?')) AS token FROM benchmark")
def _(s, d):
    return t(s, d, "benchmark").select("item_id", F.explode(X.source_tokens(F.col("text"))).alias("token"))


_MAPPED = """maps AS (SELECT conv_id, turn, 'hint' || chr(10) || 'term_map:' || chr(10) || array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda w: w || '=' || reverse(w)), chr(10)) AS block FROM conversations)"""


def _maps(s, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    return t(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("hint\nterm_map:\n"), F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("="), F.reverse(w))), "\n")).alias("block"))


@query(
    "x09_x10_x11_parse_format_term_map",
    f"""WITH {_MAPPED}, pairs AS (SELECT conv_id, turn, unnest(string_split(block, chr(10))[3:]) AS line, generate_subscripts(string_split(block, chr(10))[3:], 1) AS p FROM maps),
    firsts AS (SELECT conv_id, turn, line, min(p) AS p FROM pairs WHERE contains(line, '=') GROUP BY ALL)
    SELECT m.conv_id, m.turn, count(line) AS n_pairs, CASE WHEN count(line) = 0 THEN 'term_map:NONE' ELSE 'term_map:' || chr(10) || string_agg(line, chr(10) ORDER BY p) END AS formatted
    FROM maps m LEFT JOIN firsts f ON m.conv_id = f.conv_id AND m.turn = f.turn GROUP BY ALL""",
)
def _(s, d):
    pairs = X.parse_term_map(F.col("block"))
    return _maps(s, d).select("conv_id", "turn", F.size(X.dedup_pairs(pairs)).cast("long").alias("n_pairs"), X.format_term_map(pairs, "none_block").alias("formatted"))


@query(
    "x12_x13_strip_tags_with_timings",
    """WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i % 3 = 0 THEN '<term>' || x || '</term>' WHEN i % 7 = 0 THEN '<term>' ELSE x END) AS words FROM conversations),
    z AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w)
    SELECT conv_id, turn, count(*) AS n, sum(i * 0.5) AS delay, string_agg(regexp_replace(word, '</?term>', '', 'g'), ' ' ORDER BY i) AS stripped
    FROM z WHERE regexp_replace(word, '</?term>', '', 'g') <> '' GROUP BY ALL""",
)
def _(s, d):
    words = F.transform(F.split("text", " "), lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("<term>"), x, F.lit("</term>"))).when((i + 1) % 7 == 0, F.lit("<term>")).otherwise(x))
    rows = t(s, d, "conversations").select("conv_id", "turn", words.alias("words"))
    rows = rows.select("conv_id", "turn", X.strip_tag_words(F.col("words"), F.transform("words", lambda x, i: (i + 1) * 0.5)).alias("z")).where(F.size("z") > 0)
    return rows.select("conv_id", "turn", F.size("z").cast("long").alias("n"), F.aggregate("z", F.lit(0.0), lambda a, z: a + z["v0"]).alias("delay"), F.array_join("z.word", " ").alias("stripped"))


@query(
    "x14_x15_a07_mask_terms",
    f"""WITH {GLOSSARY}, tok AS (SELECT item_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')) AS term FROM benchmark)
    SELECT item_id, count(*)::INT AS removed, count(DISTINCT term) AS types FROM tok SEMI JOIN glossary USING (term) GROUP BY 1""",
)
def _(s, d):
    hits = term_match(t(s, d, "benchmark").select("item_id", "text"), glossary(s, d).select("term"), "text")
    longest = F.sort_array(F.collect_set(F.struct((-F.length("term")).alias("size"), "term")))
    by_text = hits.groupBy("item_id", "text").agg(longest.alias("terms"))
    masked = X.mask_terms(F.col("text"), F.transform("terms", lambda x: X.mask_pattern(x["term"])))
    return by_text.select("item_id", masked["removed"].cast("int").alias("removed"), F.size("terms").cast("long").alias("types"))


@query(
    "x16_latency_units",
    """SELECT doc_id, CASE WHEN lang IN ('zh', 'ja') THEN length(regexp_replace(text, '\\s', '', 'g')) WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END::INT AS units FROM documents""",
)
def _(s, d):
    return t(s, d, "documents").select("doc_id", X.latency_units(F.col("text"), F.col("lang")).cast("int").alias("units"))


@query(
    "x17_x20_x23_x24_term_normalisers",
    f"""WITH n AS (SELECT p_partkey, p_name, p_type, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') AS bare FROM part)
    SELECT p_partkey, CASE WHEN len(list_filter(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}[0-9]*') OR w[2:] <> lower(w[2:]))) > 0 OR regexp_matches(p_name, '[0-9]')
      THEN 'acronym_or_symbolic_name' WHEN len(regexp_extract_all(p_name, '[A-Za-z0-9]+')) >= 2 THEN 'multiword_expression' ELSE 'single_word_term' END AS term_class,
      array_to_string(list_transform(list_filter(string_split(bare, ' '), lambda w: w <> ''), lambda w: {SINGULAR.format(w='w')}), ' ') AS aggressive,
      trim(p_name) <> '' AS can_copy, len(list_filter(string_split(bare, ' '), lambda w: w <> '')) AS n_tokens FROM n""",
)
def _(s, d):
    c = F.col("p_name")
    return t(s, d, "part").select(
        "p_partkey", X.term_class(c).alias("term_class"), X.normalise_term(c, "aggressive").alias("aggressive"), X.can_count_copy(c).alias("can_copy"),
        F.size(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")).cast("long").alias("n_tokens"),
    )


@query(
    "x18_outcome",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 AND l_tax >= 0.04 THEN 'both_correct' WHEN l_discount >= 0.05 THEN 'gain' WHEN l_tax >= 0.04 THEN 'loss' ELSE 'both_wrong' END AS outcome FROM lineitem""",
)
def _(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.outcome(F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04).alias("outcome"))


@query(
    "x19_x26_x27_candidate_numbers",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0.9 WHEN value IS NULL THEN 0.5 WHEN value < 20 THEN 0.25 WHEN value < 60 THEN 0.6 ELSE 0.85 END AS keep,
    greatest(1, round_even(value / 0.96, 0)::INT) AS mult, ceil(value * 10)::INT AS recall_k, least(16, greatest(1, round_even(2.5 * greatest(1, round_even(value / 0.96, 0)::INT), 0)::INT)) AS cap FROM events""",
)
def _(s, d):
    v = F.col("value")
    mult = X.multiplier(v)
    return t(s, d, "events").select(
        "event_id", X.candidate_keep_probability(F.col("event_type") == "purchase", v, (20, 60), (0.9, 0.5, 0.25, 0.6, 0.85)).alias("keep"),
        mult.alias("mult"), X.recall_k(v, by="duration").alias("recall_k"), X.map_cap(mult, 2.5, 16).alias("cap"),
    )


@query(
    "x21_stable_draw",
    f"SELECT o_orderkey, {draw_sql(chr(39) + '7' + chr(39), 'o_orderkey', 'o_orderpriority')} AS u, ('0x' || sha256(concat_ws(chr(31), '7', o_orderkey::VARCHAR, o_orderpriority))[1:16])::UBIGINT::VARCHAR AS h FROM orders",
)
def _(s, d):
    parts = (F.lit("7"), F.col("o_orderkey"), F.col("o_orderpriority"))
    return t(s, d, "orders").select("o_orderkey", X.stable_draw(*parts).alias("u"), X.stable_uint64(*parts).cast("string").alias("h"))


@query("x22_stable_ids", "SELECT count(*) AS n, count(DISTINCT o_clerkish) AS distinct_keys, 0 AS bad FROM (SELECT o_orderkey AS o_clerkish FROM orders)")
def _(s, d):
    ids = t(s, d, "orders").select(X.stable_id63(F.col("o_orderkey")).alias("id"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_keys"), F.count_if(F.col("id") <= 0).cast("int").alias("bad"))


@query("x25_speech_group_key", "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type || '::' || user_id WHEN props <> '' THEN 'path::' || props ELSE '' END AS k FROM events")
def _(s, d):
    u = F.when(F.col("event_type") != "error", F.col("event_type"))
    return t(s, d, "events").select("event_id", X.speech_group_key(u, F.col("user_id"), F.col("props")).alias("k"))


@query(
    "x28_x29_chunks_and_duration_tags",
    """SELECT l_orderkey, l_linenumber, greatest(1, ceil(round(l_quantity / (0.96 * (l_linenumber % 4 + 1)), 9))::INT) AS chunks_up, greatest(1, floor(round(l_quantity / (0.96 * (l_linenumber % 4 + 1)), 9))::INT) AS chunks_down,
    replace(printf('%.2f', l_quantity * 0.96), '.', 'p') AS tag,
    CASE WHEN least(abs(l_quantity * 0.96 - 0.96), abs(l_quantity * 0.96 - 1.92), abs(l_quantity * 0.96 - 2.88)) <= 0.05 THEN replace(printf('%.2f', l_quantity * 0.96), '.', 'p') ELSE 'unknown:' || printf('%.2f', l_quantity * 0.96) END AS nearest FROM lineitem""",
)
def _(s, d):
    q, lm = F.col("l_quantity"), F.col("l_linenumber") % 4 + 1
    return t(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", X.seconds_to_chunks(q, lm).alias("chunks_up"), X.seconds_to_chunks(q, lm, False).alias("chunks_down"),
        X.duration_tag(q * 0.96).alias("tag"), X.nearest_duration(q * 0.96, [0.96, 1.92, 2.88]).alias("nearest"),
    )


@query(
    "x30_x31_context_windows",
    """WITH e AS (SELECT event_id, value AS a, value + 2.0 AS b FROM events), w AS (SELECT *, greatest(0.0, least((a + b) / 2 - 1.92, 100.0 - 3.84)) AS free FROM e)
    SELECT event_id, free AS centered, greatest(0.0, least(greatest(free, b - 3.84), a)) AS covering, CASE WHEN least(b, 60.0) - 10.0 > greatest(a, 10.0) - 10.0 THEN greatest(a, 10.0) - 10.0 END AS clip_start FROM w""",
)
def _(s, d):
    a, b = F.col("value"), F.col("value") + 2.0
    return t(s, d, "events").select(
        "event_id", X.centered_start((a + b) / 2, 3.84, F.lit(100.0)).alias("centered"), X.covering_start(a, b, 3.84, F.lit(100.0)).alias("covering"),
        X.clipped_span(a, b, F.lit(10.0), F.lit(60.0))["start"].alias("clip_start"),
    )


@query(
    "x32_x33_x34_term_filters",
    """SELECT p_partkey, length(p_name) BETWEEN 3 AND 60 AND regexp_matches(p_name, '^\\pL') AND NOT regexp_matches(p_name, '[()\\[\\]{}:;]') AND len(string_split(lower(p_name), ' ')) <= 5 AS valid,
    trim(replace(replace(lower(p_name), lower(p_brand), ''), ',', '')) = '' AS echo, contains(regexp_replace(lower(p_name), '[^\\pL\\pN]', '', 'g'), regexp_replace(lower(p_type), '[^\\pL\\pN]', '', 'g'))
      OR contains(regexp_replace(lower(p_type), '[^\\pL\\pN]', '', 'g'), regexp_replace(lower(p_name), '[^\\pL\\pN]', '', 'g')) AS trivial,
    length(p_type) / length(p_name) BETWEEN 0.5 AND 2.0 AS ratio_ok FROM part""",
)
def _(s, d):
    a, b = F.col("p_name"), F.col("p_type")
    return t(s, d, "part").select("p_partkey", X.valid_term(a).alias("valid"), X.description_echo(a, F.col("p_brand")).alias("echo"), X.trivial_match(a, b).alias("trivial"), X.length_ratio_ok(a, b).alias("ratio_ok"))


@query("x38_split_chunks")
def _(s, d):
    chunks = X.split_chunks(F.col("text"), 400)
    return t(s, d, "documents").select("doc_id", F.size(chunks).alias("n"), F.array_max(F.transform(chunks, F.length)).alias("longest"), F.size(X.sample_evenly(chunks, 5)).alias("sampled"))


@query("x39_parse_json_array", "SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events")
def _(s, d):
    fenced = F.concat(F.lit("```json\n["), F.col("props"), F.lit("]\n```"))
    return t(s, d, "events").select("event_id", X.parse_json_array(fenced, "array<struct<k:int>>")[0]["k"].alias("k"))


@query(
    "x40_x41_x45_s10_paths",
    """SELECT page_id, replace(replace(url, 'https://www.', 'S:'), 'https://', 'T:') AS scrubbed, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '') AS stem,
    regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS tag, CASE WHEN length(url) > 20 THEN url[1:20] || '...' ELSE url END AS short, page_id * 2 AS start, page_id * 2 + 7 AS stop FROM pages""",
)
def _(s, d):
    u = F.col("url")
    audio = X.audio_field(F.concat(u, F.lit(":"), F.col("page_id") * 2, F.lit(":7")))
    return t(s, d, "pages").select(
        "page_id", X.scrub_paths(u, {"https://": "T:", "https://www.": "S:"}).alias("scrubbed"), X.path_stem(u).alias("stem"), X.safe_tag(u).alias("tag"),
        X.truncate(u, 20).alias("short"), audio["start"].alias("start"), audio["end"].alias("stop"),
    )


@query("x42_x43_parse_outputs", "SELECT o_orderkey, round(o_totalprice, 2) AS bleu, o_orderstatus AS family FROM orders")
def _(s, d):
    line = F.format_string("BLEU = %.2f TERM_ACC=0.5", F.col("o_totalprice"))
    tags = F.array(F.lit("x"), F.concat(F.lit("family:"), F.col("o_orderstatus")))
    return t(s, d, "orders").select("o_orderkey", X.metric_line(line, "BLEU").alias("bleu"), X.tag_value(tags, "family").alias("family"))


@query(
    "x46_x47_token_spans",
    with_ctes(
        """SELECT doc_id, sent_idx, (i - 1)::INT AS start FROM (SELECT doc_id, sent_idx, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, sent_idx, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM sentences))
        WHERE w[i] = 'of' AND w[i + 1] = 'the'""",
        SENTENCES,
    ),
)
def _(s, d):
    spans = X.find_token_spans(X.alnum_tokens(F.col("line")), F.array(F.lit("Of"), F.lit("the")))
    return sentences(s, d).select("doc_id", "sent_idx", F.explode(spans).alias("x")).select("doc_id", "sent_idx", F.col("x.start").alias("start"))


@query(
    "x48_plural_merge",
    f"WITH {GLOSSARY}, c AS (SELECT {SINGULAR.format(w='term')} AS canonical, term FROM glossary) SELECT canonical, count(*) AS n, min(term) AS first_term FROM c GROUP BY canonical",
)
def _(s, d):
    return glossary(s, d).select(X.singular(F.col("term")).alias("canonical"), "term").groupBy("canonical").agg(F.count("*").alias("n"), F.min("term").alias("first_term"))
