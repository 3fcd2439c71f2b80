"""Queries of approximate matching: gold terms with a fuzzy step (N-06, X-36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as C
from ..operators import fuzzy as Z
from .fixtures import t
from .q_convo import _ENT
from .registry import query

#: Blocks of the longest common strings, found in boxes from the whole pair down, and the best score of blocks in a row.
_SCORED = """a AS (SELECT id, i, target[i] AS c FROM (SELECT *, unnest(range(1, length(target) + 1)) AS i FROM pairs)), b AS (SELECT id, j, x[j] AS c FROM (SELECT *, unnest(range(1, length(x) + 1)) AS j FROM pairs)),
    run AS MATERIALIZED (SELECT id, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM a JOIN b USING (id, c)) GROUP BY id, i - j, g),
    box AS (SELECT id, 0 AS k, {'al': 1::BIGINT, 'ah': length(target) + 1, 'bl': 1::BIGINT, 'bh': length(x) + 1} AS z FROM pairs UNION ALL
      SELECT id, k.k, k.z FROM (SELECT id, unnest([{'k': 0, 'z': {'al': al, 'ah': m.i, 'bl': bl, 'bh': m.j}}, {'k': 0, 'z': {'al': m.i + m.n, 'ah': ah, 'bl': m.j + m.n, 'bh': bh}}, {'k': 1, 'z': {'al': m.i, 'ah': m.i + m.n, 'bl': m.j, 'bh': m.j + m.n}}]) AS k
        FROM (SELECT id, al, ah, bl, bh, min({'o': -n, 'i': i, 'j': j, 'n': n}) AS m FROM (
          SELECT id, al, ah, bl, bh, i + s AS i, j + s AS j, least(n - s, ah - i - s, bh - j - s) AS n FROM (
            SELECT q.id, z.al AS al, z.ah AS ah, z.bl AS bl, z.bh AS bh, r.i, r.j, r.n, greatest(0, z.al - r.i, z.bl - r.j) AS s FROM box q JOIN run r ON q.id = r.id AND q.k = 0 AND r.i < z.ah AND r.j < z.bh AND r.i + r.n > z.al AND r.j + r.n > z.bl))
          WHERE n > 0 GROUP BY id, al, ah, bl, bh))),
    block AS (SELECT id, z.al AS i, z.bl AS j, z.bh AS e, z.bh - z.bl AS n, sum(z.bh - z.bl) OVER (PARTITION BY id ORDER BY z.al) AS upto FROM box WHERE k = 1),
    scored AS (SELECT l.id, max(2 * (r.upto - l.upto + l.n) / (length(target) + r.e - l.j)) AS score FROM block l JOIN block r ON l.id = r.id AND r.i >= l.i JOIN pairs p ON p.id = l.id
      WHERE r.e - l.j <= greatest(length(target) + 4, floor(length(target) * 1.6)::BIGINT + 4) GROUP BY l.id)"""


@query(
    "n06_fuzzy_gold",
    f"""WITH RECURSIVE {_ENT}, full_text AS (SELECT conv_id, string_agg(lower(text), '' ORDER BY turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY 1),
    off AS (SELECT conv_id, turn, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS off FROM conversations),
    e AS MATERIALIZED (SELECT conv_id, chunk_idx, pos, term_key, f[off + 1:] AS x FROM ent JOIN (SELECT conv_id, chunk_idx, turn FROM chunk) USING (conv_id, chunk_idx) JOIN off USING (conv_id, turn) JOIN full_text USING (conv_id) WHERE term_key NOT IN ('the', 'and', 'with')),
    pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, chunk_idx, pos, term_key AS target, x FROM e WHERE NOT contains(x, term_key) AND length(term_key) >= 5), {_SCORED},
    hit AS (SELECT conv_id, chunk_idx, pos, term_key AS term, 'exact' AS match_type, NULL::DOUBLE AS fuzzy_score FROM e WHERE contains(x, term_key) UNION ALL
      SELECT conv_id, chunk_idx, pos, target, 'fuzzy', round(score, 6) FROM pairs JOIN scored USING (id) WHERE score >= 0.8)
    SELECT conv_id, chunk_idx, term, match_type, fuzzy_score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk_idx ORDER BY pos) AS r FROM hit) WHERE r <= 12""",
)
def _(s, d):
    rows = t(s, d, "conversations")
    tok = C.chunks(rows).select("conv_id", "chunk_idx", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("p", "term"))
    entries = tok.groupBy("conv_id", "chunk_idx", "turn", "term").agg((F.min("p") + 1).alias("pos")).withColumn("translation", F.col("term"))
    lower = rows.withColumn("text", F.lower("text"))
    return Z.derive_gold(entries, lower, 2, ("the", "and", "with"), 5, 0.8, most=12).select("conv_id", "chunk_idx", "term", "match_type", "fuzzy_score")
