"""Terminology inputs derived from the driver's tables, as DataFrames and, for the oracles, as DuckDB CTEs of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over the cores; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def glossary(s: SparkSession, d: str) -> DataFrame:
    """term, translation, pos (first place), n (occurrences): words of six letters or more of the benchmark."""
    words = t(s, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("p", "term"))
    return words.groupBy("term").agg(F.min(F.col("item_id") * 10000 + F.col("p")).alias("pos"), F.count("*").alias("n")).withColumn("translation", F.reverse("term"))


def sentences(s: SparkSession, d: str) -> DataFrame:
    """doc_id, talk, lang, sent_idx, line, reference (the next line), hypothesis (words of even length)."""
    lines = F.split("text", "\n")
    rows = spread(t(s, d, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", F.col("source").alias("talk"), "lang", lines.alias("lines"))
    pairs = F.arrays_zip(F.col("lines").alias("line"), F.slice("lines", 2, F.size("lines")).alias("next"))
    rows = rows.select("doc_id", "talk", "lang", F.posexplode(pairs).alias("sent_idx", "z"))
    return rows.select(
        "doc_id", "talk", "lang", F.col("sent_idx").cast("long").alias("sent_idx"), F.col("z.line").alias("line"),
        F.coalesce("z.next", "z.line").alias("reference"),
        F.array_join(F.filter(F.split("z.line", " "), lambda x: F.length(x) % 2 == 0), " ").alias("hypothesis"),
    )


GLOSSARY = """glossary AS (
  SELECT term, reverse(term) AS translation, min(item_id * 10000 + p) AS pos, count(*) AS n
  FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p
        FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{6,}') AS w FROM benchmark)) GROUP BY term)"""

SENTENCES = """sentences AS (
  SELECT doc_id, talk, lang, i - 1 AS sent_idx, lines[i] AS line, coalesce(lines[i + 1], lines[i]) AS reference,
    array_to_string(list_filter(string_split(lines[i], ' '), lambda x: length(x) % 2 = 0), ' ') AS hypothesis
  FROM (SELECT doc_id, source AS talk, lang, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents)))"""

#: Sentence and glossary rows that match at word boundaries.
MATCHES = """toks AS (SELECT DISTINCT doc_id, sent_idx, unnest(regexp_extract_all(replace(lower(line), 'ß', 'ss'), '[a-z0-9]+')) AS term FROM sentences),
matches AS (SELECT m.doc_id, m.sent_idx, g.term, g.translation, g.pos FROM toks m JOIN glossary g USING (term))"""

BASE = f"WITH {GLOSSARY}, {SENTENCES}, {MATCHES}"


def with_ctes(sql: str, *ctes: str) -> str:
    """The SQL after the named CTEs, or after glossary, sentences and matches."""
    return f"WITH {', '.join(ctes)} {sql}" if ctes else f"{BASE} {sql}"


def draw_sql(*parts: str) -> str:
    """The SQL of functions.text.stable_draw."""
    return f"(('0x' || sha256(concat_ws(chr(31), {', '.join(f'({p})::VARCHAR' for p in parts)}))[1:13])::BIGINT::DOUBLE / 4503599627370496.0)"
