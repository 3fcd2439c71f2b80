"""Source divergence audit: how far the term frequencies of a language's sources lie apart, by baseline and corrections."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow, table

#: A language keeps the terms that so many of its documents have; TOP terms of a source are ranked.
LEAST_DOCS, TOP = 30, 50
#: Frequencies are 1 + floor(SCALE * (count + SMOOTH) / (all counts + SMOOTH * terms)).
SCALE, SMOOTH = 1_000_000_000, 5
#: Runs of letters A-Z and of characters above ASCII, as code points and as UTF-8 bytes alike.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct terms that a task counts before it sends them on, and those of a batch that it sends.
HELD_TERMS, SENT_TERMS = 800_000, 20_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); a group's row with the empty term shows that it occurs.

    A task counts a batch's words before anything is shuffled and holds at most ``HELD_TERMS`` and what one document adds.
    """
    find = re.compile(TERM.encode()).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (all_n, docs) in held.items():
                terms = [b"", *all_n]
                cols = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *all_n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, all_n)], pa.int64())]
                whole = pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
                yield from (whole.slice(k, SENT_TERMS) for k in range(0, len(terms), SENT_TERMS))

        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                all_n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, words = len(all_n), find(text.lower())
                all_n.update(words)
                docs.update(set(words))
                size += len(all_n) - before
                if size > HELD_TERMS:
                    yield from rows()
                    held.clear()
                    size = 0
        yield from rows()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = map_arrow(docs.select(text("lang"), text("source"), text("text")), count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """The scaled frequency in whole numbers, exact for any count."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTH} AS DECIMAL(20,0))) div CAST({total} + {SMOOTH} * terms AS DECIMAL(20,0))")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources (``pair``) and its outstanding terms (``term``).

    Null texts, languages and sources count as empty.  Repeated rows are documents each; ties go to the smaller item by
    UTF-8 bytes; other columns are not read; an empty table gives no rows.  A very long text is one Python string and its
    words in one task.

    ``pair``: two sources start at the number of terms times the distance of the frequencies that a zero count gives.  A
    source's postings then correct that for every other source, first as if the other had none of its terms: this depends on
    the frequency alone, so postings of equal frequency are one row.  Terms that both have are joined by posting list and
    correct the rest.  Only corrections other than zero are summed, on both sides of the shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    counts = cut(term_counts(docs), scratch)
    some = counts.where("term <> ''")
    kept = cut(some.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), scratch)
    postings = cut(some.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), scratch)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = counts.select("lang", "source").distinct().join(postings.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")])
    groups = cut(groups.withColumn("zero", F.when(F.col("terms") > 0, _share("0", "total")).otherwise(F.lit(0).cast("long"))))
    priced = cut(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "zero", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q")))
    scratch.clear()

    far = lambda a, b: F.abs(F.col(a) - F.col(b))
    side = lambda df, *cols: df.select("lang", *[F.col(c).alias(f"{c}_b") for c in cols])
    pair = [F.col("lang"), F.least("source", "source_b").alias("low"), F.greatest("source", "source_b").alias("high")]
    base = groups.join(side(groups, "source", "zero"), "lang").where("source < source_b").select(*pair, (F.col("terms") * far("zero", "zero_b")).alias("value"))
    alike = priced.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("times"))
    one = alike.join(side(groups, "source", "zero"), "lang").where("source <> source_b").select(*pair, (F.col("times") * (far("p", "zero_b") - far("zero", "zero_b"))).alias("value"))
    right = priced.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "zero", "p")])
    both = priced.join(right, ["lang", "term"]).where("source < source_b").select(*pair, (far("p", "p_b") - far("p", "zero_b") - far("zero", "p_b") + far("zero", "zero_b")).alias("value"))
    distances = base.unionByName(one.where("value <> 0")).unionByName(both.where("value <> 0")).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    pairs = distances.select("lang", F.explode(F.array(way("low", "high"), way("high", "low"))).alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    outstanding = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(outstanding.select("*", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM documents),
kept AS MATERIALIZED (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTH})) // (total + {SMOOTH} * v) AS p FROM gt JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + {SMOOTH})) // (sum(sum(n)) OVER (PARTITION BY lang) + {SMOOTH} * any_value(v)) AS q FROM n JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TOP}"""
