"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: A Poisson variable with a larger mean is drawn as the sum of several with means up to this.
PART_MEAN = 16.0
#: Terms of a part's distribution; for a mean of 16 the rest is below 1e-28.
TERMS = 80
#: Up to so many sources their rates are broadcast (under 100 MB with their distributions); beyond it they are joined by salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 32
SEED = "mix-1"
ALPHA = 0.7


def _uniform(*parts: Column) -> Column:
    """52 bits of md5 over the parts, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, epochs: float, source: str, text: str) -> DataFrame:
    """__src, __rate, __parts, __cdf of each source.

    A source's mass is its code points.  Without ``weights`` a source weighs mass**alpha, with them as listed (0 if not).
    Its mean repetition rate is weight share * epochs * whole mass / own mass; a source without mass has rate 0.
    """
    mass = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__src")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("__mass"))
    if weights is None:
        weight = F.pow("__mass", F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("__src") == name, F.lit(float(w))).otherwise(weight)
    mass = cut(mass.withColumn("__weight", F.when(F.col("__mass") > 0, weight).otherwise(F.lit(0.0))))
    total, share = mass.agg(F.sum("__mass"), F.sum("__weight")).first()
    if not total or not share:
        mass = mass.withColumn("__rate", F.lit(0.0))
    else:
        mass = mass.withColumn("__rate", F.when(F.col("__mass") > 0, F.col("__weight") / F.lit(share) * F.lit(total * epochs) / F.col("__mass")).otherwise(F.lit(0.0)))
    mass = mass.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / PART_MEAN)).cast("int"))
    mean = F.col("__rate") / F.col("__parts")
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf"))

    return mass.select("__src", "__rate", "__parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["cdf"]).alias("__cdf"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    epochs: float = 1.0,
    seed: str = SEED,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Each document, repeated Poisson(rate of its source) times, in a global random order.

    The count is the inverse of the Poisson distribution at a uniform number hashed from seed and id, so a retried task
    draws the same.  Added: mix_rate, mix_replica (from 1), mix_key (the random order); input columns of these names are
    replaced.  Null ids hash as the empty text, null sources form one source, null texts have no mass but are drawn at
    their source's rate; repeated rows are drawn alike; an empty table gives an empty result.
    """
    base = docs.drop("mix_rate", "mix_replica", "mix_key", "__src", "__salt", "__rate", "__parts", "__cdf")
    keep = base.columns
    per_source = rates(base, weights, alpha, epochs, source, text)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = base.withColumn("__src", F.coalesce(F.col(source).cast("string"), F.lit("")))
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(per_source), "__src")
    else:
        salted = per_source.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.hash(ident), F.lit(SALTS))).join(salted, ["__src", "__salt"])

    def draw(acc: Column, part: Column) -> Column:
        u = _uniform(F.lit(seed), ident, part.cast("string"))
        return acc + F.size(F.filter("__cdf", lambda c: u >= c))

    count = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), draw)
    rows = rows.withColumn("__n", count).filter("__n > 0")
    rows = rows.select(*keep, F.col("__rate").alias("mix_rate"), F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("mix_replica"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), ident, F.col("mix_replica").cast("string"))), 1, 15), 16, 10).cast("long")
    return rows.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.round("mix_rate", 9).alias("mix_rate"), "mix_replica", "mix_key")


ORACLE = f"""
WITH RECURSIVE mass AS (
  SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0))::DOUBLE AS m FROM documents GROUP BY 1),
weighed AS (SELECT src, m, CASE WHEN m > 0 THEN pow(m, {ALPHA}) ELSE 0 END AS w FROM mass),
rated AS (SELECT src, CASE WHEN m > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(m) FROM weighed) / m ELSE 0 END AS rate FROM weighed),
parted AS (SELECT src, rate, greatest(1, ceil(rate / {PART_MEAN}))::INT AS parts FROM rated),
cdf AS (
  SELECT src, 0 AS k, exp(-rate / parts) AS term, exp(-rate / parts) AS total FROM parted
  UNION ALL
  SELECT c.src, k + 1, term * (rate / parts) / (k + 1), total + term * (rate / parts) / (k + 1)
  FROM cdf c JOIN parted p ON c.src = p.src WHERE k < {TERMS}),
draws AS (
  SELECT doc_id, coalesce(source, '') AS src, unnest(range(1, parts + 1)) AS part, rate
  FROM documents JOIN parted ON coalesce(source, '') = src),
uniform AS (
  SELECT *, ('0x' || md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || part)[1:13])::BIGINT::DOUBLE / {2**52}::DOUBLE AS u FROM draws),
counts AS (
  SELECT doc_id, any_value(rate) AS rate, sum((SELECT count(*) FROM cdf WHERE cdf.src = uniform.src AND u >= total))::INT AS n
  FROM uniform GROUP BY doc_id),
reps AS (SELECT doc_id, rate, unnest(range(1, n + 1))::INT AS r FROM counts WHERE n > 0)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(rate, 9) AS mix_rate, r AS mix_replica,
  ('0x' || md5('{SEED}|order|' || coalesce(d.doc_id::VARCHAR, '') || '|' || r)[1:15])::BIGINT AS mix_key
FROM documents d JOIN reps ON d.doc_id = reps.doc_id
"""
