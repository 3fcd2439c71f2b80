"""Writers.  Each replaces its target as a whole through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def tsv(df: DataFrame, path: str, fields: list[str]) -> None:
    """One headed file with these fields in this order; other columns are left out.  For result tables, which are small."""
    df.select(*fields).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def with_stats(df: DataFrame, path: str, **stats) -> dict:
    """Write rows and return aggregates of them from the same pass."""
    seen = Observation("stats")
    df.observe(seen, *[c.alias(n) for n, c in stats.items()]).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def debug_samples(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both tables, new ones replacing old ones of their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def content_addressed(df: DataFrame, content: str) -> DataFrame:
    """Rows with distinct content, named by its sha256."""
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates(["sha256"])


def by_talk(df: DataFrame, path: str, talk: str) -> None:
    df.write.mode("overwrite").partitionBy(talk).parquet(path)
