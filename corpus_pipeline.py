"""The corpus pipeline: stages over documents, each on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm import language, mixing, packing, quality, shingles
from termlake.llm.common import Scratch, crc_mod, cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with the least score of ``language.MIN_SCORE``; the others go.

    Null texts and texts without a letter have no language and go.  Null ids and repeated rows are judged like any, other
    columns pass through, an empty table stays empty; with no labelled document no language is known and all go.
    """
    return language.keep(docs, language.train_on(docs.where(crc_mod("doc_id", 4) != 2)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects.

    Null texts are empty and have too few words.  Null ids and repeated rows are judged like any, other columns pass
    through, an empty table stays empty.
    """
    return quality.cascade(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id; of its repeated rows one that is near.

    Null and blank texts are in no group, so all of them stay.  A row without an id stays only where no row of its group
    has one.  Where ids repeat, each row is judged for itself, by a key that is written first.  Other columns pass through;
    an empty table stays empty.
    """
    again = cut(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    if again.isEmpty():
        drop = shingles.join(docs).where("n_shingles > 0 AND doc_id <> component_id").select("doc_id")
        return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
    keyed = cut(docs.withColumn("__near_row", F.monotonically_increasing_id()))
    found = shingles.join(keyed, "__near_row").where("n_shingles > 0").withColumnsRenamed({"doc_id": "__near_row", "component_id": "part"})
    found = found.join(keyed.select("__near_row", "doc_id"), "__near_row")
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__near_row")).alias("first"))
    drop = found.join(first, "part").where("__near_row <> first.__near_row").select("__near_row")
    return keyed.join(drop, "__near_row", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order.

    Null sources form one source, null texts have no weight but are drawn at their source's rate, null ids are drawn alike,
    as are repeated rows and ties of the random order; other columns pass through, an empty table stays empty.
    """
    return mixing.mix(docs).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their place in sequences.

    Null texts are empty; repeated rows are packed each on their own; null ids stay null; other columns are not read; an
    empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the language model nor the tokenizer; a test holds run() against plain Python that shares only
#: the fitted language model and the tokenizer with it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what was written before goes then."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, written)
            written.clear(keep=1)
    return docs
