"""Scans of the formats that terminology pipelines use, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import audio_field, parse_number


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One object a line; strict scans fail on a bad line, others leave it out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jsonl_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All lines; those that do not parse stand in column _bad."""
    return spark.read.schema(schema.add("_bad", T.StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


GLOSSARY_ENTRY = "struct<term:string,key:string,translation:string,target_translation:string,target_translations:map<string,string>,source:string,source_paper:string>"


def glossary(spark: SparkSession, path: str, lang: str = "zh") -> DataFrame:
    """Entries of a glossary whose root is an object or a list: path, pos, key, term, translation.

    The first of target_translations[lang], translation and target_translation that is not empty is the translation;
    an object's key stands in where an entry has no term.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("v"))
    is_list = F.ltrim("v").startswith("[")
    listed = raw.where(is_list).select("path", F.posexplode(F.from_json("v", f"array<{GLOSSARY_ENTRY}>")).alias("pos", "e")).select("path", "pos", F.col("e.key").alias("key"), "e")
    mapped = raw.where(~is_list).select("path", F.posexplode(F.map_entries(F.from_json("v", f"map<string,{GLOSSARY_ENTRY}>"))).alias("pos", "m")).select("path", "pos", F.col("m.key").alias("key"), F.col("m.value").alias("e"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return listed.unionByName(mapped).select(
        "path", "pos", "key", F.coalesce(some(F.col("e.term")), "key").alias("term"),
        F.coalesce(some(F.col("e.target_translations")[lang]), some(F.col("e.translation")), some(F.col("e.target_translation"))).alias("translation"), F.col("e.source").alias("source"),
    )


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def metrics(df: DataFrame, names: list[str]) -> DataFrame:
    """Metric columns as numbers; empty, NA and N/A are null."""
    return df.withColumns({c: parse_number(F.col(c)) for c in names})


def last_row(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(1)


def single_row(df: DataFrame) -> DataFrame:
    """The table's one row; any other number of rows is an error when it is read."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError(f"expected exactly one row, found {'none' if not n else 'several'}")
    return df


def flat_yaml(spark: SparkSession, path: str) -> DataFrame:
    """path, item, record: the flat maps of a YAML list, values as strings without quotes and null for null or ~."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "line")).where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    item = F.sum(F.when(F.ltrim("line").startswith("- "), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("n"))
    value = F.trim(F.regexp_extract("line", r"^\s*(?:- )?\s*[^:]+:\s*(.*)$", 1))
    bare = F.regexp_replace(value, r"^(['\"])(.*)\1$", "$2")
    rows = lines.select("path", item.alias("item"), F.trim(F.regexp_extract("line", r"^\s*(?:- )?\s*([^:]+):", 1)).alias("k"), F.when(value.isin("null", "~", ""), None).otherwise(bare).alias("v"))
    return rows.groupBy("path", "item").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("record"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, line: text whose line number is its key; parts of one file are aligned by it, never by row order."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("idx", "line"))


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two line scans side by side; a line without partner is an error when it is read."""
    both = left.select("idx", F.col("line").alias("source")).join(right.select("idx", F.col("line").alias("reference")), "idx", "full_outer")
    unpaired = F.col("source").isNull() | F.col("reference").isNull()
    return both.withColumn("reference", F.when(unpaired, F.raise_error(F.concat(F.lit("no partner for line "), "idx"))).otherwise(F.col("reference")))


def manifest(df: DataFrame, key: list[str], base: str, path: str = "path") -> DataFrame:
    """Manifest rows with paths under ``base`` where relative; a repeated key is an error when it is read."""
    n = F.count("*").over(Window.partitionBy(*key))
    full = F.when(F.col(path).rlike(r"^(/|[a-z0-9]+:)"), F.col(path)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col(path)))
    return df.withColumn(path, F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws("/", *key)))).otherwise(full))


def textgrid(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, start, end, word of the words tier of long TextGrid files; blank intervals are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("v"))
    tier = F.regexp_extract("v", r'(?s)name = "words"(.*?)(?:item \[\d+\]:|$)', 1)
    parts = F.regexp_extract_all(tier, F.lit(r'(?s)intervals \[\d+\]:\s*xmin = [\d.]+\s*xmax = [\d.]+\s*text = "[^"]*"'), F.lit(0))
    rows = raw.select("path", F.posexplode(parts).alias("pos", "p"))
    num = lambda name: F.regexp_extract("p", rf"{name} = ([\d.]+)", 1).cast("double")
    return rows.select("path", "pos", num("xmin").alias("start"), num("xmax").alias("end"), F.trim(F.regexp_extract("p", r'text = "([^"]*)"', 1)).alias("word")).where("word <> ''")


def labels_and_types(text: DataFrame, type_property: str = "P31", lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(entity, label) and (entity, type) of N-Triples lines in column value; \\uXXXX escapes are decoded."""
    entity = r"^<[^>]*/(Q\d+)>"
    is_label = rf'{entity} <[^>]*#label> "((?:[^"\\]|\\.)*)"@{lang} \.'
    decoded = F.get_json_object(F.concat(F.lit('{"x":"'), F.regexp_extract("value", is_label, 2), F.lit('"}')), "$.x")
    labels = text.where(F.col("value").rlike(is_label)).select(F.regexp_extract("value", is_label, 1).alias("entity"), decoded.alias("label"))
    edge = rf"{entity} <[^>]*/{type_property}> <[^>]*/(Q\d+)> \."
    types = text.where(F.col("value").rlike(edge)).select(F.regexp_extract("value", edge, 1).alias("entity"), F.regexp_extract("value", edge, 2).alias("type"))
    return labels, types


def audio_segments(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn("segment", audio_field(F.col(field)))


def shards(spark: SparkSession, paths: str, expected: list[str], pattern: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard id from the file name, expected shards that have no file)."""
    rows = spark.read.json(paths).withColumn("shard", F.regexp_extract(F.input_file_name(), pattern, 1))
    want = spark.createDataFrame([(x,) for x in expected], "shard string")
    return rows, want.join(rows.select("shard").distinct(), "shard", "left_anti")


def term_set(df: DataFrame) -> DataFrame:
    """Distinct term keys from whichever of term, term_key, text and source_term a row has."""
    have = [c for c in ("term", "term_key", "text", "source_term") if c in df.columns]
    return df.select(F.lower(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in have])).alias("term_key")).where("term_key IS NOT NULL").distinct()


def bank(spark: SparkSession, path: str) -> DataFrame:
    """An embedding bank: term_id, vec and whatever else it has."""
    return spark.read.parquet(path)
