"""Readers and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlake.sources import readers as R
from termlake.sources import sinks as K


def put(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in R.jsonl(spark, p, "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        R.jsonl(spark, p, "a int").collect()
    assert sum(r._bad is not None for r in R.jsonl_with_rejects(spark, p, T.StructType().add("a", T.IntegerType())).collect()) == 1


@pytest.mark.parametrize("root", ['{"k": {"target_translations": {"zh": " "}, "translation": "x"}, "m": {"term": "t", "target_translations": {"zh": "y"}}}', '[{"key": "k", "translation": "x"}, {"term": "t", "target_translation": "y"}]'])
def test_glossary_roots(spark, tmp_path, root):
    rows = R.glossary(spark, put(tmp_path / "g.json", root)).orderBy("pos").collect()
    assert [(r.term, r.translation) for r in rows] == [("k", "x"), ("t", "y")]


def test_yaml_lines_align(spark, tmp_path):
    y = R.flat_yaml(spark, put(tmp_path / "a.yaml", "# c\n- wav: 'a:b.wav'\n  offset: 1.5\n- wav: c\n  offset: null\n")).orderBy("item").collect()
    assert [r.record for r in y] == [{"wav": "a:b.wav", "offset": "1.5"}, {"wav": "c", "offset": None}]
    a, b, c = (R.lines(spark, put(tmp_path / n, t)) for n, t in (("a", "x\ny\n"), ("b", "1\n2\n"), ("c", "1\n")))
    assert [(r.source, r.reference) for r in R.align(a, b).orderBy("idx").collect()] == [("x", "1"), ("y", "2")]
    with pytest.raises(Exception, match="no partner"):
        R.align(a, c).collect()


def test_textgrid_and_triples(spark, tmp_path):
    grid = 'item [1]:\n class = "IntervalTier"\n name = "words"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "hi"\n intervals [2]:\n xmin = 0.5\n xmax = 1\n text = ""\nitem [2]:\n name = "phones"\n intervals [1]:\n xmin = 0\n xmax = 1\n text = "h"\n'
    assert [(r.start, r.end, r.word) for r in R.textgrid(spark, put(tmp_path / "x.TextGrid", grid)).collect()] == [(0.0, 0.5, "hi")]
    n = spark.createDataFrame([('<http://e/Q1> <http://s#label> "caf\\u00e9"@en .',), ('<http://e/Q1> <http://s#label> "x"@de .',), ("<http://e/Q1> <http://p/P31> <http://e/Q5> .",)], "value string")
    labels, types = R.labels_and_types(n)
    assert labels.collect() == [("Q1", "café")] and types.collect() == [("Q1", "Q5")]


def test_manifest_shards_tables(spark, tmp_path):
    m = spark.createDataFrame([("a", "x.wav"), ("b", "/y.wav")], "id string, path string")
    assert [r.path for r in R.manifest(m, ["id"], "/base").orderBy("id").collect()] == ["/base/x.wav", "/y.wav"]
    with pytest.raises(Exception, match="repeated key"):
        R.manifest(m.union(m), ["id"], "/base").collect()
    put(tmp_path / "s-0.jsonl", '{"a": 1}\n')
    rows, missing = R.shards(spark, str(tmp_path / "s-*.jsonl"), ["0", "1"], r"s-(\d+)\.jsonl")
    assert rows.first().shard == "0" and [r.shard for r in missing.collect()] == ["1"]
    K.tsv(m.withColumn("z", F.lit("NA")), str(tmp_path / "t"), ["z", "id"])
    back = R.metrics(R.tsv(spark, str(tmp_path / "t")), ["z"])
    assert back.columns == ["z", "id"] and back.where("z IS NULL").count() == 2
    with pytest.raises(ValueError):
        R.single_row(back)
    assert R.last_row(back, "id").first().id == "b"
    assert K.with_stats(m, str(tmp_path / "w"), n=F.count("*"))["n"] == 2
    assert sorted(r.path for r in K.upsert(m, spark.createDataFrame([("a", "new")], m.schema), ["id"]).collect()) == ["/y.wav", "new"]
    assert K.content_addressed(m.union(m), "path").count() == 2
    assert sorted(r.term_key for r in R.term_set(spark.createDataFrame([("A ", None), ("", "b")], "term string, text string")).collect()) == ["a", "b"]
