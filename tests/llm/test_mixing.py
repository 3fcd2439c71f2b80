from __future__ import annotations

import math

from termlake.llm import mixing

from ..conftest import SMALL, rows_of


def test_oracle(spark, duck):
    assert rows_of(mixing.query(spark, SMALL).toPandas()) == rows_of(duck.execute(mixing.ORACLE).df())


def test_edges(edges, nothing):
    out = mixing.mix(edges, epochs=20).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in edges.collect()} and len(out) > 50
    assert mixing.mix(nothing).count() == 0
    assert set(edges.columns) - {"mix_key"} < set(mixing.mix(edges).columns)


def test_counts_follow_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text", "if(id % 2 = 0, 'a', 'b') AS source")
    got = {r.source: r["count"] for r in mixing.mix(docs, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    for name, share in (("a", 0.75), ("b", 0.25)):
        assert abs(got[name] - 4000 * share) < 5 * math.sqrt(4000 * share)
    many = mixing.mix(docs.limit(20), epochs=40.0).groupBy("doc_id").count().collect()  # a mean above one part's
    assert 25 < sum(r["count"] for r in many) / 20 < 55


def test_many_sources_join_by_salts(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "'t' AS text", "cast(id % 9 AS string) AS source")
    a = sorted(mixing.mix(docs, epochs=2.0).select("doc_id", "mix_replica").collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(mixing.mix(docs, epochs=2.0).select("doc_id", "mix_replica").collect()) == a
