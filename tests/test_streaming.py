"""Streams against their batch twins, and the stateful session operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termlake.streaming import sessions as ST

from .conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events") / "t")
    spark.read.parquet(f"{SMALL}/events.parquet").repartitionByRange(3, "ts").write.parquet(out)
    return out


def test_tumbling_equals_batch_where_closed(spark, folder):
    streamed = ST.run_available(ST.tumbling(ST.events(spark, folder, 10), ["user_id"], "1 hour", "1 hour"), "tumbling")
    batch = ST.tumbling(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "1 hour", "1 hour")
    key = lambda df: {(r.user_id, r.start): r.n for r in df.collect()}
    s, b = key(streamed), key(batch)
    assert s and all(b[k] == n for k, n in s.items()) and len(s) >= 0.9 * len(b)


def test_segments_fire_and_reset(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, False), ("a", 2.0, False), ("a", 2.5, True), ("b", 0.2, True)], "stream string, audio_end double, finished boolean").coalesce(1).write.parquet(str(tmp_path / "s/1"))
    rows = spark.readStream.schema("stream string, audio_end double, finished boolean").parquet(str(tmp_path / "s/*"))
    out = ST.run_available(ST.segments(rows, 0.96), "segs").orderBy("stream", "segment").collect()
    assert [(r.stream, r.segment, round(r.stop, 2), r.finished) for r in out] == [("a", 0, 0.96, False), ("a", 1, 1.92, False), ("a", 2, 2.5, True)]


def test_bounded_history(spark, tmp_path):
    spark.createDataFrame([("a", t) for t in range(9)], "stream string, turn long").coalesce(1).write.parquet(str(tmp_path / "h/1"))
    rows = spark.readStream.schema("stream string, turn long").parquet(str(tmp_path / "h/*"))
    assert ST.run_available(ST.bounded_history(rows, 4, 2), "hist", "update").first().held == [6, 7, 8]
