from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(v):
    """Values of both engines in one form: integral floats as integers, others to six significant decimals."""
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return int(v) if isinstance(v, int) else str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(map(plain, r)) for r in pdf[cols].itertuples(index=False)), key=str)
