"""A session with the settings that the library expects (UTC, adaptive execution, skew splitting), and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Settings given by name (dots as double underscores) override the defaults; a running session is reused."""
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName("termlake")
    if master:
        builder = builder.master(master)
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share; unset, and in local mode only, in this machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "termlake-shared")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
