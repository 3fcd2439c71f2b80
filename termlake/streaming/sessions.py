"""Streaming sessions: cursors, triggers, lookback, merging and bounded history on Structured Streaming.

Streams have an event-time column ``ts``; audio seconds become timestamps by adding them to a start.  State is kept by
stream id, and watermarks bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of one unit of audio, of lookback, and least seconds of new audio before a search.
UNIT, LOOKBACK, MIN_NEW = 0.96, 1.92, 0.48


def events(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A stream of parquet files of events, with a real timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, by: list[str], size: str, late: str) -> DataFrame:
    """Counts and sums by tumbling window; rows later than the watermark are dropped."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(*by, F.window("ts", size)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("start"), "n", "total")


def sliding_best(rows: DataFrame, by: list[str], term: str, size: str, slide: str, late: str) -> DataFrame:
    """Best value of each term in each sliding window."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(*by, term, F.window("ts", size, slide)).agg(F.max("value").alias("best")).select(*by, term, F.col("window.start").alias("start"), "best")


def sessions(rows: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(*by, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def lookback_join(chunks: DataFrame, evidence: DataFrame, by: str, seconds: float, late: str) -> DataFrame:
    """Each chunk with the evidence of its stream in the seconds before it: a stream-stream join that watermarks bound."""
    left = chunks.select(F.col(by).alias("stream"), F.col("ts").alias("chunk_ts"), F.col("event_id").alias("chunk_id"))
    right = evidence.select(F.col(by).alias("stream_r"), F.col("ts").alias("evidence_ts"), F.col("event_id").alias("evidence_id"))
    if chunks.isStreaming:
        left, right = left.withWatermark("chunk_ts", late), right.withWatermark("evidence_ts", late)
    span = f"interval {seconds} seconds"
    return left.join(right, F.expr(f"stream = stream_r AND evidence_ts <= chunk_ts AND evidence_ts >= chunk_ts - {span}")).select("stream", "chunk_id", "evidence_id")


def oracle_references(windows: DataFrame, gold: DataFrame, by: str, most: int) -> DataFrame:
    """Stream-static join: gold terms whose time meets a window, the last of each term, at most ``most`` in order."""
    hit = windows.join(gold, by).where("g0 < w1 AND g1 > w0")
    last = hit.groupBy(by, "w0", "w1", "term").agg(F.max_by(F.struct("pos", "translation"), "pos").alias("g"))
    picked = F.slice(F.sort_array(F.collect_list(F.struct("g.pos", "term", "g.translation"))), 1, most)
    return last.groupBy(by, "w0", "w1").agg(picked.alias("references"))


SEGMENT = "stream string, segment long, start double, stop double, units long, finished boolean"
_STATE = "cursor double, fired double, segment long, units long, source double"


def segments(rows: DataFrame, seconds: float, min_start: float = 0.0, tail: float = 0.32) -> DataFrame:
    """Segments that a session agent would emit from a stream of (stream, audio_end, finished).

    State by stream: how much audio there is, how much was used, and the segment number.  A segment fires when a whole
    ``seconds`` of new audio are there after ``min_start``, or what is left at the end if that is more than ``tail``.
    A source that shrinks is a new source and resets the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, fired, number, units, source = state.get if state.exists else (0.0, 0.0, 0, 0, 0.0)
        out = []
        pdf = pd.concat(list(batches)).sort_values("audio_end")
        reset = bool(len(pdf)) and float(pdf.audio_end.iloc[-1]) < source
        if reset:
            cursor, fired, number, units = 0.0, 0.0, 0, 0
        for end, finished in zip(pdf.audio_end, pdf.finished, strict=True):
            cursor = max(cursor, float(end))
            while cursor >= min_start and cursor - fired >= seconds - 1e-9:
                out.append((key[0], number, fired, fired + seconds, 1, False))
                fired, number, units = fired + seconds, number + 1, units + 1
            if finished and cursor - fired > tail:
                out.append((key[0], number, fired, cursor, 1, True))
                fired, number, units = cursor, number + 1, units + 1
        state.update((cursor, fired, number, units, cursor))
        yield pd.DataFrame(out, columns=["stream", "segment", "start", "stop", "units", "finished"])

    return rows.groupBy("stream").applyInPandasWithState(step, SEGMENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def bounded_history(rows: DataFrame, most: int, keep: int, strict: bool = False) -> DataFrame:
    """The turns that each conversation holds after every micro-batch of (stream, turn); trimmed to ``keep`` beyond ``most``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for turn in pd.concat(list(batches)).sort_values("turn").turn:
            held.append(int(turn))
            if len(held) > most or (not strict and len(held) == most):
                held = held[-keep:]
        state.update((held,))
        yield pd.DataFrame({"stream": [key[0]], "held": [held]})

    return rows.groupBy("stream").applyInPandasWithState(step, "stream string, held array<long>", "held array<long>", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a query over all that is there and return what it gave; for tests and small replays."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
