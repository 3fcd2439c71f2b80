"""Operators on ordered rows: cursors, islands, log windows, latency and chunk assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offset(rows: DataFrame, by: list[str], order: str, duration: str, offset: str) -> DataFrame:
    """Start of each row: its own offset if given, else the end of the row before; explicit offsets restart the cursor."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.sum(F.when(F.col(offset).isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__i", island)
    inside = Window.partitionBy(*by, "__i").orderBy(order)
    before = F.coalesce(F.sum(duration).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("start", F.coalesce(F.first(offset).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) + before).drop("__i")


def split_instances(log: DataFrame, by: list[str], order: str, kind: Column, segment: str) -> DataFrame:
    """Number of the instance that each log row belongs to.

    Of the rows only window rows of segment 0 (Z) and rows of later segments (P) matter; a Z right after a P starts an instance.
    """
    w = Window.partitionBy(*by).orderBy(order)
    mark = F.when(F.col(segment) > 0, "P").when((F.col(segment) == 0) & kind, "Z")
    marked = log.withColumn("__m", mark)
    before = F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when((F.col("__m") == "Z") & (before == "P"), 1).otherwise(0)
    return marked.withColumn("__s", start).withColumn("instance", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__m", "__s")


def prompt_windows(log: DataFrame, by: list[str], order: str, end: str, segment: str) -> DataFrame:
    """window_start of each row: the end of the row before, or 0 where the segment is 0 or ends go back."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(order))
    return log.withColumn("window_start", F.when((F.col(segment) == 0) | before.isNull() | (F.col(end) < before), F.lit(0.0)).otherwise(before))


def future_text(rows: DataFrame, by: list[str], order: str, text: Column, separator: str) -> DataFrame:
    """Text of all later rows, joined; null texts are skipped."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("future", F.array_join(F.collect_list(text).over(w), separator))


def window_grid(rows: DataFrame, frames: str, widths: list[int], stride: int, seconds: float) -> DataFrame:
    """All windows of each width over a row's frames; one window where the width covers them all."""
    wide = rows.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    starts = F.when(F.col("width") >= F.col(frames), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col(frames) - F.col("width")).cast("int"), F.lit(stride)))
    out = wide.withColumn("first", F.explode(starts)).withColumn("last", F.least(F.col("first") + F.col("width"), F.col(frames)))
    return out.withColumn("win_start", F.col("first") * seconds).withColumn("win_end", F.col("last") * seconds)


def laal(rows: DataFrame, delays: str, offset: Column, duration: Column, reference_units: Column) -> Column:
    """Mean over units of delay - offset - (i + 1) * duration / max(units, reference units)."""
    n = F.greatest(F.size(delays), reference_units)
    total = F.aggregate(F.transform(delays, lambda d, i: d - offset - (i + 1) * duration / n), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(delays))


def assign_chunk(spans: DataFrame, chunks: DataFrame, by: list[str], span_id: list[str]) -> DataFrame:
    """The chunk of each span: that of the largest overlap, else that with the nearest middle; ties to the first chunk.

    span has s0, s1; chunks have chunk_idx, c0, c1 and are few for each key.
    """
    pairs = spans.join(chunks, by)
    overlap = F.greatest(F.lit(0.0), F.least("s1", "c1") - F.greatest("s0", "c0"))
    distance = F.abs((F.col("s0") + F.col("s1")) / 2 - (F.col("c0") + F.col("c1")) / 2)
    best = F.min_by("chunk_idx", F.struct(-overlap, F.when(overlap > 0, 0.0).otherwise(distance), "chunk_idx"))
    return pairs.groupBy(*by, *span_id).agg(best.alias("chunk_idx"))
