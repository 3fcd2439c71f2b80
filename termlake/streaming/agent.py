"""The session agent as a stateful stream operator: start wait, triggers, tail rule, resets, ring limit and expiry.

Reads may come in any split into micro-batches: they wait in state until the watermark has passed them and are then taken
in the order of their times, so the segments are the same for every split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READ = "stream string, ts timestamp, at long, data binary, finished boolean"
SEGMENT = "stream string, segment long, first long, last long, data binary, padding long, held long, finished boolean"


@dataclass(frozen=True)
class Rules:
    """Sizes are in samples (bytes of a read): one segment, the least start, the shortest tail, the ring, the least increment; ``idle`` in milliseconds."""

    segment: int
    start: int = 0
    tail: int = 0
    ring: int = 1 << 40
    least: int = 0
    idle: int = 3_600_000


class Agent(StatefulProcessor):
    """State of a stream: reads that wait, the numbers of the source at hand, and what of it was not emitted yet, ring at most."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, at long, data binary, finished boolean")
        self.source = handle.getValueState("source", "seen long, dropped long, sent long, segment long, latest long")
        self.tail = handle.getValueState("tail", "data binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = []
        for pdf in rows:
            for ts, at, data, finished in zip(pdf.ts, pdf["at"], pdf.data, pdf.finished, strict=True):
                ms = int(ts.value // 1_000_000)
                new.append((ms, int(at), bytes(data or b""), bool(finished)))
        for ms in sorted({r[0] for r in new}):
            self.handle.registerTimer(max(ms, now + 1))
        self.waiting.appendList(new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = list(self.waiting.get())
        due = sorted(r for r in map(tuple, held) if r[0] <= upto)
        state = tuple(self.source.get()) if self.source.exists() else None
        if due:
            rest = [r for r in map(tuple, held) if r[0] > upto]
            self.waiting.put(rest) if rest else self.waiting.clear()
            numbers = list(state or (0, 0, 0, 0, 0))
            tail = self.tail.get()[0] if self.tail.exists() else b""
            out = []
            for ms, at, data, finished in due:
                if state and ms > numbers[4] + self.rules.idle:  # as if its state had gone already
                    numbers, tail = [0, 0, 0, 0, 0], b""
                tail, segment = advance(self.rules, numbers, bytes(tail), at, bytes(data), finished)
                numbers[4], state = ms, True
                if segment is not None:
                    out.append((key[0], *segment))
            self.source.update(tuple(numbers))
            self.tail.update((tail,))
            self.handle.registerTimer(numbers[4] + self.rules.idle)
            if out:
                yield pd.DataFrame(out, columns=["stream", "segment", "first", "last", "data", "padding", "held", "finished"])
        elif state and not held and state[4] + self.rules.idle <= upto:  # nothing came for so long: the stream's state goes
            self.source.clear()
            self.tail.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def advance(rules: Rules, numbers: list[int], tail: bytes, at: int, data: bytes, finished: bool) -> tuple[bytes, tuple | None]:
    """Take one read: changes ``numbers`` (seen, dropped, sent, segment); returns what is not emitted yet, and the segment if one is.

    A read is ``data`` at place ``at`` of its source.  A source that ends before what was seen is a new one.  The agent waits
    for the least start, and ends a source shorter than the tail without audio; else it emits what is new whenever that is a
    segment or the source is finished.  Of a source longer than the ring only its end is held, places moving on accordingly,
    and an increment below the least size is padded.
    """
    total = at + len(data)
    if total < numbers[0]:
        numbers[:4] = [0, 0, 0, numbers[3]]
        tail = b""
    seen, dropped, sent, number = numbers[:4]
    if total > seen:
        tail = (tail + data[max(0, seen - at) :])[-rules.ring :]
    numbers[0] = total
    length = total - dropped
    if not finished and length < rules.start:
        return tail, None
    if finished and length < rules.tail:
        numbers[3] += 1
        return tail, (number, sent, sent, b"", 0, length, True)
    if not finished and total - sent < rules.segment:
        return tail, None
    dropped = max(dropped, total - rules.ring)
    first = max(sent, dropped)
    part = tail[len(tail) - (total - first) :] if total > first else b""
    numbers[1:4] = [dropped, total, number + 1]
    return b"", (number, first, total, part, max(0, rules.least - len(part)), total - dropped, finished)


def agent_segments(reads: DataFrame, rules: Rules, late: str = "10 seconds") -> DataFrame:
    """Segments of a stream of reads (``READ``).

    Reads later than the watermark by ``late`` are dropped by it; state of a stream goes after ``rules.idle`` without reads.
    What a stream holds is at most its waiting reads and one ring.  Needs the RocksDB state store (``use_state_store``).
    """
    marked = reads.select("stream", "ts", "at", "data", "finished").withWatermark("ts", late)
    return marked.groupBy("stream").transformWithStateInPandas(statefulProcessor=Agent(rules), outputStructType=SEGMENT, outputMode="Append", timeMode="EventTime")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(_STORE, PROVIDER)


def replay(reads: DataFrame, rules: Rules, path: str, files: int = 1) -> DataFrame:
    """Segments of stored reads, by running the stream over them to its end: reads, checkpoints and segments are written under ``path``.

    The stream takes ``files`` of the reads' files at once, in any order: the watermark stays behind by all the time that
    the reads span, so none is late.  A last read of a stream of its own lets it pass them all and then the idle time.
    """
    spark = reads.sparkSession
    own = reads.select("stream", "ts", "at", "data", "finished").where("ts IS NOT NULL")
    low, high = own.agg(F.min("ts"), F.max("ts")).first()
    span = int((high - low).total_seconds()) + 1 if low else 1
    own.repartitionByRange("ts").write.parquet(f"{path}/reads/1")
    end = F.lit(high) + F.make_dt_interval(days=F.lit(1), secs=F.lit(span + rules.idle // 1000))
    last = spark.range(1 if low else 0).select(F.lit("").alias("stream"), end.alias("ts"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("data"), F.lit(False).alias("finished"))
    last.write.parquet(f"{path}/reads/2")
    stream = spark.readStream.schema(READ).option("maxFilesPerTrigger", files).parquet(f"{path}/reads/*")
    before = spark.conf.get(_STORE, None)
    use_state_store(spark)
    q = agent_segments(stream, rules, f"{span} seconds").writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/segments")
    q.awaitTermination()
    spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)  # the caller's session is left as it was
    return spark.read.schema(SEGMENT).parquet(f"{path}/segments").where("stream <> ''")
