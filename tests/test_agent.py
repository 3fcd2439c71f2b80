"""The stateful agent against a plain fold, for several splits into micro-batches; resets, ring, late reads, expiry."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from termlake.streaming import agent as G

START = dt.datetime(2026, 1, 1)


def fold(reads, rules):
    """Segments by the whole source held as bytes."""
    out = []
    for stream in sorted({r[0] for r in reads}):
        source, offset, seen, sent, number = b"", 0, 0, 0, 0
        for _, _, at, data, finished in sorted(r for r in reads if r[0] == stream):
            total = at + len(data)
            if total < seen:
                source, offset, sent = b"", 0, 0
                source = b"?" * at + data
            else:
                source = (b"?" * offset + source)[:seen] + data[max(0, seen - at) :]
                source = source[offset:]
            seen = total
            length = len(source)
            if not finished and length < rules.start:
                continue
            if finished and length < rules.tail:
                out.append((stream, number, offset + sent, offset + sent, b"", 0, length, True))
                number += 1
                continue
            if not finished and length - sent < rules.segment:
                continue
            if length > rules.ring:  # as a list that is cut, with offsets moved
                cut = length - rules.ring
                source, sent, offset = source[cut:], max(0, sent - cut), offset + cut
            part = source[sent:]
            out.append((stream, number, offset + sent, seen, part, max(0, rules.least - len(part)), len(source), finished))
            sent, number = len(source), number + 1
    return out


def reads_of(seed, streams=6):
    g = np.random.default_rng(seed)
    rows = []
    for s in range(streams):
        at, second = 0, int(g.integers(0, 50))
        for k in range(int(g.integers(1, 25))):
            data = bytes(g.integers(97, 123, int(g.choice([0, 1, 3, 7, 20, 60])), dtype=np.uint8))
            second += int(g.integers(1, 9))
            if g.random() < 0.12:
                at = 0  # a new source
            rows.append((f"s{s}", START + dt.timedelta(seconds=second), at, data, bool(g.random() < 0.1)))
            at += len(data)
    return rows


@pytest.mark.parametrize("files", [1, 100])
def test_replay_equals_a_plain_fold_for_any_split(spark, tmp_path, files):
    rules = G.Rules(segment=24, start=10, tail=5, ring=32, least=16)
    reads = reads_of(5)
    df = spark.createDataFrame(reads, G.READ)
    got = sorted(tuple(r) for r in G.replay(df, rules, f"file://{tmp_path}", files).collect())
    assert [(*r[:4], bytes(r[4]), *r[5:]) for r in got] == sorted(fold(reads, rules)) and len(got) > 20


@pytest.mark.parametrize("seed", range(20))
def test_steps_equal_a_plain_fold(seed):
    rules = G.Rules(segment=24, start=10, tail=5, ring=int(np.random.default_rng(seed).choice([8, 32, 1000])), least=16)
    reads, out = reads_of(seed), []
    for stream in sorted({r[0] for r in reads}):
        numbers, tail = [0, 0, 0, 0, 0], b""
        for _, _, at, data, finished in sorted(r for r in reads if r[0] == stream):
            tail, segment = G.advance(rules, numbers, tail, at, data, finished)
            assert len(tail) <= rules.ring
            if segment:
                out.append((stream, *segment))
    assert out == fold(reads, rules)


def test_state_goes_after_idle_time_and_late_reads_are_dropped(spark, tmp_path):
    G.use_state_store(spark)
    rules = G.Rules(segment=4, idle=60_000)
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[("a", at(0), 0, b"abcd", False)], [("b", at(300), 0, b"wxyz", False)], [("a", at(1), 4, b"late", False), ("b", at(900), 4, b"more", True)], [("c", at(5000), 0, b"", False)]]
    stream = spark.readStream.schema(G.READ).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, G.READ).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = G.agent_segments(stream, rules).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    got = sorted((r.stream, r.segment, bytes(r.data)) for r in spark.read.schema(G.SEGMENT).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0, b"abcd"), ("b", 0, b"more"), ("b", 0, b"wxyz")]  # b came back after the idle time
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sizes[-1] <= 3  # c's read and timer; a and b are gone


def test_no_reads(spark, tmp_path):
    assert G.replay(spark.createDataFrame([], G.READ), G.Rules(segment=4), f"file://{tmp_path}").count() == 0
