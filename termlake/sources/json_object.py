"""Scan of one huge JSON object: its members as rows, read by several tasks however the object is laid out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

RANGE = 64 << 20
_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_OPEN, _CLOSE = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str, start: int, stop: int) -> tuple[np.ndarray, bool]:
    """The bytes of a range, and whether the first one is escaped by the backslashes before it."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        at, run = start, 0
        while at > 0:  # backslashes may reach back over any number of blocks
            back = min(at, 1 << 12)
            f.seek(at - back)
            block = f.read(back)
            own = len(block) - len(block.rstrip(b"\\"))
            run += own
            at -= back
            if own < back:
                break
        f.seek(start)
        return np.frombuffer(f.read(stop - start), np.uint8), bool(run % 2)


def _quotes(x: np.ndarray, escaped: bool) -> np.ndarray:
    """True at quotes that no backslash escapes."""
    slash = np.concatenate([[escaped], x == _ESCAPE])  # one before the range stands for an odd run
    place = np.arange(len(slash))
    start = np.maximum.accumulate(np.where(slash, 0, place + 1))  # where the run of backslashes that ends here begins
    odd = (place + 1 - start) % 2 == 1
    return (x == _QUOTE) & ~(slash[:-1] & odd[:-1])


def _depths(x: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is outside strings, and how much deeper it is after it than at the range's start."""
    outside = (np.cumsum(quotes) + inside) % 2 == 0
    step = np.where(outside, np.isin(x, _OPEN).astype(np.int8) - np.isin(x, _CLOSE).astype(np.int8), 0)
    return outside, np.cumsum(step, dtype=np.int64)


def json_object(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """at, key, value: the members of the one object in a file, in order of ``at`` (their place in bytes).

    Strings are unescaped, other values are JSON text, null is null; repeated keys are rows each.  Ranges of ``size`` bytes
    are read by tasks of their own, twice: first whether a range ends inside a string and how deep it is then, for either
    way that it may begin, which the driver adds up (two numbers a range); then the members' parts, which are joined where
    ranges cut them, be it within a key, an escape or a character.  A member larger than a row can be is not supported.
    Anything but white space (or a byte order mark) around one whole object raises.
    """
    store, name = _store(path)
    total = store.get_file_info([name])[0].size
    if total is None:
        raise FileNotFoundError(path)
    n = max(1, -(-total // size))
    ranges = spark.range(0, n, 1, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                x, escaped = _read(path, k * size, min(total, (k + 1) * size))
                quotes = _quotes(x, escaped)
                deeper = [int(_depths(x, quotes, s)[1][-1]) if len(x) else 0 for s in (False, True)]
                yield pa.RecordBatch.from_pydict({"id": [k], "odd": [bool(quotes.sum() % 2)], "outside": [deeper[0]], "inside": [deeper[1]]})

    starts, inside, depth = [], False, 0
    for r in sorted(ranges.mapInArrow(scan, "id long, odd boolean, outside long, inside long").collect()):
        starts.append((inside, depth))
        depth += r.inside if inside else r.outside
        inside ^= r.odd
    if inside or depth:
        raise ValueError(f"{path} is not one whole JSON object")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                x, escaped = _read(path, k * size, min(total, (k + 1) * size))
                outside, deeper = _depths(x, _quotes(x, escaped), starts[k][0])
                after = deeper + starts[k][1]
                before = np.concatenate([[starts[k][1]], after[:-1]])
                begins = outside & (((x == _COMMA) & (after == 1)) | ((before == 0) & (after == 1)))
                ends = outside & (before == 1) & (after == 0)
                if (x[begins & (before == 0)] != _OPEN[0]).any():
                    raise ValueError(f"{path} is not one whole JSON object")
                cuts = np.flatnonzero(begins | ends)
                data, edges = x.tobytes(), [-1, *cuts.tolist(), len(x)]
                ids = [-1, *[int(c) + k * size if begins[c] else -3 for c in cuts]]  # -1: begun before, -2: outside the object, -3: after its end
                if starts[k][1] == 0:
                    ids[0] = -2
                texts = [data[edges[i] + 1 : edges[i + 1]] for i in range(len(ids))]
                at = np.array([k] * len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["k", "at", "part"])

    written = shared_path(spark, "members")
    ranges.mapInArrow(parts, "k long, at long, part binary").write.parquet(written)
    rows = spark.read.parquet(written)
    around = rows.where("at < -1").select(F.regexp_replace(F.decode("part", "UTF-8"), "^\ufeff|\\s", "").alias("t")).where("t <> ''").limit(1).count()
    around += rows.where("at = -3").limit(2).count() - 1  # of one object there is one end
    begun = rows.where("at >= 0").groupBy("k").agg(F.max("at").alias("at")).collect()
    if around or not begun:
        raise ValueError(f"{path} is not one whole JSON object")
    last, open_at = {r.k: r["at"] for r in begun}, []
    now = -1
    for k in range(n):
        open_at.append(now)
        now = last.get(k, now)
    whose = F.when(F.col("at") == -1, F.element_at(F.array(*[F.lit(a).cast("long") for a in open_at]), (F.col("k") + 1).cast("int"))).otherwise(F.col("at"))
    joined = rows.where("at >= -1").groupBy(whose.alias("at")).agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["part"]))
    members = joined.select("at", F.trim(F.decode(text, "UTF-8")).alias("member")).where("trim(member, ' \t\r\n') <> ''")
    found = F.from_json(F.concat(F.lit("{"), "member", F.lit("}")), "map<string,string>", {"mode": "FAILFAST", "allowUnquotedControlChars": "true"})
    return members.select("at", F.explode(found).alias("key", "value"))
