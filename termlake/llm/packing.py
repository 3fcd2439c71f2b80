"""Packing documents into sequences by length patterns, fitted by non-negative least squares."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, map_arrow, table

SIZE = 2048
SEPARATOR = 0
#: Steps of the least-squares fit.
STEPS = 300
#: Share of the pieces that one fit places at least, if its patterns reach; the rest is fitted again.
ROUND = 0.5
#: Pieces of one length that are ranked together; longer runs are dealt over salts.
RUN = 50_000


# ---------------------------------------------------------------- the plan, from the histogram of lengths alone


def patterns(histogram: np.ndarray, size: int) -> np.ndarray:
    """All patterns of up to three present lengths that fill ``size`` exactly, as rows of lengths, 0 where unused."""
    have = np.flatnonzero(histogram)
    have = have[(have > 0) & (have < size)]
    mask = np.zeros(size + 1, bool)
    mask[have] = True
    low = have[2 * have <= size]
    two = np.stack([size - low, low, np.zeros_like(low)], 1)[mask[size - low]]
    out = [two]
    for c in have[3 * have <= size]:  # c <= b <= a
        b = have[(have >= c) & (2 * have <= size - c)]
        a = size - c - b
        ok = mask[a]
        out.append(np.stack([a[ok], b[ok], np.full(int(ok.sum()), c)], 1))
    return np.concatenate(out).astype(np.int64)


def fit(found: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of (counts of lengths used - histogram).

    Accelerated projected gradient; a length weighs by its size, so that long pieces, which are hard to place later, fit best.
    """
    n = len(histogram)
    if not len(found):
        return np.zeros(0)
    weight = (np.arange(n) / n) ** 2 + 0.05
    weight[0] = 0
    goal = histogram.astype(float)
    degree = np.bincount(found.ravel(), minlength=n).astype(float)
    degree[0] = 0
    step = 1.0 / np.maximum((weight * degree)[found].sum(1), 1e-9)  # 1 / the pattern's row sum in the normal matrix
    x = np.zeros(len(found))
    y, t = x, 1.0
    for _ in range(steps):
        used = np.bincount(found.ravel(), weights=np.repeat(y, 3), minlength=n)
        gap = weight * (used - goal)
        gap[0] = 0
        fresh = np.maximum(y - step * gap[found].sum(1), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(fresh + (t - 1) / t2 * (fresh - x), 0)
        x, t = fresh, t2
    return x


def place_fitted(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of fitted patterns, as (lengths, copies); their pieces are taken from the histogram ``left``.

    Counts are rounded by largest remainder: every pattern has its whole part first; if these are few, patterns have one
    more in the order of the remainders, where their lengths are still there.  What is left is fitted again, until no
    pattern fills a sequence.
    """
    kinds: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: np.ndarray, copies: int) -> None:
        key = tuple(int(v) for v in pattern if v)
        copies = min(copies, *(int(left[v]) // key.count(v) for v in key))
        if copies > 0:
            kinds.append((key, copies))
            for v in key:
                left[v] -= copies

    while True:
        found = patterns(left, size)
        if not len(found):
            return kinds
        before = int(left.sum())
        x = fit(found, left)
        whole = np.floor(x + 1e-9).astype(np.int64)
        order = np.argsort(-x, kind="stable")
        for k in order[whole[order] > 0].tolist():
            put(found[k], int(whole[k]))
        rest = x - whole
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        at = 0
        while at < len(order) and left.sum() > (1 - ROUND) * before:  # a stretch at a time, without patterns whose lengths are gone
            part = order[at : at + 512]
            there = (left[found[part]] > 0) | (found[part] == 0)
            for k in part[there.all(1)].tolist():
                put(found[k], 1)
            at += 512
        if int(left.sum()) == before:
            return kinds


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: bins of the same contents are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    open_rooms: np.ndarray = np.zeros(size + 1, np.int64)
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(open_rooms[length:])
            if not len(fits):
                per = size // length  # new bins: full ones first, then the rest
                full, rest = divmod(count, per)
                for many, bins in ((per, full), (rest, 1 if rest else 0)):
                    if bins:
                        space, key = size - many * length, (length,) * many
                        room[space][key] = room[space].get(key, 0) + bins
                        open_rooms[space] += bins
                break
            space = length + int(fits[0])
            key, bins = next(iter(room[space].items()))
            many = space // length
            if count >= many:
                take = min(bins, count // many)
                put = many
            else:
                take, put = 1, count
            if take == bins:
                del room[space][key]
            else:
                room[space][key] = bins - take
            open_rooms[space] -= take
            fresh, at = key + (length,) * put, space - put * length
            room[at][fresh] = room[at].get(fresh, 0) + take
            open_rooms[at] += take
            count -= take * put
    return [(key, bins) for spaces in room.values() for key, bins in spaces.items()]


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences, as (lengths in descending order, copies), that hold exactly the histogram's pieces.

    Fitted patterns come first; the residual is packed by best-fit decreasing over the same histogram.  Everything here is
    bounded by ``size``, not by the corpus.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    kinds: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        kinds.append(((size,), int(left[size])))
        left[size] = 0
    kinds += place_fitted(left, size)
    return kinds + best_fit(left, size)


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, kinds: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        first = 0
        for key, copies in kinds:
            at = 0
            for length in sorted(set(key), reverse=True):
                many = key.count(length)
                rows[length].append((copies * many, many, first, at))
                at += many * length
            first += copies
        self.sequences = first
        self.by = {n: np.array(v, np.int64).reshape(-1, 4) for n, v in rows.items()}
        self.ends = {n: np.cumsum(v[:, 0]) for n, v in self.by.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset for ranks (from 0) of a length."""
        ends, rows = self.ends[length], self.by[length]
        k = np.searchsorted(ends, ranks, side="right")
        inside = ranks - (ends[k] - rows[k, 0])
        many = rows[k, 1]
        return rows[k, 2] + inside // many, rows[k, 3] + inside % many * length


# ---------------------------------------------------------------- documents


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, separator: int | None = SEPARATOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 of each piece; a document without ids has one of length 0 and no place."""
    path = vocabulary or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for b in batches:
            flat, offsets = encode(b.column("text"))
            if separator is not None:
                flat = np.insert(flat, offsets[1:], np.uint32(separator))
                offsets = offsets + np.arange(len(offsets))
            n = np.diff(offsets)
            count = np.maximum(1, -(-n // size))
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            raw = flat.astype("<u4")
            crc = [zlib.crc32(raw[a : a + m]) for a, m in zip((offsets[row] + start).tolist(), length.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("row_key").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, separator: int | None = SEPARATOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Only documents above ``size`` ids are cut.  Null texts are empty: their separator is their one id.  Repeated rows are
    packed each on their own; null ids stay null; other columns are not read; an empty table gives no rows.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    todo = cut(pieces(docs, size, vocabulary, separator, id_col, text))
    found = todo.groupBy("length").count().collect()  # at most size + 1 rows
    histogram = np.zeros(size + 1, np.int64)
    for r in found:
        histogram[r["length"]] += r["count"]
    places = Places(plan(histogram, size))
    salts = {n: max(1, -(-int(c) // RUN)) for n, c in enumerate(histogram) if c}
    salt_of = F.create_map(*[F.lit(x) for n, s in salts.items() if s > 1 for x in (n, s)]) if any(s > 1 for s in salts.values()) else None
    salt = F.lit(0) if salt_of is None else F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.coalesce(salt_of[F.col("length").cast("int")], F.lit(1))).cast("int")
    todo = todo.withColumn("salt", salt)
    before: dict[tuple[int, int], int] = {}
    at: dict[int, int] = defaultdict(int)
    for r in sorted(todo.groupBy("length", "salt").count().collect()) if salt_of is not None else ():  # size + pieces / RUN rows at most
        before[r["length"], r["salt"]] = at[r["length"]]
        at[r["length"]] += r["count"]
    ranked = todo.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "row_key", "piece")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salted, rank = (b.column(c).to_numpy() for c in ("length", "salt", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            key = length * (1 << 32) + salted
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order], prepend=-1))
            for rows in np.split(order, edges[1:]) if len(order) else ():
                n = int(length[rows[0]])
                if n:
                    sequence[rows], offset[rows] = places.of(n, rank[rows].astype(np.int64) - 1 + before.get((n, int(salted[rows[0]])), 0))
                else:
                    sequence[rows] = -1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(sequence), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    return map_arrow(ranked.select(*cols, "salt", "rank"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
