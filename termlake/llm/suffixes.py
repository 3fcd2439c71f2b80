"""Long byte strings that occur more than once, by distributed prefix doubling over positions that the text itself picks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow, mix64, table

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of the first strings that get ranks: a quarter of ``LENGTH``.
CORE = LENGTH // 4
#: Neighbouring window starts that one row stands for in the rounds after the first; with w of them, LENGTH + 1 - w bytes are ranked.
WIDTHS = (64, 8, 1)
#: Bytes that are hashed at once; longer texts are cut into stretches of so many window starts.
BUFFER = 1 << 20
_BASE = 0xD1342543DE82EF95  # any odd number


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, powers of the base and of its inverse."""

    def powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        have = 1
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        return out

    n = BUFFER + 2 * LENGTH + 1
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)


class Hashes:
    """64-bit names of all substrings of a buffer, equal for equal strings wherever they stand."""

    def __init__(self, data: bytes):
        letters, up, self.down = _tables()
        x = np.frombuffer(data, np.uint8)
        if len(x) >= len(up):
            raise ValueError("the buffer is too long")
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(letters[x] * up[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, mark: np.ndarray | int = 0) -> np.ndarray:
        """Names of [start, end) together with a small number."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + mix64(np.atleast_1d(np.asarray(mark, np.uint64)) + np.uint64(1)))


def _buffers(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """(text, first window start) and bytes of stretches, as many at once as a buffer holds."""
    at, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for s in range(0, len(text) - LENGTH + 1, BUFFER):
            part = text[s : s + BUFFER + LENGTH - 1]
            if parts and size + len(part) > BUFFER:
                yield at, parts
                at, parts, size = [], [], 0
            at.append((i, s))
            parts.append(part)
            size += len(part)
    if parts:
        yield at, parts


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """text, first window start, further starts, anchor's offset in the first window, core and context names of runs of windows.

    Of the strings of ``CORE`` bytes in a window the one of least hash, the last of equal ones, is its anchor: equal windows
    have the same anchor at the same offset.  A run is the windows in a row that share their anchor; its core is the anchor's
    bytes, its context all that its windows cover.
    """
    width, low = LENGTH - CORE + 1, np.uint64((1 << 24) - 1)
    for at, parts in _buffers(texts):
        names = Hashes(b"".join(parts))
        n = len(names.sums) - 1
        place = np.arange(n - CORE + 1)
        core = names.of(place, place + CORE)
        # least of each window: running minima from both ends of blocks; the low bits hold the place
        key = (core & ~low) | (low - place.astype(np.uint64))
        blocks = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
        before, after = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        windows = len(key) - width + 1
        anchor = (low - (np.minimum(after[:windows], before[width - 1 : len(key)]) & low)).astype(np.int64)
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        own = sizes - LENGTH + 1  # windows that do not reach into the next part
        part = np.repeat(np.arange(len(parts)), own)
        start = np.arange(len(part)) - np.repeat(np.cumsum(own) - own, own) + begins[part]
        a = anchor[start]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
        last = np.concatenate([first[1:], [len(a)]]) - 1
        lo, hi, a, part = start[first], start[last], a[first], part[first]
        context = names.of(lo, hi + LENGTH, ((a - lo) << 16) | (hi - lo))
        text, shift = np.array([i for i, _ in at]), np.array([s for _, s in at])
        yield text[part], lo - begins[part] + shift[part], hi - lo, a - lo, core[a].view(np.int64), context.view(np.int64)


def _marked(docs: DataFrame, id_col: str) -> DataFrame:
    """doc_id, text as bytes, and two numbers that rows share only where they have the same text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc = F.col(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-1)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _first_ranks(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, doc, mark = b.column("text").to_pylist(), b.column("doc").to_numpy(), b.column("mark").to_numpy()
            for i, lo, more, offset, core, context in runs(texts):
                cols = (doc[i], mark[i], core, context, lo << 32 | more << 16 | offset)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "mark", "core", "name", "place"])

    return map_arrow(docs.where(F.length("text") >= LENGTH).select("doc", "mark", "text"), find, "doc long, mark long, core long, name long, place long")


def _ranked(rows: DataFrame, copies, scratch: Scratch) -> DataFrame:
    """core, name, twice, more: pairs of a rank and what stands around it that are of use.

    ``twice``: the pair stands in two places or more.  ``more``: pairs of this rank differ, and one of them stands in one
    place only, so that longer strings must tell.  A rank in one place is unique and goes.
    """
    pairs = rows.groupBy("core", "name").agg(copies.alias("copies"))
    ranks = pairs.groupBy("core").agg(F.count("*").alias("kinds"), F.count_if(F.col("copies") == 1).alias("alone"), F.sum("copies").alias("places")).where("places > 1")
    ranks = cut(ranks.select("core", ((F.col("kinds") > 1) & (F.col("alone") > 0)).alias("more")), scratch)
    return cut(pairs.join(ranks, "core").where("copies > 1 OR more").select("core", "name", (F.col("copies") > 1).alias("twice"), "more"), scratch)


def _contexts(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """doc, mark, lo, offset, more, twice, bytes: one row for each entry, with all bytes that its windows cover."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, mark, text, own in zip(b.column("doc").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist(), b.column("entries").to_pylist(), strict=True):
                for e in own:
                    lo, more, offset = e["place"] >> 32, e["place"] >> 16 & 0xFFFF, e["place"] & 0xFFFF
                    out.append((doc, mark, lo, offset, more, e["twice"], text[lo : lo + more + LENGTH]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_(), pa.binary()], strict=True)], names=["doc", "mark", "lo", "offset", "more", "twice", "bytes"])

    joined = docs.select("doc", "mark", "text").join(entries, ["doc", "mark"])
    return map_arrow(joined, take, "doc long, mark long, lo long, offset long, more long, twice boolean, bytes binary", rows=256)


def _longer(open_rows: DataFrame, width: int) -> DataFrame:
    """The rows' windows in ranges of ``width`` offsets from the anchor: what all windows of the whole range share is the rank, what they cover the name."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("bytes").to_pylist()
            doc, mark, lo, offset, more, twice = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark", "lo", "offset", "more", "twice"))
            sizes = np.array([len(x) for x in data], np.int64)
            for first in range(0, len(data), 512):
                k = slice(first, first + 512)
                names, begin = Hashes(b"".join(data[k])), np.cumsum(sizes[k]) - sizes[k]
                least, most = (offset - more)[k] // width, offset[k] // width
                n = (most - least + 1).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                j = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                anchor = begin[row] + offset[k][row]
                high = np.minimum(j * width + width - 1, LENGTH - CORE)
                a, z = np.maximum(j * width, (offset - more)[k][row]), np.minimum(high, offset[k][row])  # offsets of the row's own windows
                core, name = names.of(anchor - j * width, anchor + LENGTH - high, j), names.of(anchor - z, anchor + LENGTH - a, z << 16 | a)
                at = lo[k][row] + offset[k][row]
                cols = (doc[k][row], mark[k][row], lo[k][row], at - z, at - a, core.view(np.int64), name.view(np.int64), twice[k][row])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "mark", "lo", "first", "last", "core", "name", "twice"])

    return map_arrow(open_rows, split, "doc long, mark long, lo long, first long, last long, core long, name long, twice boolean")


def _settle(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect: Spark deletes the shuffle files of tables that are written once nothing refers to them."""
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """doc, mark, spans: for each text with a string of ``LENGTH`` bytes that starts anywhere else too, the starts [a, b] of such strings.

    Positions are sampled by anchors (see ``runs``), and a rank stands for a run of window starts.  The first ranks are those
    of the anchors' ``CORE`` bytes.  Each round pairs the rank with what stands around it: a pair in two places has repeated
    windows, a rank in one place has none and goes, and all others get ranks of longer strings, for fewer windows a row,
    until ``LENGTH`` bytes are ranked.  Of pairs in several places one goes on, for others to meet it.
    """
    spark = docs.sparkSession
    texts = _marked(docs, id_col)
    found = cut(_first_ranks(texts), scratch)
    hits = cut(found.join(_ranked(found, F.count("*"), scratch), ["core", "name"]), scratch)
    _settle(spark)
    lo, more = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))
    done = hits.where("twice").select("doc", "mark", lo.alias("first"), (lo + more).alias("last"))
    entries = hits.where("more").groupBy("core", "name").agg(F.min(F.struct("doc", "mark", "place")).alias("at"), F.first("twice").alias("twice"))
    entries = cut(entries.groupBy("at.doc", "at.mark").agg(F.collect_list(F.struct("at.place", "twice")).alias("entries")), scratch)
    rows = cut(_contexts(texts, entries), scratch)
    _settle(spark)
    for width in WIDTHS:
        found = cut(_longer(rows, width), scratch)
        ranked = _ranked(found, F.sum(F.when(F.col("twice"), 2).otherwise(1)), scratch).withColumnRenamed("twice", "again")
        hits = cut(found.join(ranked, ["core", "name"]), scratch)
        done = done.unionByName(hits.where("again AND NOT twice").select("doc", "mark", "first", "last"))
        if width > 1:
            at = F.struct("doc", "mark", "lo", "first", "last")
            onward = hits.where("more").groupBy("core", "name").agg(F.min(at).alias("at"), F.first("again").alias("again"))
            onward = onward.groupBy("at.doc", "at.mark", "at.lo").agg(F.collect_list(F.struct("at.first", "at.last", "again")).alias("parts"))
            part = rows.join(cut(onward, scratch), ["doc", "mark", "lo"]).select("doc", "mark", "lo", "offset", "bytes", F.explode("parts").alias("p"))
            rows = cut(part.select("doc", "mark", F.col("p.first").alias("lo"), (F.col("offset") + F.col("lo") - F.col("p.first")).alias("offset"), (F.col("p.last") - F.col("p.first")).alias("more"), F.col("p.again").alias("twice"), F.substring("bytes", (F.col("p.first") - F.col("lo") + 1).cast("int"), (F.col("p.last") - F.col("p.first") + LENGTH).cast("int")).alias("bytes")), scratch)
        _settle(spark)
    return done.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _kept(text: bytes, spans: np.ndarray) -> tuple[list[bytes], int]:
    """What is left of a text without the windows that start in the ranges, and the number of runs that went."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1] + LENGTH)
    head = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > end[:-1]]))
    begins, ends = spans[head, 0].tolist(), end[np.concatenate([head[1:], [len(end)]]) - 1].tolist()
    return [text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True)], len(head)


def remove(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans of every row: its text without strings of ``LENGTH`` bytes that start anywhere else too.

    Null texts are empty; texts below ``LENGTH`` bytes stay whole.  Repeated rows are texts each, so that of a text in two
    rows all goes if it is long enough; null ids are kept.  Other columns are not read; an empty table gives no rows.  A very
    long text is hashed in stretches of ``BUFFER`` bytes; the text and its ranges are in one task.  What one text's rows hold
    is bounded by its own length; no row holds what grows with the number of copies.
    """
    scratch = Scratch(docs.sparkSession)
    spans = cut(repeats(docs, scratch, id_col))
    scratch.clear()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ranges = b.column("spans")
            cells, at = ranges.flatten(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy())])
            first, last = (cells.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)) if len(cells) else (np.zeros(0, np.int64),) * 2
            for i, text in enumerate(b.column("text").to_pylist()):
                k = slice(at[i], at[i + 1])
                pieces, n = _kept(text, np.stack([first[k], last[k]], 1)) if at[i] < at[i + 1] else ([text], 0)
                kept = b"".join(pieces)
                out.append((kept, len(text), len(text) - len(kept), n))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = _marked(docs, id_col).join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans")
    return map_arrow(joined, strip, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
