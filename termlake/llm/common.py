"""Helpers that the operators of this subpackage share: tables, shared storage, Arrow batches, hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import threading
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most; a single row above the bytes is a batch of its own.
BATCH_ROWS = 4096
BATCH_BYTES = 4 << 20
#: Bytes of the batches that Spark sends, about.
JVM_BYTES = 1 << 20
#: Seconds after which an idle worker lets go of what it keeps.
IDLE_SECONDS = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share (in tests: a folder of this machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_root(spark)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    set_by_hand = spark.sparkContext.getCheckpointDir()
    if set_by_hand:
        return set_by_hand.rsplit("/", 1)[0]
    import tempfile

    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + os.path.join(tempfile.gettempdir(), "termlake-shared")
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The same rows, read from a table in the shared folder: later jobs neither recompute them nor lose them with an executor."""
    spark = df.sparkSession
    path = shared_dir(spark, "cut")
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that ``cut`` wrote and that go once all that reads them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def clear(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for p in gone:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and, but for single rows above it, ``size`` bytes; small batches are joined."""
    held: list[pa.RecordBatch] = []
    n = have = 0
    for b in batches:
        if held and (n + b.num_rows > rows or have + b.nbytes > size):
            yield _joined(held)
            held, n, have = [], 0, 0
        at = 0
        while b.num_rows - at > rows or (at < b.num_rows and b.slice(at).nbytes > size):
            k = min(rows, b.num_rows - at)
            while k > 1 and (most := b.slice(at, k).nbytes) > size:
                k = max(1, min(k - 1, k * size // most))
            yield b.slice(at, k)
            at += k
        if at < b.num_rows:
            held.append(b.slice(at))
            n, have = n + b.num_rows - at, have + held[-1].nbytes
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: What modules keep in a worker from task to task (tokenizers, mapped models).
CACHES: list[dict] = []
_state: dict = {"job": None, "timer": None}


def begin(job: str) -> None:
    """At the start of a task: a worker that did another job before lets go of what it kept for that."""
    pa.set_memory_pool(pa.system_memory_pool())  # large blocks go back to the machine when they are freed
    if _state["timer"] is not None:
        _state["timer"].cancel()
    if _state["job"] != job:
        forget()
        _state["job"] = job


def end() -> None:
    """At the end of a task: freed memory goes back at once, what is kept for the next one if none comes soon."""
    release()
    _state["timer"] = timer = threading.Timer(IDLE_SECONDS, forget)
    timer.daemon = True
    timer.start()


def forget() -> None:
    _state["job"] = None
    for cache in CACHES:
        cache.clear()
    release()


def grouped(fn: Callable) -> Callable:
    """A function for applyInArrow that gives memory back after each group."""

    def run(key, data):
        begin(f"{fn.__module__}.{fn.__qualname__}")
        out = fn(key, data)
        del data
        end()
        return out

    return run


def release() -> None:
    """Give freed memory back to the machine: an idle worker, and one whose next task is another operator's, holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over batches of at most ``rows`` rows and ``size`` bytes, however large the session's batches are.

    The plan is run later, so a session whose batches may be larger than ``JVM_BYTES`` is left with that bound; it changes
    no result, only the memory that a batch takes outside the heap.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(bound).rstrip("bB")) <= JVM_BYTES:
        conf.set(bound, str(JVM_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(f"{fn.__module__}.{fn.__qualname__}")
        try:
            yield from fn(sliced(batches, rows, size))
        finally:
            end()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(name)
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- files in the shared folder


def _path(uri: str) -> str | None:
    """The plain path of a file: URI or None for another store."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: Iterator[bytes]) -> int:
    """Write a file whole or not at all: a retried or doubled task replaces it by the same bytes."""
    mark, n = f"{uri}.{uuid.uuid4().hex}", 0
    if (path := _path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = _path(mark)
        with open(tmp, "wb") as f:
            for p in parts:
                n += f.write(p)
        os.replace(tmp, path)
        return n
    store, path = _fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = _fs(mark)[1]
    with store.open_output_stream(tmp) as f:
        for p in parts:
            f.write(p)
            n += len(p)
    store.move(tmp, path)
    return n


def read_range(uri: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start``; a negative start counts from the end."""
    if (path := _path(uri)) is not None:
        with open(path, "rb") as f:
            f.seek(start, 2 if start < 0 else 0)
            return f.read(length)
    store, path = _fs(uri)
    with store.open_input_file(path) as f:
        f.seek(start if start >= 0 else f.size() + start)
        return f.read(length)


def mapped(uri: str) -> np.ndarray:
    """A file's bytes, memory-mapped; one of another store is copied to a nameless file of this machine, which ends with the process."""
    path = _path(uri)
    if path is None:
        import tempfile

        store, at = _fs(uri)
        with store.open_input_stream(at) as src, tempfile.TemporaryFile() as own:
            shutil.copyfileobj(src, own, 1 << 22)
            own.flush()
            return np.memmap(own, dtype=np.uint8, mode="r") if own.tell() else np.zeros(0, np.uint8)
    return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)


# ---------------------------------------------------------------- numpy pieces


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_az(text: bytes) -> bytes:
    """bytes.lower() changes A-Z only."""
    return text.lower()


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


class Interner(dict):
    """Bytes to small integers in order of first sight."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n
