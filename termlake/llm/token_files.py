"""Token ids in binary shards: blocks cut into byte planes, each plane compressed, with a block and a document index.

A shard holds, little-endian: the magic ``TLBP1\\0``, the compressed planes of its blocks, a block index (for each block
its file offset, its number of ids and the compressed size of each of its four planes), a document index (id, first id
in the shard, number of ids) and a footer with the places of both indexes.  Plane k of a block has byte k of every id
in turn, so that bytes of one significance stand together; a block can be read without its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow, read_range, shared_dir, table, write_file

MAGIC = b"TLBP1\0"
BLOCK = 1 << 16
PLANES = 4
LEVEL = 3
#: A shard is closed after so many ids (64 MB before compression), a document more at most.
SHARD_IDS = 1 << 24
END_ID = 2
#: Ids whose documents are read at once, a document more at most.
READ_IDS = 1 << 20
_FOOTER = np.dtype([("blocks_at", "<u8"), ("n_blocks", "<u8"), ("docs_at", "<u8"), ("n_docs", "<u8"), ("n_ids", "<u8")])
_BLOCK = np.dtype([("at", "<u8"), ("n", "<u4"), ("sizes", "<u4", (PLANES,))])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8")])


def pack_block(ids: np.ndarray) -> list[bytes]:
    """The compressed byte planes of a block."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
    press = zstandard.ZstdCompressor(level=LEVEL)
    return [press.compress(p.tobytes()) for p in planes]


def unpack_block(parts: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its compressed planes."""
    press = zstandard.ZstdDecompressor()
    planes = np.stack([np.frombuffer(press.decompress(p, max_output_size=n), np.uint8) for p in parts])
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class ShardWriter:
    """Collects documents and gives the shard's bytes; only compressed blocks are held."""

    def __init__(self) -> None:
        self.parts: list[bytes] = [MAGIC]
        self.at, self.n_ids, self.blocks, self.docs = len(MAGIC), 0, [], []
        self.rest: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, docs: list[tuple[int | None, int]]) -> None:
        """ids of whole documents, with each one's id and length."""
        start = self.n_ids
        for doc, n in docs:
            self.docs.append((doc or 0, doc is None, start, n))
            start += n
        self.n_ids = start
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            flat = np.concatenate(self.rest)
            whole = len(flat) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(flat[k : k + BLOCK])
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = pack_block(ids)
        self.blocks.append((self.at, len(ids), tuple(map(len, planes))))
        self.parts += planes
        self.at += sum(map(len, planes))

    def finish(self) -> list[bytes]:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        if len(flat):
            self._block(flat)
        blocks, docs = np.array(self.blocks, _BLOCK), np.array(self.docs, _DOC)
        foot = np.array([(self.at, len(blocks), self.at + blocks.nbytes, len(docs), self.n_ids)], _FOOTER)
        return [*self.parts, blocks.tobytes(), docs.tobytes(), foot.tobytes(), MAGIC]


class ShardReader:
    """Random access to a shard's documents and ids."""

    def __init__(self, uri: str):
        self.uri = uri
        tail = read_range(uri, -(_FOOTER.itemsize + len(MAGIC)), _FOOTER.itemsize + len(MAGIC))
        if not tail.endswith(MAGIC):
            raise ValueError(f"{uri} is no token shard")
        foot = np.frombuffer(tail, _FOOTER, 1)[0]
        self.n_ids = int(foot["n_ids"])
        self.blocks = np.frombuffer(read_range(uri, int(foot["blocks_at"]), int(foot["n_blocks"]) * _BLOCK.itemsize), _BLOCK)
        self.docs = np.frombuffer(read_range(uri, int(foot["docs_at"]), int(foot["n_docs"]) * _DOC.itemsize), _DOC)

    def block(self, k: int) -> np.ndarray:
        b = self.blocks[k]
        sizes = [int(x) for x in b["sizes"]]
        raw, parts, at = read_range(self.uri, int(b["at"]), sum(sizes)), [], 0
        for s in sizes:
            parts.append(raw[at : at + s])
            at += s
        return unpack_block(parts, int(b["n"]))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the shard from ``start``, from the blocks that hold them only."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        flat = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return flat[start - first * BLOCK : start - first * BLOCK + n]


def _bounds(docs: DataFrame, id_col: str, parts: int) -> np.ndarray:
    """parts - 1 ids that cut the documents into parts of about one size; an id that many rows share comes several times."""
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, 10 * parts)).first()[0] if cuts else None
    return np.array(found or [], np.int64)


def write(docs: DataFrame, out: str, vocabulary: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize and write all documents in ascending id order to shards under ``out``.

    Null texts are empty: their end id is their one id.  Null ids come first; rows of one id stand in the order of their
    ids' hash, so that an id that many rows share is dealt over several tasks.  Other columns are not read; an empty table
    gives no shard.  Texts are tokenized where they are read; ids, not texts, are shuffled and sorted.

    Returns the manifest: shard path, its place in the order, its documents and ids, and the ids of all shards before it.
    A task writes each shard whole under a name fixed by its partition, so a retry replaces it by the same bytes.
    """
    spark, path = docs.sparkSession, vocabulary or tokens.default_path()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, id_col, parts)
    kind = "<u2" if max(tokens.encoder(path).tokenizer.get_vocab_size(), end_id or 0) < 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.encoder(path).encode
        for b in batches:
            flat, offsets = of(b.column("text"))
            if end_id is not None:
                flat = np.insert(flat, offsets[1:], np.uint32(end_id))
                offsets = offsets + np.arange(len(offsets))
            flat = flat.astype(kind)
            ids = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * flat.itemsize), pa.py_buffer(flat)]).cast(pa.binary())
            mark = np.fromiter(map(xxhash.xxh3_64_intdigest, ids.to_pylist()), np.uint64, len(ids)) >> np.uint64(1)
            key = pc.fill_null(b.column("doc_id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, key), np.searchsorted(bounds, key, side="right")
            part = low + ((mark >> np.uint64(31)) * (high - low + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(mark.astype(np.int64)), ids, pa.array(part, pa.int32())], names=["doc_id", "mark", "ids", "part"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, k = TaskContext.get().partitionId(), ShardWriter(), 0

        def close() -> pa.RecordBatch:
            uri = f"{out}/shard-{part:06d}-{k:04d}.tlbp"
            write_file(uri, iter(shard.finish()))
            return pa.RecordBatch.from_pylist([{"path": uri, "part": part, "k": k, "n_docs": len(shard.docs), "n_ids": shard.n_ids}], schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                flat = np.frombuffer(ids.as_buffer(), kind)
                shard.add(flat, [(doc, len(flat))])
                if shard.n_ids >= SHARD_IDS:
                    yield close()
                    shard, k = ShardWriter(), k + 1
        if shard.docs:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    coded = map_arrow(rows, encode, "doc_id long, mark long, ids binary, part int", size=tokens.BATCH_BYTES)
    dealt = coded.repartitionById(parts, "part").drop("part").sortWithinPartitions("doc_id", "mark")
    found = map_arrow(dealt, save, "path string, part int, k int, n_docs long, n_ids long").collect()  # a row for each shard
    before, out_rows = 0, []
    for r in sorted(found, key=lambda r: (r.part, r.k)):
        out_rows.append((r.path, len(out_rows), r.n_docs, r.n_ids, before))
        before += r.n_ids
    return spark.createDataFrame(out_rows, "path string, place int, n_docs long, n_ids long, before long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards of a manifest, some blocks at a time.

    An empty manifest gives no rows; repeated documents come once for each time they were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = ShardReader(row["path"])
                # runs of documents that start in the same READ_IDS ids of the shard
                runs = np.flatnonzero(np.diff(shard.docs["start"] // READ_IDS, prepend=np.uint64(1 << 63)))
                for at, end in zip(runs.tolist(), [*runs[1:].tolist(), len(shard.docs)], strict=True):
                    docs = shard.docs[at:end]
                    first, n = int(docs["start"][0]), int(docs["n"].sum())
                    flat = shard.ids(first, n).astype("<u4")
                    ends = np.cumsum(docs["n"].astype(np.int64))
                    crcs = [zlib.crc32(flat[e - c : e]) for e, c in zip(ends.tolist(), docs["n"].tolist(), strict=True)]
                    ids = pa.array(docs["id"], pa.int64(), mask=docs["null"].astype(bool))
                    starts = docs["start"].astype(np.int64) + row["before"]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(docs["n"].astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return map_arrow(manifest.repartition(shards, "place"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens")))
