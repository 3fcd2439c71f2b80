"""A stored neighbour index: coarse cells, short codes of what cells leave over, exact reranking by id.

``build`` writes one table partitioned by cell; ``search`` compares a query with the codes of the cells nearest to it, and with
the vectors of the few candidates that the codes leave; both are done where a group's codes are, so that candidates never
leave a task and of each block of queries and partition of groups only the best answers do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import best_rows, block_pairs, exact, packed, top_k

#: Vectors that cells and code steps are fitted on at most: those whose ids hash smallest.
SAMPLE = 8192
#: Cells at most; below it there are about as many as the root of the bank's rows.
MOST_CELLS = 1024
#: Codes that a task holds at once: larger cells are dealt over several groups by id, smaller ones share a group.
CELL_ROWS = 16_384
#: Queries that a task holds at once, and of them those that it compares with its codes in one product.
QUERY_ROWS, QUERY_TILE = 8192, 64
#: Groups of codes that a task passes over with its queries.
TOGETHER = 16
#: With four bits: candidates stay whose rough score comes within so many deviations of its error.
DEVIATIONS = 5.0


@dataclass
class Index:
    """Where an index is, and what every task needs of it: ``MOST_CELLS`` centroids and the codes' range at most."""

    path: str
    centroids: np.ndarray
    low: np.ndarray
    step: np.ndarray
    bits: int
    groups: np.ndarray  # the first group of each cell and the number of its groups
    answers: int = 100  # a query's answers at most

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells of each row with the largest inner products, less half the squared norm of the centroid: the nearest ones."""
        score = x @ self.centroids.T - (self.centroids**2).sum(1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        levels = (1 << self.bits) - 1
        code = np.clip(np.rint((x - self.centroids[cell] - self.low) / self.step), 0, levels).astype(np.uint8)
        if self.bits == 8:
            return code
        code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
        return code[:, ::2] << 4 | code[:, 1::2]

    def decode(self, code: np.ndarray, cell: np.ndarray | int) -> np.ndarray:
        if self.bits != 8:
            code = np.stack([code >> 4, code & 15], 2).reshape(len(code), -1)[:, : self.centroids.shape[1]]
        return self.centroids[cell] + self.low + code * self.step


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.cast(pa.list_(pa.float64())).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _fit(x: np.ndarray, cells: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centroids = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(12):
        own = (x @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=cells)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    rest = x - centroids[(x @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)]
    low = rest.min(0)
    return centroids, low, np.maximum((rest.max(0) - low) / ((1 << bits) - 1), 1e-12)


def build(bank: DataFrame, path: str, bits: int = 4, cells: int | None = None, answers: int = 100) -> Index:
    """Write the index of a bank (term_id, vec; vectors of one length, no nulls) under ``path``, by cell.

    Every vector is indexed; of equal ones the ``answers`` + 1 smallest ids are, as no other can be among the ``answers`` nearest
    of a query: ties go to smaller ids, and one of them may be the query's own.  Cells and code steps are fitted on ``SAMPLE`` rows.  The table has term_id, part, code and the
    code's error, the distance of the vector from what its code stands for.
    """
    if bits not in (4, 8):
        raise ValueError("codes have four or eight bits a dimension")
    sample = bank.select("vec", "term_id").orderBy(F.xxhash64("term_id"), "term_id").limit(SAMPLE).collect()
    if not sample:
        raise ValueError("the bank is empty")
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("term_id"))
    bank = bank.select("term_id", "vec").withColumn("copy", copy).where(F.col("copy") <= answers + 1).drop("copy")
    rows = bank.count()
    cells = min(cells or max(1, int(rows**0.5)), MOST_CELLS, len(sample))
    centroids, low, step = _fit(np.array([r.vec for r in sample], float), cells, bits)
    index, dims = Index(path, centroids, low, step, bits, np.zeros((cells, 2), int), answers), centroids.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("vec"), dims)
            cell = index.nearest(x, 1)[:, 0]
            code = index.encode(x, cell)
            error = np.linalg.norm(x - index.decode(code, cell), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("term_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["term_id", "cell", "code", "error"])

    coded = bank.select(F.col("term_id").cast("long"), "vec").mapInArrow(encode, "term_id long, cell int, code binary, error double")
    spread = F.pmod(F.xxhash64("term_id"), F.lit(max(1, rows // CELL_ROWS)))  # a cell of very many rows is written by several tasks
    coded.repartition("cell", spread).write.partitionBy("cell").parquet(f"{path}/codes")
    counts = {r.cell: r["count"] for r in bank.sparkSession.read.parquet(f"{path}/codes").groupBy("cell").count().collect()}  # MOST_CELLS at most
    index.groups = _deal([counts.get(c, 0) for c in range(cells)])
    return index


def _deal(counts: list[int]) -> np.ndarray:
    """First group and number of groups of each cell: cells in order share a group while it has room, larger ones have several of their own."""
    out, free, room = [], 0, 0
    for n in counts:
        if n <= room:
            out.append((free - 1, 1))
            room -= n
        else:
            parts = max(1, -(-n // CELL_ROWS))
            out.append((free, parts))
            free, room = free + parts, CELL_ROWS - n if parts == 1 else 0
    return np.array(out)


def _candidates(index: Index, spark: SparkSession, queries: DataFrame, k: int, probes: int | None, itself: bool, bank: DataFrame | None = None) -> DataFrame:
    """query_id, term_id, score: of each query and group of codes those that can be among its k nearest, without a score.

    With the bank the k best of them by their vectors, from each task.
    """
    dims = index.centroids.shape[1]
    n = min(probes or len(index.centroids), len(index.centroids))
    first, parts = index.groups[:, 0], index.groups[:, 1]
    asked = queries.count()
    blocks = max(1, -(-asked // QUERY_ROWS), min(2 * spark.sparkContext.defaultParallelism, asked // 1024))
    of_cell = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
    codes = spark.read.parquet(f"{index.path}/codes").select("term_id", "cell", "code", "error")
    scored = bank is not None
    if scored:
        codes = codes.join(bank.select(F.col("term_id").cast("long").alias("term_id"), "vec"), "term_id")
    left = packed(queries.select(F.col("query_id").cast("long").alias("query_id"), "vec"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)), blocks)
    right = packed(codes, of_cell(first) + F.pmod(F.xxhash64("term_id"), of_cell(parts)), -(-int((first + parts).max()) // TOGETHER))
    loose = 1.0 if index.bits == 8 else DEVIATIONS / np.sqrt(dims)  # an upper bound of the error by the norms, or its usual size

    def meet(mine: pa.Table, groups: Iterator[pa.Table]) -> Iterator[pa.Table]:
        ids, vec = mine.column("query_id").to_numpy(), _vectors(mine.column("vec").combine_chunks(), dims)
        norm, tiles = np.linalg.norm(vec, axis=1), [slice(at, at + QUERY_TILE) for at in range(0, len(vec), QUERY_TILE)]
        cells = np.concatenate([_asked(index, vec[rows], n) for rows in tiles]) if n < len(index.centroids) else None
        best = [pa.table({"query_id": pa.array([], pa.int64()), "term_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}) for _ in tiles]  # rows for ids
        for t in groups:
            cell, terms = t.column("cell").to_numpy(), t.column("term_id").to_numpy()
            x = index.decode(np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), -1), cell)
            theirs = _vectors(t.column("vec").combine_chunks(), dims) if scored else None
            most = np.linalg.norm(x, axis=1).max()
            kind = np.float32 if 0 < max(norm.max(), most) < 1e15 else np.float64
            right, error = x.astype(kind), t.column("error").to_numpy() * loose
            for p, rows in enumerate(tiles):  # candidates are scored, or leave, tile by tile
                v = vec[rows]
                rough = (v.astype(kind) @ right.T).astype(np.float64)
                if cells is not None:
                    rough[~cells[rows][:, cell]] = -np.inf
                if not itself:
                    rough[ids[rows][:, None] == terms] = -np.inf
                slack = norm[rows][:, None] * (error + (dims + 8) * 4 * np.finfo(kind).eps * most) + 1e-9
                if theirs is None:
                    i, j = _near(rough, slack, _kth_largest(rough - slack, k))
                    yield pa.table({"query_id": ids[rows][i], "term_id": terms[j], "score": pa.nulls(len(i), pa.float64())})
                    continue
                edge = _edge(best[p], len(v), k)
                new = np.flatnonzero(edge == -np.inf)
                if len(new) and len(terms) >= k:  # the least true score of any k is at most that of the k-th nearest
                    top = np.argpartition(rough[new], len(terms) - k, axis=1)[:, len(terms) - k :]
                    true = exact(v, theirs, np.repeat(new, k), top.ravel()).reshape(-1, k)
                    edge[new] = np.where(np.take_along_axis(rough[new], top, 1) > -np.inf, true, -np.inf).min(1)
                i, j = _near(rough, slack, edge)
                found = pa.table({"query_id": i, "term_id": terms[j], "score": exact(v, theirs, i, j)})
                best[p] = best_rows(pa.concat_tables([best[p], found]), k)
        if scored:
            for rows, b in zip(tiles, best, strict=True):
                yield b.set_column(0, "query_id", pa.array(ids[rows][b.column("query_id").to_numpy()], pa.int64()))

    return block_pairs(left, right, meet, "query_id long, term_id long, score double")


def _asked(index: Index, x: np.ndarray, n: int) -> np.ndarray:
    """Whether each row asks each cell."""
    out = np.zeros((len(x), len(index.centroids)), bool)
    np.put_along_axis(out, index.nearest(x, n), True, 1)
    return out


def _near(rough: np.ndarray, slack: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero((rough + slack >= edge[:, None]) & (rough > -np.inf))


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, -inf where there are no more."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] > k else np.full(len(x), -np.inf)


def _edge(best: pa.Table, rows: int, k: int) -> np.ndarray:
    """The k-th score of each row of queries so far, -inf where it has fewer; sorted by row and score."""
    out, row = np.full(rows, -np.inf), best.column("query_id").to_numpy()
    last = np.searchsorted(row, np.arange(rows)) + k - 1
    has = last < np.searchsorted(row, np.arange(rows), "right")
    out[has] = best.column("score").to_numpy()[last[has]]
    return out


def search(index: Index, queries: DataFrame, bank: DataFrame, k: int, probes: int | None = None, itself: bool = True) -> DataFrame:
    """query_id, term_id, score, rank: the k nearest found by inner product, ties to the smaller id; queries (query_id, vec).

    ``probes`` is the number of cells that a query meets; without it all, and with codes of eight bits the result is then
    exact: the error of a rough score is at most the product of the query's norm and the code's error.  Scores are those of
    the vectors in ``bank`` (term_id, vec), which only meet their own candidates.  An empty set of queries gives no rows.
    """
    if k > index.answers:
        raise ValueError(f"the index was built for at most {index.answers} answers")
    return top_k(_candidates(index, bank.sparkSession, queries, k, probes, itself, bank), ["query_id"], k)
