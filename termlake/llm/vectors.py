"""Maximum inner product search by score-aware anisotropic quantisation, four-bit table scans and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

#: Vectors that the codebooks are fitted on at most: those whose ids hash smallest.
TRAIN_VECTORS = 4096
#: Dimensions of a subspace; each has 16 centroids, so that a code takes four bits.
WIDTH = 1
CENTROIDS = 16
#: Inner products above this share of the norms are those whose error counts; it sets the weight of the parallel residual.
THRESHOLD = 0.2
ROUNDS, SWEEPS = 6, 2
#: Candidates of a chunk that are reranked for each query first; their best scores decide who else is.
RERANK = 128
#: All others are reranked whose rough score comes as near to the k-th best as so many deviations of its error.
DEVIATIONS = 3.0
#: Distinct vectors of a chunk and queries of a block, on average.
CHUNK, BLOCK = 16_384, 2_048


@dataclass
class Codebook:
    """Centroids (subspaces, 16, WIDTH) and the weight of the parallel residual error."""

    dims: int
    centroids: np.ndarray
    parallel: float

    def _padded(self, x: np.ndarray) -> np.ndarray:
        spare = self.centroids.shape[0] * WIDTH - x.shape[1]
        return np.pad(x, ((0, 0), (0, spare))) if spare else x

    def assign(self, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """Codes (vectors, subspaces): each subspace in turn takes the centroid of least anisotropic loss, given the others."""
        x = self._padded(x.astype(np.float64))
        n, parts = len(x), self.centroids.shape[0]
        cells = x.reshape(n, parts, WIDTH)
        unit = cells / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        distance = ((cells[:, :, None, :] - self.centroids[None]) ** 2).sum(3)
        along = np.einsum("nmw,mkw->nmk", unit, self.centroids)
        code = distance.argmin(2)
        rows = np.arange(n)
        here = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]
        error = np.linalg.norm(x, axis=1) - here.sum(1)  # the residual along the vector
        for _ in range(sweeps):
            for m in range(parts):
                rest = error + along[rows, m, code[:, m]]
                loss = distance[:, m] + (self.parallel - 1) * (rest[:, None] - along[:, m]) ** 2
                code[:, m] = loss.argmin(1)
                error = rest - along[rows, m, code[:, m]]
        return code.astype(np.uint8)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that codes of two subspaces a byte stand for."""
        code = np.stack([packed // CENTROIDS, packed % CENTROIDS], 2).reshape(len(packed), -1)
        return self.centroids[np.arange(code.shape[1]), code].reshape(len(packed), -1)[:, : self.dims]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and pair of subspaces the inner products with all 256 pairs of centroids."""
        cells = self._padded(q.astype(np.float32)).reshape(len(q), -1, WIDTH)
        one = np.einsum("qmw,mkw->qmk", cells, self.centroids.astype(np.float32))
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CENTROIDS * CENTROIDS)

    def scan(self, tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate scores (queries, vectors) from codes of two subspaces a byte."""
        total = np.zeros((len(tables), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            total += tables[:, j].take(packed[:, j], axis=1)
        return total


def pack(code: np.ndarray) -> np.ndarray:
    return (code[:, ::2] * CENTROIDS + code[:, 1::2]).astype(np.uint8)


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Codebook:
    """Codebooks that minimise parallel * |residual along the vector|^2 + |residual across it|^2.

    In turn codes are assigned and all centroids solved for together: the loss is quadratic in them.
    """
    dims = x.shape[1]
    parts = -(-dims // WIDTH)
    parts += parts % 2
    parallel = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    n = len(x)
    padded = np.pad(x.astype(np.float64), ((0, 0), (0, parts * WIDTH - dims)))
    cells = padded.reshape(n, parts, WIDTH)
    start = cells[np.linspace(0, n - 1, CENTROIDS).astype(int)].transpose(1, 0, 2).copy()
    for _ in range(8):  # Lloyd's steps in each subspace
        code = ((cells[:, :, None, :] - start[None]) ** 2).sum(3).argmin(2)
        for m in range(parts):
            count = np.bincount(code[:, m], minlength=CENTROIDS)
            for w in range(WIDTH):
                mean = np.bincount(code[:, m], cells[:, m, w], CENTROIDS) / np.maximum(count, 1)
                start[m, :, w] = np.where(count > 0, mean, start[m, :, w])
    book = Codebook(dims, start, parallel)
    unit = (padded / np.maximum(np.linalg.norm(padded, axis=1), 1e-300)[:, None]).reshape(n, parts, WIDTH)
    size = parts * CENTROIDS * WIDTH
    for _ in range(rounds):
        code = book.assign(x)
        slot = (np.arange(parts)[None, :] * CENTROIDS + code)[:, :, None] * WIDTH + np.arange(WIDTH)
        along, goal, diagonal = np.zeros((n, size), np.float32), np.zeros(size), np.zeros(size)
        np.put_along_axis(along, slot.reshape(n, -1), unit.reshape(n, -1).astype(np.float32), 1)
        np.add.at(goal, slot.ravel(), cells.ravel())
        np.add.at(diagonal, slot.ravel(), 1.0)
        matrix = (parallel - 1) * (along.T @ along).astype(np.float64)
        matrix[np.arange(size), np.arange(size)] += diagonal + 1e-6
        solved = np.linalg.solve(matrix, parallel * goal + 1e-6 * book.centroids.ravel()).reshape(parts, CENTROIDS, WIDTH)
        used = diagonal.reshape(parts, CENTROIDS, WIDTH) > 0
        book = Codebook(dims, np.where(used, solved, book.centroids), parallel)
    return book


def valid(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec of rows with an id whose vector is not null, not zero, all finite and of the most common length.

    Of several such rows of an id the least vector counts, number by number.
    """
    v = F.col(vector)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    out = rows.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"))
    sizes = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = out.where(F.size("vec") == (sizes["n"] if sizes else 0))
    again = cut(out.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if again.isEmpty():
        return out
    least = out.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return out.join(again, "vec_id", "left_anti").unionByName(least)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _nearest(q_ids: np.ndarray, q: np.ndarray, x: np.ndarray, packed: np.ndarray, members: list[list[int]], book: Codebook, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, vector, score) of the k best of a chunk for each query; ``members`` has the smallest ids of each vector."""
    n, dims = x.shape
    slack = DEVIATIONS * np.linalg.norm(x - book.decode(packed), axis=1) / np.sqrt(dims)
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        rough = book.scan(book.tables(part), packed)
        take = min(n, max(RERANK, k + 1))
        first = np.argpartition(rough, n - take, axis=1)[:, n - take :]
        for i, rows in enumerate(first):
            edge = np.sort(x[rows] @ part[i])[max(0, take - k - 1)]
            near = rough[i] + slack * np.linalg.norm(part[i]) >= edge
            near[rows] = True
            rows = np.flatnonzero(near)
            exact = np.einsum("nd,d->n", x[rows], part[i])
            order = np.argsort(-exact, kind="stable")
            edge = exact[order[min(k, len(order) - 1)]]  # one vector may be the query's own alone
            own = int(q_ids[lo + i])
            found = [(-float(exact[o]), v) for o in order[: np.searchsorted(-exact[order], -edge, side="right")] for v in members[rows[o]] if v != own]
            for score, v in sorted(found)[:k]:
                yield own, v, -score


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself left out, ties to the smaller id.

    Rows without a usable vector take no part.  Equal vectors are searched as one, with their k + 1 smallest ids, so a
    vector that a third of all rows share costs no more than another.  Chunks of vectors meet blocks of queries; a group
    holds one of each.  Rows of one id count once, among queries and candidates, with their least vector.  Other columns are
    not read; an empty table, or no query, gives no rows.
    """
    spark = rows.sparkSession
    good, asked = valid(rows, id_col, vector), valid(queries, id_col, vector)
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    classes = good.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    classes = cut(classes.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most
    asked = cut(asked)
    count, total = classes.count(), asked.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count or not total:
        return spark.createDataFrame([], schema)
    dims = len(classes.select("vec").first()["vec"])
    sample = classes.select("vec", F.col("ids")[0].alias("id")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_VECTORS).collect()
    book = fit(np.array([r["vec"] for r in sample]))
    chunks, blocks = -(-count // CHUNK), -(-total // BLOCK)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = pack(book.assign(_matrix(b.column("vec"), dims)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*b.schema.names, "code"])

    coded = map_arrow(classes, encode, "vec array<double>, ids array<long>, code binary", 4096)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.select(F.pmod(F.xxhash64("ids"), F.lit(chunks)).cast("int").alias("chunk"), spread(blocks).alias("block"), F.lit(None).cast("long").alias("query"), "vec", "ids", "code")
    right = asked.select(spread(chunks).alias("chunk"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query"), "vec", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("code"))

    def group(key, data):
        is_query = data.column("query").is_valid()
        q, c = data.filter(is_query), data.filter(pa.compute.invert(is_query))
        found = []
        if len(q) and len(c):
            packed = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(len(c), -1)
            found = list(_nearest(q.column("query").to_numpy(), _matrix(q.column("vec"), dims), _matrix(c.column("vec"), dims), packed, c.column("ids").to_pylist(), book, k))
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    near = left.unionByName(right).groupBy("chunk", "block").applyInArrow(group, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
