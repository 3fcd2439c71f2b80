"""Centroid clustering on integers, exact on any cluster: Lloyd's rounds with partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow, table

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Dimensions that are added up between two looks at which vectors may still come nearer.
STEP = 8
#: Components are held within this bound on either side, so that no squared distance leaves 64 bits: 64 * (2 * BOUND)^2 < 2^63.
BOUND = (1 << 27) - 1


def integers(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id and v, the components as floor(1024 * x), of rows whose vector has ``dims`` components, all of them finite numbers."""
    x = F.col(vector)
    fine = (F.size(x) == dims) & F.forall(x, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    whole = lambda y: F.floor(F.greatest(F.least(SCALE * y.cast("double"), F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int")
    return rows.where(x.isNotNull() & fine).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number on ties, and its squared distance, by partial distances.

    Differences are summed over the dimensions in ``order``.  A centroid is given up for a vector as soon as its sum is
    strictly above the vector's best so far; what is left after all dimensions is not above it, so it is nearer, or as near
    and of a greater number.
    """
    x, centroids = x[:, order], centroids[:, order]
    best, d = np.zeros(len(x), np.int32), ((x - centroids[0]) ** 2).sum(1)
    for c in range(1, len(centroids)):
        rows, part = np.arange(len(x)), np.zeros(len(x), np.int64)
        for at in range(0, x.shape[1], STEP):
            part = part + ((x[rows, at : at + STEP] - centroids[c, at : at + STEP]) ** 2).sum(1)
            near = part <= d[rows]
            if not near.all():
                rows, part = rows[near], part[near]
            if not len(rows):
                break
        nearer = part < d[rows]
        best[rows[nearer]], d[rows[nearer]] = c, part[nearer]
    return best, d


def _totals(rows: DataFrame, of, slots: int, dims: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(slot, dimension): sum and count over all rows; ``of`` gives the slot of each row and the matrix to sum.

    A task sends one row for each slot and dimension; the driver gets slots * dims rows whatever the table's size.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((slots, dims), np.int64), np.zeros(slots, np.int64)
        for b in batches:
            slot, x = of(_matrix(b))
            for s in range(slots):
                mine = slot == s
                sums[s] += x[mine].sum(0)
                counts[s] += mine.sum()
        n = slots * dims
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(slots), dims)), pa.array(np.tile(np.arange(dims), slots)), pa.array(sums.reshape(n)), pa.array(np.repeat(counts, dims))], names=["slot", "dim", "total", "n"])

    found = map_arrow(rows.select("v"), partial, "slot long, dim long, total long, n long").groupBy("slot", "dim")
    found = found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    return {(r.slot, r.dim): (int(r.total), r.n) for r in found}


def start(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first k vectors by the SHA-256 of seed and id; of rows of one id the least vector first."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()], np.int64).reshape(-1, DIMS)


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that can be clustered.

    Vectors that are null, of another size than 64 or with a null or non-finite component take no part.  Rows of one id are
    vectors each; null ids stay null.  With fewer vectors than k there are as many clusters; an empty table gives no rows.
    Components beyond ``BOUND`` count as ``BOUND``.  Other columns are not read.

    The integers are written once; a round reads them, and of each task only sums by cluster leave it.  What goes to all
    tasks are k centroids.  Dimensions are compared in the order of their variance over all vectors.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    own = cut(integers(rows, id_col, vector), scratch)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start(own, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    k = len(centroids)
    first = lambda x: (np.zeros(len(x), np.int32), x)
    mean = np.array([t // n for _, (t, n) in sorted(_totals(own, first, 1, DIMS).items())])
    spread = lambda x: (np.zeros(len(x), np.int32), np.minimum(np.abs(x - mean), 1 << 20) ** 2)
    order = np.argsort([-t for _, (t, _) in sorted(_totals(own, spread, 1, DIMS).items())], kind="stable")
    for _ in range(rounds):
        now = centroids
        total = _totals(own, lambda x, now=now: (nearest(x, now, order)[0], x), k, DIMS)
        centroids = np.array([[total[c, j][0] // total[c, j][1] if total.get((c, j), (0, 0))[1] else now[c, j] for j in range(DIMS)] for c in range(k)], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, d = nearest(_matrix(b), centroids, order)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(c), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = cut(map_arrow(own.withColumn("vec_id", F.col("vec_id").cast("long")), assign, "vec_id long, cluster int, distance long"))
    scratch.clear()
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    return out.select("vec_id", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(marks, "string").alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    parts = []
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT rid, any_value(k.v) AS v, any_value(vec_id) AS vec_id, min({{'d': list_sum(list_transform(range(1, {DIMS + 1}), lambda j: (k.v[j] - c.v[j]) * (k.v[j] - c.v[j])))::BIGINT, 'c': c}}) AS m FROM k, c{i} c GROUP BY rid)"
        )
        if i < ROUNDS:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(f ORDER BY j) AS v FROM (SELECT m.c AS c, j, (sum(v[j]) - (sum(v[j]) % count(*) + count(*)) % count(*)) // count(*) AS f FROM a{i}, range(1, {DIMS + 1}) t(j) GROUP BY m.c, j) GROUP BY c) n USING (c))"
            )
    return ", ".join(parts)


ORACLE = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM k ORDER BY h, v LIMIT {K})), {_rounds_sql()}
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON m.c = c.c"""
