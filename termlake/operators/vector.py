"""Retrieval over embedding banks: multi-window maximum similarity, thresholds, fusion and ranking measures.

Scores come from ``similarities``: queries meet the bank in blocks, and of each pair of blocks only what the caller keeps (a
top-k or an aggregate) leaves a task.  Blocks are packed and shuffled once, however many blocks of the other side they meet.  A task multiplies tiles of its blocks; where few pairs count, products in single
precision with a bound of their error leave those, and only they are scored in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ranks import in_order

BANK_BLOCK, QUERY_BLOCK = 65_536, 16_384
#: Blocks of the bank that a task passes over with its block of queries.
TOGETHER = 4
#: Rows of queries and of the bank in one matrix product, and pairs that are scored in double precision at once.
QUERY_TILE, BANK_TILE, PAIRS = 128, 8192, 65_536


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def packed(rows: DataFrame, block: Column, partitions: int) -> DataFrame:
    """block, rows: the rows of a block as one piece of Arrow data; pieces are dealt by the number of their block."""
    names = rows.columns  # within the function: Spark reuses a shuffle that differs in names of columns only

    def pack(key, data):
        data, sink = data.drop_columns("block").rename_columns(names), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, data.schema) as out:
            out.write_table(data)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.withColumn("block", block.cast("int")).groupBy("block").applyInArrow(pack, "block int, rows binary").repartitionById(partitions, F.pmod("block", F.lit(partitions)))


def block_pairs(left: DataFrame, right: DataFrame, fold: Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What ``fold`` yields of each packed block of the left side and those of the right side that are in one partition.

    A cartesian product reads the pieces again where the shuffle has left them: none is written once for each block it meets.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))
    read = lambda piece: pa.ipc.open_stream(piece.as_buffer()).read_all()

    def meet(batches):
        pairs = (row for b in batches for row in zip(b.column("block").to_pylist(), b.column("rows"), b.column("others"), strict=True))
        for _, same in groupby(pairs, lambda pair: pair[0]):
            first = next(same)
            for table in fold(read(first[1]), (read(pair[2]) for pair in chain([first], same))):
                yield from table.cast(out).to_batches()

    others = right.select(F.col("rows").alias("others")).hint("shuffle_replicate_nl")
    return left.crossJoin(others).mapInArrow(meet, schema)


def similarities(queries: DataFrame, bank: DataFrame, query_blocks: int, bank_blocks: int, fold, schema: str, by: str = "query_id", merge=None) -> DataFrame:
    """What ``fold`` makes of each block of scores: queries (query_id, vec, columns), bank (term_id, vec, columns).

    ``fold(queries, bank, qv, bv)`` gets the other columns of both sides as Arrow tables, the bank in order of term_id, and
    the vectors of both; it yields Arrow tables.  A task holds a few blocks at once; with ``merge`` it sends what this makes
    of all tables of one block of queries, else the tables.  Queries of one value of ``by`` are in one block.
    """
    cast = lambda df, own: df.select(*[F.col(c).cast("long").alias(c) if c == own else F.col(c) for c in df.columns])
    left = packed(cast(queries, "query_id"), F.pmod(F.xxhash64(by), F.lit(query_blocks)), query_blocks)
    right = packed(cast(bank, "term_id"), F.pmod(F.xxhash64("term_id"), F.lit(bank_blocks)), -(-bank_blocks // TOGETHER))

    def side(data):
        return data.drop_columns("vec"), data.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(data), -1)

    def each(mine, theirs):
        (q, qv), kept = side(mine), []
        for data in theirs:
            t, bv = side(data)
            order = np.argsort(t.column("term_id").to_numpy(), kind="stable")
            found = fold(q, t.take(pa.array(order)), qv, bv[order])
            if merge is None:
                yield from found
            else:
                kept = [merge(pa.concat_tables([*kept, *found]))]
        yield from kept

    return block_pairs(left, right, each, schema)


def exact(qv: np.ndarray, bv: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs of rows i and j, a bounded number at once."""
    return np.concatenate([np.zeros(0)] + [np.round(np.einsum("nd,nd->n", qv[i[p : p + PAIRS]], bv[j[p : p + PAIRS]]), 12) for p in range(0, len(i), PAIRS)])


def rough_tiles(qv: np.ndarray, bv: np.ndarray, hide: Callable[[np.ndarray, slice, slice], None]) -> Iterator[tuple[slice, np.ndarray, Iterator[tuple[int, np.ndarray]]]]:
    """Of each tile of queries its rows, a bound of the error of its products, and the products by tiles of the bank with the tile's first row.

    Products are in single precision, where no value leaves its range; ``hide`` sets those that do not count to -inf.  The
    bound is that of sums of products in any order, with the last place of a score.
    """
    norm, most = np.linalg.norm(qv, axis=1), np.linalg.norm(bv, axis=1).max()
    big = max(norm.max(), most)
    kind = np.float32 if 0 < big < 1e15 else np.float64
    slack = (qv.shape[1] + 8) * 4 * np.finfo(kind).eps * norm * most + 1e-30 * qv.shape[1] * max(big, 1) + 2e-12
    left, right = qv.astype(kind), bv.astype(kind)

    def products(rows):
        for at in range(0, len(bv), BANK_TILE):
            rough = left[rows] @ right[at : at + BANK_TILE].T
            hide(rough, rows, slice(at, at + BANK_TILE))
            yield at, rough

    for at in range(0, len(qv), QUERY_TILE):
        rows = slice(at, min(at + QUERY_TILE, len(qv)))
        yield rows, slack[rows], products(rows)


def _above(rough: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is not hidden and not below its row's edge."""
    i, j = np.divmod(np.flatnonzero(rough >= np.maximum(edge, np.finfo(rough.dtype).min)[:, None].astype(rough.dtype)).astype(np.int32), rough.shape[1])
    return i, j


def _own(q: pa.Table, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and of the bank with the same id."""
    ids, terms = q.column("query_id").to_numpy(), t.column("term_id").to_numpy()
    lo, hi = np.searchsorted(terms, ids, "left"), np.searchsorted(terms, ids, "right")
    row = np.repeat(np.arange(len(ids)), hi - lo)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]


def _hidden(q: pa.Table, t: pa.Table, itself: bool, unlike: tuple[str, str] | None = None) -> Callable[[np.ndarray, slice, slice], None]:
    """Sets products of rows that are no answers to -inf: of one id, or of one value of the columns of ``unlike``."""
    i, j = _own(q, t)
    sides = [side.column(c).to_numpy() for side, c in zip((q, t), unlike, strict=True)] if unlike else None

    def hide(rough, rows, cols):
        if not itself:
            here = (i >= rows.start) & (i < rows.stop) & (j >= cols.start) & (j < cols.stop)
            rough[i[here] - rows.start, j[here] - cols.start] = -np.inf
        if sides:
            rough[sides[0][rows][:, None] == sides[1][cols][None, :]] = -np.inf

    return hide


def _kth(i: np.ndarray, value: np.ndarray, k: int, rows: int) -> np.ndarray:
    """The k-th largest value of each row, -inf where it has fewer."""
    order = np.lexsort((-value, i))
    first = np.searchsorted(i[order], np.arange(rows)) + k - 1
    out = np.full(rows, -np.inf)
    has = first < np.searchsorted(i[order], np.arange(rows), "right")
    out[has] = value[order[first[has]]]
    return out


def best_rows(found: pa.Table, k: int) -> pa.Table:
    """The k best rows (query_id, term_id, score) of each query, ties to the smaller term_id."""
    ids, terms, score = (found.column(c).to_numpy() for c in ("query_id", "term_id", "score"))
    order = np.lexsort((terms, -score, ids))
    ids = ids[order]
    return found.take(pa.array(order[np.arange(len(ids)) - np.searchsorted(ids, ids) < k]))


def top_similar(queries: DataFrame, bank: DataFrame, k: int, query_blocks: int, bank_blocks: int, itself: bool = True, unlike: tuple[str, str] | None = None) -> DataFrame:
    """query_id, term_id, score: exact top-k by inner product, ties to the smaller id; queries (query_id, vec), bank (term_id, vec).

    Returns all terms where the bank has fewer than k.  Without ``itself`` the bank's row of a query's own id is no answer;
    with ``unlike`` no row of the bank is whose value in the second column equals the query's in the first.
    """
    more = [[c] for c in unlike] if unlike else [[], []]

    def best(q, t, qv, bv):
        ids, terms, out = q.column("query_id").to_numpy(), t.column("term_id").to_numpy(), []
        for rows, slack, products in rough_tiles(qv, bv, _hidden(q, t, itself, unlike)):
            n, edge, found = rows.stop - rows.start, None, []
            for at, rough in products:
                if edge is None:  # the k-th of the first tile is at most the k-th of all
                    edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] - 2 * slack if k <= rough.shape[1] else np.full(n, -np.inf)
                i, j = _above(rough, edge)
                found.append((i, j + np.int32(at), rough[i, j]))
            i, j, value = map(np.concatenate, zip(*found, strict=True))
            near = value >= (_kth(i, value, k, n) - 2 * slack)[i]
            i, j = i[near], j[near]
            score = exact(qv[rows], bv, i, j)
            order = np.lexsort((j, -score, i))
            i = i[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            order = order[first]
            out.append((ids[rows][i[first]], terms[j[order]], score[order]))
        yield pa.table(dict(zip(("query_id", "term_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    near = similarities(queries.select("query_id", "vec", *more[0]), bank.select("term_id", "vec", *more[1]), query_blocks, bank_blocks, best, "query_id long, term_id long, score double", merge=lambda found: best_rows(found, k))
    return top_k(near, ["query_id"], k)


def _streams(q: pa.Table, t: pa.Table, qv: np.ndarray, bv: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Of each stream and tile of the bank the scores of its windows, -inf of a window with its own row."""
    streams, at = np.unique(q.column("stream").to_numpy(), return_inverse=True)
    own = _own(q, t)
    for k, stream in enumerate(streams):
        rows = np.flatnonzero(at == k)
        mine = np.isin(own[0], rows)
        i, j = np.searchsorted(rows, own[0][mine]), own[1][mine]
        for b in range(0, len(bv), BANK_TILE):
            score = qv[rows] @ bv[b : b + BANK_TILE].T
            here = (j >= b) & (j < b + BANK_TILE)
            score[i[here], j[here] - b] = -np.inf
            yield stream, slice(b, b + BANK_TILE), score


def late_interaction(queries: DataFrame, bank: DataFrame, query_blocks: int, bank_blocks: int) -> DataFrame:
    """stream, term, score: the mean over a term's rows of each row's best score with a window of the stream; queries (query_id, vec, stream), bank (term_id, vec, term).

    A block sends one sum for each stream and term; a window does not meet its own row.
    """

    def sums(q, t, qv, bv):
        terms, term = np.unique(t.column("term").to_numpy(), return_inverse=True)
        total = {}
        for stream, at, s in _streams(q, t, qv, bv):
            best = np.round(s.max(0), 12)
            met = best > -np.inf
            own = total.setdefault(stream, np.zeros((2, len(terms))))
            own += [np.bincount(term[at][met], best[met], len(terms)), np.bincount(term[at][met], minlength=len(terms))]
        streams = np.repeat(list(total), len(terms))
        both = np.concatenate(list(total.values()), 1)
        yield pa.table({"stream": streams, "term": np.tile(terms, len(total)), "total": both[0], "n": both[1].astype(int)}).filter(pa.array(both[1] > 0))

    near = similarities(queries, bank, query_blocks, bank_blocks, sums, "stream long, term long, total double, n long", "stream")
    return near.groupBy("stream", "term").agg((F.sum("total") / F.sum("n")).alias("score"))


def window_scores(queries: DataFrame, bank: DataFrame, query_blocks: int, bank_blocks: int, temperature: float = 0.1) -> DataFrame:
    """stream, term_id, best, soft, lse of every stream and term over all windows of the stream; queries (query_id, vec, stream).

    Max, softmax-weighted mean and log-sum-exp; a window does not meet its own row.  All windows of a stream are in one block.
    """

    def modes(q, t, qv, bv):
        terms = t.column("term_id").to_numpy()
        for stream, at, s in _streams(q, t, qv, bv):
            met = np.flatnonzero(s.max(0) > -np.inf)
            s = s[:, met]
            top = s.max(0)
            e = np.exp((s - top) / temperature)
            total = e.sum(0)
            soft = (e * np.where(e > 0, s, 0)).sum(0) / total
            yield pa.table({"stream": np.full(len(met), stream), "term_id": terms[at][met], "best": np.round(top, 12), "soft": soft, "lse": top + temperature * np.log(total)})

    return similarities(queries, bank, query_blocks, bank_blocks, modes, "stream long, term_id long, best double, soft double, lse double", "stream")


def best_by_label(queries: DataFrame, bank: DataFrame, query_blocks: int, bank_blocks: int) -> DataFrame:
    """query_id, pos, neg: the best score among all other rows of the query's label and among all of other labels; (.., ql), (.., bl)."""

    def best(q, t, qv, bv):
        ql, bl, (i, j) = q.column("ql").to_numpy(), t.column("bl").to_numpy(), _own(q, t)
        found = np.full((2, len(qv)), -np.inf)
        for a in range(0, len(qv), QUERY_TILE):
            for b in range(0, len(bv), BANK_TILE):
                rows, cols = slice(a, a + QUERY_TILE), slice(b, b + BANK_TILE)
                score, same = qv[rows] @ bv[cols].T, ql[rows][:, None] == bl[cols][None, :]
                here = (i >= a) & (i < a + QUERY_TILE) & (j >= b) & (j < b + BANK_TILE)
                score[i[here] - a, j[here] - b] = -np.inf
                for own, which in zip(found, (same, ~same), strict=True):
                    own[rows] = np.maximum(own[rows], np.where(which, score, -np.inf).max(1))
        high = lambda x: pa.array(np.round(x, 12), mask=x == -np.inf)
        yield pa.table({"query_id": q.column("query_id"), "pos": high(found[0]), "neg": high(found[1])})

    near = similarities(queries, bank, query_blocks, bank_blocks, best, "query_id long, pos double, neg double")
    return near.groupBy("query_id").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))


def ranks_of(targets: DataFrame, queries: DataFrame, bank: DataFrame, query_blocks: int, bank_blocks: int) -> DataFrame:
    """query_id, term_id, rank of each target (query_id, term_id, score) in the whole bank; ties share the earlier rank."""
    aims = targets.groupBy("query_id").agg(F.collect_list(F.struct("term_id", "score")).alias("aims"))

    def count(q, t, qv, bv):
        own, out = q.column("aims").to_pylist(), []
        for rows, slack, products in rough_tiles(qv, bv, _hidden(q, t, False)):
            aims = own[rows]
            goal = np.full((len(aims), max(map(len, aims))), np.inf)
            for i, a in enumerate(aims):
                goal[i, : len(a)] = [x["score"] for x in a]
            n = np.zeros(goal.shape, int)
            for at, rough in products:
                i, j = _above(rough, goal.min(1) - slack)
                for p in range(0, len(i), PAIRS):
                    own_i = i[p : p + PAIRS]
                    np.add.at(n, own_i, exact(qv[rows], bv, own_i, j[p : p + PAIRS] + at)[:, None] > goal[own_i])
            out += [(x, a["term_id"], int(m)) for x, many, c in zip(q.column("query_id").to_numpy()[rows].tolist(), aims, n, strict=True) for a, m in zip(many, c, strict=False)]
        yield pa.table(dict(zip(("query_id", "term_id", "n"), map(pa.array, zip(*out, strict=True)), strict=True)))

    above = similarities(queries.select("query_id", "vec").join(aims, "query_id"), bank.select("term_id", "vec"), query_blocks, bank_blocks, count, "query_id long, term_id long, n long")
    return above.groupBy("query_id", "term_id").agg((F.sum("n") + 1).alias("rank"))


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "term_id") -> DataFrame:
    """The k best of each group with their rank; the limit works before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_after_top_k(scored: DataFrame, by: list[str], k: int, threshold: float, most: int) -> DataFrame:
    """Top k first, then the threshold, then a cap: fewer than k may stay."""
    kept = top_k(scored, by, k).where(F.col("score") >= threshold)
    return top_k(kept.drop("rank"), by, most)


def max_similarity(windows: DataFrame, by: list[str], mode: str = "max", temperature: float = 0.1) -> DataFrame:
    """One score of each group over its windows: max with the window's times, softmax-weighted mean, or log-sum-exp."""
    s = F.col("sim")
    if mode == "max":
        best = F.min(F.struct((-s).alias("m"), "win_start", "win_end"))
        return windows.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.m")).alias("score"), F.col("b.win_start").alias("time_start"), F.col("b.win_end").alias("time_end"))
    e = F.exp(s / temperature)
    if mode == "softmax":
        return windows.groupBy(*by).agg((F.sum(e * s) / F.sum(e)).alias("score"))
    return windows.groupBy(*by).agg((F.log(F.sum(e)) * temperature).alias("score"))


def merge_best(results: DataFrame, by: list[str], term: str, min_end: float, k: int) -> DataFrame:
    """Best score of each term over all windows that end after ``min_end``; then top k."""
    live = results.where(F.col("time_end") > min_end)
    best = live.groupBy(*by, term).agg(F.min(F.struct((-F.col("score")).alias("m"), "time_start")).alias("b"))
    return top_k(best.select(*by, term, (-F.col("b.m")).alias("score"), F.col("b.time_start").alias("time_start")), by, k, tie=term)


def vote(results: DataFrame, stream: str, step: str, term: str, last: int, min_votes: int) -> DataFrame:
    """For each step of a stream, terms with enough votes in the last steps: their scores summed."""
    steps = results.select(stream, F.col(step).alias("at")).distinct()
    near = results.withColumn("at", F.explode(F.sequence(F.col(step), F.col(step) + last - 1)))
    return near.join(steps, [stream, "at"]).groupBy(stream, "at", term).agg(F.count("*").alias("votes"), F.sum("score").alias("score")).where(F.col("votes") >= min_votes)


def fuse_min(a: DataFrame, b: DataFrame, by: list[str], term: str) -> DataFrame:
    """Terms found by both sources with the smaller score; groups for which b is empty keep a."""
    best = lambda df, n: df.groupBy(*by, term).agg(F.max("score").alias(n))
    x, y = best(a, "sa"), best(b, "sb")
    seen = b.select(*by).distinct().withColumn("has_b", F.lit(True))
    joined = x.join(y, [*by, term], "left").join(seen, by, "left")
    return joined.where("sb IS NOT NULL OR has_b IS NULL").select(*by, term, F.least("sa", F.coalesce("sb", "sa")).alias("score"))


def relative_threshold(ranked: DataFrame, by: list[str], reference_rank: int, gap: float) -> DataFrame:
    """Rows whose score exceeds the one at a rank (clamped to the list) by the gap."""
    w = Window.partitionBy(*by)
    at = F.max(F.when(F.col("rank") == F.least(F.lit(reference_rank), F.col("__n")), F.col("score"))).over(w)
    return ranked.withColumn("__n", F.count("*").over(w)).withColumn("__r", at).where(F.col("score") - F.col("__r") >= gap).drop("__n", "__r")


def l2_score(cosine: Column) -> Column:
    return 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine)))


# ---------------------------------------------------------------- measures


def recall_at(ranked: DataFrame, positives: DataFrame, by: list[str], term: str, ks: list[int]) -> DataFrame:
    """Share of groups with a positive among the first k, for each k, and the mean reciprocal rank."""
    hit = positives.join(ranked, [*by, term], "left").groupBy(*by).agg(F.min("rank").alias("r"))
    return hit.agg(*[F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("queries"))


def detection(rows: DataFrame, score: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """Confusion counts and measures of score >= threshold, for all thresholds in one pass."""
    counts = rows.select(score.alias("s"), truth.cast("int").alias("y")).withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    p, y = F.col("s") >= F.col("tau"), F.col("y") == 1
    c = counts.groupBy("tau").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f = lambda b: F.round(F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0)), 6)
    return c.select("tau", "tp", "fp", "fn", "tn", F.round(precision, 6).alias("prec"), F.round(recall, 6).alias("recall"), f(1).alias("f1"), f(4).alias("f2"), F.round(F.coalesce(F.try_divide("fp", F.col("fp") + F.col("tn")), F.lit(0.0)), 6).alias("fpr"))


def ranking_measures(rows: DataFrame, score: str, truth: str, key: str, tpr: float) -> DataFrame:
    """ROC AUC with tied ranks averaged, average precision and the false positive rate where recall first reaches ``tpr``.

    Counts by distinct score come first, so the running sums go over scores, not rows, and by ranges of scores; of tied
    scores positives and negatives stand together.
    """
    by = rows.groupBy(score).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    run = in_order(by, [F.desc(score)], sums={"p": "tp", "n": "fp"})
    ends = rows.agg(F.sum(truth).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    run = run.join(ends)  # one row
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("pos") * F.col("neg"))
    return run.agg(
        F.round(area, 6).alias("auc"), F.round(F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("ap"),
        F.round(F.min(F.when(F.col("tp") >= tpr * F.col("pos"), F.col("fp") / F.col("neg"))), 6).alias("fpr_at_tpr"),
    )
