"""Corpus BLEU by n-gram counting in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments whose n-grams are counted together.
ROWS = 4096
SUMS = ("matches", "total", "hyp_len", "ref_len")


def tokenize(text: Column, lang: str = "13a") -> Column:
    """13a: punctuation apart from letters, decimal points kept; char: every character that is no white space."""
    if lang == "char":
        return F.filter(F.split(F.regexp_replace(text, r"\s", ""), ""), lambda x: x != "")
    s = F.regexp_replace(text, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", r"$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", r" $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", r"$1 $2 ")
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def _clipped(batch: pa.RecordBatch, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each order the clipped matches and the n-grams of the hypothesis, row by row."""
    sides = []
    for name in ("hyp", "ref"):
        column = batch.column(name).fill_null([])
        sides.append((column.flatten(), np.diff(column.offsets.to_numpy())))
    tokens = pa.concat_arrays([sides[0][0], sides[1][0]]).dictionary_encode()
    ids, rows = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.num_rows
    count = np.concatenate((sides[0][1], sides[1][1]))
    row = np.repeat(np.concatenate((np.arange(rows), np.arange(rows))), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(ids))  # tokens from here to the end of the side
    is_hyp = np.arange(len(ids)) < len(sides[0][0])
    words = max(1, len(tokens.dictionary))
    gram, out = ids, []
    for n in range(1, most + 1):
        at = np.flatnonzero(left >= n)
        if n > 1:
            gram[at] = gram[at] * words + ids_at[at + n - 1]
        else:
            ids_at = ids.copy()
        names, gram_at = np.unique(gram[at], return_inverse=True)
        gram = np.zeros(len(ids), np.int64)
        gram[at] = gram_at  # small numbers again, so that a word more fits
        pair, which = np.unique(row[at] * max(1, len(names)) + gram_at, return_inverse=True)
        h = np.bincount(which, is_hyp[at], len(pair))
        r = np.bincount(which, ~is_hyp[at], len(pair))
        own = pair // max(1, len(names))
        out.append((n, np.bincount(own, np.minimum(h, r), rows).astype(np.int64), np.bincount(own, h, rows).astype(np.int64)))
    return out


def counts(rows: DataFrame, by: list[str], hypothesis: str = "hyp", reference: str = "ref", most: int = 4) -> DataFrame:
    """by, n, matches, total, hyp_len, ref_len: clipped matches of each order, from token arrays.

    Both sides of a segment stand in one row, so n-grams are counted where the rows are read and only sums are shuffled.
    Null token arrays are empty.
    """
    base = rows.select(*by, F.col(hypothesis).alias("hyp"), F.col(reference).alias("ref"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                sizes = [pc.fill_null(pc.list_value_length(b.column(c)), 0).cast(pa.int64()) for c in ("hyp", "ref")]
                parts = [pa.table([*(b.column(c) for c in by), pa.array([n] * b.num_rows, pa.int32()), pa.array(m), pa.array(t), *sizes], names=[*by, "n", "matches", "total", "hyp_len", "ref_len"]) for n, m, t in _clipped(b, most)]
                total = pa.concat_tables(parts).group_by([*by, "n"]).aggregate([(c, "sum") for c in SUMS])
                total = total.rename_columns([c.removesuffix("_sum") for c in total.column_names]).select([*by, "n", *SUMS])
                yield from total.combine_chunks().to_batches()

    kinds = [f.dataType.simpleString() for f in base.schema.fields[: len(by)]]
    schema = ", ".join([f"`{c}` {k}" for c, k in zip(by, kinds, strict=True)] + ["n int", *(f"{c} long" for c in SUMS)])
    return base.mapInArrow(run, schema).groupBy(*by, "n").agg(*[F.sum(c).alias(c) for c in SUMS])


def bleu(rows: DataFrame, by: list[str], hypothesis: str = "hyp", reference: str = "ref", most: int = 4, smooth: str = "none") -> DataFrame:
    """BLEU of each group, from token arrays.

    Without smoothing it is 0 if an order has no match; ``exp`` takes 1/2, 1/4, ... of a match for each such order in turn.
    """
    c = counts(rows, by, hypothesis, reference, most)
    if smooth == "exp":
        empty = F.when((F.col("matches") == 0) & (F.col("total") > 0), 1).otherwise(0)
        before = F.sum(empty).over(Window.partitionBy(*by).orderBy("n"))
        c = c.withColumn("matches", F.when(empty == 1, F.pow(F.lit(0.5), before)).otherwise(F.col("matches")))
    s = c.groupBy(*by).agg(F.sum(F.log(F.try_divide(F.col("matches"), F.col("total")))).alias("l"), F.count_if(F.col("matches") > 0).alias("k"), F.max("hyp_len").alias("h"), F.max("ref_len").alias("r"))
    brevity = F.when(F.col("h") < F.col("r"), F.exp(1 - F.col("r") / F.col("h"))).otherwise(1.0)
    return s.select(*by, F.round(F.when(F.col("k") < most, 0.0).otherwise(100 * brevity * F.exp(F.col("l") / most)), 4).alias("bleu"), F.col("h").alias("hyp_len"), F.col("r").alias("ref_len"))
