"""Gold terms of conversation chunks: entries whose translation later text has, exactly or nearly.

Blocks of characters that an entry and a text share are found by searches of the entry's substrings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def longest_span(size: int, ratio: float, extra: int) -> int:
    return max(size + extra, int(size * ratio) + extra)


def matching_blocks(target: str, text: str) -> list[tuple[int, int, int]]:
    """(place in target, place in text, size) of difflib's matching blocks without junk, in order.

    The longest common substring, of several the first in the target and then in the text, and so on to its left and right.
    Its length is found by bisection: if one of n characters is common, so is one of n - 1.
    """
    out, boxes = [], [(0, len(target), 0, len(text))]
    while boxes:
        al, ah, bl, bh = boxes.pop()
        size, most, i, j = 0, min(ah - al, bh - bl), 0, 0
        while size < most:
            n = (size + most + 1) // 2
            for k in range(al, ah - n + 1):
                at = text.find(target[k : k + n], bl, bh)
                if at >= 0:
                    size, i, j = n, k, at
                    break
            else:
                most = n - 1
        if size:
            out.append((i, j, size))
            boxes += [(al, i, bl, j), (i + size, ah, j + size, bh)]
    return sorted(out)


def block_score(target: str, text: str, ratio: float = 1.6, extra: int = 4) -> float:
    """Best 2m / (len(target) + span) of matching blocks in a row that have m characters in a span short enough."""
    blocks = matching_blocks(target, text)
    most, best = longest_span(len(target), ratio, extra), 0.0
    for k, (_, first, _) in enumerate(blocks):
        matched = 0
        for _, at, size in blocks[k:]:
            span = at + size - first
            if span > most:
                break
            matched += size
            best = max(best, 2 * matched / (len(target) + span))
    return best


def least_grams(size: int, score: float) -> tuple[int, int]:
    """q, and how many of a target's places must have a q-gram that a span has too, if the score is to be reached.

    m matching characters in a span of L need 2m >= score * (size + L), and m <= L.  They stand in blocks between which a
    character of either side is left over, so in at most size + L - 2m + 1; each block loses q - 1 of its places.
    """
    if not 0 < score <= 1:
        raise ValueError("the least score is above 0 and at most 1")
    q = 2 if score > 0.75 else 1
    return q, math.ceil(size * (score if q == 1 else 3 * score - 2) / (2 - score) - (q - 1) - 1e-9)


def reaches(text: str, targets: list[str], score: float, ratio: float, extra: int) -> list[int]:
    """For each target where the last span begins, at most, that has q-grams enough; -1 if none has.

    The text's q-grams are listed once with their places.  Places are counted in bands of twice the longest span that overlap
    by one, so that every span lies within one band; a gram counts once in a band, as does one that the target has twice.
    """
    q = least_grams(1, score)[0]
    places: dict[str, list[int]] = {}
    for k in range(len(text) - q + 1):
        places.setdefault(text[k : k + q], []).append(k)
    out = []
    for target in targets:
        size, grams = len(target), list({target[k : k + q] for k in range(len(target) - q + 1)})
        need = max(1, least_grams(size, score)[1] - (size - q + 1 - len(grams)))
        most = max(1, min(longest_span(size, ratio, extra), int(size * (2 / score - 1) + 1e-9)))
        own = [(g, places[x]) for g, x in enumerate(grams) if x in places]
        if len(own) < need:
            out.append(-1)
            continue
        at = np.concatenate([np.asarray(p) for _, p in own])
        gram = np.repeat([g for g, _ in own], [len(p) for _, p in own])
        band = at // most
        pairs = np.unique(np.concatenate([band + 1, band]) * len(grams) + np.tile(gram, 2))  # bands begin at -1
        bands, n = np.unique(pairs // len(grams), return_counts=True)
        good = bands[n >= need]
        out.append(int((good.max() + 1) * most - 1) if len(good) else -1)
    return out


def future_offsets(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(conv, full): all assistant text of each conversation once; (conv, turn, offset): where what follows a turn begins in it."""
    said = F.when(F.col("role") == "assistant", F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    upto = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    offsets = rows.select(conv, turn, F.coalesce(F.sum(F.length(said)).over(upto), F.lit(0)).alias("offset"))
    turns = F.sort_array(F.collect_list(F.struct(turn, said.alias("said"))))
    return rows.groupBy(conv).agg(F.array_join(F.transform(turns, lambda x: x["said"]), "").alias("full")), offsets


def fuzzy_candidates(targets: DataFrame, texts: DataFrame, score: float, ratio: float, extra: int, conv: str = "conv_id") -> DataFrame:
    """(conv, translation, reach): targets whose conversation has a span with q-grams enough, and where the last such can begin.

    ``targets``: distinct (conv, translation); ``texts``: (conv, full).  A conversation's text meets all its targets in one
    row, and no pair of a gram and a place leaves the task.
    """
    both = targets.groupBy(conv).agg(F.collect_list("translation").alias("targets")).join(texts, conv)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [reaches(text, own, score, ratio, extra) for text, own in zip(b.column("full").to_pylist(), b.column("targets").to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(conv).take(row), b.column("targets").flatten(), pa.array([x for f in found for x in f], pa.int64())], names=[conv, "translation", "reach"])

    return both.select(conv, "targets", "full").mapInArrow(probe, f"{conv} {dict(targets.dtypes)[conv]}, translation string, reach long").where("reach >= 0")


def derive_gold(
    entries: DataFrame,
    rows: DataFrame,
    min_chars: int = 2,
    exclude_tokens: tuple[str, ...] = (),
    fuzzy_min_chars: int | None = 4,
    fuzzy_min_score: float = 0.58,
    ratio: float = 1.6,
    extra: int = 4,
    most: int = 0,
) -> DataFrame:
    """conv_id, chunk_idx, pos, term, translation, match_type, fuzzy_score of the entries that the assistant says after their chunk.

    ``entries``: conv_id, chunk_idx, turn (the chunk's), pos, term, translation; ``rows``: conv_id, turn, role, text.  Entries
    with a short translation or a source token to exclude go.  An entry is ``exact`` where later text has its translation,
    else ``fuzzy`` if that is long enough and ``block_score`` reaches the least score; ``fuzzy_min_chars`` None leaves that
    step out.  Of entries of one chunk with the same casefolded term and translation the first counts; ``most`` above 0
    bounds a chunk's terms.  Null translations match nothing; null texts are empty.

    The text of a conversation is built once and sent to its targets as one row of each; an entry's later text is a slice.
    All long enough are scored: that takes less than ``fuzzy_candidates``.
    """
    texts, offsets = future_offsets(rows)
    ok = entries.where(F.col("translation").isNotNull() & (F.col("translation") != "") & (X.norm_len(F.col("translation")) >= min_chars))
    if exclude_tokens:
        ok = ok.where(~F.arrays_overlap(X.source_tokens(F.coalesce("term", F.lit(""))), F.array(*[F.lit(x.lower()) for x in exclude_tokens])))
    ok = ok.join(offsets, ["conv_id", "turn"])
    # the last place of each target in its conversation decides for all chunks
    wanted = ok.groupBy("conv_id").agg(F.collect_set("translation").alias("targets")).join(texts, "conv_id")
    last = lambda z, t: z["size"] - F.length(t) - F.instr(z["back"], F.reverse(t)) + 1
    places = X.let(
        F.struct(F.reverse("full").alias("back"), F.length("full").alias("size")),
        lambda z: F.transform("targets", lambda t: F.struct(t.alias("translation"), F.when(F.contains("full", t), last(z, t)).otherwise(-1).alias("last"))),
    )
    where = wanted.select("conv_id", F.explode(places).alias("p")).select("conv_id", "p.translation", "p.last")
    found = ok.join(where, ["conv_id", "translation"])
    columns = ["conv_id", "chunk_idx", "pos", "term", "translation"]
    exact = found.where("last >= offset").select(*columns, F.lit("exact").alias("match_type"), F.lit(None).cast("double").alias("fuzzy_score"))
    out = exact
    if fuzzy_min_chars is not None:
        rest = found.where((F.col("last") < F.col("offset")) & (X.norm_len(F.col("translation")) >= fuzzy_min_chars))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scores(full: pd.Series, pairs: pd.Series) -> pd.Series:
            return pd.Series([[block_score(p["translation"], text[p["offset"] :], ratio, extra) for p in own] for text, own in zip(full, pairs, strict=True)])

        pairs = rest.groupBy("conv_id").agg(F.collect_set(F.struct("translation", "offset")).alias("pairs")).join(texts, "conv_id")
        scored = pairs.select("conv_id", F.explode(F.arrays_zip("pairs", scores("full", "pairs").alias("score"))).alias("z"))
        scored = scored.select("conv_id", "z.pairs.translation", "z.pairs.offset", "z.score").where(F.col("score") >= fuzzy_min_score)
        fuzzy = rest.join(scored, ["conv_id", "translation", "offset"])
        out = exact.unionByName(fuzzy.select(*columns, F.lit("fuzzy").alias("match_type"), F.round("score", 6).alias("fuzzy_score")))
    first = F.row_number().over(Window.partitionBy("conv_id", "chunk_idx", X.casefold(F.col("term")), "translation").orderBy("pos"))
    out = out.withColumn("__r", first).where("__r = 1").drop("__r")
    if most > 0:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy("conv_id", "chunk_idx").orderBy("pos"))).where(F.col("__r") <= most).drop("__r")
    return out
