"""Folds whose steps depend on the ones before: grouped Python, one talk or conversation at a time."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aligned(gold: list[str], windows: list[set[str]]) -> int:
    """Most gold terms that windows match in order: each window may match any number of a stretch, stretches do not overlap."""
    best = np.zeros(len(gold) + 1, np.int64)  # of the first terms, by the windows so far
    for w in windows:
        hits = np.concatenate(([0], np.cumsum([g in w for g in gold], dtype=np.int64)))
        best = hits + np.maximum.accumulate(best - hits)
    return int(best[-1])


def ordered_matches(rows: DataFrame) -> DataFrame:
    """talk, gold, matched: gold terms and windows (is_gold false) of a talk, both in order of pos.

    A window is an array of candidate terms (``terms``); a gold row has its one term there.  Null arrays have none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        terms = [list(x) if x is not None else [] for x in pdf.terms]
        gold = [x[0] for x, g in zip(terms, pdf.is_gold, strict=True) if g and x]
        windows = [set(x) for x, g in zip(terms, pdf.is_gold, strict=True) if not g]
        return pd.DataFrame({"talk": [pdf.talk.iloc[0]], "gold": [len(gold)], "matched": [aligned(gold, windows)]})

    kind = dict(rows.dtypes)["talk"]
    return rows.groupBy("talk").applyInPandas(run, f"talk {kind}, gold long, matched long")


def best_span(term: str, text: str, extra: int = 2, ratio: float = 1.3) -> tuple[float, int, int]:
    """Best score 2m / (len(term) + span) of a span of the text that starts at a matching block, with its place."""
    limit = max(len(term) + extra, int(len(term) * ratio) + extra)
    best = (0.0, 0, 0)
    matcher = difflib.SequenceMatcher(None, term, text, autojunk=False)
    starts = {b.b - b.a for b in matcher.get_matching_blocks() if b.size} | {b.b for b in matcher.get_matching_blocks() if b.size}
    for start in sorted(max(0, x) for x in starts):
        for size in range(max(1, len(term) - extra), min(limit, len(text) - start) + 1):
            m = sum(b.size for b in difflib.SequenceMatcher(None, term, text[start : start + size], autojunk=False).get_matching_blocks())
            best = max(best, (2 * m / (len(term) + size), -start, size))
    return best[0], -best[1], best[2]


@F.pandas_udf(T.DoubleType())
def fuzzy_score(term: pd.Series, text: pd.Series) -> pd.Series:
    """Score of the best span; null where either is null."""
    return pd.Series([None if a is None or b is None else best_span(a, b)[0] for a, b in zip(term, text, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def morphology(term: pd.Series, text: pd.Series) -> pd.Series:
    """substring, spacing_variant, fuzzy or none: how a text has a term."""

    def one(a: str, b: str) -> str:
        x, y = a.casefold(), b.casefold()
        if not x:
            return "none"
        if x in y:
            return "substring"
        small = "".join(c for c in x if c.isalnum())
        if small and small in "".join(c for c in y if c.isalnum()):
            return "spacing_variant"
        words, n = y.split(), max(1, len(x.split()))
        near = any(difflib.SequenceMatcher(None, x, " ".join(words[i : i + n]), autojunk=False).ratio() >= 0.78 for i in range(len(words) - n + 1))
        return "fuzzy" if near else "none"

    return pd.Series([one(a or "", b or "") for a, b in zip(term, text, strict=True)])


def _alignment_ends(ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """For each number of reference words how many hypothesis words stand before them on a path of least edit distance.

    The path is taken from the end, by words that only the hypothesis has first, then pairs, then words that only the
    reference has.  Rows of costs are kept at every k-th reference word, k about the root of their number, and the rows
    between two of them are computed again on the way back: memory grows with the words of the hypothesis times k.
    """
    n, m = len(ref), len(hyp)
    steps = np.arange(m + 1, dtype=np.int32)
    every = max(1, int(n**0.5))

    def following(row: np.ndarray, i: int) -> np.ndarray:
        cost = np.empty(m + 1, np.int32)
        cost[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (hyp != ref[i - 1]), out=cost[1:])
        return np.minimum.accumulate(cost - steps) + steps

    kept, row = {0: steps}, steps
    for i in range(1, n + 1):
        row = following(row, i)
        if i % every == 0:
            kept[i] = row
    ends, j = np.zeros(n + 1, np.int64), m
    ends[n] = m
    for top in range((n - 1) // every * every, -1, -every):
        rows = [kept[top]]
        for i in range(top + 1, min(top + every, n) + 1):
            rows.append(following(rows[-1], i))
        for i in range(min(top + every, n), top, -1):
            now, before = rows[i - top], rows[i - top - 1]
            while j and now[j] == now[j - 1] + 1:
                j -= 1
            if j and now[j] == before[j - 1] + (ref[i - 1] != hyp[j - 1]):
                j -= 1
            ends[i - 1] = j
    return ends


def resegment(rows: DataFrame) -> DataFrame:
    """talk, sent_idx, segment: a talk's hypothesis words cut into as many segments as references, at least edit distance.

    ``rows``: talk, sent_idx, reference, hypothesis (any cut of the same words).  Levenshtein alignment of all words
    against all reference words; a segment ends where its reference's last word is aligned.  A talk is one group: its words
    as numbers and a few rows of costs; 20,000 words on either side take some 20 MB and seconds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sent_idx")
        refs = [r.split() for r in pdf.reference.fillna("")]
        words = [w for r in refs for w in r]
        hyp = " ".join(pdf.hypothesis.fillna("")).split()
        number = {w: k for k, w in enumerate(dict.fromkeys([*words, *hyp]))}
        ids = lambda ws: np.array([number[w] for w in ws], np.int32)
        m = len(hyp)
        ends = _alignment_ends(ids(words), ids(hyp))
        at, last, out = 0, 0, []
        for k, r in enumerate(refs):
            at += len(r)
            end = m if k == len(refs) - 1 else max(last, int(ends[at]) if at else 0)
            out.append(" ".join(hyp[last:end]))
            last = end
        return pd.DataFrame({"talk": pdf.talk, "sent_idx": pdf.sent_idx, "segment": out})

    kind = dict(rows.dtypes)["talk"]
    return rows.groupBy("talk").applyInPandas(run, f"talk {kind}, sent_idx long, segment string")


def tag_terms(rows: DataFrame, open_tag: str = "<term>", close_tag: str = "</term>") -> DataFrame:
    """conv_id, turn, text: each target wrapped at its first unwrapped, boundary-safe place in a later assistant turn.

    ``rows``: conv_id, turn, role, text, targets (array of strings, on user turns).  Later targets see earlier tags.
    """

    def place(text: str, target: str) -> int:
        at = text.find(target)
        while at >= 0:
            before, after = text[at - 1 : at], text[at + len(target) : at + len(target) + 1]
            inside = text.rfind(open_tag, 0, at) > text.rfind(close_tag, 0, at)
            latin = lambda a, b: a.isascii() and a.isalnum() and b.isascii() and b.isalnum()
            if not inside and not latin(before, target[0]) and not latin(target[-1], after):
                return at
            at = text.find(target, at + 1)
        return -1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn").reset_index(drop=True)
        texts = pdf.text.fillna("").tolist()
        for i, (role, targets) in enumerate(zip(pdf.role, pdf.targets, strict=True)):
            if role == "user" and targets is not None:
                for target in targets:
                    for j in range(i + 1, len(texts)):
                        if target and pdf.role[j] == "assistant" and (at := place(texts[j], target)) >= 0:
                            texts[j] = f"{texts[j][:at]}{open_tag}{target}{close_tag}{texts[j][at + len(target) :]}"
                            break
        return pd.DataFrame({"conv_id": pdf.conv_id, "turn": pdf.turn, "text": texts})

    return rows.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, text string")
