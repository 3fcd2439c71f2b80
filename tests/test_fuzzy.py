"""Fuzzy gold terms against plain Python over all pairs."""

from __future__ import annotations

import re
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.operators import conversation, fuzzy

from .conftest import SMALL


def brute(entries, rows, exclude, min_chars, score, most):
    """Chunk by chunk, entry by entry, with the text that follows."""
    out = []
    for conv, chunk in sorted({(e["conv_id"], e["chunk_idx"]) for e in entries}):
        own = sorted((e for e in entries if (e["conv_id"], e["chunk_idx"]) == (conv, chunk)), key=lambda e: e["pos"])
        later = "".join(r["text"] or "" for r in sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn"]) if r["role"] == "assistant" and r["turn"] > own[0]["turn"])
        seen, found = set(), []
        for e in own:
            target = e["translation"]
            key = ((e["term"] or "").casefold(), target)
            if not target or len("".join(target.split())) < 2 or set(re.findall("[a-z]+(?:'[a-z]+)?", (e["term"] or "").lower())) & set(exclude) or key in seen:
                continue
            s = None if target in later else round(fuzzy.block_score(target, later), 6)
            if s is None or (len("".join(target.split())) >= min_chars and s >= score):
                seen.add(key)
                found.append((conv, chunk, e["term"], target, "exact" if s is None else "fuzzy", s))
        out += found[: most or None]
    return sorted(out, key=str)


def got(spark, entries, rows, *args, **more):
    e = spark.createDataFrame(entries, "conv_id long, chunk_idx long, turn long, pos long, term string, translation string")
    r = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = fuzzy.derive_gold(e, r, *args, **more).collect()
    return sorted(((x.conv_id, x.chunk_idx, x.term, x.translation, x.match_type, x.fuzzy_score) for x in out), key=str)


def test_all_pairs_of_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", F.lower("text").alias("text"))
    rows = [r.asDict() for r in df.collect()]
    tok = conversation.chunks(df).select("conv_id", "chunk_idx", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("pos", "term"))
    entries = [r.asDict() for r in tok.select("conv_id", "chunk_idx", "turn", "pos", "term", F.col("term").alias("translation")).collect()]
    assert len(entries) > 500
    order = lambda es: [tuple(e[c] for c in ("conv_id", "chunk_idx", "turn", "pos", "term", "translation")) for e in es]
    lines = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows]
    for score, least, most in ((0.8, 5, 12), (0.58, 4, 0)):
        assert got(spark, order(entries), lines, 2, ("the", "und"), least, score, most=most) == brute(entries, rows, ("the", "und"), least, score, most)


def test_nulls_repeats_and_order(spark):
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", "alpha be"), (1, 2, "assistant", "ta gamma"), (1, 3, "user", "y"), (1, 4, "assistant", None), (1, 5, "assistant", "delta rays"), (2, 0, "user", "z")]
    entries = [(1, 0, 0, 1, "B", "beta"), (1, 0, 0, 2, "b", "beta"), (1, 0, 0, 3, None, "gamma"), (1, 0, 0, 4, "n", None), (1, 0, 0, 5, "s", "g"), (1, 1, 3, 1, "B", "beta"), (1, 1, 3, 2, "d", "delta raz"), (2, 0, 0, 1, "B", "beta"), (1, 0, 0, 6, "Skip this", "alpha")]
    assert got(spark, entries, rows, 2, ("skip",), 4, 0.8) == [(1, 0, "B", "beta", "exact", None), (1, 0, None, "gamma", "exact", None), (1, 1, "d", "delta raz", "fuzzy", round(16 / 17, 6))]
    assert got(spark, entries[:0] or [(9, 0, 0, 0, "t", "none such")], rows) == []


@pytest.mark.parametrize("score", [0.5, 0.7, 0.76, 0.85, 0.95])
def test_filter_drops_no_pair_that_reaches_the_score(spark, score):
    g = np.random.default_rng(int(score * 100))
    word = lambda n: "".join(g.choice(list("abcde "), n))
    texts = [(i, word(60)) for i in range(6)]
    targets = {(i, "".join(x if g.random() < 0.85 else str(g.choice(list("abcde"))) for x in texts[i][1][p : p + int(g.integers(4, 14))])) for i in range(6) for p in g.integers(0, 46, 12)}
    t, full = spark.createDataFrame(sorted(targets), "conv_id int, translation string"), spark.createDataFrame(texts, "conv_id int, full string")
    kept = {(r.conv_id, r.translation): r.reach for r in fuzzy.fuzzy_candidates(t, full, score, 1.6, 4).collect()}
    near = {(i, x) for i, x in targets if fuzzy.block_score(x, texts[i][1]) >= score}
    assert near and near <= kept.keys()


def test_filter_drops_most_of_what_is_far(spark):
    g = np.random.default_rng(3)
    word = lambda: "".join(g.choice(list("abcdefghijklmnopqrstuvwxyz"), int(g.integers(8, 13))))
    texts, targets = [(i, " ".join(word() for _ in range(60))) for i in range(5)], [(i, word()) for i in range(5) for _ in range(40)]
    kept = fuzzy.fuzzy_candidates(spark.createDataFrame(targets, "conv_id int, translation string"), spark.createDataFrame(texts, "conv_id int, full string"), 0.85, 1.6, 4)
    assert kept.count() < 0.1 * len(targets)


def test_blocks_are_those_of_difflib_and_cheaper():
    g = np.random.default_rng(5)
    for letters in ("ab", "abc ", "abcdefghijklmnop ", "aäß术"):
        for _ in range(300):
            a, b = ("".join(g.choice(list(letters), int(g.integers(0, n)))) for n in (14, 60))
            assert fuzzy.matching_blocks(a, b) == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    text, targets = "".join(g.choice(list("abcdefghijklmnop "), 5000)), ["".join(g.choice(list("abcdefghijklmnop"), 9)) for _ in range(100)]
    took = []
    for fn in (lambda x: fuzzy.block_score(x, text), lambda x: SequenceMatcher(None, x, text, autojunk=False).get_matching_blocks()):
        began = time.process_time()
        for x in targets:
            fn(x)
        took.append(time.process_time() - began)
    assert took[0] < took[1] / 3
