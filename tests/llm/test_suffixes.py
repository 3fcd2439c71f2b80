from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from termlake.llm import suffixes

from ..conftest import SMALL


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept hash) by looking every string up."""
    texts, seen = [(t or "").encode() for _, t in rows], defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + 1 + length] -= 1
        gone = np.concatenate([[False], np.cumsum(gone)[1:-1] > 0])
        kept = bytes(b for b, g in zip(t, gone[1:], strict=True) if not g)
        out.append((doc, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = suffixes.remove(df).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


@pytest.fixture
def short(monkeypatch):
    """Strings of 40 bytes and small buffers, so that small texts have every case."""
    for name, value in {"LENGTH": 40, "CORE": 10, "WIDTHS": (8, 3, 1), "BUFFER": 300}.items():
        monkeypatch.setattr(suffixes, name, value)
    suffixes._tables.cache_clear()
    yield
    suffixes._tables.cache_clear()


def test_runs_cover_every_window_once(short):
    g = np.random.default_rng(0)
    texts = [bytes(g.integers(97, 100, n, dtype=np.uint8)) for n in (0, 39, 40, 41, 700, 1500)] + [b"a" * 500]
    starts = defaultdict(list)
    for i, lo, more, offset, _, _ in suffixes.runs(texts):
        for t, a, m, o in zip(i, lo, more, offset, strict=True):
            starts[t] += range(a, a + m + 1)
            assert m <= o <= 30
    assert {t: sorted(s) for t, s in starts.items()} == {t: list(range(len(x) - 39)) for t, x in enumerate(texts) if len(x) >= 40}


def test_names_are_those_of_the_strings(short):
    data = b"abcabdabcabc" * 5
    names = suffixes.Hashes(data)
    a, b = np.meshgrid(np.arange(50), np.arange(1, 10))
    got = names.of(a.ravel(), (a + b).ravel())
    by_name = defaultdict(set)
    for s, n, h in zip(a.ravel(), b.ravel(), got, strict=True):
        by_name[data[s : s + n]].add(int(h))
    assert all(len(v) == 1 for v in by_name.values()) and len({next(iter(v)) for v in by_name.values()}) == len(by_name)


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_shared_passages_at_all_offsets(spark):
    """Passages around the length, cut and edited at any place, one near another, repeated in one text, and text of one letter."""
    g = np.random.default_rng(1)
    words = lambda n: " ".join(f"{g.integers(10**6):x}" for _ in range(n))
    base = [words(300) for _ in range(3)]
    rows = []
    for _ in range(90):
        parts = []
        for _ in range(int(g.integers(1, 4))):
            b = base[int(g.integers(3))]
            n = int(g.choice([100, 250, 395, 399, 400, 401, 405, 450, 700, 1200]))
            at = int(g.integers(0, len(b) - n))
            piece = list(b[at : at + n])
            if g.random() < 0.4:
                piece[int(g.integers(n))] = "#"
            parts += ["".join(piece), words(int(g.integers(0, 40)))]
        rows.append("".join(parts))
    rows += ["z" * 399, "z" * 400, "z" * 401, "y" * 402, "q" * 400, "é" * 250, "é" * 200 + words(60), None, ""]
    data = [(int(i), t) for i, t in enumerate(rows)]
    assert found(spark.createDataFrame(data, "doc_id long, text string").repartition(5)) == brute(data, 400)


def test_copies_and_edges(spark, edges, nothing):
    assert found(edges) == brute([(r.doc_id, r.text) for r in edges.collect()], 400)
    assert suffixes.remove(nothing).count() == 0
    text = " ".join(f"w{i}" for i in range(200))
    data = [(1, text), (1, text), (None, text), (2, text[:500]), (3, text + "x"), (3, "other"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "a") for r in data], "doc_id long, text string, n_bytes int, spans string")
    assert found(df) == brute(data, 400)


def test_long_texts_in_stretches(spark):
    g = np.random.default_rng(2)
    letters = lambda n: bytes(g.integers(97, 123, n, dtype=np.uint8)).decode()
    passage, edge = letters(3000), suffixes.BUFFER
    first = letters(edge - 1500) + passage + letters(1000)
    second = letters(700) + passage + letters(300)
    got = {r[0]: r for r in found(spark.createDataFrame([(1, first), (2, second), (3, first[:edge])], "doc_id long, text string"))}
    assert got[2][2:4] == (3000, 1) and got[3][2:4] == (edge, 1) and got[1][2:4] == (edge + 1500, 1)
