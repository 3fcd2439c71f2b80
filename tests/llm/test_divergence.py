from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from termlake.llm import divergence

from ..conftest import SMALL, rows_of


def brute(rows, least, top):
    """Rows of the audit with all terms of all pairs compared."""
    docs = [(x or "", s or "", re.findall(divergence.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for x, s, t in rows]
    have, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        have[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in have[lang].items() if n >= least]
        share = lambda n, total, v=len(kept): 1 + 10**9 * (n + 5) // (total + 5 * v)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            parts = {"pair": [(u, sum(abs(p[s][t] - p[u][t]) for t in kept)) for u in sources if u != s], "term": [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def got(df, least=30, top=50):
    return sorted(map(tuple, divergence.audit(df, least, top).collect()))


def test_oracle(spark, duck):
    assert rows_of(divergence.query(spark, SMALL).toPandas()) == rows_of(duck.execute(divergence.ORACLE).df())


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows, 30, 50) and got(docs, 3, 4) == brute(rows, 3, 4)


def test_groups_without_terms_ties_and_odd_texts(spark, edges, nothing, monkeypatch):
    g = np.random.default_rng(4)
    words = ["Ärger", "ärger", "ÄRGER", "the", "THE", "a1b", "x", "\U0001f600", "中文", "zebra", "É", "it's"]
    rows = [(str(g.choice(["en", "de"])), str(g.choice(["hot", "hot", "b", "c"])), " ".join(g.choice(words, int(g.integers(0, 9))))) for _ in range(300)]
    rows += [("en", "bare", None), ("en", None, "..."), (None, None, "the"), ("fr", "a", "seul"), ("fr", "b", "seul"), ("en", "long", "the zebra " * 50_000)] + [("de", "same", "x x"), ("de", "twin", "x x")] * 2
    df = spark.createDataFrame([(*r, 1, "y", "z") for r in rows], "lang string, source string, text string, value int, term string, item string").repartition(3)
    assert got(df, 5, 3) == brute(rows, 5, 3)
    assert got(df) == brute(rows, 30, 50)
    assert got(edges) == brute([(r.lang, r.source, r.text) for r in edges.collect()], 30, 50)
    assert got(nothing) == []


def test_counts_beyond_64_bits_times_scale(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, terms long")
    assert df.select(divergence._share("n", "total")).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)
