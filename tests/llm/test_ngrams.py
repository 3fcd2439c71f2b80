from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termlake.llm import ngrams

from ..conftest import SMALL


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**45) | st.integers(0, 300), max_size=200), st.lists(st.integers(0, 2**46) | st.integers(0, 400), max_size=60))
def test_elias_fano(values, asked):
    x = np.array(sorted(values), np.uint64)
    ef = ngrams.EliasFano.build(x)
    place = {v: i for i, v in enumerate(x.tolist())}
    q = asked + x.tolist()
    assert ef.find(np.array(q, np.uint64)).tolist() == [place.get(v, -1) for v in q]
    assert ef.get(np.arange(len(x))).tolist() == x.tolist()


def tokens_of(text):
    return [*(text or "").encode().lower().split(), "<end>"]


def level(p, steps):
    return 2 ** (-math.ceil(-math.log2(p) * steps - 1e-9) / steps)


def brute(train, asked):
    """(known, base, score) of token lists by the model's formulas on plain counters, with probabilities on the trie's levels."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in train:
        c1.update(w)
        c2.update(zip(w, w[1:]))
        c3.update(zip(w, w[1:], w[2:]))
    n, v, k = sum(c1.values()), len(c1), ngrams.BACKOFF
    kinds1, kinds2 = Counter(x for x, _ in c2), Counter((x, y) for x, y, _ in c3)
    p2 = {(x, y): level(m / c1[x], ngrams.STEPS) for (x, y), m in c2.items()}
    p3 = {(x, y, z): level(m / (c2[x, y] + k * kinds2[x, y]), ngrams.STEPS) for (x, y, z), m in c3.items()}
    mass2, mass3 = Counter(), Counter()
    for (x, _), p in p2.items():
        mass2[x] += p
    for (x, y, _), p in p3.items():
        mass3[x, y] += p
    for w in asked:
        base = score = 0.0
        for i, x in enumerate(w):
            p = one = (c1[x] + 1) / (n + v + 1)
            if i and c1[w[i - 1]]:
                h = w[i - 1]
                own = c1[h] / (c1[h] + k * kinds1[h])
                p = own * p2.get((h, x), 0) + (1 - own * mass2[h]) * one
                if i > 1 and mass3[w[i - 2], h]:
                    p = p3.get((w[i - 2], h, x), 0) + (1 - mass3[w[i - 2], h]) * p
            base, score = base + math.log10(one), score + math.log10(p)
        yield sum(c1[x] > 0 for x in w), base, score, n


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 20_000)  # several shards
    monkeypatch.setattr(ngrams, "VOCABULARY_TOKENS", 30_000)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want = dict(zip([d for d, _ in docs], brute([tokens_of(x) for d, x in docs if not held(d)], [tokens_of(x) for _, x in docs]), strict=True))
    got = ngrams.query(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        known, base, score, n = want[r.doc_id]
        assert (r.n_known, r.train_tokens, r.held_out) == (known, n, held(r.doc_id)) and abs(r.base_score - base) < 1e-6
        assert abs(r.score - score) < 0.0003 * r.n_tokens  # weights have 16 bits
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges(edges, nothing, tmp_path):
    trie = ngrams.train(edges, f"file://{tmp_path}/a")
    rows = ngrams.score(edges, trie).collect()
    assert len(rows) == edges.count() and {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    empty = ngrams.train(nothing, f"file://{tmp_path}/b")
    assert empty.tokens == 0 and all(r.base_score == r.score == 0 and r.n_known == 0 for r in ngrams.score(edges, empty).collect())
    assert ngrams.score(nothing, trie).count() == 0


def test_all_trigrams_are_stored(spark, tmp_path):
    texts = ["the red fox ran over the green hill", "a red cat sat under the old tree"]
    trie = ngrams.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/t")
    seen = {tuple(w[k : k + 3]) for w in map(tokens_of, texts) for k in range(len(w) - 2)}
    assert sum(len(ngrams.Shard(ngrams.mapped(f"{trie.folder}/grams-{s:04d}")).p3) for s in range(trie.shards)) == len(seen)


def test_probabilities_after_a_context_sum_to_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 50_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scorer = ngrams.Scorer(ngrams.train(docs, f"file://{tmp_path}/t"))
    texts = [r.text for r in docs.collect()]
    assert max(scorer.probabilities(pa.array([x]))[3].max() for x in texts) <= 1
    words = sorted({w for x in texts for w in tokens_of(x)[:-1]})
    seen = [tokens_of(x)[k : k + 2] for k, x in enumerate(texts[:6]) if len(tokens_of(x)) > k + 4]
    for u, v in [*seen, [b"not", b"there"], [words[5], b"unseen"], [words[7], words[11]]]:
        rows = [b" ".join((u, v, w)).decode("utf-8", "surrogatepass") for w in [*words, b"unknown-word"]]
        offsets, _, _, p = scorer.probabilities(pa.array([*rows, b" ".join((u, v)).decode()]))
        after = np.append(p[offsets[:-2] + 2], p[offsets[-2] + 2])  # of all words, an unknown one, and the end
        assert 0.999 < after.sum() <= 1 + 1e-6


def test_relative_successors_take_less_space(spark, tmp_path):
    trie = ngrams.train(spark.read.parquet(f"{SMALL}/documents.parquet"), f"file://{tmp_path}/t")
    for s in trie.written:
        one = ngrams.Shard(ngrams.mapped(f"{trie.folder}/grams-{s:04d}"))
        pointers = one.ptr.get(np.arange(one.ptr.n)).astype(np.int64)
        value = one.three.get(np.arange(one.three.n))
        context = np.repeat(np.arange(one.two.n), np.diff(pointers))
        ends = np.concatenate((np.zeros(1, np.uint64), value + np.uint64(1)))
        base = ends[pointers[:-1]][context]
        absolute = ngrams.EliasFano.build(context.astype(np.uint64) * np.uint64(trie.words) + value - base.astype(np.uint64))
        assert sum(a.nbytes for a in one.three.arrays()) < sum(a.nbytes for a in absolute.arrays())


def test_a_lost_shard_is_an_error(spark, edges, tmp_path):
    trie = ngrams.train(edges, f"file://{tmp_path}/l")
    for s in trie.written:
        (tmp_path / "l" / f"grams-{s:04d}").unlink()
    with pytest.raises(FileNotFoundError):
        ngrams.Scorer(trie).score(pa.array(["the quick brown fox"]))
