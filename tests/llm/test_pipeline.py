from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from termlake.llm import language, mixing, packing, tokens
from termlake.llm.common import crc_mod

from ..conftest import SMALL
from .test_shingles import brute

STOP = set(
    "the of and to in a is that it for was on are as with be at by this from or an der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur de la que el en y a los del se las por un para con no una su al lo es".split()
)


def is_good(text):
    """The quality rules, word by word."""
    w = (text or "").encode().split()
    win = Counter(zip(w, w[1:], w[2:]))
    repeated = {p for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    return (
        len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 2 * len(w) <= chars <= 12 * len(w)
        and sum(c in "#*$%&|<>" for c in text) <= 0.1 * len(w) and len(lines) - len(set(lines)) <= 0.5 * len(lines)
        and sum(any(c.isalpha() for c in x.decode()) for x in w) >= 0.6 * len(w) and sum(x.decode().lower() in STOP for x in w) >= 2
    )


def copies(rows):
    """How often each row is repeated: Poisson counts at the rates of sources."""
    mass = Counter()
    for r in rows:
        mass[r.source] += len(r.text)
    weight = {s: m**mixing.ALPHA for s, m in mass.items()}
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(mass.values()) / mass[r.source]
        parts = max(1, math.ceil(rate / mixing.PART_MEAN))
        n = 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}|{part}".encode()).hexdigest()[:13], 16) / 2**52
            term = total = math.exp(-rate / parts)
            k = 0
            while u >= total and k < mixing.TERMS + 1:
                n, k = n + 1, k + 1
                term *= rate / parts / k
                total += term
        yield r, n


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train_on(docs.where(crc_mod("doc_id", 4) != 2))
    rows = docs.collect()
    names, scores = language.label_batch(model, pa.array([r.text for r in rows]))
    rows = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= language.MIN_SCORE and is_good(r.text)]
    first = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if first[r.doc_id] == r.doc_id]
    want, lengths, encode = [], [], Tokenizer.from_file(tokens.default_path())
    for r, n in copies(rows):
        ids = [*encode.encode(r.text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want += [(r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] * n
            lengths += [len(part)] * n
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and got
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):  # no gap, no overlap, no sequence too long
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= packing.SIZE and len(at) <= sum(lengths) / 2048 * 1.02 + 1


def test_near_duplicates_judge_rows_of_one_id_each_for_itself(spark):
    word = lambda k, n=60: [f"w{k}x{i}" for i in range(n)]
    text = lambda w: " ".join(w)
    near = lambda w: text([*w[:-1], "changed"])
    a, b, c, d = word(1), word(2), word(3), word(4)
    rows = [(3, text(a)), (5, near(a)), (5, text(b)), (6, text(c)), (6, near(c)), (6, ""), (7, None), (None, text(d)), (None, near(d)), (None, near(b)), (8, text(b))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()]
    want = [(3, text(a)), (5, text(b)), (6, text(c)), (6, ""), (7, None), (None, text(d))]
    assert sorted(got, key=str) == sorted(want, key=str)


#: Rows that a stage alone keeps of the edge rows (the other long ones repeat themselves).
LEFT = {"language ID": [1, 1, 2, 3, 7, 8, 9, 11, None], "quality rules": [9], "n-gram Jaccard join": [1, 4, 5, 6, 7, 9, 10, 11, None]}


def test_edges(spark, edges, nothing):
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            left = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
            assert left == ([] if docs is nothing else LEFT.get(name, left)), name
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
