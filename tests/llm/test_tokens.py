from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termlake.llm import packing, token_files, tokens

from ..conftest import SMALL

ENCODER = tokens.ChunkEncoder(tokens.default_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aé ßÄx'sS\n\t.<|>1½中Σİ́ \x85-")) | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_ids_equal_whole_tokenizer(texts):
    flat, at = ENCODER.encode(pa.array([*texts, "<|endoftext|>a", None], pa.string()))
    for i, x in enumerate([*texts, "<|endoftext|>a", ""]):
        assert flat[at[i] : at[i + 1]].tolist() == ENCODER.tokenizer.encode(x, add_special_tokens=False).ids


def brute(rows, end):
    return [(r.doc_id, ENCODER.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_block_round_trip():
    for n in (0, 1, 5, 70_000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (token_files.unpack_block(token_files.pack_block(ids), n) == ids).all()


def test_files_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = token_files.read(token_files.write(docs, f"file://{tmp_path}/t")).collect()
    start, want = 0, []
    for doc, ids in sorted(brute(docs.collect(), 2)):
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got)) == want


def test_random_access(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"number {i} of many") for i in range(50)], "doc_id long, text string").coalesce(1)
    path = token_files.write(docs, f"file://{tmp_path}/t").first().path
    shard = token_files.ShardReader(path)
    d = shard.docs[-1]
    ids = ENCODER.tokenizer.encode(f"number {d['id']} of many", add_special_tokens=False).ids
    assert shard.ids(int(d["start"]), int(d["n"])).tolist() == [*ids, 2]


def test_file_edges(edges, nothing, tmp_path):
    got = token_files.read(token_files.write(edges, f"file://{tmp_path}/e")).collect()
    assert len(got) == edges.count() and {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert sorted(r.start for r in got)[0] == 0 and token_files.read(token_files.write(nothing, f"file://{tmp_path}/n")).count() == 0


def test_one_id_on_many_rows_is_dealt_over_tasks(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text {i} of one id") for i in range(300)]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/h")
    assert manifest.where("n_docs > 0").count() > 1
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(manifest).collect())
    assert [r[1] for r in got] == sorted(r[0] for r in rows) and [r[0] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    want = [(doc, len(ids), crc(ids)) for doc, ids in ((d, [*ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in rows)]
    assert sorted(r[1:] for r in got) == sorted(want)


def test_cache_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    own = tokens.ChunkEncoder(tokens.default_path())
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = [" ".join(f"w{x}ord" for x in rng.zipf(1.3, 30) % 500) for _ in range(3)]
        flat, at = own.encode(pa.array(texts))
        for i, x in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == ENCODER.tokenizer.encode(x, add_special_tokens=False).ids


def check_packed(rows, docs, size):
    seq, by = {}, {}
    for r in rows:
        by.setdefault((r.doc_id, r.piece, r.start), []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = {}
    for doc, ids in docs:
        for k in range(0, len(ids), size):
            want.setdefault((doc, k // size, k), []).append((len(ids[k : k + size]), crc(ids[k : k + size])))
    assert {k: sorted((r.length, r.ids_crc32) for r in v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    return len(seq)


def test_packing_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    all_ids = brute(docs.collect(), 0)
    n = check_packed(packing.pack(docs).collect(), all_ids, 2048)
    assert n <= 1.02 * (sum(len(i) for _, i in all_ids) / 2048) + 1


def test_fitted_patterns_place_most(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lengths = [n for _, ids in brute(docs.collect(), 0) for n in [2048] * (len(ids) // 2048) + [len(ids) % 2048] if n]
    left = np.bincount(lengths, minlength=2049)
    left[2048] = 0
    fitted = sum(copies for _, copies in packing.place_fitted(left, 2048))
    assert fitted > 4 * sum(copies for _, copies in packing.best_fit(left, 2048))


def test_packing_edges(edges, nothing, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 2)  # lengths dealt over salts
    check_packed(packing.pack(edges, size=64).collect(), brute(edges.collect(), 0), 64)
    assert packing.pack(nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_plan_holds_every_piece(lengths):
    histogram = np.bincount(np.array(lengths, int), minlength=33)
    kinds = packing.plan(histogram, 32)
    held = np.zeros(33, int)
    for key, copies in kinds:
        assert sum(key) <= 32
        for v in key:
            held[v] += copies
    assert (held == histogram).all()
