from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termlake.llm import common


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3000), max_size=12), max_size=6), st.integers(1, 10), st.integers(1, 4000))
def test_batches_are_cut_and_joined(sizes, rows, size):
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * n for n in b], pa.string())], names=["t"]) for b in sizes]
    got = list(common.sliced(iter(batches), rows, size))
    assert [x for b in got for x in b.column(0).to_pylist()] == ["x" * n for b in sizes for n in b]
    assert all(0 < b.num_rows <= rows and (b.num_rows == 1 or b.nbytes <= size) for b in got)


def test_workers_forget_between_jobs():
    kept = {"a": 1}
    common.CACHES.append(kept)
    try:
        common.begin("one")
        kept["b"] = 2
        common.end()
        common.begin("one")
        assert "b" in kept
        common.begin("two")
        assert not kept
    finally:
        common.CACHES.remove(kept)
