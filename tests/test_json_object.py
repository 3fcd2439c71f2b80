"""One JSON object read by ranges of bytes against the json module."""

from __future__ import annotations

import json

import numpy as np
import pytest

from termlake.sources import json_object as J

ODD = {
    "plain": "x", "with \"quotes\" and \\": 'a "b" \\', "brackets {[": "]}{[,", "": "", "comma, colon:": {"a": [1, {"b": "}"}], "c": None}, "list": [1, 2, ["x,y"]], "number": 1.5, "yes": True,
    "nothing": None, "größe 术语 \U0001f600": "ü" * 50, "slashes": "\\" * 41 + '"' + "\\" * 40, "tab\t": "line\nbreak", "last": {},
}


def value(v):
    return v if v is None or isinstance(v, str) else json.loads(json.dumps(v))


def got(spark, path, size):
    out = []
    for r in sorted(J.json_object(spark, str(path), size).collect()):
        out.append((r.key, r.value))
    return out


def same(found, want):
    assert [k for k, _ in found] == list(want)
    for (k, v), w in zip(found, want.values(), strict=True):
        assert v == w if w is None or isinstance(w, str) else json.loads(v) == w, k


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("indent", [None, 2])
def test_cuts_at_every_place(spark, tmp_path, ascii_only, indent):
    data = json.dumps(ODD, ensure_ascii=ascii_only, indent=indent).encode()
    path = tmp_path / "o.json"
    path.write_bytes(b"\xef\xbb\xbf \n" * ascii_only + data + b"\n ")
    for size in (7, 64, 1 << 20):
        same(got(spark, path, size), ODD)


@pytest.mark.parametrize("seed", range(40))
def test_quotes_and_depths_by_ranges(seed, tmp_path):
    g = np.random.default_rng(seed)
    text = json.dumps({str(k): "".join(g.choice(list('ab"\\{}[],'), int(g.integers(0, 12)))) for k in range(20)})
    path, size = tmp_path / "o.json", int(g.integers(1, 30))
    path.write_text(text)
    whole = J._quotes(np.frombuffer(text.encode(), np.uint8), False)
    cut = [J._quotes(*J._read(str(path), a, min(len(text), a + size))) for a in range(0, len(text), size)]
    assert (np.concatenate(cut) == whole).all()
    inside = np.cumsum(whole) % 2
    assert [bool(q) for q in whole] == [c == '"' and _unescaped(text, i) for i, c in enumerate(text)] and inside[-1] == 0


def _unescaped(text, i):
    n = 0
    while text[i - 1 - n] == "\\":
        n += 1
    return n % 2 == 0


def test_many_members(spark, tmp_path):
    want = {f"term {i}": {"zh": f"术语{i}", "n": i} if i % 3 else f'"{i}" \\' for i in range(20_000)}
    path = tmp_path / "many.json"
    path.write_text(json.dumps(want, ensure_ascii=False))
    df = J.json_object(spark, str(path), 100_000)
    assert df.count() == 20_000
    same([(r.key, r.value) for r in df.orderBy("at").collect()], want)


@pytest.mark.parametrize("text", ['{"a": 1', '{"a": "1}', '[1, 2]', '{"a": 1} {"b": 2}', '{"a": 1} x', "", "   ", '{"a": {"b": 1}'])
def test_what_is_no_object(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        J.json_object(spark, str(path), 5).collect()


def test_empty_object_and_repeated_keys(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(" { } ")
    assert got(spark, path, 3) == []
    path.write_text('{"a": 1, "a": 2,\n"b": 3}')
    assert got(spark, path, 4) == [("a", "1"), ("a", "2"), ("b", "3")]
