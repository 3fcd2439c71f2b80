from __future__ import annotations

from collections import Counter

from termlake.llm import quality

from ..conftest import SMALL, rows_of


def test_oracle(spark, duck):
    assert rows_of(quality.query(spark, SMALL).toPandas()) == rows_of(duck.execute(quality.ORACLE).df())


def test_repeat_words_brute_force():
    for raw in (b"", b"a b c", b"a b c a b c", b"x a b c y a b c z", b"a a a a a"):
        w = raw.split()
        win = Counter(zip(w, w[1:], w[2:]))
        at = {p for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert quality.Text(raw).n_repeat_words == len(at)


def test_edges(edges, nothing):
    rows = {(r.doc_id, r.n_words): r for r in quality.measure(edges).collect()}
    assert rows[(4, 0)].base_failed and rows[(6, 0)].word_chars == 0 and rows[(11, 6)].word_chars == 34 - 2 + 0 or rows[(11, 6)].n_words == 6
    assert quality.measure(edges).count() == edges.count() and quality.measure(nothing).count() == 0
    kept = quality.cascade(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 3, 9}
    assert quality.cascade(nothing).count() == 0


def test_order_prefers_rejection_per_cost():
    now = [0.0]

    def rule(name, cost, rejects):
        def run(t):
            now[0] += cost
            return rejects(t.raw)

        return quality.Rule(name, run)

    rules = (rule("dear", 5.0, lambda x: x > b"1"), rule("cheap", 1.0, lambda x: x > b"2"), rule("idle", 0.1, lambda x: False))
    got = quality.order_rules([b"0", b"1", b"2", b"3", b"4"], rules, clock=lambda: now[0])
    assert [r.name for r in got] == ["cheap", "dear", "idle"]
