"""Every registered query against its oracle, or for those without one that it gives rows of a stable schema."""

from __future__ import annotations

import pytest

from termlake.plans import catalog

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = rows_of(catalog.QUERIES[name](spark, SMALL).toPandas())
    want = rows_of(duck.execute(catalog.ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    differ = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    close = [1 for a, b in differ if all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True))]
    assert len(differ) == len(close), differ[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert df.schema == catalog.QUERIES[name](spark, SMALL).schema
