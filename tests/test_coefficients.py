"""Coefficients of filters against those that their SQL works out, to the last bit: one bit is a rounded sample in millions."""

import duckdb
import pytest

from undula import queries
from undula.operators import scan
from undula.plans import chain
from undula.signal import Signal


@pytest.mark.parametrize("name", ["band"])
def test_coefficients(monkeypatch, name):
    text, rate, sql = queries._FILTERS[name]
    found = []
    monkeypatch.setattr(scan, "recursive", lambda x, b, a: found.append([float(v) / float(a[0]) for v in [*b, *a[1:]]]) or x)
    chain.run(Signal(None, rate, 1, 16), text)
    tables = sql[sql.index(" FROM r), ") + len(" FROM r), ") : sql.index(", u AS (SELECT")]
    assert found == [list(map(float, duckdb.connect().execute(f"WITH {tables} SELECT b0, b1, b2, a1, a2 FROM k").fetchone()))]
