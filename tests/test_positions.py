"""Long lists of positions: the same as short ones, and planned at once."""

import random
import time

import numpy as np
import pytest
from test_stateful import rows_of, samples, streams_of

from undula.operators import rows, sequential
from undula.signal import Signal


def plain_trim(v, positions):
    keep = np.zeros(len(v), bool)
    for a, b in rows.intervals(positions):
        keep[a:b] = True
    return v[keep].tolist()


def plain_pad(v, before, after, inside):
    out, at = [0] * before, 0
    for count, place in sorted(inside, key=lambda p: p[1]):
        if place <= len(v):
            out += [*v[at:place], *[0] * count]
            at = place
    return [*out, *v[at:], *[0] * after]


@pytest.mark.parametrize("named", [0, 16])
def test_lists_of_positions(spark, monkeypatch, named):
    monkeypatch.setattr(rows, "NAMED", named)
    rng = random.Random(named)
    s = samples(2, 900)
    x = Signal(rows_of(spark, {"a": s, "b": s[:, :100]}), 8000.0, 2)
    for count in (1, 2, 7, 40, 301):
        positions = sorted(rng.sample(range(1, 1200), count))
        got = streams_of(rows.trim(x, positions).df)
        want = {k: [plain_trim(v, positions) for v in own] for k, own in (("a", s), ("b", s[:, :100]))}
        assert got == {k: v for k, v in want.items() if v[0]}
        inside = [(rng.randint(1, 9), p) for p in positions if p <= 100]  # a pad past the end leaves a hole
        got = streams_of(rows.pad(x, 3, 4, inside).df)
        assert got == {k: [plain_pad(v.tolist(), 3, 4, inside) for v in own] for k, own in (("a", s), ("b", s[:, :100]))}
    assert rows.trim(x, [5, 5]).df.count() == 0


def test_ten_thousand_positions_plan_at_once(spark):
    s = samples(1, 90_000)
    x = Signal(rows_of(spark, {"a": s[:, :3000]}), 8000.0, 1)
    positions = list(range(3, 90_003, 9))
    assert len(positions) == 10_000
    began = time.time()
    trimmed, padded = rows.trim(x, positions), rows.pad(x, 0, 0, [(1, p) for p in positions])
    for y in (trimmed, padded):
        y.df._jdf.queryExecution().executedPlan()
    assert time.time() - began < 10
    assert streams_of(trimmed.df)["a"][0] == plain_trim(s[0, :3000], positions)
    assert padded.df.where("n < 3000").count() == 3000
    with pytest.raises(ValueError):
        rows.piecewise(x, [(k, 0) for k in range(rows.MOST + 1)])


def test_splices_at_thousands_of_positions(spark):
    s = samples(1, 6000)
    x = Signal(rows_of(spark, {"a": s}), 8000.0, 1)
    y = streams_of(sequential.splice(x, [(p, 0, 0) for p in range(1, 6000, 2)]).df)
    assert y["a"] == s.tolist()
