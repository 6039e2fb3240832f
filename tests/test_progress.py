"""A chain under watch: counts by operator, tasks, and cancelling it without touching other jobs."""

import time

import pytest
from test_stateful import rows_of, samples

from undula.plans import chain, progress
from undula.signal import Signal


def test_counts_by_operator(spark):
    s = samples(2, 500)
    s[0, 7] = 2**31 - 1
    x = Signal(rows_of(spark, {"a": s, "b": s[:, :300]}), 8000.0, 2)
    run = progress.Run(x, "trim 100s 200s remix 1 pad 10s 5s reverse").start(lambda y: y.df.count())
    assert run.wait(120) == 2 * 215
    counts = run.counts()
    assert [n for n, _ in counts] == ["input", "trim", "remix", "pad", "reverse"]
    rows = {n: c["rows"] for n, c in counts}
    assert rows["trim"] == 800 and rows["remix"] == 400 and rows["pad"] == rows["reverse"] == 430 and rows["input"] >= 1600
    assert dict(counts)["reverse"]["longest"] == 215
    done, known = run.tasks()
    assert 0 < done <= known


class Slow:
    """A sample a tenth of a second."""

    def start(self, channels):
        return {}

    def flow(self, state, s):
        time.sleep(0.1 * s.shape[1])
        return s

    def drain(self, state):
        return None


def test_cancelled_chain(spark):
    chain.USER["slow"] = Slow()
    try:
        x = Signal(rows_of(spark, {"a": samples(1, 2000)}), 8000.0, 1)
        run = progress.Run(x, "vol 0.5 slow").start(lambda y: y.df.count())
        until = time.time() + 60
        while not run.tasks()[1] and time.time() < until:
            time.sleep(0.1)
        with pytest.raises(TimeoutError):
            run.wait(0.5)
        run.cancel()
        with pytest.raises(progress.Cancelled):
            run.wait(60)
        assert spark.range(10).count() == 10
        with pytest.raises(RuntimeError):
            run.start(lambda y: None)
    finally:
        del chain.USER["slow"]


def test_errors_are_the_actions_own(spark):
    x = Signal(rows_of(spark, {"a": samples(1, 100)}), 8000.0, 1)

    def broken(y):
        raise KeyError("own")

    with pytest.raises(KeyError):
        progress.Run(x, "vol 0.5").start(broken).wait(60)
