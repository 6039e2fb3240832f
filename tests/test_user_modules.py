"""A caller's operators and kernels from modules that executors don't have."""

import importlib
import sys

import numpy as np
import pytest

from undula.operators import stateful
from undula.plans import chain
from undula.signal import Signal

SOURCE = """
import numpy as np
FACTOR = 2


def twice(s):
    return s * FACTOR


def kernel(v):
    return np.clip(twice(v), -1, 1 - 2**-31)


class Operator:
    def start(self, channels):
        return {}

    def flow(self, state, s):
        return twice(s)

    def drain(self, state):
        return None
"""


@pytest.fixture
def module(tmp_path, monkeypatch):
    (tmp_path / "callers_own_module.py").write_text(SOURCE)
    monkeypatch.syspath_prepend(str(tmp_path))
    yield importlib.import_module("callers_own_module")
    del sys.modules["callers_own_module"]


@pytest.mark.parametrize("kind", ["operator", "kernel"])
def test_module_that_executors_lack(spark, module, kind):
    x = Signal(spark.createDataFrame([("a", 0, k, k * 1000) for k in range(50)], "stream_id string, channel int, n bigint, s int"), 100.0, 1)
    chain.USER["own"] = module.Operator() if kind == "operator" else module.kernel
    try:
        got = sorted((r["n"], r["s"]) for r in x.chain("own").df.collect())
    finally:
        del chain.USER["own"]
    assert got == [(k, k * 2000) for k in range(50)]


def test_what_executors_have_stays_as_it_is():
    dither = stateful.Dither(8, [], [], False, 1, None)
    assert stateful.shipped(dither) is dither and stateful.shipped(np.tanh) is np.tanh
