"""Draws at any place are those of the generator run step by step; noises that need no past need no shuffle and no Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stateful import rows_of, samples, streams_of

from undula.functions import draws
from undula.operators import sequential, stateful, synth
from undula.signal import Signal


def test_states_at_any_place(spark):
    places = [0, 1, 2, 255, 256, 257, 65_535, 70_000, 2**32 - 1, 2**32, 2**39 + 12_345, 2**40 - 1] + [random.Random(1).randrange(2**40) for _ in range(20)]
    df = spark.createDataFrame([(k, s) for k in places for s in (1, 7920, -5)], "k bigint, seed int")
    got = draws.with_state(df, F.col("k"), F.col("seed")).collect()

    def state(k, seed):
        a, c, x, step = 1, 0, seed % 2**32, (draws.A, draws.C)
        while k:  # by squaring
            if k & 1:
                a, c = a * step[0] % 2**32, (c * step[0] + step[1]) % 2**32
            step = step[0] ** 2 % 2**32, (step[1] * step[0] + step[1]) % 2**32
            k >>= 1
        return (a * x + c) % 2**32

    assert all(r["_state"] == state(r["k"], r["seed"]) for r in got)
    first = draws.with_state(spark.range(1, 3000).withColumnRenamed("id", "k"), F.col("k"), 1).orderBy("k").select(draws.signed(F.col("_state")).alias("v"))
    assert [r["v"] for r in first.collect()] == stateful.lcg(1, 2999).tolist()


def plan_of(x):
    return x.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["whitenoise", "tpdfnoise"])
def test_noise_goes_round_the_channels(spark, kind):
    x = Signal(spark.createDataFrame([("a", c, n, 0) for n in range(500) for c in range(3)], "stream_id string, channel int, n bigint, s int"), 8000.0, 3)
    got = np.array(streams_of(synth.synth(x, kind, seed=5).df)["a"])
    d = stateful.lcg(5 + synth.APART, 3000 if kind == "tpdfnoise" else 1500) / 2**31
    y = (d if kind == "whitenoise" else (d[::2] + d[1::2]) / 2).reshape(500, 3).T * (2**31 - 1)
    assert (got == np.trunc(y + np.where(y < 0, -0.5, 0.5)).astype(np.int64)).all()


@pytest.mark.parametrize("slope", [False, True])
def test_flat_dither_is_the_block_operator(spark, slope):
    streams = {"a": samples(2, 700, 1), "b": samples(2, 300, 2)}
    x = Signal(rows_of(spark, streams), 8000.0, 2)
    want = {k: stateful.whole(stateful.Dither(8, [], [], slope, 3, None), s).tolist() for k, s in streams.items()}
    assert streams_of(sequential.dither(x, 8, slope=slope, seed=3).df) == want


def test_no_shuffle_and_no_python(spark, tmp_path):
    rows_of(spark, {"a": samples(1, 200)}).write.parquet(f"{tmp_path}/x")
    x = Signal(spark.read.parquet(f"{tmp_path}/x"), 8000.0, 1)
    for y in (synth.synth(x, "whitenoise"), synth.synth(x, "tpdfnoise"), sequential.dither(x, 8), sequential.dither(x, 8, slope=True)):
        plan = plan_of(y)
        assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("kind", ["pinknoise", "brownnoise", "pluck"])
def test_noises_with_a_past_in_blocks(kind):
    rng = np.random.default_rng(2)
    s = samples(2, 900)
    operator = synth.Noise(kind, "mix", 0.1, 99, 37)
    want = stateful.whole(operator, s)
    state = operator.start(2)
    parts = [operator.flow(state, p) for p in np.split(s, sorted(rng.integers(0, 900, 40)), axis=1)]
    if kind != "pluck":  # a string's first draws come before all others
        assert np.abs(want).max() > 0
    assert (np.concatenate(parts, axis=1) == want).all()
