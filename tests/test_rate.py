"""The resampler's stages and phases: responses, places of echoes, plans of long ratios, blocks against one pass."""

from fractions import Fraction

import numpy as np
import pytest
from test_stateful import rows_of, samples, streams_of

from undula.operators import resample
from undula.signal import Signal


def full(plan, v, total):
    """All outputs of a signal with silence around."""
    m = np.arange(total)
    lo, hi = plan.input(0, total - 1)
    out = np.zeros(hi - lo + 1)
    at = np.arange(len(v)) - lo
    ok = (at >= 0) & (at < len(out))
    out[at[ok]] = v[ok]
    return plan.outputs(out, m)


def level(y):
    y = y[len(y) // 4 : -len(y) // 4]
    return 10 * np.log10(2 * np.mean(y**2) + 1e-30)


@pytest.mark.parametrize("step", [Fraction(12), Fraction(160, 147), Fraction(1, 6), Fraction(75, 2)])
@pytest.mark.parametrize("phase", [50, 0, 25])
def test_pass_and_stop_bands(step, phase):
    plan, n = resample.stages(step, 0.9, 126.0, phase), int(8000 * max(1, step))
    low = min(1.0, float(1 / step))
    total = int(n / step)
    t = np.arange(n)
    for share, bounds in ((0.05, (-0.02, 0.02)), (0.5, (-0.02, 0.02)), (0.88, (-0.2, 0.02))):
        assert bounds[0] < level(full(plan, np.sin(np.pi * low * share * t), total)) < bounds[1]
    if low < 0.5:
        for f in (1.03 * low, 0.7, 0.51):
            if 1.02 * low < f < 1:
                assert level(full(plan, np.sin(np.pi * f * t), total)) < -115


def test_long_ratios_have_no_longer_kernels():
    plans = {k: resample.stages(Fraction(k), 0.95, 126.0) for k in (2, 4, 32, 256, 4096)}
    assert [len(p.halvings) for p in plans.values()] == [0, 1, 4, 7, 11]
    taps = {k: sum(h.taps.shape[1] for h in p.halvings) + p.final.taps.shape[1] for k, p in plans.items()}
    # work for an input: each halving sees half the inputs of the one before
    work = {k: sum(h.taps.shape[1] / 2 ** (i + 1) for i, h in enumerate(p.halvings)) + p.final.taps.shape[1] / k for k, p in plans.items()}
    assert taps[4096] < 2 * taps[2] and work[4096] < work[32] < work[2]
    assert plans[4096].halvings[0].taps.shape[1] < 40


def test_minimum_phase_has_no_echo_before(spark):
    v = np.zeros(4000)
    v[2000] = 1.0
    before, after = {}, {}
    for phase in (0, 25, 50, 100):
        y = full(resample.stages(Fraction(2, 3), 0.95, 126.0, phase), v, 6000)
        peak = int(np.argmax(np.abs(y)))
        assert abs(peak - 3000) <= 3
        before[phase], after[phase] = np.sum(y[: peak - 6] ** 2), np.sum(y[peak + 7 :] ** 2)
    assert before[0] < 1e-3 * before[50] and before[0] < before[25] < before[50] and np.isclose(before[50], after[50], rtol=0.05)
    assert after[100] < 1e-3 * before[100]


def test_aliasing_shortens_echoes():
    plain, short = resample.stages(Fraction(2), 0.9, 126.0), resample.stages(Fraction(2), 0.9, 126.0, aliasing=True)
    assert short.final.taps.shape[1] < 0.55 * plain.final.taps.shape[1]
    t = np.arange(40_000)
    for share in (0.3, 0.89):
        assert abs(level(full(short, np.sin(np.pi * 0.5 * share * t), 20_000))) < 0.2
    assert level(full(short, np.sin(np.pi * 0.5 * 1.12 * t), 20_000)) < -115  # its alias would be in the pass band
    assert level(full(short, np.sin(np.pi * 0.5 * 1.05 * t), 20_000)) > -60  # its alias is above


@pytest.mark.parametrize(("to", "options"), [(500.0, {}), (500.0, {"phase": 0.0}), (12_000.0, {"phase": 25.0}), (8001.5, {}), (8001.5, {"phase": 0.0}), (250.0, {"aliasing": True})])
def test_blocks_are_one_pass(spark, monkeypatch, to, options):
    monkeypatch.setattr(resample, "BLOCK", 64)
    monkeypatch.setattr(resample, "PHASES", 512)
    streams = {"a": samples(2, 3000, 1), "b": samples(2, 100, 2)}
    x = Signal(rows_of(spark, streams), 8000.0, 2)
    got = streams_of(resample.rate(x, to, "m", **options).df)
    step = resample._ratio(x, to)
    plan = resample.stages(step, 0.95, 102.0, **options)
    for k, s in streams.items():
        for c in range(2):
            want = full(plan, s[c].astype(float), int(s.shape[1] / step + 0.5))
            want = np.rint(np.clip(want, -(2**31), 2**31 - 1))
            assert np.abs(np.array(got[k][c]) - want).max() <= 1


def test_places_between_tabled_ones():
    v = np.sin(np.arange(3000) * 0.2)
    near = full(resample.stages(Fraction(10_007, 9_973), 0.95, 126.0, 0), v, 2900)
    exact = full(resample.stages(Fraction(10_007, 9_973), 0.95, 126.0, 50), v, 2900)
    lag = np.argmax([np.dot(near[500:2000], exact[500 + d : 2000 + d]) for d in range(-20, 21)]) - 20
    assert abs(lag) <= 6 and abs(level(near) - level(exact)) < 1e-2
