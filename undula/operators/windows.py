"""Feed-forward operators: each output reads a bounded stretch of the input.

Short stretches are window expressions. Long kernels run over blocks that hold the samples they reach back to (a halo), so the
work of one channel spreads over blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import design
from ..functions.numeric import half_even, rounded
from ..signal import KEYS, Signal
from .rows import zeros

BY = ["stream_id", "channel"]
#: Kernels up to so many taps are expressions.
SHORT = 64
BLOCK = 1 << 14


def at(k: int):
    """The sample k places before (after, if negative), 0 outside."""
    w = Window.partitionBy(*BY).orderBy("n")
    return F.coalesce((F.lag("s", k) if k >= 0 else F.lead("s", -k)).over(w), F.lit(0))


def convolve_blocks(x: Signal, kernel: np.ndarray, delay: int, block: int = BLOCK):
    """(stream_id, channel, n, y): y[n] = sum_k kernel[k] x[n + delay - k], of the input's length; FFT over blocks with halo."""
    taps = len(kernel)
    back, ahead = taps - 1 - delay, delay
    n = F.col("n")
    first, last = F.floor((n - ahead) / block), F.floor((n + back) / block)
    dealt = x.df.select(*BY, "n", "s", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("block"))

    def convolved(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["block"].iat[0])
        lo = k * block - back
        v = np.zeros(block + taps - 1)
        v[pdf["n"].to_numpy() - lo] = pdf["s"].to_numpy(float)
        size = 1 << int(np.ceil(np.log2(len(v) + taps)))
        y = np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(kernel, size), size)[taps - 1 : taps - 1 + block]
        mine = np.sort(pdf["n"].to_numpy())
        mine = mine[(mine >= k * block) & (mine < (k + 1) * block)]
        return pd.DataFrame({"stream_id": pdf["stream_id"].iat[0], "channel": np.int32(pdf["channel"].iat[0]), "n": mine, "y": y[mine - k * block]})

    return dealt.groupBy(*BY, "block").applyInPandas(convolved, "stream_id string, channel int, n bigint, y double")


def fir(x: Signal, kernel, delay: int | None = None) -> Signal:
    """Convolution; the output is moved back by delay (half the kernel if not given) and has the input's length."""
    h = np.asarray(kernel, float)
    delay = len(h) // 2 if delay is None else delay
    if len(h) <= SHORT:
        y = sum((at(k - delay) * F.lit(float(c)) for k, c in enumerate(h)), F.lit(0.0))
        return x.with_df(x.df.withColumn("s", half_even(y)), precision=32)
    return x.with_df(convolve_blocks(x, h, delay).withColumn("s", half_even(F.col("y"))), precision=32)


def sinc(x: Signal, high: float | None = None, low: float | None = None, attenuation: float = 120, transition: float | None = None, taps: int | None = None, phase: float = 50, beta: float | None = None) -> Signal:
    h = design.sinc_kernel(x.rate, high, low, attenuation, transition, taps, beta)
    return fir(x, design.to_phase(h, phase), len(h) // 2 if phase == 50 else 0)


def hilbert(x: Signal, taps: int | None = None) -> Signal:
    return fir(x, design.hilbert_kernel(taps or int(x.rate / 76.5 + 2) | 1))


def loudness(x: Signal, gain: float = -10, reference: float = 65, taps: int = 1023) -> Signal:
    return x if gain == 0 else fir(x, design.loudness_kernel(x.rate, gain, reference, taps))


def firfit(x: Signal, knots: list[tuple[float, float]]) -> Signal:
    return fir(x, design.curve_kernel(knots, x.rate))


def with_tail(x: Signal, tail: int):
    """Rows of x and `tail` rows of silence after each channel."""
    ends = x.df.groupBy(*BY).agg((F.max("n") + 1).alias("_l"))
    return x.df.select(*KEYS, "s").unionByName(zeros(ends, F.col("_l"), F.lit(tail))) if tail else x.df


def _cut24(d):
    """Fraction cut off, clipped to 24 bits, back in 32."""
    c = F.greatest(F.lit(-8388608.0), F.least(F.lit(8388607.0), d))
    return (F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)) * 256).cast("int")


def _places(x: Signal, taps: list[tuple[float, float]]) -> list[tuple[int, float]]:
    return [(int(ms * x.rate / 1000), decay) for ms, decay in taps]


def echo(x: Signal, gain_in: float, gain_out: float, taps: list[tuple[float, float]]) -> Signal:
    """Plus delayed copies (ms, decay), in 24 bits; grows by the longest delay."""
    places = _places(x, taps)
    y = F.col("s") / 256.0 * gain_in
    for d, decay in places:
        y = y + at(d) / 256.0 * decay
    return x.with_df(with_tail(x, max(d for d, _ in places)).withColumn("s", _cut24(y * gain_out)), precision=32)


def echos(x: Signal, gain_in: float, gain_out: float, taps: list[tuple[float, float]]) -> Signal:
    """As echo, but the j-th line is fed j times the input; grows by the sum of delays."""
    places = _places(x, taps)
    y = F.col("s") / 256.0 * gain_in
    for j, (d, decay) in enumerate(places):
        y = y + at(d) / 256.0 * ((j + 1) * decay)
    return x.with_df(with_tail(x, sum(d for d, _ in places)).withColumn("s", _cut24(y * gain_out)), precision=32)


def chorus(x: Signal, gain_in: float, gain_out: float, voices: list[tuple[float, float, float, float, str]]) -> Signal:
    """Plus copies (delay ms, decay, speed Hz, depth ms, shape s or t) whose delay swings by a wave; grows by the longest.

    A copy's delay depends on the place alone, so each voice is an equi-join of the signal with itself.
    """
    longest = max(int((d + depth) * x.rate / 1000) for d, _, _, depth, _ in voices)
    out = with_tail(x, longest).withColumn("y", F.col("s") / 256.0 * gain_in)
    source = x.df.select(*BY, F.col("n").alias("_m"), (F.col("s") / 256.0).alias("_v"))
    for delay, decay, speed, depth, shape in voices:
        top, swing, period = int((delay + depth) * x.rate / 1000), int(depth * x.rate / 1000), max(1, int(x.rate / speed))
        phase = F.col("n") % period / float(period)
        wave = (F.sin(phase * 2 * math.pi) + 1) / 2 if shape == "s" else F.when(phase < 0.5, phase * 2).otherwise(2 - phase * 2)
        out = out.withColumn("_m", F.col("n") - F.floor(top - 2 * swing + wave * 2 * swing + 0.5).cast("bigint")).join(source, [*BY, "_m"], "left").withColumn("y", F.col("y") + F.coalesce("_v", F.lit(0.0)) * decay).drop("_m", "_v")
    return x.with_df(out.withColumn("s", _cut24(F.col("y") * gain_out)), precision=32)


#: Taps of the headphone filter over interleaved left and right samples: fixed values.
HEADPHONE = [4, -6, 4, -11, -1, -5, 3, 3, -2, -5, -5, -1, 9, 1, 6, 3, -4, -5, -5, -3, -2, -5, -7, 1, 6, -7, 30, -29, 12, -3, -11, 4, -3, 7, -20, 23, 2, 0, 1, -6, -14, -5, 15, -18, 6, 7, 15, -10, -14, 22, -7, -2, -4, 9, 6, -12, 6, -6, 0, -11, 0, -5, 4, 0]


def earwax(x: Signal) -> Signal:
    """A fixed filter across left and right for headphones, for stereo at 44.1 kHz; each tap counts in 64ths."""
    if x.channels != 2 or x.rate != 44100:
        raise ValueError("earwax needs stereo at 44100 Hz")
    w = Window.partitionBy("stream_id").orderBy("n", "channel")
    y = sum((F.coalesce(F.lag("s", k).over(w), F.lit(0)) / 64.0 * c for k, c in enumerate(HEADPHONE)), F.lit(0.0))
    return x.with_df(x.df.withColumn("s", rounded(y)), precision=32)


def stretch(x: Signal, factor: float, window_ms: float = 20, shift: float | None = None, fading: float | None = None) -> Signal:
    """Longer (or shorter) at the same pitch: windows of the input, faded at both ends, are added at a spacing `factor` times."""
    size = int(x.rate * window_ms / 1000 + 0.5)
    shift = shift if shift is not None else 1.0 if factor <= 1 else 0.8
    step_in, step_out = (shift * size, factor * shift * size) if factor < 1 else (shift * size / factor, shift * size)
    step_in, step_out = max(1, int(step_in + 0.5)), max(1, int(step_out + 0.5))
    fade = max(1, min(size // 2, int(size * (fading if fading is not None else (1 - factor * shift if factor < 1 else 1 - shift)))))
    n = F.col("n")
    frames = x.df.withColumn("f", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((n - size) / step_in) + 1), F.floor(n / step_in))))
    k = n - F.col("f") * step_in
    weight = F.least(F.lit(1.0), F.least(k + 0.5, size - k - 0.5) / float(fade))
    out = frames.select(*BY, (F.col("f") * step_out + k).alias("n"), (F.col("s") * weight).alias("y")).groupBy(*BY, "n").agg(rounded(F.sum("y")).alias("s"))
    return x.with_df(out, precision=32)
