"""Change of sample rate.

An output reads a bounded stretch of the input around its place, so outputs are computed by blocks that hold the inputs they
reach to. Quality q is a four-point cubic, as column expressions; the others are a windowed sinc evaluated at each place, after as
many halvings of the rate as the ratio holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import design
from ..functions.numeric import half_even
from ..signal import Signal
from .scan import _whole

BY = ["stream_id", "channel"]
#: Bandwidth share and stop-band attenuation in dB by quality: fixed values.
QUALITY = {"l": (0.80, 102.0), "m": (0.95, 102.0), "h": (0.95, 126.0), "v": (0.95, 175.0)}
BLOCK = 1 << 13
#: Places between inputs for which kernels are tabled, at most; a ratio with more has its kernels worked out by output.
PHASES = 4096
#: Places between inputs at which a kernel gets its phase response; further ones follow from them.
COARSE = 8


def rate(x: Signal, to: float, quality: str = "h", bandwidth: float | None = None, phase: float = 50, aliasing: bool = False) -> Signal:
    """To another rate; bandwidth: the share of the band to pass in place of the quality's own. phase and aliasing: see bandlimited."""
    if to == x.rate:
        return x
    if quality == "q":
        return cubic(x, to)
    share, attenuation = QUALITY[quality]
    return bandlimited(x, to, bandwidth or share, attenuation, phase, aliasing)


def _ratio(x: Signal, to: float) -> Fraction:
    return Fraction(x.rate).limit_denominator(1 << 20) / Fraction(to).limit_denominator(1 << 20)


def cubic(x: Signal, to: float) -> Signal:
    """Each input place has the outputs that fall in [n, n + 1): they are made from it and its three neighbours."""
    step = _ratio(x, to)
    p, q = step.numerator, step.denominator  # output m is at input m * p / q
    w = Window.partitionBy(*BY).orderBy("n")
    n = F.col("n")
    first, last = F.ceil(n * q / float(p)).cast("bigint"), F.ceil((n + 1) * q / float(p)).cast("bigint") - 1
    s0, s1 = F.col("s").cast("double"), F.coalesce(F.lead("s", 1).over(w), F.lit(0)).cast("double")
    sm, s2 = F.coalesce(F.lag("s", 1).over(w), F.lit(0)).cast("double"), F.coalesce(F.lead("s", 2).over(w), F.lit(0)).cast("double")
    rows = x.df.select(*BY, "n", s0.alias("s0"), s1.alias("s1"), sm.alias("sm"), s2.alias("s2"), first.alias("lo"), last.alias("hi")).where("hi >= lo").withColumn("m", F.explode(F.sequence("lo", "hi")))
    t = (F.col("m") * p - F.col("n") * q) / F.lit(float(q))
    b = F.col("sm") * 0.5 + F.col("s1") * 0.5 - F.col("s0")
    a = (F.col("s2") - F.col("s1") + F.col("sm") - F.col("s0") - b * 4) / 6
    c = F.col("s1") - F.col("s0") - a - b
    return x.with_df(rows.select(*BY, F.col("m").alias("n"), half_even(((a * t + b) * t + c) * t + F.col("s0")).alias("s")), rate=to, precision=32)


@dataclass(frozen=True)
class Kernel:
    """Taps over places first, first + 1, ... of an input, by phase: the place between inputs, in steps of 1 / (rows of taps)."""

    first: int
    taps: np.ndarray

    @property
    def last(self) -> int:
        return self.first + self.taps.shape[1] - 1


def windowed_sinc(d: np.ndarray, cutoff: float, reach: int, beta: float) -> np.ndarray:
    """Kaiser-windowed sinc at distances from its middle; cutoff is a share of the Nyquist frequency."""
    return cutoff * np.sinc(cutoff * d) * np.i0(beta * np.sqrt(np.clip(1 - (d / (reach + 1)) ** 2, 0, 1))) / np.i0(beta)


def kaiser_reach(attenuation: float, width: float) -> int:
    """Taps to either side of the middle for a transition width that is a share of the Nyquist frequency."""
    return math.ceil((attenuation - 7.95) / (2.285 * math.pi * width) / 2)


def polyphase(cutoff: float, reach: int, attenuation: float, phases: int, phase: float) -> Kernel:
    """The kernel of a phase response at all of so many places between inputs: a prototype at a rate higher by them, dealt out."""
    coarse = min(phases, COARSE)
    d = np.arange(-(reach + 1) * coarse + 1, (reach + 1) * coarse) / coarse
    g, peak = design.to_phase_whole(windowed_sinc(d, cutoff, reach, design.kaiser_beta(attenuation)), phase, attenuation)
    if coarse < phases:  # the kernel has no frequencies that the coarse places don't tell
        lead = -peak % coarse
        size = -(-(lead + len(g)) // coarse)
        ring = np.pad(g, (lead, (size + 64) * coarse - lead - len(g)))
        g = np.fft.irfft(np.fft.rfft(ring), (size + 64) * phases)[: size * phases] * (phases / coarse)
        peak = (peak + lead) // coarse * phases
    first, last = (peak - len(g) + 1) // phases, -(-(peak + phases - 1) // phases)
    j = peak - np.arange(first, last + 1)[None, :] * phases + np.arange(phases)[:, None]  # an earlier input is a later place of g
    return Kernel(first, np.where((j >= 0) & (j < len(g)), g[np.clip(j, 0, len(g) - 1)], 0.0))


def halving(edge: float, attenuation: float, phase: float) -> Kernel:
    """Halves a rate without aliases below edge, a share of its Nyquist frequency of at most a quarter or so: the cut-off is in
    the middle of the band, where the filter and its mirror meet, and the transition as wide as the edge allows."""
    reach = kaiser_reach(attenuation, 1 - 2 * edge)
    g, peak = design.to_phase_whole(windowed_sinc(np.arange(-reach, reach + 1), 0.5, reach, design.kaiser_beta(attenuation)), phase, attenuation)
    return Kernel(-peak, g[None, :])


@dataclass(frozen=True)
class Stages:
    """A rate change: halvings, then one polyphase step of p / q inputs an output."""

    halvings: list[Kernel]
    p: int
    q: int
    final: Kernel
    exact: Callable[[np.ndarray], np.ndarray] | None = None

    def input(self, first: int, last: int) -> tuple[int, int]:
        """The inputs that outputs first to last read."""
        a, b = first * self.p // self.q + self.final.first, last * self.p // self.q + self.final.last
        for h in reversed(self.halvings):
            a, b = 2 * a - h.last, 2 * b - h.first
        return a, b

    def outputs(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Outputs m (consecutive) of the inputs that they read."""
        for h, (a, b) in zip(self.halvings, self.levels(int(m[0]), int(m[-1]))):
            y = np.convolve(v, h.taps[0])[len(h.taps[0]) - 1 : len(v)]  # of each place that has all its inputs
            v = y[::2][: b - a + 1]
        place = m * self.p
        whole, part = place // self.q, place % self.q
        lo, k = int(whole[0]) + self.final.first, np.arange(self.final.taps.shape[1])
        out, phases = np.empty(len(m)), len(self.final.taps)
        for a in range(0, len(m), 512):
            r = part[a : a + 512]
            if self.exact is not None:
                h = self.exact(r / self.q)
            elif phases == self.q:
                h = self.final.taps[r]
            else:  # between two of the tabled places
                at = r * (phases / self.q)
                w = np.floor(at).astype(int)
                after = np.where((w + 1 < phases)[:, None], self.final.taps[np.minimum(w + 1, phases - 1)], np.pad(self.final.taps[:1], ((0, 0), (1, 0)))[:, :-1])
                h = self.final.taps[w] + (after - self.final.taps[w]) * (at - w)[:, None]
            out[a : a + 512] = (h * v[whole[a : a + 512, None] + self.final.first - lo + k[None, :]]).sum(1)
        return out

    def levels(self, first: int, last: int) -> list[tuple[int, int]]:
        """The places that each halving must give."""
        a, b = first * self.p // self.q + self.final.first, last * self.p // self.q + self.final.last
        out = []
        for h in reversed(self.halvings):
            out.append((a, b))
            a, b = 2 * a - h.last, 2 * b - h.first
        return out[::-1]


def stages(step: Fraction, bandwidth: float, attenuation: float, phase: float = 50, aliasing: bool = False) -> Stages:
    """A plan: the rate is halved as long as four inputs or more make an output, so that no kernel grows with the ratio.

    Pass band: bandwidth times the lower rate's Nyquist frequency; the stop band begins there, or with aliasing where aliases
    reach the pass band. Halvings keep all below that clean.
    """
    attenuation += 10 * (phase != 50)  # as filling the zeros of a kernel lifts its stop band
    edge = min(1.0, float(1 / step)) * (2 - bandwidth if aliasing else 1.0)
    made = []
    while step >= 4:
        made.append(halving(edge, attenuation, phase))
        step, edge = step / 2, edge * 2
    low = min(1.0, float(1 / step))
    width = low * (1 - bandwidth) * (2 if aliasing else 1)
    reach, cutoff, beta = kaiser_reach(attenuation, width), low if aliasing else low * (1 + bandwidth) / 2, design.kaiser_beta(attenuation)
    p, q = step.numerator, step.denominator
    if phase == 50:
        k = np.arange(-reach, reach + 1)
        taps = lambda part: windowed_sinc(k[None, :] - part[:, None], cutoff, reach, beta)
        return Stages(made, p, q, Kernel(-reach, taps(np.arange(q) / q))) if q <= PHASES else Stages(made, p, q, Kernel(-reach, np.zeros((1, len(k)))), taps)
    return Stages(made, p, q, polyphase(cutoff, reach, attenuation, min(q, PHASES), phase))


def bandlimited(x: Signal, to: float, bandwidth: float = 0.95, attenuation: float = 126.0, phase: float = 50, aliasing: bool = False) -> Signal:
    """Kaiser-windowed sinc (see stages); floor(in / factor + 0.5) outputs.

    phase: 0 minimum, 25 intermediate, 50 linear, 100 maximum. Blocks of outputs hold the inputs that they read.
    """
    step = _ratio(x, to)
    p, q = step.numerator, step.denominator
    plan = stages(step, bandwidth, attenuation, phase, aliasing)
    # how far an output's inputs may lie from its own place
    reach = max(abs(e - m * p // q) for m in range(0, 2 * q, max(1, q // 64)) for e in plan.input(m, m)) + 2 * 2 ** len(plan.halvings)
    n = F.col("n")
    of = lambda k: F.floor(F.floor(k * q / float(p)) / BLOCK)  # noqa: E731  block of outputs at input place k
    ends = x.df.groupBy(*BY).agg((F.max("n") + 1).alias("length"))
    dealt = x.df.select(*BY, "n", "s", F.explode(F.sequence(of(F.greatest(n - reach - 1, F.lit(0))), of(n + reach + 1))).alias("block")).join(ends, BY)
    count = int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*BY, "block"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole(batches, key):
            first = t.take(pa.array(starts))
            at, s = t.column("n").to_numpy(), t.column("s").to_numpy().astype(float)
            out, places = [], []
            for a, b, block, length in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], first.column("block").to_pylist(), first.column("length").to_pylist()):
                m = np.arange(block * BLOCK, min((block + 1) * BLOCK, int(length * q / p + 0.5)))
                places.append(m)
                if len(m):
                    lo, hi = plan.input(int(m[0]), int(m[-1]))
                    v = np.zeros(hi - lo + 1)
                    own = at[a:b] - lo
                    ok = (own >= 0) & (own < len(v))
                    v[own[ok]] = s[a:b][ok]
                    out.append(plan.outputs(v, m))
            sizes = [len(m) for m in places]
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks().take(of) for c in BY), pa.array(np.concatenate(places)), pa.array(np.concatenate([np.empty(0), *out]))], [*BY, "n", "y"])

    dealt = dealt.withColumns({"channel": F.col("channel").cast("int"), "n": F.col("n").cast("bigint"), "block": F.col("block").cast("bigint"), "length": F.col("length").cast("bigint")})
    out = dealt.repartition(count, *key).sortWithinPartitions(*key, "n").mapInArrow(made, "stream_id string, channel int, n bigint, y double")
    return x.with_df(out.withColumn("s", half_even(F.col("y"))), rate=to, precision=32)
