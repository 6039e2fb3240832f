"""Generators: tones and noises as functions of the place, from spark.range."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.numeric import FULL, MAX, MIN, rounded
from ..signal import WIDE, Signal
from .scan import recurse
from .stateful import blockwise, lcg

TONES = ("sine", "square", "sawtooth", "triangle", "trapezium", "exp")
NOISES = ("whitenoise", "tpdfnoise", "pinknoise", "brownnoise", "pluck")


#: Poles and gains of the filter that makes noise pink: fixed values.
PINK = ((0.99886, 0.0555179), (0.99332, 0.0750759), (0.969, 0.153852), (0.8665, 0.3104856), (0.55, 0.5329522), (-0.7616, -0.016898))


def silent(spark: SparkSession, length: int, rate: float, channels: int = 1, stream_id: str = "0") -> Signal:
    """`length` wide samples of silence."""
    rows = spark.range(length * channels)
    return Signal(rows.select(F.lit(stream_id).alias("stream_id"), (F.col("id") % channels).cast("int").alias("channel"), F.floor(F.col("id") / channels).alias("n"), F.lit(0).alias("s")), rate, channels, 1)


def turns(n: Column, rate: float, f: float, f2: float | None = None, sweep: str = ":", length: int | None = None) -> Column:
    """Cycles since the start at place n. Sweeps from f to f2 over length places: ':' linear, '+' squared, '/' exponential (by_cycle(): '-', exponential by the cycle)."""
    t = n / F.lit(float(rate))
    if f2 is None or f2 == f:
        return t * f
    if not length:
        raise ValueError("a sweep needs a length")
    if sweep == ":":
        return (F.lit(float(f)) + n * F.lit((f2 - f) / (2 * length))) * t
    if sweep == "+":
        m = math.sqrt(abs(f2 - f)) / (length * math.sqrt(3))
        return (F.lit(float(f)) + F.lit(math.copysign(1.0, f2 - f)) * F.pow(n * F.lit(m), 2)) * t
    m = math.log(f2 / f) / length * rate
    return (F.exp(t * F.lit(m)) - 1) * F.lit(f / m)


def cycle_phases(count: int, rate: float, f: float, f2: float, length: int) -> np.ndarray:
    """Phases of an exponential sweep that holds its frequency within a cycle: a cycle ends where, at the frequency of its end, it
    is a whole one."""
    step = math.log(f2 / f) / length
    out, begun = np.empty(count), 0.0
    for n in range(count):
        t, power = n / rate, n * step
        h = f * math.exp(power) if power < 709.78 else math.inf  # numpy's exp differs in a last bit, which grows with the phase
        if h * (t - begun) >= 1:
            begun += 1 / h
        out[n] = h * (t - begun)
    return out


def by_cycle(x: Signal, f: float, f2: float, length: int) -> DataFrame:
    """Rows of x with the phase p of such a sweep: worked out once for each channel. Samples pass as they are, beyond 32 bits too."""

    def run(t: pa.Table) -> pa.Table:
        return t.sort_by("n").append_column("p", pa.array(cycle_phases(t.num_rows, x.rate, f, f2, length)))

    rows = x.df.select("stream_id", F.col("channel").cast("int"), F.col("n").cast("bigint"), F.col("s").cast("bigint"))
    return rows.groupBy("stream_id", "channel").applyInArrow(run, WIDE + ", p double")


def shape(kind: str, phase: Column, p1: float | None = None, p2: float | None = None, p3: float | None = None) -> Column:
    """-1 to 1 for a phase from 0 to 1."""
    if kind == "sine":
        return F.sin(phase * (2 * math.pi))
    if kind == "square":
        return F.when(phase < (0.5 if p1 is None else p1), 1.0).otherwise(-1.0)
    if kind == "sawtooth":
        return phase * 2 - 1
    if kind == "triangle":
        p = 0.5 if p1 is None else p1
        return F.when(phase < p, phase / p * 2 - 1).otherwise(1 - (phase - p) / (1 - p) * 2)
    if kind == "trapezium":
        a, b, c = 0.1 if p1 is None else p1, 0.5 if p2 is None else p2, 0.6 if p3 is None else p3
        return F.when(phase < a, phase / a * 2 - 1).when(phase < b, 1.0).when(phase < c, 1 - (phase - b) / (c - b) * 2).otherwise(-1.0)
    p, low = 0.5 if p1 is None else p1, 10 ** (-(p2 if p2 is not None else 0.5) * 200 / 20)
    bump = F.when(phase < p, phase / p).otherwise((1 - phase) / (1 - p))
    return (F.pow(F.lit(low), 1 - bump) - low) / (1 - low) * 2 - 1


def _combined(df: DataFrame, y: Column, how: str) -> DataFrame:
    s = F.col("s")
    return df.withColumn("s", rounded({"create": y * MAX, "mix": (y * MAX + s) / 2, "amod": (y + 1) * s / 2, "fmod": y * s}[how]))


def synth(x: Signal, kind: str, how: str = "create", f: float = 440.0, f2: float | None = None, sweep: str = ":", offset: float = 0.0, phase: float = 0.0, p1: float | None = None, p2: float | None = None, p3: float | None = None, length: int | None = None, seed: int = 1) -> Signal:
    """A tone or noise over the places of x, created or combined with its samples. offset and phase are shares."""
    if kind in TONES and sweep == "-" and f2 not in (None, f):
        if not length:
            raise ValueError("a sweep needs a length")
        y = shape(kind, F.pmod(F.col("p") + F.lit(phase), F.lit(1.0)), p1, p2, p3)
        return x.with_df(_combined(by_cycle(x, f, f2, length), y * (1 - abs(offset)) + offset, how), precision=32)
    if kind in TONES:
        cycle = F.pmod(turns(F.col("n"), x.rate, f, f2, sweep, length) + F.lit(phase), F.lit(1.0))
        y = shape(kind, cycle, p1, p2, p3)
    else:
        return noise(x, kind, how, f, offset, seed)
    return x.with_df(_combined(x.df, y * (1 - abs(offset)) + offset, how), precision=32)


#: What is added to the seed of a generator of noise.
APART = 7919


def noise(x: Signal, kind: str, how: str = "create", f: float = 440.0, offset: float = 0.0, seed: int = 1) -> Signal:
    """White, triangular, pink or brown noise and a plucked string.

    Draws go round the channels: those of a place come from one after the other. White and triangular noise are expressions of the
    place; the others, which depend on their own past, run in blocks.
    """
    if kind in ("whitenoise", "tpdfnoise"):
        count = 2 if kind == "tpdfnoise" else 1
        first = ((F.col("n") * x.channels + F.col("channel")) * count + 1).cast("bigint")
        df = draws.with_state(x.df, first, seed + APART, "_u")
        y = draws.signed(F.col("_u")) / F.lit(FULL)
        if count == 2:
            y = (y + draws.signed(draws.after(F.col("_u"))) / F.lit(FULL)) / 2
        return x.with_df(_combined(df, y * (1 - abs(offset)) + offset, how), precision=32)
    size = max(2, int(x.rate / f + 0.5)) if kind == "pluck" else 0
    return blockwise(x, Noise(kind, how, offset, seed + APART, size))


@dataclass(frozen=True)
class Noise:
    """Noises that go on from their own past, in blocks; combined with the samples that pass."""

    kind: str
    how: str
    offset: float
    seed: int
    size: int

    def start(self, channels: int) -> dict:
        return {"seed": self.seed, "past": np.zeros((channels, len(PINK))), "draw": np.zeros((channels, 1)), "brown": [0.0] * channels, "lines": None, "place": 0}

    def draws(self, state: dict, channels: int, places: int) -> np.ndarray:
        d = lcg(state["seed"], channels * places)
        state["seed"] = int(d[-1]) if len(d) else state["seed"]
        return d.reshape(places, channels).T / FULL

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        y = np.stack(getattr(self, self.kind)(state, *s.shape)) * (1 - abs(self.offset)) + self.offset
        v = {"create": y * MAX, "mix": (y * MAX + s) / 2, "amod": (y + 1) * s / 2, "fmod": y * s}[self.how].clip(MIN, MAX)
        return np.trunc(v + np.where(v < 0, -0.5, 0.5)).clip(MIN, MAX).astype(np.int64).astype(np.int32)

    def pinknoise(self, state: dict, channels: int, places: int) -> list[np.ndarray]:
        out = []
        for c, d in enumerate(self.draws(state, channels, places)):
            y = np.zeros(places)
            for k, (pole, gain) in enumerate(PINK):
                own = recurse([gain], [1.0, -pole], d, state["past"][c, k : k + 1])
                state["past"][c, k] = own[-1] if places else state["past"][c, k]
                y += own
            led = np.concatenate([state["draw"][c], d])
            state["draw"][c] = led[-1]
            out.append(np.clip((y + d * 0.5362 + led[:-1] * 0.115926) * 0.11, -1, 1))
        return out

    def brownnoise(self, state: dict, channels: int, places: int) -> list[np.ndarray]:
        out = []
        for c, d in enumerate(self.draws(state, channels, places) / 16):
            v, own = state["brown"][c], []
            for step in d.tolist():
                v = v + step if abs(v + step) <= 1 else v - step  # a step that would leave the range goes back
                own.append(v)
            state["brown"][c] = v
            out.append(np.array(own))
        return out

    def pluck(self, state: dict, channels: int, places: int) -> list[np.ndarray]:
        if state["lines"] is None:
            state["lines"] = self.draws(state, channels, self.size).tolist()
        out = []
        for line in state["lines"]:
            own = []
            for k in range(state["place"], state["place"] + places):
                at = k % self.size
                own.append(line[at])
                line[at] = 0.4985 * (line[at] + line[(at + 1) % self.size])
            out.append(np.array(own))
        state["place"] += places
        return out

    def drain(self, state: dict) -> None:
        return None
