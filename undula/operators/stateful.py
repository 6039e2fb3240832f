"""Operators that keep a state, run in blocks of bounded length: the same operator in batch and over streams.

An operator has start(channels), which makes a state of plain values and arrays, flow(state, s), which takes a block of samples
(channels, places) of 32 bits and gives what it can give so far, and drain(state), which gives the rest, if any. What comes out doesn't
depend on where blocks are cut. In batch a stream's rows, in order, pass one task a block at a time; over streams the state
stays in the state store between micro-batches.
"""

from __future__ import annotations

import inspect
import math
import pickle
import sysconfig
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import design
from ..functions.numeric import FULL, MAX, MIN
from ..signal import WIDE, Signal
from .scan import recurse


class Operator(Protocol):
    def start(self, channels: int) -> Any: ...

    def flow(self, state: Any, s: np.ndarray) -> np.ndarray: ...

    def drain(self, state: Any) -> np.ndarray | None: ...


class _Shipped:
    def __init__(self, code: bytes):
        self.code = code

    def __reduce__(self):
        return pickle.loads, (self.code,)


def shipped(kernel):
    """A caller's kernel or operator as executors get it: with the code of its module where that isn't installed, as they may
    not have the module."""
    module = inspect.getmodule(kernel if inspect.isroutine(kernel) or inspect.isclass(kernel) else type(kernel))
    file = getattr(module, "__file__", None)
    installed = [Path(sysconfig.get_path(k)) for k in ("stdlib", "purelib", "platlib")]
    if not file or module.__name__.split(".")[0] == __name__.split(".")[0] or any(Path(file).is_relative_to(p) for p in installed):
        return kernel
    known = module.__name__ in cloudpickle.list_registry_pickle_by_value()
    cloudpickle.register_pickle_by_value(module)
    try:
        return _Shipped(cloudpickle.dumps(kernel))
    finally:
        if not known:
            cloudpickle.unregister_pickle_by_value(module)


def to_samples(y: np.ndarray, cut: bool = False) -> np.ndarray:
    d = np.clip(y * FULL, MIN, MAX)
    return (np.trunc(d) if cut else np.trunc(d + np.where(d < 0, -0.5, 0.5))).clip(MIN, MAX).astype(np.int64).astype(np.int32)


def _joined(*parts: np.ndarray | None) -> np.ndarray:
    return np.concatenate([p for p in parts if p is not None], axis=1)


class Flow:
    """One stream's way through an operator: the operator's state, places given so far and rows of a wide sample not whole yet."""

    def __init__(self, operator: Operator, channels: int):
        self.operator, self.channels, self.given = operator, channels, 0
        self.state = operator.start(channels)
        self.rest = (np.empty(0, np.int64),) * 3

    @property
    def silent(self) -> np.ndarray:
        """A block without places."""
        return self.operator.flow(self.state, np.zeros((self.channels, 0), np.int64))

    def add(self, channel: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Rows sorted by n and channel; the last wide sample waits until all its channels or rows of a later one are there."""
        channel, n, s = (np.concatenate(x) for x in zip(self.rest, (channel, n, s)))
        whole = len(n)
        if whole and np.searchsorted(n, n[-1]) + self.channels > whole:
            whole = int(np.searchsorted(n, n[-1]))
        self.rest = (channel[whole:], n[whole:], s[whole:])
        return self.block(channel[:whole], n[:whole], s[:whole])

    def block(self, channel: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        if not len(n):
            return self.silent
        a = np.zeros((self.channels, int(n[-1] - n[0]) + 1), np.int64)
        a[channel, n - n[0]] = s
        return self.operator.flow(self.state, a)

    def end(self) -> np.ndarray:
        last, self.rest = self.rest, (np.empty(0, np.int64),) * 3
        return _joined(self.block(*last), self.operator.drain(self.state))

    def rows(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """channel, n and s of the next places given."""
        c, m = out.shape
        first, self.given = self.given, self.given + m
        return np.repeat(np.arange(c, dtype=np.int32), m), np.tile(np.arange(first, first + m), c), out.ravel().astype(np.int64)


def blockwise(x: Signal, operator: Operator, **changes) -> Signal:
    """The operator over all streams of x, each in one task as its state asks for, held a block at a time."""
    channels, operator = x.channels, shipped(operator)
    n = int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flow = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("stream_id").dictionary_encode()
            code, names = ids.indices.to_numpy(), ids.dictionary.to_pylist()
            columns = b.column("channel").to_numpy().astype(np.int64), b.column("n").to_numpy(), b.column("s").to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            out = []
            for a, z in zip(cuts, cuts[1:]):
                stream = names[code[a]]
                if flow is None or stream != now:
                    if flow is not None:
                        out.append((now, flow.rows(flow.end())))
                    now, flow = stream, Flow(operator, channels)
                out.append((now, flow.rows(flow.add(*(c[a:z] for c in columns)))))
            yield _rows(out)
        if flow is not None:
            yield _rows([(now, flow.rows(flow.end()))])

    ordered = x.df.select("stream_id", F.col("channel").cast("int").alias("channel"), F.col("n").cast("bigint").alias("n"), "s").repartition(n, "stream_id").sortWithinPartitions("stream_id", "n", "channel")
    return x.with_df(ordered.mapInArrow(run, WIDE), **({"precision": 32} | changes))


def _rows(parts: list[tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    sizes = [len(p[1][1]) for p in parts]
    ids = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(parts)), sizes), pa.int32()), pa.array([p[0] for p in parts], pa.string())).cast(pa.string())
    channel, n, s = (np.concatenate([p[1][k] for p in parts]) for k in range(3))
    return pa.RecordBatch.from_arrays([ids, pa.array(channel, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.int64())], ["stream_id", "channel", "n", "s"])


def streamed(rows: DataFrame, operator: Operator, channels: int) -> DataFrame:
    """The operator over streaming rows (stream_id, channel, n, s), which come in order of n from micro-batch to micro-batch.

    A row without s ends its stream: the operator is drained, and its state goes.
    """
    operator = shipped(operator)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flow = Flow(operator, channels)
        if state.exists:
            flow.state, flow.given, flow.rest = pickle.loads(state.get[0])
        pdf = pd.concat(list(batches)).sort_values(["n", "channel"])
        own = pdf[pdf["s"].notna()]
        out = [flow.add(own["channel"].to_numpy(np.int64), own["n"].to_numpy(np.int64), own["s"].to_numpy(np.int64))]
        if len(own) < len(pdf):
            out.append(flow.end())
            state.remove()
        channel, n, s = flow.rows(_joined(*out))
        if len(own) == len(pdf):
            state.update((pickle.dumps((flow.state, flow.given, flow.rest)),))
        yield pd.DataFrame({"stream_id": key[0], "channel": channel, "n": n, "s": s})

    return rows.groupBy("stream_id").applyInPandasWithState(step, WIDE, "flow binary", "append", GroupStateTimeout.NoTimeout)


def whole(operator: Operator, s: np.ndarray) -> np.ndarray:
    """The operator over all of a stream's samples (channels, places) at once."""
    state = operator.start(len(s))
    return _joined(operator.flow(state, s), operator.drain(state))


# --- levels ---


def follow(levels: np.ndarray, attack: float, decay: float, v: float) -> tuple[np.ndarray, float]:
    """A level that nears the given ones by one share of the distance when it rises and another when it falls."""
    out = []
    for u in levels.tolist():
        v += (u - v) * (attack if u > v else decay)
        out.append(v)
    return np.array(out), v


@dataclass(frozen=True)
class Compand:
    """Gain by a curve of the level, which looks `late` places ahead; past the end there is silence.

    rates: (attack, decay) shares, one pair for all channels together or one for each.
    """

    rates: list[tuple[float, float]]
    curve: Any
    initial: float
    late: int = 0

    def start(self, channels: int) -> dict:
        return {"level": [self.initial] * channels, "held": np.zeros((channels, 0))}

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        v = s / FULL
        if len(self.rates) == 1 and len(v) > 1:
            level, last = follow(np.abs(v).max(0), *self.rates[0], state["level"][0])
            levels, state["level"] = np.broadcast_to(level, v.shape), [last] * len(v)
        else:
            each = [follow(np.abs(row), *self.rates[min(k, len(self.rates) - 1)], state["level"][k]) for k, row in enumerate(v)]
            levels, state["level"] = np.stack([e[0] for e in each]), [e[1] for e in each]
        v = np.concatenate([state["held"], v], axis=1)
        m = max(0, v.shape[1] - self.late)
        state["held"] = v[:, m:]
        return to_samples(v[:, :m] * self.curve(levels[:, levels.shape[1] - m :]), cut=True)

    def drain(self, state: dict) -> np.ndarray:
        return to_samples(state["held"] * self.curve(np.zeros(state["held"].shape)), cut=True)


@dataclass(frozen=True)
class Bands:
    """Companding by frequency band: splits by two filters in a row at each crossover, rounded to samples, bands added and clipped.

    splits: (lowpass, highpass) coefficients b0 b1 b2 a0 a1 a2 of each crossover; bands: (attack and decay, curve, initial level).
    """

    splits: list[tuple]
    bands: list[tuple]

    def start(self, channels: int) -> dict:
        return {"filters": {}, "level": [b[2] for b in self.bands]}

    def filtered(self, state: dict, key: tuple, c, v: np.ndarray) -> np.ndarray:
        b, a = np.asarray(c[:3], float) / c[3], np.asarray(c[3:], float) / c[3]
        x, y = state["filters"].get(key, (np.zeros(2), np.zeros(2)))
        led, w = np.concatenate([x, v]), np.zeros(len(v))
        for k in range(3):
            w += b[k] * led[2 - k : 2 - k + len(v)]
        out = recurse([1.0], a, w, y)
        state["filters"][key] = led[len(led) - 2 :], np.concatenate([out[::-1], y])[:2]
        return out

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        v = s / FULL
        total, rest = np.zeros_like(v), v
        for k, ((attack, decay), curve, _) in enumerate(self.bands):
            low = rest
            if k < len(self.splits):
                halves = [[np.round(self.filtered(state, (k, c, h, 1), f, self.filtered(state, (k, c, h, 0), f, row)) * FULL) / FULL for c, row in enumerate(rest)] for h, f in enumerate(self.splits[k])]
                low, rest = (np.stack(h) for h in halves)
            level, state["level"][k] = follow(np.abs(low).max(0), attack, decay, state["level"][k])
            total = np.clip(total + low * curve(level), -1, 1)
        return to_samples(total)

    def drain(self, state: dict) -> None:
        return None


# --- modulated delays ---


@dataclass(frozen=True)
class Flanger:
    """A swinging delay with feedback. wave(n, channel) tells it in places; quadratic or linear between places."""

    wave: Any
    size: int
    regen: float
    dry: float
    wet: float
    quadratic: bool

    def start(self, channels: int) -> dict:
        return {"n": 0, "channels": [([0.0] * self.size, 0.0, 0) for _ in range(channels)]}

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        n = np.arange(state["n"], state["n"] + s.shape[1])
        state["n"] += s.shape[1]
        out = np.empty(s.shape)
        for c, v in enumerate(s / FULL):
            line, last, pos = state["channels"][c]
            at = self.wave(n, c)
            where = np.floor(at).astype(int)
            m = self.size
            for k, (u, w, f) in enumerate(zip(v.tolist(), where.tolist(), (at - where).tolist())):
                pos = (pos - 1) % m
                line[pos] = u + last * self.regen
                a, b = line[(pos + w) % m], line[(pos + w + 1) % m]
                if self.quadratic:
                    q = line[(pos + w + 2) % m]
                    last = a + f * ((b - a) * 2 - (q - a) / 2 + f * ((q - a) / 2 - (b - a)))
                else:
                    last = a + (b - a) * f
                out[c, k] = u * self.dry + last * self.wet
            state["channels"][c] = line, last, pos
        return to_samples(out)

    def drain(self, state: dict) -> None:
        return None


@dataclass(frozen=True)
class Phaser:
    """Feedback through a swinging delay of whole places, told by place(n)."""

    place: Any
    size: int
    gain_in: float
    gain_out: float
    decay: float

    def start(self, channels: int) -> dict:
        return {"n": 0, "channels": [([0.0] * self.size, 0) for _ in range(channels)]}

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        place = self.place(np.arange(state["n"], state["n"] + s.shape[1])).tolist()
        state["n"] += s.shape[1]
        out = np.empty(s.shape)
        for c, v in enumerate(s / FULL):
            line, pos = state["channels"][c]
            for k, (u, w) in enumerate(zip(v.tolist(), place)):
                d = u * self.gain_in + line[(pos + w) % self.size] * self.decay
                pos = (pos + 1) % self.size
                line[pos] = d
                out[c, k] = d * self.gain_out
            state["channels"][c] = line, pos
        return to_samples(out)

    def drain(self, state: dict) -> None:
        return None


# --- choosing by level ---


def power(last: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean square over as many places as `last` has, which come before s; and the last such places. Sums are whole numbers, so
    that blocks don't change them."""
    led, size = np.concatenate([last, s.astype(np.int64)], axis=1), last.shape[1]
    high, low = led >> 16, led & 0xFFFF
    total = 0.0
    for part, unit in ((high * high, 2.0**32), (high * low, 2.0**17), (low * low, 1.0)):
        sums = np.cumsum(part, axis=1)
        total = total + (sums[:, size:] - sums[:, :-size]) * unit
    return total / (FULL * FULL * size), led[:, led.shape[1] - size :]


WAIT, SKIP, PASS, STOP = range(4)


@dataclass(frozen=True)
class Silence:
    """Drops silence: see sequential.silence. What waits for a decision is held, at most a period of it."""

    size: int
    above_periods: int
    above: tuple[int, float]
    below_periods: int
    below: tuple[int, float]
    leave: bool

    def start(self, channels: int) -> dict:
        return {"last": np.zeros((channels, self.size), np.int64), "mode": WAIT if self.above_periods else PASS, "run": 0, "periods": 0, "held": np.zeros((channels, 0), np.int32)}

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        mean, state["last"] = power(state["last"], s)
        loud = np.sqrt(mean)
        on, off = ((loud > level).any(0).tolist() for level in (self.above[1], self.below[1]))
        led = state["held"].shape[1]
        v = np.concatenate([state["held"], s], axis=1)
        keep = np.zeros(v.shape[1], bool)
        first = 0  # of the samples that wait
        mode, run, periods = state["mode"], state["run"], state["periods"]
        for at, (a, b) in enumerate(zip(on, off), led):
            if mode == SKIP and not a:
                mode, run = WAIT, 0
            if mode == WAIT:
                run = run + 1 if a else 0
                first = at + 1 - run
                if run and run >= self.above[0]:
                    periods += 1
                    if periods < self.above_periods:
                        mode, first = SKIP, at + 1
                    else:
                        keep[first:at] = True
                        mode, run, periods, first = PASS, 0, 0, at
            if mode == PASS:
                if not self.below_periods:
                    keep[at], first = True, at + 1
                    continue
                run = 0 if b else run + 1
                if not run:
                    keep[first : at + 1], first = True, at + 1
                elif run >= self.below[0]:
                    periods += 1
                    if periods < abs(self.below_periods):
                        keep[first : at + 1] = True
                    elif self.leave:
                        keep[first : first + self.below[0]] = True
                    first, run = at + 1, 0
                    if periods >= abs(self.below_periods):
                        periods, mode = 0, STOP if self.below_periods > 0 else WAIT if self.above_periods else PASS
            elif mode in (STOP, SKIP):
                first = at + 1
        state |= {"mode": mode, "run": run, "periods": periods, "held": v[:, first:]}
        return v[:, keep]

    def drain(self, state: dict) -> np.ndarray:
        return state["held"] if state["mode"] == PASS else state["held"][:, :0]


def onset(measures: np.ndarray, trigger: float, bridged: int) -> int:
    """How many measures ago speech began, of measures latest first.

    Measures at the trigger are loud. Loud ones that lie at most `bridged` measures apart are one utterance, and the utterance that
    counts is the latest. It began after the first silent measure (0) before it; without one, before all measures.
    """
    loud = np.flatnonzero(measures >= trigger)
    if not len(loud):
        return len(measures)
    apart = np.flatnonzero(np.diff(loud) > bridged)
    earliest = loud[apart[0]] if len(apart) else loud[-1]
    silent = np.flatnonzero(measures[earliest:] == 0)
    return int(earliest + silent[0]) if len(silent) else len(measures)


@dataclass(frozen=True)
class Voice:
    """Drops what comes before speech: see sequential.vad. Held are the samples that the search may go back to."""

    window: int
    size: int
    period: int
    kept: int
    bridged: int
    before: int
    boots: int
    band: tuple[int, int]
    quefrencies: tuple[int, int]
    trigger: float
    up: float
    down: float
    slow: float
    mean_share: float
    reduction: float
    taper: np.ndarray = field(repr=False)
    lift: np.ndarray = field(repr=False)

    def start(self, channels: int) -> dict:
        width = self.band[1] - self.band[0]
        return {"held": np.zeros((channels, 0), np.int32), "base": 0, "frame": 0, "on": False, "level": np.zeros((channels, width)), "floor": np.zeros((channels, width)), "mean": np.zeros(channels), "measures": np.zeros((channels, self.kept))}

    def measured(self, state: dict, v: np.ndarray) -> np.ndarray:
        """The measure of a frame by channel: power of the cepstrum of its cleared, smoothed magnitudes, in nepers over -21."""
        (first, last), (low, high), k = self.band, self.quefrencies, state["frame"]
        now = np.abs(np.fft.rfft(v / FULL * self.taper, self.size))[:, first:last]
        old = k / (1 + k) if k < self.boots else self.slow
        state["level"] = state["level"] * old + now * (1 - old)
        power = state["level"] ** 2
        old = 0.0 if k < self.boots else np.where(power > state["floor"], self.up, self.down)
        state["floor"] = state["floor"] * old + power * (1 - old)
        clear = np.zeros((len(v), self.size // 2))
        clear[:, first:last] = np.sqrt(np.maximum(0, power - self.reduction * state["floor"])) * self.lift
        cepstrum = np.abs(np.fft.rfft(clear))[:, low:high] ** 2
        with np.errstate(divide="ignore"):
            return np.maximum(0, 21 + np.log(cepstrum.mean(1)))

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        if state["on"]:
            return s
        v = np.concatenate([state["held"], s], axis=1)
        have = state["base"] + v.shape[1]
        while (end := self.window + state["frame"] * self.period) <= have:
            measure = self.measured(state, v[:, end - self.window - state["base"] : end - state["base"]])
            state["frame"] += 1
            state["measures"] = np.concatenate([measure[:, None], state["measures"][:, :-1]], axis=1)
            state["mean"] = state["mean"] * self.mean_share + measure * (1 - self.mean_share)
            spoken = state["mean"] >= self.trigger
            if spoken.any():
                back = max(onset(m, self.trigger, self.bridged) for m in state["measures"][spoken])
                state["on"], state["held"] = True, v[:, :0]
                return v[:, max(0, end - self.window - back * self.period - self.before - state["base"]) :]
        oldest = self.window + state["frame"] * self.period - self.window - self.kept * self.period - self.before
        gone = min(v.shape[1], max(0, oldest - state["base"]))
        state["held"], state["base"] = v[:, gone:], state["base"] + gone
        return v[:, :0]

    def drain(self, state: dict) -> None:
        return None


# --- time ---


@dataclass(frozen=True)
class Splice:
    """Cross-fades: see sequential.splice. Held is what the next join may read."""

    joins: list[tuple[int, int, int]]
    fade: Any

    def start(self, channels: int) -> dict:
        return {"held": np.zeros((channels, 0)), "base": 0, "join": 0}

    def passed(self, state: dict, v: np.ndarray, ended: bool) -> np.ndarray:
        """Output of what is held and v: joins whose places are all there, or at the end all."""
        v = np.concatenate([state["held"], v], axis=1)
        out, at, base = [], 0, state["base"]  # at: what has been given, from base on
        plain = lambda a, b: np.rint(v[:, a:b] * FULL).astype(np.int64)  # noqa: E731  as it came
        while state["join"] < len(self.joins):
            position, excess, leeway = self.joins[state["join"]]
            begin, size = max(at, position - excess - base), 2 * excess
            if not ended and begin + 2 * size + leeway > v.shape[1]:
                at_most = min(begin, v.shape[1])
                out.append(plain(at, at_most))
                at = at_most
                break
            old = v[:, begin : begin + size]
            fits = [((v[:, begin + size + d : begin + 2 * size + d][:, : old.shape[1]] - old) ** 2).sum() if begin + 2 * size + d <= v.shape[1] else np.inf for d in range(leeway + 1)]
            d = int(np.argmin(fits)) if np.isfinite(fits).any() else 0
            new = v[:, begin + size + d : begin + 2 * size + d]
            m = min(old.shape[1], new.shape[1])
            up, down = self.fade(np.arange(m) / max(1, m))
            out += [plain(at, begin), to_samples(old[:, :m] * down + new[:, :m] * up)]
            at = min(begin + size + d + m, v.shape[1])
            state["join"] += 1
        else:
            out.append(plain(at, v.shape[1]))
            at = v.shape[1]
        state["held"], state["base"] = v[:, at:], base + at
        return np.concatenate(out, axis=1)

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        return self.passed(state, s / FULL, False)

    def drain(self, state: dict) -> np.ndarray:
        return self.passed(state, state["held"][:, :0], True)


@dataclass(frozen=True)
class Tempo:
    """Segments overlapped where they fit best: see sequential.tempo. Held are the input from the next search on and the output that
    might be too much if the input ended now."""

    factor: float
    segment: int
    search: int
    overlap: int

    def start(self, channels: int) -> dict:
        none = np.zeros((channels, 0))
        return {"held": none, "base": 0, "tail": none, "out": none, "given": 0, "count": 0, "length": 0}

    def advanced(self, state: dict, v: np.ndarray, most: float) -> np.ndarray:
        """Output of as many segments as v (the input from base on) holds, until there is `most`."""
        hop, base = self.segment - self.overlap, state["base"]
        ramp = np.arange(self.overlap) / self.overlap
        out = [state["out"]]
        have = state["given"] + state["out"].shape[1]
        if not state["count"] and v.shape[1] >= self.segment:
            out.append(v[:, :hop])
            state["tail"], state["count"], have = v[:, hop : self.segment], 1, hop
        while state["count"] and have < most:
            at = int(self.factor * state["count"] * hop + 0.5) - base
            if at + self.segment + self.search > v.shape[1]:
                break
            tail = state["tail"]
            fits = [((v[:, at + d : at + d + self.overlap] - tail) ** 2).sum() for d in range(self.search + 1)]
            at += int(np.argmin(fits))
            out += [tail * (1 - ramp) + v[:, at : at + self.overlap] * ramp, v[:, at + self.overlap : at + hop]]
            state["tail"] = v[:, at + hop : at + self.segment]
            state["count"], have = state["count"] + 1, have + hop
        gone = min(v.shape[1], max(0, int(self.factor * state["count"] * hop + 0.5) - base)) if state["count"] else 0
        state["held"], state["base"] = v[:, gone:], base + gone
        return np.concatenate(out, axis=1)

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        state["length"] += s.shape[1]
        out = self.advanced(state, np.concatenate([state["held"], s / FULL], axis=1), math.inf)
        sure = max(0, min(out.shape[1], int(state["length"] / self.factor + 0.5) - state["given"]))
        state["out"], state["given"] = out[:, sure:], state["given"] + sure
        return to_samples(out[:, :sure].astype(np.float32).astype(float))

    def drain(self, state: dict) -> np.ndarray:
        total = int(state["length"] / self.factor + 0.5)
        while state["given"] + state["out"].shape[1] < total:  # silence follows
            state["out"] = self.advanced(state, np.pad(state["held"], ((0, 0), (0, self.segment + self.search))), total)
        return to_samples(state["out"][:, : total - state["given"]].astype(np.float32).astype(float))


@dataclass(frozen=True)
class Bend:
    """A phase vocoder whose ratio is a function of the place: see sequential.bend. Held are a frame of input and of output."""

    ratio: Any
    size: int
    oversampling: int

    def start(self, channels: int) -> dict:
        zeros = lambda n: np.zeros((channels, n))
        bins = self.size // 2 + 1
        return {"held": zeros(self.size), "out": zeros(self.size), "at": 0, "length": 0, "last": zeros(bins), "total": zeros(bins)}

    def advanced(self, state: dict, v: np.ndarray) -> list[np.ndarray]:
        """What no later frame adds to, of the frames that v (from the next frame on) holds."""
        size, over, step = self.size, self.oversampling, self.size // self.oversampling
        w, bins, out = design.window("hann", size + 1)[:size], np.arange(size // 2 + 1), []
        while v.shape[1] >= size:
            spectrum = np.fft.rfft(v[:, :size] * w)
            phase = np.angle(spectrum)
            turn = phase - state["last"] - 2 * np.pi * bins / over
            state["last"] = phase
            true = bins + (turn - 2 * np.pi * np.round(turn / (2 * np.pi))) * over / (2 * np.pi)
            r = self.ratio(state["at"] - size + size // 2)
            to = (bins * r).astype(int)
            ok = to <= size // 2
            mag = np.stack([np.bincount(to[ok], m[ok], size // 2 + 1) for m in np.abs(spectrum)])
            freq = np.zeros(mag.shape)
            freq[:, to[ok]] = true[:, ok] * r
            state["total"] = state["total"] + 2 * np.pi * freq / over
            state["out"] = state["out"] + np.fft.irfft(mag * np.exp(1j * state["total"]), size) * w * (8 / 3 / over)
            out.append(state["out"][:, :step])
            state["out"] = np.pad(state["out"][:, step:], ((0, 0), (0, step)))
            v, state["at"] = v[:, step:], state["at"] + step
        state["held"] = v
        return out

    def given(self, state: dict, parts: list[np.ndarray], before: int) -> np.ndarray:
        """Output places `before` on, without the silence that was put before the input."""
        out = np.concatenate([state["out"][:, :0], *parts], axis=1)
        return to_samples(out[:, max(0, self.size - before) :])

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        state["length"] += s.shape[1]
        before = state["at"]
        return self.given(state, self.advanced(state, np.concatenate([state["held"], s / FULL], axis=1)), before)

    def drain(self, state: dict) -> np.ndarray:
        before = state["at"]
        parts = self.advanced(state, np.pad(state["held"], ((0, 0), (0, self.size))))
        end = self.size + state["length"]  # of the input, with the silence before
        return self.given(state, [*parts, state["out"]], before)[:, : max(0, end - max(before, self.size))]


@dataclass(frozen=True)
class Reverb:
    """Combs and all-passes: see sequential.reverb. Delay lines are rings; a block is read from them in pieces.

    lines: for each side the lengths of combs and of all-passes; mixed(v, wet) makes outputs of inputs and wet signals [input][side].
    """

    lines: list[tuple[list[int], list[int]]]
    early: int
    feedback: float
    damp: float
    gain: float
    mixed: Any

    def start(self, channels: int) -> dict:
        ring = lambda n: {"line": np.zeros(n), "at": 0, "low": 0.0}
        return {"early": np.zeros((channels, self.early)), "sides": [[([ring(n) for n in combs], [ring(n) for n in passes]) for combs, passes in self.lines] for _ in range(channels)]}

    @staticmethod
    def pieces(ring: dict, size: int) -> Iterator[tuple[slice, slice]]:
        """Stretches of a block and the places of the ring that they read and then fill."""
        done, n = 0, len(ring["line"])
        while done < size:
            m = min(size - done, n - ring["at"])
            yield slice(done, done + m), slice(ring["at"], ring["at"] + m)
            done, ring["at"] = done + m, (ring["at"] + m) % n

    def comb(self, v: np.ndarray, ring: dict) -> np.ndarray:
        out = np.empty(len(v))
        for own, place in self.pieces(ring, len(v)):
            y = out[own] = ring["line"][place].copy()
            smooth = recurse([1 - self.damp], [1.0, -self.damp], y, np.array([ring["low"]]))
            ring["low"] = smooth[-1]
            ring["line"][place] = v[own] + smooth * self.feedback
        return out

    def allpass(self, v: np.ndarray, ring: dict) -> np.ndarray:
        out = np.empty(len(v))
        for own, place in self.pieces(ring, len(v)):
            y = ring["line"][place].copy()
            ring["line"][place] = v[own] + y * 0.5
            out[own] = y - v[own]
        return out

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        v = s / FULL
        late = np.concatenate([state["early"], v], axis=1)
        state["early"] = late[:, v.shape[1] :]
        wet = []
        for row, sides in zip(late[:, : v.shape[1]], state["sides"]):
            wet.append([])
            for combs, passes in sides:
                y = sum(self.comb(row, ring) for ring in combs)
                for ring in passes:
                    y = self.allpass(y, ring)
                wet[-1].append(y * self.gain)
        return to_samples(np.stack(self.mixed(v, wet)).astype(np.float32).astype(float))

    def drain(self, state: dict) -> None:
        return None


# --- requantising ---


def lcg(seed: int, count: int) -> np.ndarray:
    """count draws of the 32-bit generator x <- 1664525 x + 1013904223 after seed, as signed values; by doubling."""
    a, c = np.array([1664525], np.uint64), np.array([1013904223], np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    while len(a) < count:
        a, c = np.concatenate([a, a * a[-1] & mask]), np.concatenate([c, (a * c[-1] + c) & mask])
    return ((a[:count] * np.uint64(seed & 0xFFFFFFFF) + c[:count]) & mask).astype(np.uint32).view(np.int32)


@dataclass(frozen=True)
class Dither:
    """To so many bits: see sequential.dither. fed: taps over past errors; own: taps over the shaper's past outputs."""

    bits: int
    fed: list[float]
    own: list[float]
    slope: bool
    seed: int
    rests: int | None

    def start(self, channels: int) -> dict:
        return {"seed": [self.seed + c for c in range(channels)], "draw": [0] * channels, "since": [1 << 30] * channels, "was_on": [False] * channels, "errors": [[0.0] * len(self.fed)] * channels, "outputs": [[0.0] * len(self.own)] * channels}

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        return np.stack([self.channel(state, c, row) for c, row in enumerate(s)])

    def channel(self, state: dict, c: int, s: np.ndarray) -> np.ndarray:
        step, s = 1 << (32 - self.bits), s.astype(np.int64)
        on = np.ones(len(s), bool)
        if self.rests is not None:
            n = np.arange(len(s))
            since = n - np.maximum.accumulate(np.where(s & (step - 1), n, -1 - state["since"][c]))
            on = since < self.rests
            state["since"][c] = int(since[-1]) if len(s) else state["since"][c]
        v = s[on].astype(float)
        draws = lcg(state["seed"][c], len(v) * (1 if self.slope else 2))
        state["seed"][c] = int(draws[-1]) if len(draws) else state["seed"][c]
        draws = draws.astype(np.int64) >> self.bits
        if self.slope:
            noise = np.diff(draws, prepend=state["draw"][c])
            state["draw"][c] = int(draws[-1]) if len(draws) else state["draw"][c]
        else:
            noise = draws[::2] + draws[1::2]
        if not self.fed:
            q = np.trunc((v + noise) / step + np.where(v + noise < 0, -0.5, 0.5))
        else:
            q = self.shaped(state, c, v, noise, step, on)
        state["was_on"][c] = bool(on[-1]) if len(s) else state["was_on"][c]
        out = s.copy()
        top = 1 << (self.bits - 1)
        out[on] = (np.clip(q, -top, top - 1) * step).astype(np.int64)
        return out

    def shaped(self, state: dict, c: int, v: np.ndarray, noise: np.ndarray, step: int, on: np.ndarray) -> np.ndarray:
        errors, outputs = state["errors"][c], state["outputs"][c]
        place = np.flatnonzero(on)
        begins = np.diff(place, prepend=-1 if state["was_on"][c] else -2) > 1  # after a rest nothing is fed back
        q = []
        for u, w, fresh in zip(v.tolist(), noise.tolist(), begins.tolist()):
            if fresh:
                errors, outputs = [0.0] * len(self.fed), [0.0] * len(self.own)
            back = sum(a * e for a, e in zip(self.fed, errors)) - sum(a * o for a, o in zip(self.own, outputs))
            want = u / step - back
            noisy = want + w / step
            level = math.trunc(noisy + (-0.5 if noisy < 0 else 0.5))
            q.append(level)
            errors, outputs = [level - want, *errors[:-1]], [back, *outputs[:-1]] if self.own else []
        state["errors"][c], state["outputs"][c] = errors, outputs
        return np.array(q, float)

    def drain(self, state: dict) -> None:
        return None


def tapers(window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a frame and of its magnitudes."""
    return design.window("hann", window) * 2 / math.sqrt(window), design.window("hann", width) * 2 / math.sqrt(width)
