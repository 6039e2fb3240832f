"""Operators on single samples and on wide samples: expressions in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.numeric import FULL, MAX, MIN, linear, rounded, truncated
from ..signal import KEYS, Signal


def vol(x: Signal, gain: float, kind: str = "amplitude", limiter: float | None = None) -> Signal:
    """Times a gain (amplitude, dB, or power: the signed root), fraction cut; above a limiter's threshold the slope is eased."""
    g = linear(gain) if kind == "dB" else math.copysign(math.sqrt(abs(gain)), gain) if kind == "power" else gain
    if g == 1:
        return x
    if limiter is None or abs(g) < 1:
        return x.map(lambda s: truncated(s * F.lit(g)))
    edge = MAX * (1 - limiter) / (abs(g) - limiter)
    sign = math.copysign(1, g)
    return x.map(lambda s: truncated(F.when(s > edge, sign * (MAX - limiter * (MAX - s))).when(s < -edge, -sign * (MAX - limiter * (MAX + s))).otherwise(s * F.lit(g))))


def gain(x: Signal, db: float, limit: bool = False) -> Signal:
    """Times a gain in dB, rounded; limit: a soft limiter in place of clipping."""
    g = linear(db)
    if not limit:
        return x if g == 1 else x.map(lambda s: rounded(s * F.lit(g)))
    k = (1 - 1 / g) / MAX

    def soft(s: Column) -> Column:
        d = s * F.lit(g)
        return F.when(d > 0, truncated(1 / (1 / d + k) + 0.5)).when(d < 0, truncated(1 / (1 / d - k) - 0.5)).otherwise(F.lit(0))

    return x.map(soft)


def dcshift(x: Signal, shift: float, limiter: float | None = None) -> Signal:
    """Plus a share of full scale, rounded; with a limiter, samples beyond its threshold are eased instead of clipped."""
    if limiter is None:
        return x.map(lambda s: rounded(s + F.lit(shift * FULL)))
    edge = MAX * (1 - (abs(shift) - limiter))

    def eased(s: Column) -> Column:
        if shift > 0:
            return F.when(s > edge, truncated((s - edge) * limiter / (MAX - edge) + edge + shift)).otherwise(truncated(s + F.lit(shift * FULL)))
        return F.when(s < -edge, truncated((s + edge) * limiter / (MAX - edge) - edge + shift)).otherwise(truncated(s + F.lit(shift * FULL)))

    return x.map(eased)


def contrast(x: Signal, amount: float = 75) -> Signal:
    def bent(s: Column) -> Column:
        d = s * F.lit(math.pi / 2 / FULL)
        return truncated(F.sin(d + F.sin(d * 4) * F.lit(amount / 750)) * MAX)

    return x.map(bent)


def matrix(x: Signal, rows: list[list[tuple[int, float]]]) -> Signal:
    """Output channel j is the rounded sum of factor * channel over rows[j]; an empty row is silence.

    The rows of one input channel are few literals, so the projection is one explode and one sum by wide sample.
    """
    places: dict[int, list[tuple[int, float]]] = {}
    for j, row in enumerate(rows):
        for c, f in row:
            places.setdefault(c, []).append((j, f))
    empty = [j for j, row in enumerate(rows) if not row]
    if empty:  # a silent channel has the length of the stream: it rides on channel 0
        places.setdefault(0, []).extend((j, 0.0) for j in empty)
    pairs = F.lit(None).cast("array<struct<j:int,f:double>>")
    for c, found in places.items():
        pairs = F.when(F.col("channel") == c, F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(f)).alias("f")) for j, f in found])).otherwise(pairs)
    out = x.df.select("stream_id", "n", "s", F.explode(pairs).alias("p"))
    if all(len(r) < 2 for r in rows):  # no sum: no shuffle
        s = F.when(F.col("p.f") == 1.0, F.col("s")).otherwise(rounded(F.col("s") * F.col("p.f")))  # a copy is as it was
        out = out.select("stream_id", F.col("p.j").alias("channel"), "n", s.alias("s"))
    else:
        out = out.groupBy("stream_id", F.col("p.j").alias("channel"), "n").agg(rounded(F.sum(F.col("s") * F.col("p.f"))).alias("s"))
    return x.with_df(out, channels=len(rows), precision=32)


def remix(x: Signal, specs: list[str], power: bool = False) -> Signal:
    """Output channels by text: '1,2' the mean, '1-3', '0' silence, factors 'v0.5', 'p-3' (dB) and 'i-3' (inverted dB)."""
    rows = []
    for spec in specs:
        found: list[tuple[int, float | None]] = []
        for part in spec.split(","):
            m = part.strip()
            factor: float | None = None
            for k, letter in enumerate(m):
                if letter in "vpi":
                    value = m[k + 1 :]
                    factor = float(value or 1) if letter == "v" else (1 if letter == "p" else -1) * linear(float(value or 0))
                    m = m[:k]
                    break
            if m in ("0", ""):
                if m == "0":
                    continue
                m = "-"
            a, dash, b = m.partition("-")
            lo, hi = int(a or 1), int(b or (x.channels if dash else a))
            found += [(c - 1, factor) for c in range(lo, hi + 1)]
        n = len(found)
        plain = 1 / math.sqrt(n) if power and n else 1 / n if n else 0.0
        semi = any(f is not None for _, f in found)
        rows.append([(c, f if f is not None else 1.0 if semi else plain) for c, f in found])
    if any(c >= x.channels or c < 0 for row in rows for c, _ in row):
        raise ValueError("remix: no such channel")
    return matrix(x, rows)


def channels(x: Signal, count: int) -> Signal:
    """Fewer channels: means of every count-th; more: repetitions."""
    if count == x.channels:
        return x
    if count < x.channels:
        groups = [[c for c in range(j, x.channels, count)] for j in range(count)]
        return matrix(x, [[(c, 1 / len(g)) for c in g] for g in groups])
    return matrix(x, [[(j % x.channels, 1.0)] for j in range(count)])


def oops(x: Signal) -> Signal:
    """Both outputs are left less right."""
    return matrix(x, [[(0, 1.0), (1, -1.0)]] * 2)


def swap(x: Signal) -> Signal:
    """Channels of each pair change places; an odd last one stays."""
    to = F.col("channel").bitwiseXOR(1)
    return x.with_df(x.df.withColumn("channel", F.when(to < x.channels, to).otherwise(F.col("channel"))))


def divide(x: Signal) -> Signal:
    """Each further channel divided by the first; where that is 0, the last quotient before is held (0 at the start)."""
    base = x.df.where("channel = 0").select("stream_id", "n", F.col("s").alias("by"))
    rest = x.df.where("channel > 0").join(base, ["stream_id", "n"])
    w = Window.partitionBy("stream_id", "channel").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col("by") != 0, rounded(F.col("s") / F.col("by") * FULL))
    held = rest.withColumn("s", F.coalesce(F.last(q, ignorenulls=True).over(w), F.lit(0)))
    return x.with_df(x.df.where("channel = 0").unionByName(held.select(*KEYS, "s")))


def tremolo(x: Signal, speed: float, depth: float = 40) -> Signal:
    """Times a sine from 1 down to 1 - depth%, at `speed` Hz, starting a quarter in."""
    offset = 1 - depth / 200
    phase = F.lit(2 * math.pi) * (F.pmod(F.col("n") * (speed / x.rate) + 0.25, F.lit(1.0)))
    return x.map(lambda s: rounded(s * (F.sin(phase) * (1 - offset) + offset)))


def fade(x: Signal, into: int, stop: int | None = None, out: int | None = None, shape: str = "l") -> Signal:
    """Fades in over `into` samples and out before `stop` (samples; None: no fade out; 0: the end), cut there, padded to it.

    shapes: q quarter sine, h half sine, l logarithmic (100 dB), t linear, p parabola. The fraction is cut off.
    """
    curve = {
        "q": lambda i: F.sin(i * (math.pi / 2)), "h": lambda i: (1 - F.cos(i * math.pi)) / 2, "l": lambda i: F.pow(F.lit(0.1), (1 - i) * 5), "t": lambda i: i, "p": lambda i: 1 - (1 - i) * (1 - i),
    }[shape]
    n = F.col("n")
    df = x.df
    factor = F.lit(1.0)
    if stop is not None:
        fall = into if out is None else out
        if stop == 0:
            df = x.with_length()
            end = F.col("length")
        else:
            from .rows import padded_to

            df = padded_to(x.df, stop).where(n < stop)
            end = F.lit(stop)
        if fall:
            factor = F.when(n >= end - fall, curve((end - n) / F.lit(float(fall)))).otherwise(factor)
    if into:
        factor = F.when(n < into, curve(n / F.lit(float(into)))).otherwise(factor)
    return x.with_df(df.withColumn("s", truncated(F.col("s") * factor)), precision=32)


def upsample(x: Signal, factor: int = 2) -> Signal:
    """factor - 1 zeros after each sample."""
    k = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    out = x.df.select("stream_id", "channel", (F.col("n") * factor).alias("m"), "s", k.alias("k"))
    return x.with_df(out.select("stream_id", "channel", (F.col("m") + F.col("k")).alias("n"), F.when(F.col("k") == 0, F.col("s")).otherwise(0).alias("s")), rate=x.rate * factor)


def downsample(x: Signal, factor: int = 2) -> Signal:
    """Every factor-th sample."""
    return x.with_df(x.df.where(F.col("n") % factor == 0).withColumn("n", F.floor(F.col("n") / factor)), rate=x.rate / factor)


def speed(x: Signal, factor: float) -> Signal:
    """The same samples at another rate."""
    return x.with_df(x.df, rate=x.rate * factor)


def quantise(x: Signal, bits: int) -> Signal:
    """Samples of so many bits, in 32."""
    from ..functions.numeric import from_bits, to_bits

    return x.map(lambda s: from_bits(to_bits(s, bits), bits), precision=bits)


def with_clips(x: Signal, factor: float):
    """(channel, clips) that a gain makes: what rounding saturates."""
    d = F.col("s") * F.lit(factor)
    return x.df.groupBy("stream_id", "channel").agg(F.count_if((d >= MAX + 0.5) | (d <= MIN - 0.5)).alias("clips"))
