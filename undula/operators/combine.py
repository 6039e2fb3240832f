"""Several signals into one."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from ..functions.numeric import FULL, rounded
from ..plans import comments
from ..signal import Signal
from . import maps


def _checked(inputs: list[Signal]) -> list[Signal]:
    if len({x.rate for x in inputs}) > 1:
        raise ValueError("the inputs' rates differ")
    return inputs


def _stacked(inputs: list[Signal], factor: float):
    parts = [x.df.withColumn("s", rounded(F.col("s") * F.lit(factor)) if factor != 1 else F.col("s")).withColumn("i", F.lit(k)) for k, x in enumerate(_checked(inputs))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def scaled(inputs: list[Signal], volumes: list[float | None]) -> list[Signal]:
    """The inputs, each at its own volume; None: as it is."""
    if len(volumes) != len(inputs):
        raise ValueError("a volume, or None, is due for each input")
    return [x if v is None or v == 1 else x.map(lambda s, v=v: rounded(s * F.lit(float(v)))) for x, v in zip(inputs, volumes)]


def replay_gain(x: Signal, of: str = "track") -> Signal:
    """At the gain that a comment REPLAYGAIN_TRACK_GAIN or REPLAYGAIN_ALBUM_GAIN names, as '-3.2 dB'; without one, as it is."""
    told = comments.find(x.comments, f"REPLAYGAIN_{of.upper()}_GAIN")
    return maps.gain(x, float(told.split()[0])) if told else x


def mix(inputs: list[Signal], factor: float | None = None, volumes: list[float | None] | None = None) -> Signal:
    """Sum by channel and place, each input times 1/n (or factor); rounded and clipped after each addition, in input order.

    volumes: the inputs' own, in place of 1/n.

    A wide sample gathers as many rows as there are inputs, so the ordered fold is over a bounded array.
    """
    if volumes is not None:
        inputs, factor = scaled(inputs, volumes), 1.0 if factor is None else factor
    rows = _stacked(inputs, 1 / len(inputs) if factor is None else factor)
    ordered = F.array_sort(F.collect_list(F.struct("i", "s")))
    out = rows.groupBy("stream_id", "channel", "n").agg(F.aggregate(ordered, F.lit(0), lambda a, v: rounded(a.cast("double") + v["s"])).alias("s"))
    return inputs[0].with_df(out, channels=max(x.channels for x in inputs), precision=32)


def mix_power(inputs: list[Signal]) -> Signal:
    """As mix, each input times 1/sqrt(n)."""
    return mix(inputs, 1 / math.sqrt(len(inputs)))


def multiply(inputs: list[Signal]) -> Signal:
    """Product by channel and place, in units of full scale; rounded after each factor. A missing sample is 0."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "s")))
    folded = F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), ordered[0]["s"].cast("bigint"), lambda a, v: rounded(a.cast("double") * v["s"] / FULL).cast("bigint"))
    out = _stacked(inputs, 1).groupBy("stream_id", "channel", "n").agg(F.when(F.count(F.lit(1)) == len(inputs), folded).otherwise(0).alias("s"))
    return inputs[0].with_df(out, channels=max(x.channels for x in inputs), precision=32)


def merge(inputs: list[Signal]) -> Signal:
    """Channels of all inputs side by side, short ones padded with silence."""
    from .rows import zeros

    base, parts = 0, []
    for x in _checked(inputs):
        parts.append(x.df.withColumn("channel", F.col("channel") + base))
        base += x.channels
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    ends = rows.groupBy("stream_id", "channel").agg((F.max("n") + 1).alias("_l"))
    longest = ends.groupBy("stream_id").agg(F.max("_l").alias("_m"))
    grid = longest.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(base - 1)))).join(ends, ["stream_id", "channel"], "left").withColumn("_l", F.coalesce("_l", F.lit(0)))
    return inputs[0].with_df(rows.unionByName(zeros(grid, F.col("_l"), F.col("_m") - F.col("_l"))), channels=base)


def concatenate(inputs: list[Signal]) -> Signal:
    """One after the other; places go on. Streams that an input lacks add nothing."""
    rows = _stacked(inputs, 1)
    if len({x.channels for x in inputs}) > 1:
        raise ValueError("the inputs' channels differ")
    sizes = rows.groupBy("stream_id", "i").agg((F.max("n") + 1).alias("_l"))
    before = sizes.withColumnRenamed("i", "j").join(sizes.select("stream_id", "i"), "stream_id").where("j < i").groupBy("stream_id", "i").agg(F.sum("_l").alias("_b"))
    out = rows.join(before, ["stream_id", "i"], "left").withColumn("n", F.col("n") + F.coalesce("_b", F.lit(0)))
    return inputs[0].with_df(out)


def sequence(inputs: list[Signal]) -> list[Signal]:
    """Runs of inputs of one rate and channel count, each concatenated: one output a run."""
    groups: list[list[Signal]] = []
    for x in inputs:
        if groups and (groups[-1][0].rate, groups[-1][0].channels) == (x.rate, x.channels):
            groups[-1].append(x)
        else:
            groups.append([x])
    return [concatenate(g) for g in groups]
