"""Statistics of signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import FULL, MAX, MIN, decibels, linear, rounded
from ..signal import Signal

BY = ["stream_id", "channel"]


def stats_core(x: Signal, by: list[str] = BY) -> DataFrame:
    """Offset, extremes, levels, peak count and bit mask by channel (or by stream): one aggregation with partial sums."""
    v = F.col("s") / F.lit(FULL)
    out = x.df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg(v).alias("dc"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v * v).alias("power"), F.bit_or("s").alias("mask"))
    peak = F.greatest(F.abs("min"), F.abs("max"))
    return out.select(*by, "samples", "dc", "min", "max", decibels(peak).alias("peak_db"), decibels(F.sqrt("power")).alias("rms_db"), F.when(F.col("power") > 0, peak / F.sqrt("power")).otherwise(1.0).alias("crest"), "mask")


def bit_depth(mask):
    """Bits in use: 32 less the zeros below the lowest bit that any sample has."""
    low = mask.bitwiseAND(-mask)
    return F.when(mask == 0, 0).otherwise(F.lit(32) - F.round(F.log2(F.abs(low.cast("double")))).cast("int"))


def flat_runs(x: Signal) -> DataFrame:
    """(stream_id, channel, peak_count, flat_db): samples at the extremes, and how squared runs of them are long."""
    ends = x.df.groupBy(*BY).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    w = Window.partitionBy(*BY).orderBy("n")
    at = x.df.join(ends, BY).withColumn("edge", F.when(F.col("s") == F.col("lo"), -1).when(F.col("s") == F.col("hi"), 1).otherwise(0))
    new = F.when(F.col("edge") != F.coalesce(F.lag("edge").over(w), F.lit(2)), 1).otherwise(0)
    runs = at.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("edge != 0").groupBy(*BY, "run").agg(F.count(F.lit(1)).alias("m"))
    return runs.groupBy(*BY).agg(F.sum("m").alias("peak_count"), (F.lit(20.0) * F.log10(F.sum(F.col("m") * F.col("m")) / F.sum("m"))).alias("flat_db"))


def rms_window(x: Signal, seconds: float = 0.05) -> DataFrame:
    """(stream_id, channel, peak, trough): extremes of the exponentially averaged power, from 5 time constants on.

    The average is a linear recursion, so it is scanned in blocks (see operators.scan). Signals shorter than that have the
    mean power as both.
    """
    from .scan import recursive_by_channel

    m = math.exp(-1 / (seconds * x.rate))
    power = x.df.select(*BY, "n", (F.pow(F.col("s") / F.lit(FULL), 2) * (1 - m)).alias("v"))
    smooth = recursive_by_channel(power, [1.0], [1.0, -m])
    ripe = F.col("n") + 1 >= math.floor(5 * seconds * x.rate + 0.5)
    out = smooth.groupBy(*BY).agg(F.max(F.when(ripe, F.col("y"))).alias("peak"), F.min(F.when(ripe, F.col("y"))).alias("trough"))
    return out


def stats(x: Signal, seconds: float = 0.05) -> DataFrame:
    """All fields by channel: core, peak count, flat factor, RMS peak and trough in dB, bit depth, length."""
    core = stats_core(x).join(flat_runs(x), BY).join(rms_window(x, seconds), BY)
    level = lambda c: F.lit(10.0) * F.log10(F.coalesce(F.col(c), F.pow(F.lit(10.0), F.col("rms_db") / 10)))
    return core.select(*BY, "samples", "dc", "min", "max", "peak_db", "rms_db", level("peak").alias("rms_peak_db"), level("trough").alias("rms_trough_db"), "crest", "flat_db", "peak_count", bit_depth(F.col("mask")).alias("bits"), (F.col("samples") / x.rate).alias("seconds"))


def stats_overall(x: Signal) -> DataFrame:
    """One row a stream, rolled up by field: the offset of the largest magnitude, extremes, pooled level, mean peak count."""
    c = stats_core(x).join(flat_runs(x), BY)
    power = F.pow(F.lit(10.0), F.col("rms_db") / 10)
    return c.groupBy("stream_id").agg(F.max_by("dc", F.abs("dc")).alias("dc"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("peak_db").alias("peak_db"), (F.lit(10.0) * F.log10(F.sum(power * F.col("samples")) / F.sum("samples"))).alias("rms_db"), (F.sum("peak_count") / F.count(F.lit(1))).alias("peak_count"), F.max("samples").alias("samples"))


def stat(x: Signal) -> DataFrame:
    """Statistics of all channels together; differences run through the interleaved samples."""
    w = Window.partitionBy("stream_id").orderBy("n", "channel")
    v = x.df.withColumn("v", F.col("s") / F.lit(FULL))
    v = v.withColumn("d", F.abs(F.col("v") - F.lag("v").over(w)))
    a = v.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("v").alias("max"), F.min("v").alias("min"), F.avg(F.abs("v")).alias("mean_norm"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.max("d").alias("delta_max"), F.lit(0.0).alias("delta_min"), F.sum("d").alias("_ds"), F.sum(F.col("d") * F.col("d")).alias("_d2"), F.sum(F.col("v") * F.col("v")).alias("_v2"),
    )
    amp = F.greatest(-F.col("min"), F.col("max"))
    rest = F.greatest(F.col("samples") - 1, F.lit(1))
    return a.select("stream_id", "samples", "max", "min", ((F.col("max") + F.col("min")) / 2).alias("mid"), "mean_norm", "mean", "rms", "delta_max", "delta_min", (F.col("_ds") / rest).alias("delta_mean"), F.sqrt(F.col("_d2") / rest).alias("delta_rms"), F.floor(F.when(F.col("_v2") > 0, F.sqrt(F.col("_d2") / F.col("_v2"))).otherwise(0.0) * (x.rate / (2 * math.pi))).alias("rough_frequency"), F.when(amp > 0, F.lit(MAX / FULL) / amp).alias("volume_adjustment"))


def quarters(x: Signal) -> DataFrame:
    """(stream_id, quarter, samples): a histogram of the top two bits, from which an encoding is guessed."""
    return x.df.groupBy("stream_id", F.shiftright("s", 30).alias("quarter")).agg(F.count(F.lit(1)).alias("samples"))


def encoding_guess(x: Signal) -> DataFrame:
    """(stream_id, guess) from the quarters: outer ones filled like inner ones point to the wrong signedness."""
    q = quarters(x).groupBy("stream_id").pivot("quarter", [-2, -1, 0, 1]).sum("samples").na.fill(0)
    outer, inner = F.col("-2") + F.col("1"), F.col("-1") + F.col("0")
    ratio = F.when(inner > 0, outer / inner)
    return q.select("stream_id", F.when(ratio.isNull() | (ratio > 3), "unsigned").when(ratio < 1 / 3, "signed").when((ratio > 0.5) & (ratio < 2), "logarithmic or noise").otherwise("unknown").alias("guess"))


def normalise(x: Signal, db: float = 0.0, balance: str = "") -> Signal:
    """To a peak level. balance: '' all channels by one gain, 'e' each channel to the largest peak, 'B' to the largest power, 'b' too,
    but all lower by as much as the channel that would clip most."""
    v = F.col("s").cast("double")
    if not balance:
        g = x.df.groupBy("stream_id").agg(F.greatest(F.max("s"), F.lit(1)).alias("hi"), F.least(F.min("s"), F.lit(-1)).alias("lo"))
        factor = F.least(F.lit(float(MAX)) / F.col("hi"), F.lit(float(MIN)) / F.col("lo")) * linear(db)
        df = x.df.join(g.select("stream_id", factor.alias("_g")), "stream_id")
    else:
        own = x.df.groupBy(*BY).agg((F.max(F.abs(v)) if balance == "e" else F.sqrt(F.avg(v * v))).alias("level"), F.max("s").alias("hi"), F.min("s").alias("lo"))
        top = own.groupBy("stream_id").agg(F.max("level").alias("top"))
        own = own.join(top, "stream_id").select(*BY, F.when(F.col("level") > 0, F.col("top") / F.col("level")).otherwise(1.0).alias("_g"), "hi", "lo")
        if balance == "b":
            room = F.least(F.lit(float(MAX)) / F.greatest(F.col("hi"), F.lit(1)), F.lit(float(MIN)) / F.least(F.col("lo"), F.lit(-1))) / F.col("_g")
            own = own.join(own.groupBy("stream_id").agg(F.least(F.lit(1.0), F.min(room)).alias("_r")), "stream_id").withColumn("_g", F.col("_g") * F.col("_r"))
        df = x.df.join(own.select(*BY, "_g"), BY).withColumn("_g", F.col("_g") * linear(db))
    return x.with_df(df.withColumn("s", rounded(F.col("s") * F.col("_g"))), precision=32)


def reclaim(x: Signal, db: float = 0.0) -> Signal:
    """Room made before is given back, as far as nothing clips, and the level changed by db."""
    g = x.df.groupBy("stream_id").agg(F.greatest(F.max("s"), F.lit(1)).alias("hi"), F.least(F.min("s"), F.lit(-1)).alias("lo"))
    most = F.least(F.lit(float(MAX)) / F.col("hi"), F.lit(float(MIN)) / F.col("lo"))
    df = x.df.join(g.select("stream_id", (F.least(F.lit(1 / x.headroom), most) * linear(db)).alias("_g")), "stream_id")
    return x.with_df(df.withColumn("s", rounded(F.col("s") * F.col("_g"))), precision=32, headroom=1.0)


def meter(x: Signal, seconds: float = 0.1) -> DataFrame:
    """(stream_id, channel, window, peak_db): a level meter's reading for each window; silence reads -200 dB."""
    size = max(1, int(x.rate * seconds + 0.5))
    peak = F.max(F.abs(F.col("s") / F.lit(FULL)))
    return x.df.groupBy(*BY, F.floor(F.col("n") / size).alias("window")).agg(decibels(F.greatest(peak, F.lit(1e-10))).alias("peak_db"))


def headroom(x: Signal) -> DataFrame:
    """(stream_id, db): by how much a stream can be raised before it clips."""
    peak = F.max(F.abs(F.col("s") / F.lit(FULL)))
    return x.df.groupBy("stream_id").agg((F.lit(0.0) - decibels(F.greatest(peak, F.lit(1e-10)))).alias("db"))
