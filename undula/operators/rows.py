"""Operators that choose, shift, insert or repeat samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..signal import KEYS, Signal

#: Rows of silence that one row is blown up to at once.
ZEROS = 1 << 14


def intervals(positions: list[int]) -> list[tuple[int, int | None]]:
    """Stretches kept by a toggle at each position; an odd number leaves the last open."""
    ends: list[int | None] = [*positions, None] if len(positions) % 2 else list(positions)
    return [(a, b) for a, b in zip(ends[::2], ends[1::2]) if b is None or b > a]


#: Positions that an expression may name; longer lists are joined by the block that a place lies in.
NAMED = 16
#: Positions that may be sent to the executors.
MOST = 1_000_000


def piecewise(x: Signal, pieces: list[tuple[int, int | None]]) -> DataFrame:
    """x's rows with n moved: of ascending (from, offset) the last one whose `from` isn't beyond a row's n says by how much, or
    with None that the row goes. Rows before the first go.

    Short lists are an expression. A longer one becomes a table of blocks of places, each with the pieces that begin in it or
    last into it, which is broadcast (its length is checked) and joined by the block: a row meets the few pieces of its block.
    """
    n = F.col("n")
    if len(pieces) <= NAMED:
        offset = F.lit(None).cast("bigint")
        for begin, by in pieces:
            offset = F.when(n >= begin, F.lit(by).cast("bigint")).otherwise(offset)
        return x.df.withColumn("_by", offset).where("_by IS NOT NULL").withColumn("n", n + F.col("_by")).drop("_by")
    if len(pieces) > MOST:
        raise ValueError(f"more than {MOST} positions")
    size = max(1, (pieces[-1][0] - pieces[0][0]) // len(pieces))
    last = pieces[-1][0] // size
    held: dict[int, list] = {}
    for k, (begin, by) in enumerate(pieces):
        end = pieces[k + 1][0] if k + 1 < len(pieces) else begin + 1
        for block in range(begin // size, (end - 1) // size + 1):
            held.setdefault(block, []).append((begin, by))
    spark = x.df.sparkSession
    table = spark.createDataFrame(pd.DataFrame({"_block": list(held), "_from": [[p[0] for p in v] for v in held.values()], "_offset": [[0 if p[1] is None else p[1] for p in v] for v in held.values()], "_stays": [[p[1] is not None for p in v] for v in held.values()]}), "_block bigint, _from array<bigint>, _offset array<bigint>, _stays array<boolean>")
    block = F.least(F.floor(n / size), F.lit(last)).cast("bigint")
    met = x.df.where(n >= pieces[0][0]).withColumn("_block", block).join(F.broadcast(table), "_block")
    place = F.size(F.filter("_from", lambda p: p <= n))
    at = met.withColumn("_at", place).where("_at > 0 AND element_at(_stays, _at)")
    return at.withColumn("n", n + F.expr("element_at(_offset, _at)"))


def trim(x: Signal, positions: list[int]) -> Signal:
    """Keeps what lies between pairs of positions (in samples), joined. The range predicate reaches the scan."""
    kept, pieces, first = intervals(positions), [], 0
    n = F.col("n")
    for a, b in kept:
        pieces += [(a, first - a)] + ([] if b is None else [(b, None)])
        first += 0 if b is None else b - a
    if not kept:
        return x.with_df(x.df.where(F.lit(False)))
    inside = n >= kept[0][0] if kept[-1][1] is None else (n >= kept[0][0]) & (n < kept[-1][1])
    return x.with_df(piecewise(x.with_df(x.df.where(inside)), pieces))


def trim_end(x: Signal, start: int, before_end: int) -> Signal:
    """From start to `before_end` samples before the end."""
    df = x.with_length().where((F.col("n") >= start) & (F.col("n") < F.col("length") - before_end))
    return x.with_df(df.withColumn("n", F.col("n") - start))


def zeros(places: DataFrame, start, count) -> DataFrame:
    """count rows of silence from start on, for each (stream_id, channel) of places."""
    sized = places.select("stream_id", "channel", start.cast("bigint").alias("_s"), count.cast("bigint").alias("_c")).where("_c > 0")
    # a long stretch is made in runs, so that no row holds it whole
    runs = sized.withColumn("_r", F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / ZEROS)))).withColumn("_f", F.col("_s") + F.col("_r") * ZEROS)
    filled = runs.withColumn("n", F.explode(F.sequence(F.col("_f"), F.least(F.col("_f") + ZEROS, F.col("_s") + F.col("_c")) - 1)))
    return filled.select("stream_id", "channel", "n", F.lit(0).alias("s"))


def padded_to(df: DataFrame, length: int) -> DataFrame:
    ends = df.groupBy("stream_id", "channel").agg((F.max("n") + 1).alias("_l"))
    return df.select(*KEYS, "s").unionByName(zeros(ends, F.col("_l"), F.lit(length) - F.col("_l")))


def pad(x: Signal, before: int = 0, after: int = 0, inside: list[tuple[int, int]] = ()) -> Signal:
    """Silence before and after, and (count, position) in the input inside."""
    at = sorted(p for p in [(0, before), *((place, count) for count, place in inside)] if p[1])
    pieces, gaps, total = [(0, 0)], [], 0
    for place, count in at:
        gaps.append((place, place + total, count))
        total += count
        pieces = [p for p in pieces if p[0] != place] + [(place, total)]
    ends = x.df.groupBy("stream_id", "channel").agg((F.max("n") + 1).alias("_l"))
    out = piecewise(x, pieces).select(*KEYS, "s")
    if gaps:
        array = lambda k: f"array({', '.join(f'{g[k]}L' for g in gaps)})"
        each = ends.withColumns({c: F.expr(array(k)) for k, c in enumerate(("place", "start", "count"))}).select("stream_id", "channel", "_l", F.explode(F.arrays_zip("place", "start", "count")).alias("_g"))
        out = out.unionByName(zeros(each.where("_l >= _g.place"), F.col("_g.start"), F.col("_g.count")))
    return x.with_df(out.unionByName(zeros(ends, F.col("_l") + sum(g[2] for g in gaps), F.lit(after))))


def repeat(x: Signal, count: int = 1) -> Signal:
    """The signal count + 1 times."""
    df = x.with_length().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(count))))
    return x.with_df(df.withColumn("n", F.col("n") + F.col("_k") * F.col("length")))


def reverse(x: Signal) -> Signal:
    """Back to front: an index map, without a sort."""
    return x.with_df(x.with_length().withColumn("n", F.col("length") - 1 - F.col("n")))


def delay(x: Signal, by: list[int]) -> Signal:
    """Channels later by so many samples each; all grow by the largest."""
    longest = max([0, *by])
    own = F.lit(0)
    for c, d in enumerate(by):
        own = F.when(F.col("channel") == c, d).otherwise(own)
    ends = x.df.groupBy("stream_id", "channel").agg((F.max("n") + 1).alias("_l"))
    moved = x.df.withColumn("n", F.col("n") + own)
    return x.with_df(moved.unionByName(zeros(ends, F.lit(0), own)).unionByName(zeros(ends, F.col("_l") + own, F.lit(longest) - own)))


def segments(x: Signal, length: int) -> DataFrame:
    """Rows with a segment number and places from 0 in it: what a writer of several files partitions by."""
    return x.df.withColumn("segment", F.floor(F.col("n") / length)).withColumn("n", F.col("n") % length)
