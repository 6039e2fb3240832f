"""Linear recursions in parallel over blocks.

y = B(z)/A(z) x is an affine map of the block's samples and of the last outputs before it. Blocks are solved from silence on
all executors, the last outputs are carried through the blocks of a channel in a small table, and each block adds its response
to what is carried in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design
from ..functions.numeric import rounded
from ..signal import Signal, joined

BY = ["stream_id", "channel"]
BLOCK = 1 << 12
#: Rows that a task solves at once, about: its blocks advance side by side.
AT_ONCE = 1 << 18


def recurse(b, a, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """y for a filter whose input starts here; before: the outputs y[-1], y[-2], ... before it."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    order = len(a) - 1
    w = np.zeros(len(x))
    for k, c in enumerate(b[: len(x)]):
        w[k:] += c * np.asarray(x, float)[: len(x) - k]
    if not order or not len(w):
        return w
    past = [0.0] * order if before is None else [float(v) for v in np.asarray(before, float)[:order]]
    back, out = a[1:].tolist(), w.tolist()
    for n, v in enumerate(out):
        for c, p in zip(back, past):
            v -= c * p
        out[n] = v
        past = [v, *past[:-1]]
    return np.array(out)


def responses(a, size: int) -> np.ndarray:
    """(size, order): what each output before a block adds in it."""
    order = len(a) - 1
    return np.stack([recurse([1.0], a, np.zeros(size), np.eye(order)[k]) for k in range(order)], 1) if order else np.zeros((size, 0))


def _edges(t: pa.Table, names: list[str]) -> np.ndarray:
    """Places at which rows of other keys begin, 0 first."""
    fresh = np.zeros(max(0, t.num_rows - 1), bool)
    for c in names:
        column = t.column(c).combine_chunks()
        v = (column.dictionary_encode(null_encoding="encode").indices if pa.types.is_string(column.type) else column).to_numpy(zero_copy_only=False)
        fresh |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(fresh) + 1]) if t.num_rows else np.empty(0, np.int64)


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of AT_ONCE rows or so that don't cut a key, and where keys begin."""
    held: list[pa.RecordBatch] = []
    size, due = 0, AT_ONCE
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= due:
            t = pa.Table.from_batches(held).combine_chunks()
            starts = _edges(t, names)
            cut = int(starts[-1])
            if cut:
                yield t.slice(0, cut), starts[:-1]
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut
            due = size + AT_ONCE
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _edges(t, names)


def solve_blocks(v: np.ndarray, starts: np.ndarray, leads: np.ndarray, b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of blocks solved from silence, one after the other, their lengths, and their last outputs, latest first.

    v holds the blocks' inputs, each led by `leads` inputs of the block before. All blocks advance together, each in the
    recursion's own order.
    """
    sizes = np.diff(np.append(starts, len(v)))
    halo, order, own = len(b) - 1, len(a) - 1, sizes - leads
    longest = int(own.max())
    x = np.zeros((longest + halo, len(starts)))
    block = np.repeat(np.arange(len(starts)), sizes)
    x[np.arange(len(v)) - np.repeat(starts, sizes) + np.repeat(halo - leads, sizes), block] = v
    y = np.zeros((longest + order, len(starts)))  # led by the silence before
    for k, c in enumerate(b):
        y[order:] += c * x[halo - k : halo - k + longest]
    for n in range(order, longest + order):
        for k in range(1, order + 1):
            y[n] -= a[k] * y[n - k]
    last = np.stack([y[own + order - 1 - k, np.arange(len(starts))] for k in range(order)], 1) if order else np.zeros((len(starts), 0))
    inside = np.arange(longest)[None, :] < own[:, None]
    return y[order:].T[inside], own, last


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def recursive_by_channel(rows: DataFrame, b: list[float], a: list[float], block: int = BLOCK, keep: str | None = None) -> DataFrame:
    """(stream_id, channel, n, y) for rows (stream_id, channel, n, v); inputs and outputs before n = 0 are 0.

    keep: a whole-number column of rows that the result has too. A block also reads the len(b) - 1 inputs before it: those rows
    are dealt to two blocks.
    """
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    halo, order = len(b) - 1, len(a) - 1
    key = [*BY, "block"]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.floor(F.col("n") / block)
    names = [*BY, "n", "v", *([keep] if keep else [])]
    dealt = rows.select(*names, F.explode(F.when(F.col("n") % block >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))).alias("block")) if halo else rows.select(*names, own.alias("block"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole(batches, key):
            n, at = t.column("n").to_numpy(), t.column("block").to_numpy()
            lead = n < at * block
            leads = np.add.reduceat(lead.astype(np.int64), starts)
            y, sizes, last = solve_blocks(t.column("v").to_numpy().astype(float), starts, leads, b, a)
            first = t.take(pa.array(starts))
            out = [first.column(c).combine_chunks() for c in key] + [_lists(pa.array(y), sizes), _lists(pa.array(last.ravel()), np.full(len(starts), order))]
            if keep:
                out.append(_lists(t.column(keep).combine_chunks().filter(pa.array(~lead)), sizes))
            yield pa.RecordBatch.from_arrays(out, [*key, "y", "last", *([keep] if keep else [])])

    layout = "stream_id string, channel int, block bigint, y array<double>, last array<double>" + (f", {keep} array<bigint>" if keep else "")
    if keep:
        dealt = dealt.withColumn(keep, F.col(keep).cast("bigint"))
    dealt = dealt.withColumns({"channel": F.col("channel").cast("int"), "n": F.col("n").cast("bigint"), "block": F.col("block").cast("bigint"), "v": F.col("v").cast("double")})
    blocks = dealt.repartition(count, *key).sortWithinPartitions(*key, "n").mapInArrow(solved, layout).where("size(y) > 0")
    if order:
        blocks = _carried(blocks, responses(a, block), count, keep)
    each = F.arrays_zip("y", keep) if keep else F.col("y")
    out = blocks.select(*key, F.posexplode(each).alias("k", "y"))
    place = (F.col("block") * block + F.col("k")).alias("n")
    return out.select(*BY, place, F.col("y.y").alias("y"), F.col(f"y.{keep}").alias(keep)) if keep else out.select(*BY, place, "y")


def _carried(blocks: DataFrame, reply: np.ndarray, count: int, keep: str | None) -> DataFrame:
    """Blocks with what earlier blocks of their channel leave behind added. Only last outputs, a few numbers a block, are
    ordered by channel; channels of one block have nothing to carry."""
    order = reply.shape[1]
    end = reply[::-1][:order]
    later = blocks.where("block > 0").select(*BY).distinct()

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, np.zeros(order)
        for b in batches:
            out = []
            for k, (stream, channel, last) in enumerate(zip(*(b.column(c).to_pylist() for c in (*BY, "last")))):
                if (stream, channel) != now:
                    now, state = (stream, channel), np.zeros(order)
                out.append(state.tolist())
                state = np.asarray(last) + end @ state
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*BY, "block")), pa.array(out, pa.list_(pa.float64()))], [*BY, "block", "before"])

    ends = joined(blocks.select(*BY, "block", "last"), later, BY, "left_semi")
    before = ends.repartition(count, *BY).sortWithinPartitions(*BY, "block").mapInArrow(states, "stream_id string, channel int, block bigint, before array<double>").where("block > 0")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y")
            sizes, values = np.diff(y.offsets.to_numpy()), y.flatten().to_numpy().copy()
            at = 0
            for n, state in zip(sizes.tolist(), b.column("before").to_pylist()):
                if state is not None:
                    values[at : at + n] += reply[:n] @ np.asarray(state)
                at += n
            yield pa.RecordBatch.from_arrays([_lists(pa.array(values), sizes) if c == "y" else b.column(c) for c in names], names)

    names = [*BY, "block", "y", *([keep] if keep else [])]
    layout = "stream_id string, channel int, block bigint, y array<double>" + (f", {keep} array<bigint>" if keep else "")
    return joined(blocks.select(*names), before, [*BY, "block"], "left").select(*names, "before").mapInArrow(added, layout)


def recursive(x: Signal, b: list[float], a: list[float]) -> Signal:
    """A filter over each channel; its state is not rounded, its outputs are."""
    y = recursive_by_channel(x.df.select(*BY, "n", F.col("s").cast("double").alias("v")), list(b), list(a))
    return x.with_df(y.withColumn("s", rounded(F.col("y"))), precision=32)


def biquad(x: Signal, c) -> Signal:
    return recursive(x, list(c[:3]), list(c[3:]))


def shelf_or_band(x: Signal, kind: str, f: float, width: float, width_kind: str = "q", gain: float = 0.0, poles: int = 2) -> Signal:
    """The filters of design.biquad; a shelf or peak of 0 dB does nothing."""
    if kind in ("bass", "treble", "equalizer") and gain == 0:
        return x
    return biquad(x, design.biquad(kind, x.rate, f, width, width_kind, gain, poles))


def transfer(spark: SparkSession, c, rate: float, points: int = 512) -> DataFrame:
    """(hz, db) of a biquad from 0 to half the rate."""
    w = F.col("id") * (math.pi / points)
    power = lambda k: F.pow(F.lit(float(k[0])) + F.lit(float(k[1])) * F.cos(w) + F.lit(float(k[2])) * F.cos(w * 2), 2) + F.pow(F.lit(float(k[1])) * F.sin(w) + F.lit(float(k[2])) * F.sin(w * 2), 2)
    return spark.range(points).select((F.col("id") * (rate / 2 / points)).alias("hz"), (F.lit(10.0) * F.log10(F.greatest(F.lit(1e-24), power(c[:3]) / power(c[3:])))).alias("db"))


def kernel_transfer(spark: SparkSession, kernel, rate: float, points: int = 512) -> DataFrame:
    """(hz, db) of a kernel from 0 to half the rate."""
    w = F.col("id") * (math.pi / points)
    re, im = (sum((F.lit(float(c)) * f(w * k) for k, c in enumerate(kernel)), F.lit(0.0)) for f in (F.cos, F.sin))
    return spark.range(points).select((F.col("id") * (rate / 2 / points)).alias("hz"), (F.lit(10.0) * F.log10(F.greatest(F.lit(1e-24), re * re + im * im))).alias("db"))


def overdrive(x: Signal, gain_db: float = 20, colour: float = 20) -> Signal:
    """Cubic soft clipping, a one-pole block of the offset, mixed with half the input."""
    g = 10 ** (gain_db / 20)
    d = F.col("s") * F.lit(g / 2147483648.0) + F.lit(colour / 200)
    bent = F.when(d < -1, F.lit(-2 / 3)).when(d > 1, F.lit(2 / 3)).otherwise(d - d * d * d / 3)
    y = recursive_by_channel(x.df.select(*BY, "n", "s", bent.alias("v")), [1.0, -1.0], [1.0, -0.995], keep="s")
    return x.with_df(y.withColumn("s", rounded((F.col("s") / F.lit(2147483648.0) * 0.5 + F.col("y") * 0.75) * F.lit(2147483648.0))), precision=32)
