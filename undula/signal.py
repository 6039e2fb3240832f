"""Signals: samples in long form with what is known of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["stream_id", "channel", "n"]
LAYOUT = "stream_id string, channel int, n bigint, s int"
#: For operators that hand on samples as they are, those beyond 32 bits too (see from_table).
WIDE = "stream_id string, channel int, n bigint, s bigint"


@dataclass(frozen=True)
class Signal:
    """df has stream_id, channel, n (from 0, without gaps) and s (32-bit sample); rate in Hz; precision in bits."""

    df: DataFrame
    rate: float = 48000.0
    channels: int = 1
    precision: int = 32
    comments: list[str] = field(default_factory=list)
    #: The factor by which room for later operators was made, to be taken back.
    headroom: float = 1.0

    def __reduce__(self):
        """What a kernel on an executor sees: all but the rows."""
        return Signal, (None, self.rate, self.channels, self.precision, self.comments, self.headroom)

    def with_df(self, df: DataFrame, **changes) -> Signal:
        return replace(self, df=df.select(*KEYS, "s"), **changes)

    def map(self, f: Callable[[Column], Column], **changes) -> Signal:
        """s replaced by an expression of itself: stays in generated code, no shuffle."""
        return self.with_df(self.df.withColumn("s", f(F.col("s"))), **({"precision": 32} | changes))

    def lengths(self) -> DataFrame:
        """(stream_id, length) in wide samples."""
        return self.df.groupBy("stream_id").agg((F.max("n") + 1).alias("length"))

    def with_length(self) -> DataFrame:
        """df with each row's stream length; the lengths are one row a stream and are joined by the stream."""
        return joined(self.df, self.lengths(), ["stream_id"])

    def effect(self, name: str, *args) -> Signal:
        """The operator of that name, with text or numeric arguments."""
        from .plans.chain import apply

        return apply(self, name, [str(a) for a in args])

    def chain(self, text: str) -> Signal:
        """Operators by name, as on a command line: 'trim 0 1 vol 3dB'."""
        from .plans.chain import run

        return run(self, text)


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join by columns, stream_id first, in which streams without a name meet as well: those rows are one stream."""
    other = right.withColumnsRenamed({c: f"_u_{c}" for c in by})
    first, *rest = by
    on = [F.col(first).eqNullSafe(F.col(f"_u_{first}")), *(F.col(c) == F.col(f"_u_{c}") for c in rest)]
    return left.join(other, on, how).drop(*(f"_u_{c}" for c in by))


def from_table(df: DataFrame, stream: Column, order: list[Column], sample: Column, rate: float, channels: int = 1, precision: int = 32) -> Signal:
    """A signal from a table: the rows of a stream, in order, are its interleaved samples; an incomplete last wide sample goes.

    order must be total; nulls come last. Streams are windows of their own, so the work spreads over streams. Samples beyond 32 bits
    come as they are; what operators calculate of them is clipped.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy(*[F.col(f"_o{k}").asc_nulls_last() for k in range(len(order))])
    src = df.select(stream.cast("string").alias("stream_id"), sample.cast("bigint").alias("s"), *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    row = src.withColumn("_k", F.row_number().over(w) - 1)
    if channels > 1:
        row = row.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("stream_id"))).where(F.floor(F.col("_k") / channels) < F.floor(F.col("_m") / channels))
    return Signal(row.select("stream_id", (F.col("_k") % channels).cast("int").alias("channel"), F.floor(F.col("_k") / channels).alias("n"), "s"), rate, channels, precision)
