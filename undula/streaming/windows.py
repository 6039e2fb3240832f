"""Signals as streams: rows (stream_id, channel, n, ts, s) that arrive in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import FULL
from ..operators.scan import recurse


def tumbling_stats(rows: DataFrame, duration: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, extremes and mean power by stream, channel and window of event time; rows later than `late` are dropped."""
    v = F.col("s") / F.lit(FULL)
    marked = rows.withWatermark("ts", late)
    span = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    return marked.groupBy(span, "stream_id", "channel").agg(F.count(F.lit(1)).alias("samples"), F.min("s").alias("min"), F.max("s").alias("max"), F.avg(v * v).alias("power")).select("stream_id", "channel", F.col("window.start").alias("start"), "samples", "min", "max", "power")


def sounding(rows: DataFrame, level: float, gap: str, late: str) -> DataFrame:
    """Sessions of samples over a level (share of full scale) with gaps of less than `gap`."""
    loud = rows.withWatermark("ts", late).where(F.abs("s") > level * FULL)
    return loud.groupBy(F.session_window("ts", gap).alias("w"), "stream_id").agg(F.count(F.lit(1)).alias("samples")).select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def recursive(rows: DataFrame, b: list[float], a: list[float]) -> DataFrame:
    """A linear filter over each channel of a stream; its last inputs and outputs are the state. Batches come in order of n."""
    order_b, order_a = len(b) - 1, len(a) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("n")
        before_x, before_y = (np.array(v) for v in state.get) if state.exists else (np.zeros(order_b), np.zeros(order_a))
        x = pdf["s"].to_numpy(float)
        w = np.convolve(np.concatenate([before_x, x]), np.asarray(b) / a[0])[order_b : order_b + len(x)]
        y = recurse([1.0], np.asarray(a) / a[0], w, before_y)
        keep_x, keep_y = np.concatenate([before_x, x]), np.concatenate([y[::-1], before_y])
        state.update((keep_x[len(keep_x) - order_b :].tolist(), keep_y[:order_a].tolist()))
        yield pd.DataFrame({"stream_id": key[0], "channel": key[1], "n": pdf["n"], "y": y})

    return rows.groupBy("stream_id", "channel").applyInPandasWithState(step, "stream_id string, channel int, n bigint, y double", "x array<double>, y array<double>", "append", GroupStateTimeout.NoTimeout)
