"""Framed spectral operators: frames of samples as rows, transformed by numpy in batches."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import design
from ..functions.numeric import FULL
from ..signal import Signal
from .stateful import blockwise, to_samples

BY = ["stream_id", "channel"]


def frames(x: Signal, size: int, step: int) -> DataFrame:
    """(stream_id, channel, frame, x): frames that start inside the signal, padded with 0; a row holds one bounded frame."""
    n = F.col("n")
    dealt = x.df.select(*BY, "n", "s", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((n - size) / step) + 1), F.floor(n / step))).alias("frame")).where(n - F.col("frame") * step < size)
    listed = dealt.groupBy(*BY, "frame").agg(F.array_sort(F.collect_list(F.struct((n - F.col("frame") * step).alias("k"), (F.col("s") / F.lit(FULL)).alias("v")))).alias("p"))
    return listed.select(*BY, "frame", F.col("p.v").alias("x"))


def spectra(framed: DataFrame, size: int, window: np.ndarray | None = None) -> DataFrame:
    """(stream_id, channel, frame, power): squared magnitudes of bins 0 to size / 2."""
    w = np.ones(size) if window is None else window

    def transformed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.zeros((len(pdf), size))
            for k, row in enumerate(pdf["x"]):
                v[k, : len(row)] = row
            p = np.abs(np.fft.rfft(v * w, axis=1)) ** 2
            yield pdf[[*BY, "frame"]].assign(power=p.tolist())

    return framed.mapInPandas(transformed, "stream_id string, channel int, frame bigint, power array<double>")


def power_spectrum(x: Signal, size: int = 4096) -> DataFrame:
    """(stream_id, channel, frame, bin, hz, power) of blocks that don't overlap."""
    p = spectra(frames(x, size, size), size)
    return p.select(*BY, "frame", F.posexplode("power").alias("bin", "power")).where(F.col("bin") < size // 2).withColumn("hz", F.col("bin") * x.rate / size)


def noise_profile(x: Signal, size: int = 2048) -> DataFrame:
    """(stream_id, channel, bin, log_power): mean log power by bin over blocks that don't overlap; powers of 0 don't count."""
    p = spectra(frames(x, size, size), size).select(*BY, F.posexplode("power").alias("bin", "power"))
    return p.groupBy(*BY, "bin").agg(F.coalesce(F.avg(F.when(F.col("power") > 0, F.log("power"))), F.lit(0.0)).alias("log_power"))


def noise_reduce(x: Signal, profile: DataFrame, amount: float = 0.5, size: int = 2048) -> Signal:
    """Gates bins whose power is under the profile: frames at half overlap, gains smoothed over frames, added again.

    profile: (channel, bin, log_power), one row a channel and bin, sent to the tasks: channels times 1,025 rows.
    """
    held = {r["channel"]: np.array([v["log_power"] for v in r["p"]]) for r in profile.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("bin", "log_power"))).alias("p")).toLocalIterator()}
    return blockwise(x, Gate(size, np.stack([held.get(c, np.zeros(size // 2 + 1)) for c in range(x.channels)]) + amount * 8))


@dataclass(frozen=True)
class Gate:
    """Frames from half a frame before the first sample on, so that all samples are in two; threshold by channel and bin (log power)."""

    size: int
    threshold: np.ndarray

    def start(self, channels: int) -> dict:
        half = self.size // 2
        return {"held": np.zeros((channels, half)), "tail": np.zeros((channels, half)), "gain": np.ones((channels, half + 1)), "frame": 0, "length": 0}

    def advanced(self, state: dict, v: np.ndarray) -> list[np.ndarray]:
        half, hann, out = self.size // 2, design.window("hann", self.size + 1)[: self.size], []
        while v.shape[1] >= self.size:
            now = v[:, : self.size]
            with np.errstate(divide="ignore"):
                open_ = np.log(np.abs(np.fft.rfft(now)) ** 2) >= self.threshold
            gain = state["gain"] = 0.5 * state["gain"] + 0.5 * open_
            lone = np.zeros(gain.shape, bool)
            lone[:, 1:-1] = (gain[:, 1:-1] >= 0.1) & (gain[:, :-2] < 0.1) & (gain[:, 2:] <= 0.1)
            y = np.fft.irfft(np.fft.rfft(now * hann) * np.where(lone, 0.0, gain), self.size)
            if state["frame"]:  # what comes before the first sample is not given
                out.append(state["tail"] + y[:, :half])
            state["tail"], state["frame"], v = y[:, half:], state["frame"] + 1, v[:, half:]
        state["held"] = v
        return out

    def flow(self, state: dict, s: np.ndarray) -> np.ndarray:
        state["length"] += s.shape[1]
        return to_samples(np.concatenate([s[:, :0] / FULL, *self.advanced(state, np.concatenate([state["held"], s / FULL], axis=1))], axis=1))

    def drain(self, state: dict) -> np.ndarray | None:
        half = self.size // 2
        left = state["length"] - max(0, state["frame"] - 1) * half
        if left <= 0:
            return None
        out = self.advanced(state, np.pad(state["held"], ((0, 0), (0, self.size + half))))
        return to_samples(np.concatenate(out, axis=1)[:, :left])


def spectrogram(x: Signal, rows: int = 257, window: str = "hann", step: int | None = None, parameter: float = 0.0) -> DataFrame:
    """(stream_id, channel, column, row, db): windowed power in dB to full scale, of rows - 1 a power of two or any number."""
    size = 2 * (rows - 1)
    w = design.window(window, size, parameter)
    w = w * (2 / w.sum())
    p = spectra(frames(x, size, step or size // 2), size, w)
    return p.select(*BY, F.col("frame").alias("column"), F.posexplode("power").alias("row", "p")).select(*BY, "column", "row", (F.lit(10.0) * F.log10(F.greatest("p", F.lit(1e-20)))).alias("db"))


#: Corners of the palette, evenly spaced from the floor to the top: black, blue, violet, red, yellow, white.
CORNERS = ((0, 0, 0), (0, 0, 140), (150, 0, 150), (230, 40, 20), (250, 220, 60), (255, 255, 255))
#: Rows of a channel, at least, and the tallest and widest picture.
LEAST_ROWS, WIDEST = 33, 200_000


def palette(colours: int, grey: bool = False, light: bool = False) -> np.ndarray:
    """(colours + 2, 3) bytes: one for all below the floor, the colours, one for all above the top. light: for paper."""
    at = np.linspace(0, len(CORNERS) - 1, colours + 2)
    corners = np.array(CORNERS, float)
    rgb = np.stack([np.interp(at, np.arange(len(corners)), corners[:, k]) for k in range(3)], axis=1)
    rgb = np.repeat(np.linspace(0, 255, colours + 2)[:, None], 3, axis=1) if grey else rgb
    return np.rint(255 - rgb if light else rgb).astype(np.uint8)


def indexed_png(pixels: np.ndarray, colours: np.ndarray) -> bytes:
    """A picture of palette indices (rows x columns)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.pad(pixels.astype(np.uint8), ((0, 0), (1, 0))).tobytes()  # each row after its filter, none
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 3, 0, 0, 0)) + chunk(b"PLTE", colours.tobytes()) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_pixels(png: bytes) -> np.ndarray:
    """Palette indices of a picture of indexed_png()."""
    width, height = struct.unpack_from(">II", png, 16)
    at, data = 8, b""
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        data += png[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


def rows_for(height: int, channels: int) -> int:
    """Rows of a channel: one more than a power of two, so that all channels fit the height, but not fewer than LEAST_ROWS."""
    fit = height // max(1, channels)
    return max(LEAST_ROWS, (1 << max(0, (fit - 1).bit_length() - 1 if fit < 2 else int(math.log2(fit - 1)))) + 1)


def picture(
    x: Signal, width: int = 800, height: int = 550, rows: int | None = None, pixels_per_second: float | None = None, span: float = 120.0, top: float | None = 0.0, colours: int = 249, window: str = "hann", parameter: float = 0.0,
    grey: bool = False, light: bool = False,
) -> DataFrame:
    """(stream_id, width, height, png): a spectrogram of each stream as an indexed picture.

    Channels lie from top to bottom, low frequencies at the bottom of each, time from left to right. A channel has `rows`, or what
    `height` allows (see rows_for). A column is 1 / pixels_per_second long; without that number, as long that the longest stream
    fits the width. It is the mean power of one or more frames, which overlap by half or more; what comes after `width` columns
    isn't shown. Levels from top - span to top (dB to full scale; top None: the greatest level) have the colours.

    Columns are made and averaged all over; a stream's picture, which is of bounded size, is put together in one task.
    """
    if not 1 <= width <= WIDEST or not 1 <= colours <= 254:
        raise ValueError(f"a picture has 1 to {WIDEST} columns and 1 to 254 colours")
    rows = rows or rows_for(height, x.channels)
    size = 2 * (rows - 1)
    if pixels_per_second is None:
        longest = x.df.agg(F.max("n")).first()[0]
        pixels_per_second = width * x.rate / ((longest or 0) + 1)
    column = max(1, int(x.rate / pixels_per_second + 0.5))  # places of a column
    steps = -(-2 * column // size)  # frames of a column
    step = max(1, column // steps)
    w = design.window(window, size, parameter)
    power = spectra(frames(x.with_df(x.df.where(F.col("n") < width * steps * step)), size, step), size, w * (2 / w.sum()))
    cell = power.select(*BY, F.floor(F.col("frame") / steps).alias("column"), F.posexplode("power").alias("row", "p")).groupBy(*BY, "column", "row").agg(F.avg("p").alias("p"))
    level = cell.where(F.col("column") < width).withColumn("db", F.lit(10.0) * F.log10(F.greatest("p", F.lit(1e-20))))
    if top is None:
        top = level.agg(F.max("db")).first()[0] or 0.0
    share = (F.col("db") - (top - span)) / span * colours
    shade = level.select("stream_id", "channel", "column", "row", F.when(share < 0, 0).when(share >= colours, colours + 1).otherwise(F.floor(share) + 1).cast("int").alias("shade"))
    look, channels = palette(colours, grey, light), x.channels

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((channels * rows, int(pdf["column"].max()) + 1), np.uint8)
        grid[(pdf["channel"] + 1) * rows - 1 - pdf["row"], pdf["column"]] = pdf["shade"]
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iat[0]], "width": [grid.shape[1]], "height": [grid.shape[0]], "png": [indexed_png(grid, look)]})

    return shade.groupBy("stream_id").applyInPandas(drawn, "stream_id string, width int, height int, png binary")
