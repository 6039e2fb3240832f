"""A-law and mu-law companding, by rule, as tables of bytes and as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int64)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte."""
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int64)


def nearest_code(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The byte whose value is nearest to each 16-bit value; of two as near, the one of the larger value."""
    order = np.argsort(table, kind="stable")
    levels = table[order]
    edges = (levels[1:] + levels[:-1]) / 2
    return order[np.searchsorted(edges, values, "right")].astype(np.uint8)


def reversed_bits() -> np.ndarray:
    return np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8)


def decode(code: Column, table: np.ndarray) -> Column:
    """Sample of a byte, looked up in a literal array."""
    values = F.from_json(F.lit(str([int(v) << 16 for v in table])), "array<int>")
    return values[F.pmod(code, F.lit(256)).cast("int")]
