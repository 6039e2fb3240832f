"""Column expressions for samples: conversion, rounding and clipping, decibels.

A sample is a whole number of full scale 2**31. Values are clipped before they are cast, as ANSI casts raise on overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 2147483648.0
MAX, MIN = 2147483647, -2147483648


def clip(d: Column) -> Column:
    return F.greatest(F.lit(float(MIN)), F.least(F.lit(float(MAX)), d))


def rounded(d: Column) -> Column:
    """Nearest sample, halves away from zero."""
    c = clip(d)
    return F.when(c < 0, F.ceil(c - 0.5)).otherwise(F.floor(c + 0.5)).cast("int")


def truncated(d: Column) -> Column:
    """Sample with its fraction cut off."""
    c = clip(d)
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")


def half_even(d: Column) -> Column:
    """Nearest sample, halves to even."""
    return F.rint(clip(d)).cast("int")


def clips(d: Column) -> Column:
    """Whether rounding d saturates."""
    return (d >= MAX + 0.5) | (d <= MIN - 0.5)


def to_unit(s: Column) -> Column:
    return s / F.lit(FULL)


def from_unit(x: Column) -> Column:
    return rounded(x * F.lit(FULL))


def from_bits(v: Column, bits: int, signed: bool = True) -> Column:
    """A sample from a whole number of so many bits."""
    wide = v.cast("bigint") - (0 if signed else 1 << (bits - 1))
    return (wide * (1 << (32 - bits))).cast("int")


def to_bits(s: Column, bits: int, signed: bool = True) -> Column:
    """A whole number of so many bits, halves rounded up, saturated at the top."""
    step = 1 << (32 - bits)
    wide = F.floor((s.cast("bigint") + step // 2) / F.lit(float(step))) if bits < 32 else s.cast("bigint")
    return F.least(wide, F.lit((1 << (bits - 1)) - 1)).cast("bigint") + (0 if signed else 1 << (bits - 1))


def linear(db: float) -> float:
    return 10.0 ** (db / 20.0)


def decibels(x: Column) -> Column:
    return F.lit(20.0) * F.log10(x)


def figures3(v: Column, units: tuple[str, ...] = ("", "k", "M", "G", "T")) -> Column:
    """A number from 0 on as text of three figures, with k, M, G or T for thousands."""
    big = F.greatest(v, F.lit(1e-9))
    scale = F.floor(F.log10(big)).cast("int")
    step = F.pow(F.lit(10.0), scale - 2)
    r = F.floor(v / step + 0.5) * step  # three figures; may reach the next power
    group = F.greatest(F.lit(0), F.least(F.lit(len(units) - 1), F.floor(F.log10(F.greatest(r, F.lit(1.0)) * (1 + 1e-12)) / 3).cast("int")))
    m = r / F.pow(F.lit(1000.0), group)
    digits = F.when(m < 9.995, F.format_string("%.2f", m)).when(m < 99.95, F.format_string("%.1f", m)).otherwise(F.format_string("%.0f", m))
    return F.concat(digits, F.array(*[F.lit(x) for x in units])[group])
