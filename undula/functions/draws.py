"""Draws of a 32-bit linear congruential generator at any place, as column expressions: no draw waits for the one before it.

One step is x -> a x + c modulo 2^32; so are many steps, with a and c of their own. The number of steps is read in digits to the
base 256, and for each digit the step's a and c are looked up in a table of 256 powers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The generator: fixed values.
A, C = 1664525, 1013904223
MASK = 0xFFFFFFFF
#: Digits of a number of steps: up to 2^40.
DIGITS = 5


def composed(first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
    """One step made of two."""
    return first[0] * then[0] & MASK, (first[1] * then[0] + then[1]) & MASK


def powers(step: tuple[int, int], count: int) -> list[tuple[int, int]]:
    """0, 1, 2, ... times a step."""
    out = [(1, 0)]
    while len(out) < count:
        out.append(composed(out[-1], step))
    return out


def tables() -> list[list[tuple[int, int]]]:
    out, step = [], (A, C)
    for _ in range(DIGITS):
        out.append(powers(step, 256))
        step = composed(out[-1][-1], step)
    return out


def _applied(x: Column, a: Column, c: Column) -> Column:
    """a x + c modulo 2^32 in halves of 16 bits, as ANSI arithmetic must not overflow."""
    high = F.shiftright(x, 16) * a
    return (x.bitwiseAND(0xFFFF) * a + F.shiftleft(high.bitwiseAND(0xFFFF), 16) + c).bitwiseAND(MASK)


def after(x: Column, steps: int = 1) -> Column:
    """A state some steps later."""
    a, c = powers((A, C), steps + 1)[-1]
    return _applied(x, F.lit(a), F.lit(c))


def with_state(df: DataFrame, steps: Column, seed: Column | int, into: str = "_state") -> DataFrame:
    """df with the generator's state (0 to 2^32 - 1) so many steps (a whole number from 0 on) after a seed."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    out = df.withColumn("_steps", steps.cast("bigint")).withColumn(into, seed.cast("bigint").bitwiseAND(MASK))
    for k, table in enumerate(tables()):
        a, c = (F.expr(f"array({', '.join(f'{row[j]}L' for row in table)})[CAST(shiftrightunsigned(_steps, {8 * k}) & 255 AS INT)]") for j in (0, 1))
        out = out.withColumn("_a", a).withColumn("_c", c).withColumn(into, _applied(F.col(into), F.col("_a"), F.col("_c")))
    return out.drop("_steps", "_a", "_c")


def signed(x: Column) -> Column:
    """A state as a signed 32-bit value: what a draw is."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
