"""Numbers as the applications of the data round, clamp and blend them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Halves go up, also below zero: -2.5 is -2."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    """x between low and high; low where it is missing or not a number."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(low)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), x)))


def score(x: Column) -> Column:
    """A whole number from 0 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), half_up(x))).cast("int")


def percent(share: Column) -> Column:
    return half_up(clamp(share, 0.0, 1.0) * 100).cast("int")


def duration(ms: Column) -> Column:
    """Whole milliseconds, down; 0 for what is missing or below 0."""
    return F.when(ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0), F.lit(0)).otherwise(F.floor(ms)).cast("long")


def estimate(ms: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(ms))).cast("long")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def sigmoid(x: Column) -> Column:
    """Saturated beyond 30 on either side."""
    return F.when(x >= 30, F.lit(1.0)).when(x <= -30, F.lit(0.0)).otherwise(1 / (1 + F.exp(-x)))


def compiled_apart(c: Column) -> Column:
    """c as it is; what is selected beside it is compiled in small functions.

    Generated whole stages put a select into one function, and the virtual machine never translates one of more than 8,000 bytes: it interprets it, some
    ten times as slowly. A list that is gone through with a function isn't part of such stages.
    """
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))
