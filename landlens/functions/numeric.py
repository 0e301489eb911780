"""Rounding, clamping and small array statistics with fixed conventions for ties and unknown values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; unknown stays unknown (plain ``greatest`` would turn NULL into the bound)."""
    limited = F.least(F.lit(high), F.greatest(F.lit(low), value))
    return F.when(value.isNotNull(), limited)


def half_up(value: Column, digits: int = 0) -> Column:
    """Round ties towards plus infinity (-2.5 -> -2); ``F.round`` rounds ties away from zero."""
    if digits == 0:
        return F.floor(value + F.lit(0.5))
    scale = 10.0**digits
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round ties to even: whole numbers by ``rint``, decimals by ``bround``."""
    return F.rint(value) if digits == 0 else F.bround(value, digits)


def union_prob(values: Column) -> Column:
    """Probability that at least one of several independent events holds."""
    miss = F.aggregate(values, F.lit(1.0), lambda acc, v: acc * (F.lit(1.0) - v))
    return F.lit(1.0) - miss


def array_mean(values: Column, empty: float | None = 0.0) -> Column:
    """Mean of an array; ``empty`` is 0 for the terrain code and None for the summaries."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, F.try_divide(total, F.size(values))).otherwise(F.lit(empty))


def array_median(values: Column) -> Column:
    """Middle value, or the mean of the two middle values; 0 for an empty array."""

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        upper = F.get(ordered, F.shiftright(n, 1))
        lower = F.get(ordered, F.shiftright(n - 1, 1))
        return F.when(n > 0, (lower + upper) / 2).otherwise(F.lit(0.0))

    return let(F.sort_array(values), middle)


def array_mad(values: Column) -> Column:
    """Median absolute deviation from the median."""
    return let(array_median(values), lambda centre: array_median(F.transform(values, lambda v: F.abs(v - centre))))


def axis_angle(a: Column, b: Column) -> Column:
    """Angle between two undirected axes in degrees, 0..90."""
    raw = F.abs(a - b) % F.lit(180.0)
    return F.least(raw, F.lit(180.0) - raw)
