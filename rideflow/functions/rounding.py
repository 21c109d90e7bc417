"""Half-to-even rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, ties to the even neighbour (2.5 → 2, 3.5 → 4)."""
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def steady(x: Column) -> Column:
    """Snap a float sum to a millionth, so that the order of addition no longer shows."""
    return half_even(x, 6)
