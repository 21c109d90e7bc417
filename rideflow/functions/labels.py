"""Time and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rideflow.functions.rounding import half_even


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` as a double; fractions are cut at either end."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("double")


def day_label(day: Column) -> Column:
    """``Friday, 05 January 2024``."""
    return F.date_format(day, "EEEE, dd MMMM yyyy")


def clock_label(ts: Column) -> Column:
    """``01:04 PM``."""
    return F.date_format(ts, "hh:mm a")


def iso_text(ts: Column) -> Column:
    """``2024-01-05T13:04:00``; NULL stays NULL."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def two_decimals_text(x: Column) -> Column:
    """At most two decimals, at least one, never an exponent: 12.0, 12.5, 12.35."""
    fixed = half_even(x, 2).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(fixed, "0$", "")


def dollars_text(x: Column) -> Column:
    return F.concat(F.lit("$"), two_decimals_text(x))


def rides_text(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" rides"))
