"""The fare rule, in whole units.

Every fare is a whole number of units of 1/1200: a second at 0.05 a minute is one. Fares are worked out
and added up as such integers, so a sum is exact and the order of addition, the number of partitions
or of micro-batches can't show; ``revenue`` is that number divided once. A duration with a fraction of a
second gives the nearest whole fare, one that is no number none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rideflow.functions.rounding import half_even

# Fixed values of the fare rule, in currency units and minutes.
CASUAL_UNLOCK_FEE = 1.0
CASUAL_CLASSIC_PER_MINUTE = 0.05
CASUAL_ELECTRIC_PER_MINUTE = 0.15
MEMBER_CLASSIC_FREE_MINUTES = 45.0
MEMBER_CLASSIC_PER_MINUTE = 0.05
MEMBER_ELECTRIC_PER_MINUTE = 0.1

UNITS = 1200


def _whole(amount: float) -> float:
    """An amount of the fare rule in units, which it is a whole number of."""
    return float(round(amount * UNITS))


def ride_units(rider: Column, bike: Column, seconds: Column) -> Column:
    """Fare of a ride in units: casual riders pay by the rounded minute, members by the second.

    A known rider and bike with an unknown duration has no fare; any other class rides free.
    """
    minutes = half_even(seconds / F.lit(60.0))
    casual, member = rider == "casual", rider == "member"
    classic, electric = bike == "classic_bike", bike == "electric_bike"
    unlock = F.lit(_whole(CASUAL_UNLOCK_FEE))
    extra = seconds - F.lit(60 * MEMBER_CLASSIC_FREE_MINUTES)
    # greatest(extra, 0) would turn an unknown duration into 0.
    billed = F.when(extra > 0, extra).when(extra.isNotNull(), F.lit(0.0))
    fare = (
        F.when(casual & classic, unlock + minutes * _whole(CASUAL_CLASSIC_PER_MINUTE))
        .when(casual & electric, unlock + minutes * _whole(CASUAL_ELECTRIC_PER_MINUTE))
        .when(member & classic, billed * (_whole(MEMBER_CLASSIC_PER_MINUTE) / 60))
        .when(member & electric, seconds * (_whole(MEMBER_ELECTRIC_PER_MINUTE) / 60))
        .otherwise(F.lit(0.0))
    )
    return F.rint(fare).try_cast("bigint")


def amount(units: Column) -> Column:
    """Units as currency."""
    return units.cast("double") / F.lit(float(UNITS))


def per_ride(units: Column, rides: Column) -> Column:
    """Currency per ride; NULL for no rides."""
    return F.try_divide(units.cast("double"), rides.cast("double") * F.lit(float(UNITS)))


def cents(units: Column, rides: Column | None = None) -> Column:
    """Currency (per ride) to two decimals. A half cent is told exactly and goes to the even one."""
    of = F.lit(UNITS / 100.0)
    if rides is not None:
        of = of * rides.cast("double")
    return F.rint(F.try_divide(units.cast("double"), of)) / F.lit(100.0)


def units_of(revenue: Column) -> Column:
    """The units an amount stands for."""
    return F.rint(revenue * F.lit(float(UNITS))).try_cast("bigint")


def total_units(revenue: Column | str) -> Column:
    """Aggregate: the exact sum of amounts, in units."""
    column = F.col(revenue) if isinstance(revenue, str) else revenue
    return F.coalesce(F.sum(units_of(column)), F.lit(0).cast("bigint"))


def ride_revenue(rider: Column, bike: Column, seconds: Column) -> Column:
    """Fare of a ride as currency."""
    return amount(ride_units(rider, bike, seconds))


def with_revenue(rides: DataFrame) -> DataFrame:
    """Add ``revenue`` to rides that carry ``duration_seconds``."""
    return rides.withColumn(
        "revenue",
        ride_revenue(F.col("member_casual"), F.col("rideable_type"), F.col("duration_seconds")),
    )
