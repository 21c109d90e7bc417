"""Ride counts, revenue and busiest stations over a set of rides.

``by`` names further grouping columns, such as a day; without it a KPI covers all rides given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rideflow.functions.pricing import (
    amount,
    cents,
    per_ride,
    total_units,
    units_of,
    with_revenue,
)
from rideflow.functions.rounding import steady
from rideflow.operators.cleaning import on_day, with_duration


def rides_on_day(rides: DataFrame, day: str) -> DataFrame:
    """The priced rides of one day, in start order."""
    return with_revenue(with_duration(on_day(rides, day))).orderBy("started_at", "ride_id")


def rides_per_day(rides: DataFrame) -> DataFrame:
    return rides.groupBy(F.to_date("started_at").alias("date")).agg(F.count("*").alias("count"))


def type_counts(rides: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rides per bike type; rides of unknown type are left out."""
    known = rides.filter(F.col("rideable_type").isNotNull())
    return known.groupBy(*by, "rideable_type").agg(F.count("*").alias("count"))


def station_counts(rides: DataFrame, end: str = "start", by: Sequence[str] = ()) -> DataFrame:
    """Rides per named start (or end) station."""
    station = f"{end}_station_name"
    known = rides.filter(F.col(station).isNotNull())
    return known.groupBy(*by, station).agg(F.count("ride_id").alias("rides"))


def top_station(counts: DataFrame, end: str = "start", by: Sequence[str] = ()) -> DataFrame:
    """The station with most rides, the alphabetically first of several."""
    station = f"{end}_station_name"
    best = F.min(F.struct((-F.col("rides")).alias("rank"), F.col(station))).alias("best")
    return counts.groupBy(*by).agg(best).select(
        *by, f"best.{station}", (-F.col("best.rank")).alias("rides")
    )


def hourly(rides: DataFrame) -> DataFrame:
    """Rides and revenue per clock hour and bike type."""
    known = rides.filter(F.col("rideable_type").isNotNull() & F.col("started_at").isNotNull())
    return known.groupBy(F.date_trunc("hour", "started_at").alias("hour"), "rideable_type").agg(
        F.count("ride_id").alias("rides"),
        amount(total_units("revenue")).alias("revenue"),
    )


def hourly_mean(hours: DataFrame) -> DataFrame:
    """Per day, the mean over its (hour, type) rows, not over its hours."""
    return hours.groupBy(F.to_date("hour").alias("date")).agg(
        F.count("*").alias("bars"), steady(F.avg("rides")).alias("mean_rides")
    )


def revenue_by_type(rides: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    known = rides.filter(F.col("rideable_type").isNotNull())
    total = amount(total_units("revenue"))
    return known.groupBy(*by, "rideable_type").agg(total.alias("revenue"))


def revenue_total(rides: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of rides and revenue, to two decimals."""
    total = cents(total_units("revenue"))
    return rides.groupBy(*by).agg(F.count("*").alias("rides"), total.alias("revenue"))


def revenue_per_ride(rides: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, count and their ratio per bike type, from one pass over the rides."""
    known = rides.filter(F.col("rideable_type").isNotNull())
    sums = known.groupBy(*by, "rideable_type").agg(
        total_units("revenue").alias("fare"), F.count("*").alias("count")
    )
    fare, count = F.col("fare"), F.col("count")
    return sums.select(
        *by,
        "rideable_type",
        amount(fare).alias("revenue"),
        "count",
        per_ride(fare, count).alias("rpr"),
    )


def revenue_joined_to_counts(revenue: DataFrame, counts: DataFrame) -> DataFrame:
    """The same ratio from the two aggregates, matched on the bike type."""
    return revenue.join(counts, "rideable_type", "inner").withColumn(
        "rpr", per_ride(units_of(F.col("revenue")), F.col("count"))
    )


def revenue_per_ride_wide(per_type: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One column per bike type; NULL where a type has no rides."""

    def of(bike: str):
        shown = cents(units_of(F.col("revenue")), F.col("count"))
        return F.max(F.when(F.col("rideable_type") == bike, shown))

    return per_type.groupBy(*by).agg(
        of("classic_bike").alias("classic_rpr"),
        of("electric_bike").alias("electric_rpr"),
    )
