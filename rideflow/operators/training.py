"""Daily ride counts matched with daily weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rideflow.operators.cleaning import between, complete_rides
from rideflow.operators.kpis import rides_per_day
from rideflow.schemas import WEATHER_COLUMNS, WEATHER_MEASURES

FEATURES = WEATHER_MEASURES
LABEL = "count"
HOLD_OUT_EVERY = 5
# Weather days, of some hundred bytes each, that are sent to every executor: 10 MB.
DAYS_TO_BROADCAST = 100_000


def training_set(
    rides: DataFrame, weather: DataFrame, after: str, before: str
) -> DataFrame:
    """Complete rides per day, strictly between the bounds, with that day's weather."""
    counts = rides_per_day(complete_rides(between(rides, "started_at", after, before)))
    days = between(weather.select(*WEATHER_COLUMNS), "datetime", after, before)
    # The timestamp meets the date as a date, so that the join stays an equality.
    return counts.join(days, counts["date"] == F.to_date(days["datetime"]), "inner")


def stored_training_set(stored: DataFrame, days: DataFrame) -> DataFrame:
    """Complete rides per day of the stored ride table on some weather days, with their weather.

    ``days`` is a selection of weather days by a condition. Its days reach the scan of the ride table
    as a dynamic partition filter, also through the count: of the ride table only the files of these
    days are read, two columns of them. The filter is read off the broadcast side of the join, so the
    days are counted first and sent up to ``DAYS_TO_BROADCAST``; more are joined without a hint. Days
    without rides are left out, and days that are selected twice come twice.
    """
    counts = complete_rides(stored).groupBy("date").agg(F.count("*").alias("count"))
    chosen = days.select(*WEATHER_COLUMNS)
    if chosen.limit(DAYS_TO_BROADCAST + 1).count() <= DAYS_TO_BROADCAST:
        chosen = F.broadcast(chosen)
    return counts.join(chosen, counts["date"] == F.to_date(chosen["datetime"]), "inner")


def features(training: DataFrame) -> DataFrame:
    """Day, the seven features and the label."""
    return training.select("date", *FEATURES, LABEL)


def with_split(training: DataFrame) -> DataFrame:
    """Mark every fifth calendar day as held out: the same 80/20 split on every run."""
    day_number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    held_out = day_number % HOLD_OUT_EVERY == 0
    return training.withColumn("part", F.when(held_out, "test").otherwise("train"))


def random_split(training: DataFrame, seed: int = 42) -> list[DataFrame]:
    """Random 80/20 split."""
    return training.randomSplit([0.8, 0.2], seed)
