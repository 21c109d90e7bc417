"""Parsing, completing, filtering and de-duplicating rides and weather days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from rideflow.functions.labels import seconds_between
from rideflow.schemas import (
    CLEAN_RIDE_MESSAGE,
    COORDINATES,
    RIDE_MESSAGE,
    RIDE_TABLE,
    SOURCE_TYPE_COLUMN,
    WEATHER_MESSAGE,
)


def parse_messages(messages: DataFrame, schema: StructType) -> DataFrame:
    """JSON ``value`` to columns. Malformed text gives a row of NULLs, a bad field a NULL."""
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(parsed.alias("data")).select("data.*")


def parse_rides(messages: DataFrame) -> DataFrame:
    raw = parse_messages(messages, RIDE_MESSAGE)
    return raw.withColumnRenamed(SOURCE_TYPE_COLUMN, "rideable_type")


def parse_clean_rides(messages: DataFrame) -> DataFrame:
    raw = parse_messages(messages, CLEAN_RIDE_MESSAGE)
    return raw.withColumnRenamed(SOURCE_TYPE_COLUMN, "rideable_type")


def parse_weather(messages: DataFrame) -> DataFrame:
    return parse_messages(messages, WEATHER_MESSAGE)


def with_duration(rides: DataFrame) -> DataFrame:
    """Add ``duration_seconds``."""
    return rides.withColumn(
        "duration_seconds", seconds_between(F.col("started_at"), F.col("ended_at"))
    )


def clean_rides(rides: DataFrame) -> DataFrame:
    """The stream's rule: add the duration, drop rides without a start station id."""
    return with_duration(rides).filter(F.col("start_station_id").isNotNull())


def complete_rides(rides: DataFrame) -> DataFrame:
    """The training set's rule: drop rides that lack either station id."""
    return rides.dropna(subset=["start_station_id", "end_station_id"])


def between(df: DataFrame, column: str, after: str | None, before: str | None) -> DataFrame:
    """Strict bounds on a time column: a row exactly on a bound is outside."""
    if after is not None:
        df = df.filter(F.col(column) > F.lit(after).cast("timestamp"))
    if before is not None:
        df = df.filter(F.col(column) < F.lit(before).cast("timestamp"))
    return df


def on_day(rides: DataFrame, day: str) -> DataFrame:
    """Rides of one calendar day."""
    return rides.filter(F.to_date("started_at") == F.lit(day).cast("date"))


def with_coordinates(rides: DataFrame) -> DataFrame:
    """Coordinates from text to double; unreadable text becomes NULL."""
    return rides.withColumns({c: F.col(c).try_cast("double") for c in COORDINATES})


def to_ride_table(clean: DataFrame) -> DataFrame:
    """The 14 columns of the ride table, by name and declared type, plus its layout column.

    ``date`` is the day by UTC, whatever the session's time zone.
    """
    named = clean if "duration" in clean.columns else clean.withColumnRenamed(
        "duration_seconds", "duration"
    )
    typed = named.select(*[F.col(f.name).cast(f.dataType) for f in RIDE_TABLE.fields])
    utc = F.to_utc_timestamp("started_at", F.current_timezone())
    return typed.withColumn("date", F.to_date(utc))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, NULLs last, remaining ties by the other columns.

    A ranking window whose rank is limited to 1: each task keeps only its first copy of a key before
    the shuffle, so a key with a very large number of copies never meets in one task.
    """
    others = [c for c in df.columns if c != key and c not in order]
    ranked = Window.partitionBy(key).orderBy(
        *(F.col(c).asc_nulls_last() for c in order), *(F.col(c).asc_nulls_last() for c in others)
    )
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side, each once."""
    return left.unionByName(right).distinct()
