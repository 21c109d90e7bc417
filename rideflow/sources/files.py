"""CSV files in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rideflow.functions.rounding import half_even
from rideflow.schemas import (
    COORDINATES,
    RIDE_COLUMNS,
    RIDE_FILE,
    SOURCE_TYPE_COLUMN,
    WEATHER_COLUMNS,
    WEATHER_FILE,
    WEATHER_MEASURES,
)

# Spark's default keeps milliseconds only.
_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _widen(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def read_ride_file(spark: SparkSession, path: str) -> DataFrame:
    """Ride CSV by position against the fixed schema, floats widened to double."""
    raw = spark.read.schema(RIDE_FILE).option("header", True).csv(path)
    return _widen(raw.withColumnRenamed(SOURCE_TYPE_COLUMN, "rideable_type"), COORDINATES)


def read_weather_file(spark: SparkSession, path: str) -> DataFrame:
    """Weather CSV by position against the fixed schema, floats widened to double."""
    raw = spark.read.schema(WEATHER_FILE).option("header", True).csv(path)
    return _widen(raw.select(*WEATHER_COLUMNS), WEATHER_MEASURES)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types. Costs a second pass over the file: for exploration only."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_rides(spark: SparkSession, path: str) -> DataFrame:
    """Serving rides: columns by header name, times and coordinates coerced, bad text NULL."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [*RIDE_COLUMNS, "duration"]
    return (
        raw.select(*[c for c in wanted if c in raw.columns])
        .withColumns({c: F.col(c).try_cast("timestamp") for c in ("started_at", "ended_at")})
        .withColumns({c: F.col(c).try_cast("double") for c in COORDINATES})
        .withColumns({c: F.col(c).try_cast("double") for c in raw.columns if c == "duration"})
    )


def rounded_weather(weather: DataFrame) -> DataFrame:
    """Every weather measure to two decimals, half to even."""
    return weather.withColumns({c: half_even(F.col(c), 2) for c in WEATHER_MEASURES})


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Serving weather: columns by header name, coerced and rounded to two decimals."""
    raw = spark.read.option("header", True).csv(path).select(*WEATHER_COLUMNS)
    return rounded_weather(
        raw.withColumn("datetime", F.col("datetime").try_cast("timestamp")).withColumns(
            {c: F.col(c).try_cast("double") for c in WEATHER_MEASURES}
        )
    )


def write_csv(
    df: DataFrame, path: str, single_file: bool = False, order: Sequence[str] = ()
) -> None:
    """CSV with a header, in ``order`` if given, written in parallel.

    ``single_file`` sends the finished rows through one task, for results known to be small. The
    work before that stays parallel, which coalescing to one partition would not leave it.
    """
    if single_file:
        out = df.repartition(1)
        out = out.sortWithinPartitions(*order) if order else out
    else:
        out = df.orderBy(*order) if order else df
    out.write.option("header", True).option("timestampFormat", _TIMESTAMP_FORMAT).csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """A training set written as CSV: day, count and weather, coerced."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col("date").try_cast("date").alias("date"),
        F.col("count").try_cast("long").alias("count"),
        F.col("datetime").try_cast("timestamp").alias("datetime"),
        *[F.col(c).try_cast("double").alias(c) for c in WEATHER_MEASURES],
        "conditions",
    )
