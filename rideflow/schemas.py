"""Schemas of ride and weather records, messages and tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

COORDINATES = ("start_lat", "start_lng", "end_lat", "end_lng")

# The columns of a ride record, in source order.
RIDE_COLUMNS = (
    "ride_id",
    "rideable_type",
    "started_at",
    "ended_at",
    "start_station_name",
    "start_station_id",
    "end_station_name",
    "end_station_id",
    "start_lat",
    "start_lng",
    "end_lat",
    "end_lng",
    "member_casual",
)

# The seven numeric weather columns, in source order.
WEATHER_MEASURES = (
    "tempmax",
    "tempmin",
    "humidity",
    "precip",
    "snow",
    "windspeed",
    "windgust",
)
WEATHER_COLUMNS = ("datetime", *WEATHER_MEASURES, "conditions")


def _rides(coordinate: object, type_column: str = "rideable_type") -> StructType:
    kinds = {
        "started_at": TimestampType(),
        "ended_at": TimestampType(),
        **dict.fromkeys(COORDINATES, coordinate),
    }
    return StructType(
        [
            StructField(
                type_column if name == "rideable_type" else name,
                kinds.get(name, StringType()),
            )
            for name in RIDE_COLUMNS
        ]
    )


# The ride file and the ride message call the bike type `ride_type`; it is renamed on the way in.
SOURCE_TYPE_COLUMN = "ride_type"
RIDE_FILE = _rides(FloatType(), SOURCE_TYPE_COLUMN)
RIDE_MESSAGE = _rides(StringType(), SOURCE_TYPE_COLUMN)
CLEAN_RIDE_MESSAGE = _rides(StringType(), SOURCE_TYPE_COLUMN).add("duration", DoubleType())

# The ride table keeps coordinates as text, as its declared types do. `date` is the layout column.
RIDE_TABLE = _rides(StringType()).add("duration", DoubleType())
RIDE_TABLE_STORED = StructType([*RIDE_TABLE.fields, StructField("date", DateType())])


def _weather(measure: object) -> StructType:
    return StructType(
        [
            StructField("datetime", TimestampType()),
            *[StructField(name, measure) for name in WEATHER_MEASURES],
            StructField("conditions", StringType()),
        ]
    )


WEATHER_FILE = _weather(FloatType())
WEATHER_MESSAGE = WEATHER_FILE
WEATHER_TABLE = WEATHER_FILE

# A file-backed topic: one row per message; partition and batch are folder names.
TOPIC = StructType(
    [
        StructField("value", StringType()),
        StructField("partition", IntegerType()),
        StructField("batch", StringType()),
    ]
)
