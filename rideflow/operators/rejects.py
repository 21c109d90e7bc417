"""Input that can't be read is kept, with the reason, beside what can.

One pass judges every message or line; the readable ones go on, the others to a reject table. A
message is rejected if it isn't a JSON object, or if a time or coordinate is there but can't be read
(the text ``None`` stands for a missing time). Fields that are missing are no reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rideflow.schemas import (
    COORDINATES,
    RIDE_COLUMNS,
    RIDE_FILE,
    RIDE_MESSAGE,
    SOURCE_TYPE_COLUMN,
)

NOT_JSON = "not json"
BAD_LINE = "unreadable line"
TIMES = ("started_at", "ended_at")
# Where a message comes from, as far as its source tells.
ORIGIN = ("topic", "partition", "offset", "batch")


def judged_rides(messages: DataFrame) -> DataFrame:
    """The ride columns of each message, its ``value``, origin and ``reason``; NULL if it is fine."""
    value = F.col("value").cast("string")
    origin = [F.col(c) for c in ORIGIN if c in messages.columns]
    parsed = messages.select(
        value.alias("value"),
        *origin,
        F.from_json(value, "map<string,string>").alias("_raw"),
        F.from_json(value, RIDE_MESSAGE).alias("_data"),
    )

    def unreadable(column: str) -> Column:
        text, read = F.col("_raw")[column], F.col("_data")[column]
        if column in COORDINATES:
            read = read.try_cast("double")
        return F.when(text.isNotNull() & (text != "None") & read.isNull(), F.lit(column))

    reason = F.coalesce(
        F.when(F.col("_raw").isNull(), F.lit(NOT_JSON)), *map(unreadable, (*TIMES, *COORDINATES))
    )
    return (
        parsed.withColumn("reason", reason)
        .select("value", *origin, "reason", "_data.*")
        .withColumnRenamed(SOURCE_TYPE_COLUMN, "rideable_type")
    )


def counted(judged: DataFrame, name: str = "parsed") -> DataFrame:
    """The same rows; a run over them reports how many were read and how many rejected."""
    return judged.observe(
        name, F.count("*").alias("read"), F.count("reason").alias("rejected")
    )


def good(judged: DataFrame) -> DataFrame:
    """The rides that can be read."""
    return judged.filter(F.col("reason").isNull()).select(*RIDE_COLUMNS)


def rejected(judged: DataFrame) -> DataFrame:
    """What can't: the text as it came, where from, and why."""
    origin = [c for c in ORIGIN if c in judged.columns]
    return judged.filter(F.col("reason").isNotNull()).select("value", *origin, "reason")


def judged_ride_file(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a ride CSV: its columns, and for a line of another number of fields, or with a
    number or time that can't be read, the line as ``value``, its file as ``batch``, and ``reason``."""
    corrupt = "_corrupt"
    schema = StructType([*RIDE_FILE.fields, StructField(corrupt, StringType())])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("columnNameOfCorruptRecord", corrupt)
        .csv(path)
    )
    judged = raw.withColumns(
        {
            "value": F.col(corrupt),
            "batch": F.col("_metadata.file_name"),
            "reason": F.when(F.col(corrupt).isNotNull(), F.lit(BAD_LINE)),
            **{c: F.col(c).cast("double") for c in COORDINATES},
        }
    )
    return judged.drop(corrupt).withColumnRenamed(SOURCE_TYPE_COLUMN, "rideable_type")


def split_to(judged: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """Write a judged table once, good and rejected rows apart, and read both back."""
    spark = judged.sparkSession
    marked = judged.withColumn("is_rejected", F.col("reason").isNotNull())
    marked.write.partitionBy("is_rejected").parquet(place)
    stored = spark.read.schema(marked.schema).parquet(place)
    return good(stored.filter("not is_rejected")), rejected(stored.filter("is_rejected"))
