"""Message topics: JSON values on Kafka, or in Parquet folders with the same shape.

A file-backed topic is laid out as ``<topic>/partition=<n>/batch=<id>/*.parquet``. One code path
serves both; a target or source given as a dict is a set of Kafka options, a string is a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rideflow.functions.labels import iso_text
from rideflow.schemas import (
    RIDE_COLUMNS,
    SOURCE_TYPE_COLUMN,
    TOPIC,
    WEATHER_COLUMNS,
)

# Raw rides go to partition 0 of the topic, cleaned ones to partition 1.
RAW_PARTITION = 0
CLEAN_PARTITION = 1


def to_messages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object per row in ``value``; NULL fields are left out."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def ride_messages(rides: DataFrame) -> DataFrame:
    """Raw ride messages: times as text, the bike type under its source name."""
    texts = {c: F.col(c).cast("string") for c in ("started_at", "ended_at")}
    columns = [SOURCE_TYPE_COLUMN if c == "rideable_type" else c for c in RIDE_COLUMNS]
    named = rides.withColumnRenamed("rideable_type", SOURCE_TYPE_COLUMN).withColumns(texts)
    return to_messages(named, columns)


def clean_ride_messages(clean: DataFrame) -> DataFrame:
    """Cleaned ride messages; they keep the duration, in seconds."""
    texts = {c: F.col(c).cast("string") for c in ("started_at", "ended_at")}
    columns = [SOURCE_TYPE_COLUMN if c == "rideable_type" else c for c in RIDE_COLUMNS]
    named = (
        clean.withColumnRenamed("rideable_type", SOURCE_TYPE_COLUMN)
        .withColumns(texts)
        .withColumn("duration", F.col("duration_seconds"))
    )
    return to_messages(named, [*columns, "duration"])


def weather_messages(weather: DataFrame) -> DataFrame:
    """Weather messages with the day as ISO text."""
    return to_messages(weather.withColumn("datetime", iso_text(F.col("datetime"))), WEATHER_COLUMNS)


def kafka_write_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def kafka_read_options(
    servers: str,
    topic: str,
    partitions: Sequence[int] | None = None,
    starting: str = "latest",
    max_per_trigger: int | None = None,
    min_tasks: int | None = None,
) -> dict[str, str]:
    """Options of a Kafka source; ``partitions`` narrows it from the whole topic to those.

    All raw rides are on one topic partition; ``min_tasks`` lets that many tasks share it.
    """
    options = {"kafka.bootstrap.servers": servers, "startingOffsets": starting}
    if partitions is None:
        options["subscribe"] = topic
    else:
        options["assign"] = json.dumps({topic: list(partitions)})
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_tasks is not None:
        options["minPartitions"] = str(min_tasks)
    return options


def batch_folder(topic: str, partition: int | None, batch: str | int) -> str:
    return f"{topic}/partition={partition or 0}/batch={batch}"


def publish(
    messages: DataFrame,
    target: str | dict[str, str],
    partition: int | None = None,
    batch: str | int | None = None,
) -> None:
    """Send messages, to one partition if given. All executors write; nothing is collected.

    On a file-backed topic ``batch`` names the folder the messages go to, a new one if not given. A
    batch sent again under its name replaces what it wrote before.
    """
    if isinstance(target, dict):
        if partition is not None:
            messages = messages.withColumn("partition", F.lit(partition))
        messages.write.format("kafka").options(**target).save()
    else:
        name = uuid.uuid4().hex if batch is None else batch
        messages.write.mode("overwrite").parquet(batch_folder(target, partition, name))


def batch_writer(
    target: str | dict[str, str], partition: int | None = None, sender: str = "stream"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` callback that publishes each micro-batch under its sender and id."""

    def write(messages: DataFrame, batch_id: int) -> None:
        publish(messages, target, partition, f"{sender}-{batch_id}")

    return write


def _only(messages: DataFrame, partition: int | None) -> DataFrame:
    return messages if partition is None else messages.filter(F.col("partition") == partition)


def read_topic(spark: SparkSession, source: str | dict[str, str], partition: int | None = None):
    """All messages of a topic as a batch; on folders ``partition`` prunes to one of them."""
    if isinstance(source, dict):
        return _only(spark.read.format("kafka").options(**source).load(), partition)
    return _only(spark.read.schema(TOPIC).parquet(source), partition)


def stream_topic(
    spark: SparkSession,
    source: str | dict[str, str],
    partition: int | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same topic as an unbounded stream."""
    if isinstance(source, dict):
        return _only(spark.readStream.format("kafka").options(**source).load(), partition)
    reader = spark.readStream.schema(TOPIC)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _only(reader.parquet(source), partition)
