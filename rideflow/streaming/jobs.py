"""Structured Streaming jobs: clean, load, de-duplicate, and hourly figures.

Every job takes a checkpoint folder. By default a job handles what has arrived and stops
(``availableNow``), which also is how to drain a topic before a shutdown; pass ``every`` to keep it
running.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rideflow.functions.pricing import amount, total_units, with_revenue
from rideflow.operators.cleaning import (
    clean_rides,
    parse_clean_rides,
    parse_rides,
    parse_weather,
)
from rideflow.operators.rejects import counted, good, judged_rides, rejected
from rideflow.sources.tables import append_rides, append_weather, table_writer
from rideflow.sources.topics import (
    CLEAN_PARTITION,
    RAW_PARTITION,
    batch_writer,
    clean_ride_messages,
    stream_topic,
)

BatchFn = Callable[[DataFrame, int], None]

# Keys that are never forgotten belong on disk, not in the executors' heap.
_DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's settings come back after."""
    before = {k: spark.conf.get(k, None) for k in _DISK_STATE}
    for k, v in _DISK_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def until_marked(
    start: Callable[[str | None], StreamingQuery], every: str, marker: str, look: float = 1.0
) -> None:
    """Run a job until there is a file ``marker``, then stop it in good order.

    ``start`` starts the job with the given interval. The batch in hand is finished, and what has
    arrived since is handled by a last run of the same job that takes all there is and ends.
    """
    query = start(every)
    spark = query._spark if hasattr(query, "_spark") else SparkSession.getActiveSession()
    place = spark._jvm.org.apache.hadoop.fs.Path(marker)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    while query.isActive and not files.exists(place):
        query.awaitTermination(look)
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(look / 10)
    query.stop()
    query.awaitTermination()
    start(None).awaitTermination()


def run(stream: DataFrame, write: BatchFn, checkpoint: str, mode: str, every: str | None):
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with disk_state(stream.sparkSession):
        return writer.trigger(**trigger).start()


def clean_stream(
    spark: SparkSession,
    source: str | dict[str, str],
    target: str | dict[str, str],
    checkpoint: str,
    every: str | None = None,
    files_per_trigger: int | None = None,
    to_partition: int | None = CLEAN_PARTITION,
    rejects: str | None = None,
) -> StreamingQuery:
    """Raw ride messages in, cleaned ones with their duration out, on the other partition.

    With ``to_partition`` None a Kafka target spreads them over all its partitions. Messages that
    can't be read go to the table ``rejects``, if one is named, with their origin and the reason
    (:mod:`rideflow.operators.rejects`), and no further; the progress of the query reports how many.
    """
    partition = None if isinstance(source, dict) else RAW_PARTITION
    messages = stream_topic(spark, source, partition, files_per_trigger)
    clean = clean_ride_messages(clean_rides(parse_rides(messages)))
    # Batch ids count from 0 for each checkpoint; its name keeps two of them apart.
    sender = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    write = batch_writer(target, to_partition, sender)
    if rejects is None:
        return run(clean, write, checkpoint, "append", every)

    def write_both(rows: DataFrame, batch_id: int) -> None:
        judged = rows.persist()
        try:
            write(clean_ride_messages(clean_rides(good(judged))), batch_id)
            place = f"{rejects}/batch_id={sender}-{batch_id}"
            rejected(judged).write.mode("overwrite").parquet(place)
        finally:
            judged.unpersist()

    return run(counted(judged_rides(messages)), write_both, checkpoint, "append", every)


def load_rides_stream(
    spark: SparkSession,
    source: str | dict[str, str],
    table: str,
    checkpoint: str,
    every: str | None = None,
    files_per_trigger: int | None = None,
    resent_unchanged: bool = False,
) -> StreamingQuery:
    """Cleaned ride messages into the ride table, one row per ride.

    ``resent_unchanged`` is explained at :func:`rideflow.sources.tables.append_rides`.
    """
    partition = None if isinstance(source, dict) else CLEAN_PARTITION
    messages = stream_topic(spark, source, partition, files_per_trigger)
    rides = parse_clean_rides(messages)
    write = table_writer(append_rides, table, resent_unchanged=resent_unchanged)
    return run(rides, write, checkpoint, "append", every)


def load_weather_stream(
    spark: SparkSession,
    source: str | dict[str, str],
    table: str,
    checkpoint: str,
    every: str | None = None,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Weather messages into the weather table, one row per day."""
    messages = stream_topic(spark, source, None, files_per_trigger)
    days = parse_weather(messages)
    return run(days, table_writer(append_weather, table), checkpoint, "append", every)


def dedup_rides(
    rides: DataFrame, delay: str | None = None, salts: int | None = None
) -> DataFrame:
    """Each ride once, whenever its copies arrive.

    The state holds every key, a narrow row each, and grows with the keys; the jobs here keep it on
    disk. With ``delay`` a key is forgotten that long after it was seen, so the state is bounded, and a
    copy that comes later passes. The clock is then the job's own, the time of the micro-batch: no
    ride is ever late, however old its start is, however the input is cut into batches, and with or
    without a start time.

    With ``salts`` copies are first dropped within so many slices of the input, at the price of a
    second shuffle and state: a ride sent very many times then reaches the task that owns its key at
    most ``salts`` times.
    """
    keyed = rides.filter(F.col("ride_id").isNotNull())
    if delay is None:
        if salts is not None:
            sliced = keyed.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(salts)))
            keyed = sliced.dropDuplicates(["ride_id", "_slice"]).drop("_slice")
        return keyed.dropDuplicates(["ride_id"])
    keyed = keyed.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", delay)
    if salts is not None:
        sliced = keyed.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(salts)))
        keyed = sliced.dropDuplicatesWithinWatermark(["ride_id", "_slice"]).drop("_slice")
    return keyed.dropDuplicatesWithinWatermark(["ride_id"]).drop("_seen")


def dedup_stream(
    spark: SparkSession,
    source: str | dict[str, str],
    target: str,
    checkpoint: str,
    every: str | None = None,
    files_per_trigger: int | None = None,
    delay: str | None = None,
    salts: int | None = None,
) -> StreamingQuery:
    """Raw ride messages in, each ride once out, as a Parquet folder."""
    partition = None if isinstance(source, dict) else RAW_PARTITION
    rides = parse_rides(stream_topic(spark, source, partition, files_per_trigger))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = (
        dedup_rides(rides, delay, salts)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
    )
    with disk_state(spark):
        return writer.start()


def claim(spark: SparkSession, target: str, checkpoint: str) -> None:
    """Refuse a target whose batches are numbered by another checkpoint than this one."""
    own = spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0].strip()
    place = f"{target}/owner"
    spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("ignore").text(place)
    found = spark.read.text(place).first()[0]
    if found != own:
        raise ValueError(f"{target} was written by a job with another checkpoint")


HOURS = "hour timestamp, rideable_type string, rides long, revenue double"


def hourly_stream(
    spark: SparkSession,
    source: str | dict[str, str],
    target: str,
    checkpoint: str,
    every: str | None = None,
    files_per_trigger: int | None = None,
    delay: str | None = None,
) -> StreamingQuery:
    """Cleaned ride messages in, hourly figures out: what each micro-batch adds to its hours.

    A ride counts once (:func:`dedup_rides`). Counts and sums add up, so no hour is ever closed and no ride too late; a
    batch that runs again replaces its own folder. :func:`latest_hours` adds the batches up,
    :func:`fold_hours` replaces old ones by their sum. A target belongs to one checkpoint; a job with
    another one is refused.
    """
    partition = None if isinstance(source, dict) else CLEAN_PARTITION
    messages = stream_topic(spark, source, partition, files_per_trigger)
    rides = parse_clean_rides(messages).withColumnRenamed("duration", "duration_seconds")

    def write(rows: DataFrame, batch_id: int) -> None:
        claim(spark, target, checkpoint)
        added = _summed(with_revenue(rows).select(
            F.date_trunc("hour", "started_at").alias("hour"),
            "rideable_type",
            F.lit(1).alias("rides"),
            "revenue",
        ))
        added.write.mode("overwrite").parquet(f"{target}/added/batch={batch_id}")

    return run(dedup_rides(rides, delay), write, checkpoint, "append", every)


def _summed(parts: DataFrame) -> DataFrame:
    known = parts.filter(F.col("rideable_type").isNotNull() & F.col("hour").isNotNull())
    return known.groupBy("hour", "rideable_type").agg(
        F.sum("rides").cast("long").alias("rides"),
        amount(total_units("revenue")).alias("revenue"),
    )


def _parts(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    """The newest folded sum and the batches after it, no further than ``upto``."""
    none = spark.createDataFrame([], f"{HOURS}, upto long")
    none.write.mode("ignore").partitionBy("upto").parquet(f"{target}/folded")
    none.withColumnRenamed("upto", "batch").write.mode("ignore").partitionBy("batch").parquet(
        f"{target}/added"
    )
    folded = spark.read.schema(f"{HOURS}, upto long").parquet(f"{target}/folded")
    added = spark.read.schema(f"{HOURS}, batch long").parquet(f"{target}/added")
    last = folded.agg(F.max("upto")).first()[0]
    if last is not None:
        folded, added = folded.filter(F.col("upto") == last), added.filter(F.col("batch") > last)
    if upto is not None:
        added = added.filter(F.col("batch") <= upto)
    return folded.drop("upto").unionByName(added.drop("batch"))


def latest_hours(spark: SparkSession, target: str) -> DataFrame:
    """The figures of each hour and bike type, over all batches so far."""
    return _summed(_parts(spark, target))


def fold_hours(spark: SparkSession, target: str, upto: int) -> None:
    """Write the sum of all batches up to number ``upto``; readers then take it in their stead.

    The batches stay where they are, so a reader that began before still finds them; their folders
    may go once no such reader is left.
    """
    _summed(_parts(spark, target, upto)).write.mode("overwrite").parquet(
        f"{target}/folded/upto={upto}"
    )
