"""Batches of messages in one global order, spread over as many files as it takes.

The messages are sorted by ranges: every task writes one segment, whose messages come after those of
all earlier segments. A message knows its segment and its place in it; how many messages each segment
holds is written beside the topic, in ``<topic>.order``, once all of them are there. Position in the
batch is then the number of messages in earlier segments plus the place, so reading in order takes
neither a sort nor a shuffle, and reading from a position on opens the segments from there on alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from rideflow.schemas import TOPIC
from rideflow.sources.topics import batch_folder

# A generated row number holds the task above these bits, the row in the task in them.
_ROW_BITS = 33
_COUNTS = "segment int, messages long"


class Segment(NamedTuple):
    number: int
    first: int
    messages: int


def sorted_rows(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` in global order; equal ones by where they were read.

    The last key also parts equal rows, so however many there are they don't meet in one task.
    """
    read = rows.withColumn("__read", F.monotonically_increasing_id())
    return read.orderBy(*order, "__read").drop("__read")


def _counts_path(topic: str, partition: int | None, batch: str | int) -> str:
    return batch_folder(f"{topic}.order", partition, batch)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def publish(
    messages: DataFrame,
    topic: str,
    partition: int | None = None,
    batch: str | int | None = None,
) -> str:
    """Send messages made of ``sorted_rows`` to a file-backed topic; returns the batch's name.

    For other readers of the topic it is a batch like any other. A batch sent again under its name
    replaces the old one; while that is under way it has no order.
    """
    spark = messages.sparkSession
    name = uuid.uuid4().hex if batch is None else str(batch)
    folder, counts = batch_folder(topic, partition, name), _counts_path(topic, partition, name)
    _remove(spark, counts)
    row = F.monotonically_increasing_id()
    numbered = messages.select(
        "value",
        F.shiftright(row, _ROW_BITS).cast("int").alias("segment"),
        row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("place"),
    )
    numbered.write.mode("overwrite").parquet(folder)
    written = spark.read.schema(numbered.schema).parquet(folder)
    held = written.groupBy("segment").agg(F.count("*").alias("messages"))
    held.coalesce(1).write.mode("overwrite").parquet(counts)
    return name


def segments(
    spark: SparkSession, topic: str, batch: str | int, partition: int | None = None
) -> list[Segment]:
    """The segments of a batch, in order. There are as many as tasks wrote it."""
    held = spark.read.schema(_COUNTS).parquet(_counts_path(topic, partition, batch))
    rows = sorted((r.segment, r.messages) for r in held.collect())
    firsts = accumulate((n for _, n in rows), initial=0)
    return [Segment(number, first, n) for (number, n), first in zip(rows, firsts)]


def read(
    spark: SparkSession,
    topic: str,
    batch: str | int,
    partition: int | None = None,
    first: int = 0,
    last: int | None = None,
) -> DataFrame:
    """``value`` and ``position`` (from 0) of the messages of a batch from ``first`` to ``last``.

    Segments outside are skipped by the statistics of their files. A batch whose order isn't written
    (yet) can't be read here.
    """
    found = segments(spark, topic, batch, partition)
    end = sum(s.messages for s in found) - 1 if last is None else last
    wanted = [s for s in found if s.first <= end and s.first + s.messages > first]
    schema = f"value {TOPIC['value'].dataType.simpleString()}, segment int, place long"
    rows = spark.read.schema(schema).parquet(batch_folder(topic, partition, batch))
    if not wanted:
        return rows.select("value", F.col("place").alias("position")).limit(0)
    low, high = wanted[0].number, wanted[-1].number
    before = dict((s.number, s.first) for s in wanted)
    starts = F.array(*[F.lit(before.get(n, 0)).cast("bigint") for n in range(low, high + 1)])
    position = F.get(starts, F.col("segment") - low) + F.col("place")
    placed = rows.filter(F.col("segment").between(low, high)).select(
        "value", position.alias("position")
    )
    return placed.filter(F.col("position").between(first, end))
