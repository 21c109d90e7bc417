"""Intraday figures of a running day, kept up to date by micro-batches.

A micro-batch adds its rides, and their sums per minute and key, to the parts by day; the days it
touches, and no others, are worked out anew. Their edges move as rides come in, but the minute an edge
lies in follows from the histogram of the minutes, and every other minute goes to its snapshot as a
sum: of a day's rides only those of the few minutes with an edge are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rideflow.functions.pricing import with_revenue
from rideflow.operators.cleaning import parse_clean_rides
from rideflow.operators.positions import cell_of, snapshot_points
from rideflow.operators.snapshots import KEYS, headline_sums, kpis_from_cells
from rideflow.session import run_folder, scratch_path
from rideflow.sources.tables import same_partitions
from rideflow.sources.topics import CLEAN_PARTITION, stream_topic
from rideflow.streaming.jobs import claim, dedup_rides, run

_RIDES = (
    "ride_id string, started_at timestamp, rideable_type string, start_station_name string, "
    "end_station_name string, revenue double, hour timestamp, cell long, date date, batch long"
)
_SUMS = (
    "cell long, no_bar int, no_start int, hour timestamp, rideable_type string, "
    "start_station_name string, end_station_name string, rides long, fare long, "
    "date date, batch long"
)


def _parts(spark: SparkSession, target: str, kind: str, schema: str, upto: int | None) -> DataFrame:
    """Parts of all batches, those up to the newest folded one in its stead; none after ``upto``."""
    none = spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch", "date")
    none.parquet(f"{target}/{kind}")
    folded = spark.createDataFrame([], schema.replace("batch long", "upto long"))
    folded.write.mode("ignore").partitionBy("upto", "date").parquet(f"{target}/{kind}-folded")
    parts = spark.read.schema(schema).parquet(f"{target}/{kind}")
    whole = spark.read.schema(folded.schema).parquet(f"{target}/{kind}-folded")
    last = whole.agg(F.max("upto")).first()[0]
    if last is not None:
        whole, parts = whole.filter(F.col("upto") == last), parts.filter(F.col("batch") > last)
    if upto is not None:
        parts = parts.filter(F.col("batch") <= upto)
    return whole.drop("upto").unionByName(parts.drop("batch"))


def figures_of_days(
    spark: SparkSession, target: str, days: DataFrame, upto: int | None = None
) -> DataFrame:
    """The headline figures of all snapshots of the days in ``days``, from the parts."""
    sums = same_partitions(_parts(spark, target, "sums", _SUMS, upto), days, "date")
    rides = same_partitions(_parts(spark, target, "rides", _RIDES, upto), days, "date")
    bars = sums.filter("no_bar = 0")
    cells = bars.groupBy("date", "cell").agg(F.sum("rides").alias("cell_rows"))
    return kpis_from_cells(sums, rides, snapshot_points(rides, cells=cells))


def add_batch(spark: SparkSession, target: str, rides: DataFrame, batch_id: int) -> None:
    """Add a batch of distinct priced rides and bring their days up to date.

    A batch that comes again replaces its own folders.
    """
    timed = rides.filter(F.col("started_at").isNotNull() & F.col("ride_id").isNotNull()).select(
        *_RIDES.replace(",", "").split()[:12:2],
        F.date_trunc("hour", "started_at").alias("hour"),
        cell_of(F.col("started_at")).alias("cell"),
        F.to_date("started_at").alias("date"),
    )
    with run_folder(spark):
        # A micro-batch is planned without AQE, which would leave as many files a day as tasks: read
        # back in the caller's session, its rows are dealt by day.
        arrived = scratch_path(spark, "arrived")
        timed.write.parquet(arrived)
        folder = f"{target}/rides/batch={batch_id}"
        _write_by_day(spark.read.schema(timed.schema).parquet(arrived), folder)
        # In order of minutes, the written rides shrink to their sums within tasks.
        added = spark.read.schema(_RIDES.removesuffix(", batch long")).parquet(folder)
        if added.isEmpty():
            return
        _write_by_day(headline_sums(added, ["date", "cell"]), f"{target}/sums/batch={batch_id}")
        found = figures_of_days(spark, target, added, batch_id)
        found.write.mode("overwrite").partitionBy("date").parquet(f"{target}/kpis/batch={batch_id}")


def _write_by_day(rows: DataFrame, folder: str) -> None:
    """Write rows by day in order of minutes, so that a read of a few skips the other blocks of a file."""
    rows.hint("rebalance", "date").sortWithinPartitions("date", "cell").write.mode(
        "overwrite"
    ).partitionBy("date").parquet(folder)


def snapshot_stream(
    spark: SparkSession,
    source: str | dict[str, str],
    target: str,
    checkpoint: str,
    every: str | None = None,
    files_per_trigger: int | None = None,
    delay: str | None = None,
) -> StreamingQuery:
    """Cleaned ride messages in, the headline figures of every snapshot of their days out.

    Every ride counts once (:func:`rideflow.streaming.jobs.dedup_rides`). :func:`latest_kpis` reads the
    figures, :func:`fold` joins the parts of old batches. A target belongs to one checkpoint.
    """
    partition = None if isinstance(source, dict) else CLEAN_PARTITION
    messages = stream_topic(spark, source, partition, files_per_trigger)
    rides = parse_clean_rides(messages).withColumnRenamed("duration", "duration_seconds")

    def write(rows: DataFrame, batch_id: int) -> None:
        claim(spark, target, checkpoint)
        add_batch(spark, target, with_revenue(rows), batch_id)

    return run(dedup_rides(rides, delay), write, checkpoint, "append", every)


def latest_kpis(spark: SparkSession, target: str) -> DataFrame:
    """The figures of every day, from the last batch that touched it."""
    found = spark.read.parquet(f"{target}/kpis")
    last = found.groupBy(F.col("date").alias("_day")).agg(F.max("batch").alias("_last"))
    newest = (F.col("date") == F.col("_day")) & (F.col("batch") == F.col("_last"))
    return found.join(last, newest).drop("_day", "_last", "batch")


def fold(spark: SparkSession, target: str, upto: int) -> None:
    """Join the parts of all batches up to number ``upto``, one set by day, rides in order.

    Sums of one minute and key are added up. The old parts stay for readers that have begun with them.
    """
    rides = _parts(spark, target, "rides", _RIDES, upto)
    sums = _parts(spark, target, "sums", _SUMS, upto).groupBy("date", "cell", *KEYS).agg(
        F.sum("rides").alias("rides"), F.sum("fare").alias("fare")
    )
    for kind, rows in (("sums", sums), ("rides", rides)):
        _write_by_day(rows, f"{target}/{kind}-folded/upto={upto}")
