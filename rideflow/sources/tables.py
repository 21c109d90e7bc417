"""Ride and weather tables: creation, keyed append, reading."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rideflow.operators.cleaning import first_per_key, to_ride_table
from rideflow.schemas import RIDE_TABLE, RIDE_TABLE_STORED, WEATHER_COLUMNS, WEATHER_TABLE
from rideflow.sources.keys import known_keys, make_folder

# Keys of one batch are broadcast up to so many bytes, 32 added to each.
BROADCAST_BYTES = 64 << 20
# Days of one batch that are looked up as constants; more are matched by a join.
DAY_LIST = 400


def _columns(schema: StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def create_ride_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """The 14-column ride table, laid out by day, if it is not there yet."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(RIDE_TABLE)}, date date)"
        f" USING parquet PARTITIONED BY (date){where}"
    )


def create_weather_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """The 9-column weather table, if it is not there yet."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(WEATHER_TABLE)}) USING parquet{where}"
    )


def location(spark: SparkSession, name: str) -> str:
    """Folder of a catalog table."""
    described = spark.sql(f"DESCRIBE FORMATTED {name}")
    return described.where("col_name = 'Location'").select("data_type").first()[0]


def insert_by_name(
    spark: SparkSession, name: str, rows: DataFrame, key: str | None = None, order: Sequence[str] = ()
) -> None:
    """Append ``rows`` to a catalog table, columns matched by name.

    With ``key`` a row is appended only if it has a key that is new, the first by ``order`` of
    several. Keys are looked up in the index of the table's folder, so rows that were appended there
    by path count too; the days they brought are made known to the catalog.
    """
    if key is None:
        _insert(spark, name, rows)
        return
    fresh = first_per_key(rows.filter(F.col(key).isNotNull()), key, order).persist()
    try:
        place = location(spark, name)
        make_folder(spark, place)
        if any(c.isPartition for c in spark.catalog.listColumns(name)):
            spark.catalog.recoverPartitions(name)
        _insert(spark, name, _unknown(fresh, known_keys(spark, place, fresh, key), key))
    finally:
        fresh.unpersist()


def _insert(spark: SparkSession, name: str, rows: DataFrame) -> None:
    balanced = rows.hint("rebalance", "date") if "date" in rows.columns else rows
    spark.sql(f"INSERT INTO {name} BY NAME SELECT * FROM {{rows}}", rows=balanced)


def _stored(
    spark: SparkSession, path: str, schema: StructType, partition_by: str | None
) -> DataFrame:
    """The table as it is, empty if it has just been made."""
    empty = spark.createDataFrame([], schema).write.mode("ignore")
    (empty.partitionBy(partition_by) if partition_by else empty).parquet(path)
    return spark.read.schema(schema).parquet(path)


def same_partitions(known: DataFrame, fresh: DataFrame, partition_by: str) -> DataFrame:
    """Stored rows in the very partitions the new ones fall into, however far apart these are."""
    parts = fresh.select(partition_by).distinct()
    found = [r[0] for r in parts.limit(DAY_LIST + 1).collect()]
    if len(found) > DAY_LIST:
        same = F.col(partition_by).eqNullSafe(F.col("_part"))
        return known.join(parts.withColumnRenamed(partition_by, "_part"), same, "left_semi")
    # Constants, so that other partitions are not even listed.
    column = F.col(partition_by)
    listed = column.isin([x for x in found if x is not None])
    return known.filter(listed | column.isNull() if None in found else listed)


def _unknown(fresh: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """Rows of ``fresh`` whose key is not among the known ones."""
    if known is None:
        return fresh
    width = F.octet_length(F.col(key).cast("string")) + 32
    size = fresh.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first().bytes
    if size <= BROADCAST_BYTES:
        # A pass over the stored keys without shuffling them; at most one hit per key.
        hits = known.join(F.broadcast(fresh.select(key)), key, "left_semi")
        return fresh.join(F.broadcast(hits), key, "left_anti")
    return fresh.join(known, key, "left_anti")


def append_unique(
    rows: DataFrame,
    path: str,
    key: str,
    order: Sequence[str],
    partition_by: str | None = None,
    within_partition: bool = False,
) -> None:
    """Append the rows whose key is new, one per key; rows without a key are refused.

    Keys are looked up in an index beside the table (:mod:`rideflow.sources.keys`), which covers all
    its files, whoever wrote them. With ``within_partition`` keys are looked up in the partitions of
    the rows themselves: right where copies of a row always share its partition.

    Appending the same rows again changes nothing, so a replayed micro-batch is harmless, and so is an
    append that ended early, as the files it left are seen by the next. One writer per table at a
    time, as with any primary key that is checked before it is written.
    """
    spark = rows.sparkSession
    fresh = first_per_key(rows.filter(F.col(key).isNotNull()), key, order).persist()
    try:
        stored = _stored(spark, path, rows.schema, partition_by)
        if within_partition and partition_by:
            known = same_partitions(stored, fresh, partition_by).select(key)
        else:
            known = known_keys(spark, path, fresh, key)
        new = _unknown(fresh, known, key)
        if partition_by is None:
            new.write.mode("append").parquet(path)
        else:
            # Rebalancing gathers a day into few files, but splits a day that is too large.
            new.hint("rebalance", partition_by).write.mode("append").partitionBy(
                partition_by
            ).parquet(path)
    finally:
        fresh.unpersist()


def append_rides(clean: DataFrame, path: str, resent_unchanged: bool = False) -> None:
    """Append cleaned rides to the ride table, unique by ``ride_id``, earliest start first.

    Say ``resent_unchanged`` if a ride that comes again always has the same start time: its key is
    then looked up among the rides of its day only.
    """
    append_unique(
        to_ride_table(clean), path, "ride_id", ["started_at"], "date", resent_unchanged
    )


def append_weather(weather: DataFrame, path: str) -> None:
    """Append weather days to the weather table, unique by ``datetime``."""
    typed = weather.select(*[F.col(f.name).cast(f.dataType) for f in WEATHER_TABLE.fields])
    append_unique(typed, path, "datetime", [])


def table_writer(
    append: Callable[..., None], path: str, **options: bool
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` callback that appends each micro-batch to a table."""

    def write(rows: DataFrame, batch_id: int) -> None:
        append(rows, path, **options)

    return write


def read_ride_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RIDE_TABLE_STORED).parquet(path)


def read_weather_table(
    spark: SparkSession, path: str, days: int | None = None
) -> DataFrame:
    """Weather days; with ``days``, the earliest so many."""
    weather = spark.read.schema(WEATHER_TABLE).parquet(path)
    return weather if days is None else first_days(weather, days)


def first_days(weather: DataFrame, days: int) -> DataFrame:
    return weather.select(*WEATHER_COLUMNS).orderBy("datetime").limit(days)


def read_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Rides of one day, by UTC, in start order; only that day's folder is read."""
    stored = read_ride_table(spark, path).filter(F.col("date") == F.lit(day).cast("date"))
    return stored.orderBy("started_at", "ride_id")
