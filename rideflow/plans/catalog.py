"""Named queries over a folder of star-schema tables.

Each is a function of (session, folder). Times leave as zone-less timestamps, so a result does not
depend on the session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from rideflow.functions.labels import (
    day_label,
    dollars_text,
    rides_text,
    two_decimals_text,
)
from rideflow.functions.pricing import with_revenue
from rideflow.operators import cleaning, flows, forecast, kpis, rejects, snapshots, training, trees
from rideflow.schemas import COORDINATES, RIDE_COLUMNS, WEATHER_MEASURES
from rideflow.session import scratch_path, stage
from rideflow.sources import files, ordered, star, tables, topics
from rideflow.streaming import jobs, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Cut-offs and days the queries are asked for. Current data starts in 2024; the past tables hold
# the years 1992-2001 and are split at the start of 1998.
CURRENT_AFTER = "2024-01-01"
PAST_AFTER, PAST_BEFORE = "1996-12-31", "1998-01-01"
DAY = "2024-01-15"
FORECAST_FROM = "2024-01-08"
SERVED_DAYS = 57


def query(fn: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = fn(spark, folder)
        times = [f.name for f in result.schema.fields if isinstance(f.dataType, TimestampType)]
        return result.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def priced(spark: SparkSession, folder: str) -> DataFrame:
    """All rides with duration and revenue."""
    return with_revenue(cleaning.with_duration(star.rides(spark, folder)))


# Sources and sinks


@query
def csv_typed_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "rides-csv")
    files.write_csv(star.rides(spark, folder), path)
    return files.read_ride_file(spark, path)


@query
def csv_inferred_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "rides-csv")
    files.write_csv(star.rides(spark, folder), path)
    return files.read_inferred(spark, path).withColumn("ride_id", F.col("ride_id").cast("string"))


@query
def weather_inferred_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "weather-csv")
    days = star.weather(spark, folder).withColumn("datetime", F.to_date("datetime"))
    files.write_csv(days, path, single_file=True)
    found = files.read_inferred(spark, path)
    return found.withColumns({c: F.col(c).cast("double") for c in WEATHER_MEASURES})


@query
def weather_daily(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "weather-csv")
    files.write_csv(star.weather(spark, folder), path, single_file=True, order=["datetime"])
    return files.read_weather_file(spark, path)


@query
def serving_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "rides-csv")
    files.write_csv(star.rides(spark, folder), path)
    return files.read_rides(spark, path)


@query
def publish_ride_json(spark: SparkSession, folder: str) -> DataFrame:
    topic = scratch_path(spark, "rides-topic")
    topics.publish(topics.ride_messages(star.rides(spark, folder)), topic, topics.RAW_PARTITION)
    return cleaning.with_coordinates(cleaning.parse_rides(topics.read_topic(spark, topic)))


@query
def publish_weather_json(spark: SparkSession, folder: str) -> DataFrame:
    topic = scratch_path(spark, "weather-topic")
    topics.publish(topics.weather_messages(star.weather(spark, folder)), topic)
    found = cleaning.parse_weather(topics.read_topic(spark, topic))
    return found.withColumns({c: F.col(c).cast("double") for c in WEATHER_MEASURES})


@query
def publish_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    topic = scratch_path(spark, "rides-topic")
    rides = star.rides(spark, folder)
    topics.publish(topics.ride_messages(rides), topic, topics.RAW_PARTITION)
    clean = cleaning.clean_rides(rides)
    topics.publish(topics.clean_ride_messages(clean), topic, topics.CLEAN_PARTITION)
    parts = []
    for partition in (topics.RAW_PARTITION, topics.CLEAN_PARTITION):
        found = cleaning.parse_clean_rides(topics.read_topic(spark, topic, partition))
        parts.append(found.select("ride_id", "duration", F.lit(partition).alias("partition")))
    return parts[0].unionByName(parts[1])


@query
def publish_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Rides sent in start order, with their positions as a reader finds them."""
    topic = scratch_path(spark, "rides-topic")
    rides = ordered.sorted_rows(star.rides(spark, folder), ["started_at", "ride_id"])
    batch = ordered.publish(topics.ride_messages(rides), topic, topics.RAW_PARTITION)
    found = ordered.read(spark, topic, batch, topics.RAW_PARTITION)
    return found.select(F.get_json_object("value", "$.ride_id").alias("ride_id"), "position")


@query
def ride_table_ddl(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "ride-table")
    name = "ride_data_" + path[-12:]
    tables.create_ride_table(spark, name, path)
    tables.create_ride_table(spark, name, path)
    clean = cleaning.clean_rides(star.rides(spark, folder))
    for _ in range(2):
        tables.insert_by_name(
            spark, name, cleaning.to_ride_table(clean), "ride_id", ["started_at"]
        )
    spark.sql(f"DROP TABLE {name}")
    return cleaning.with_coordinates(tables.read_ride_table(spark, path))


@query
def table_day_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One day of the ride table; the other days' folders are not read."""
    table = scratch_path(spark, "ride-table")
    tables.append_rides(cleaning.clean_rides(star.rides(spark, folder)), table)
    return cleaning.with_coordinates(tables.read_day(spark, table, DAY))


@query
def table_weather_days(spark: SparkSession, folder: str) -> DataFrame:
    """Rides and weather of the stored rainy days; the other days' folders are not read."""
    rides, weather = scratch_path(spark, "ride-table"), scratch_path(spark, "weather-table")
    tables.append_rides(cleaning.clean_rides(star.rides(spark, folder)), rides)
    tables.append_weather(star.weather(spark, folder), weather)
    rainy = tables.read_weather_table(spark, weather).filter(F.col("conditions") == "Rain")
    found = training.stored_training_set(tables.read_ride_table(spark, rides), rainy)
    return found.withColumns({c: F.col(c).cast("double") for c in WEATHER_MEASURES})


@query
def table_mixed_writers(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the rides by SQL, a third by path within their days, then all by both ways."""
    path = scratch_path(spark, "ride-table")
    name = "ride_data_" + path[-12:]
    clean = cleaning.clean_rides(star.rides(spark, folder))
    third = F.col("ride_id").cast("long") % 3
    tables.create_ride_table(spark, name, path)
    tables.insert_by_name(
        spark, name, cleaning.to_ride_table(clean.filter(third == 0)), "ride_id", ["started_at"]
    )
    tables.append_rides(clean.filter(third == 1), path, resent_unchanged=True)
    later = clean.withColumn("started_at", F.expr("started_at + interval 1 day"))
    tables.insert_by_name(
        spark, name, cleaning.to_ride_table(later.filter(third != 2)), "ride_id", ["started_at"]
    )
    tables.append_rides(clean, path)
    spark.catalog.recoverPartitions(name)
    found = cleaning.with_coordinates(spark.table(name))
    return stage(found, "mixed-writers")


@query
def weather_table_ddl(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "weather-table")
    name = "weather_data_" + path[-12:]
    tables.create_weather_table(spark, name, path)
    tables.insert_by_name(spark, name, star.weather(spark, folder))
    spark.sql(f"DROP TABLE {name}")
    found = tables.read_weather_table(spark, path)
    return found.withColumns({c: F.col(c).cast("double") for c in WEATHER_MEASURES})


# Cleaning, filters and projections


@query
def rides_future(spark: SparkSession, folder: str) -> DataFrame:
    rides = cleaning.between(star.rides(spark, folder), "started_at", CURRENT_AFTER, None)
    return rides.orderBy("started_at", "ride_id")


@query
def rides_past(spark: SparkSession, folder: str) -> DataFrame:
    rides = star.past_rides(spark, folder)
    return cleaning.between(rides, "started_at", PAST_AFTER, PAST_BEFORE).orderBy(
        "started_at", "ride_id"
    )


@query
def weather_future(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.between(star.weather(spark, folder), "datetime", "2023-12-31", None)


@query
def weather_past(spark: SparkSession, folder: str) -> DataFrame:
    weather = star.past_weather(spark, folder)
    return cleaning.between(weather, "datetime", PAST_AFTER, PAST_BEFORE)


@query
def weather_limit(spark: SparkSession, folder: str) -> DataFrame:
    return tables.first_days(star.past_weather(spark, folder), SERVED_DAYS)


@query
def weather_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return files.rounded_weather(star.weather(spark, folder))


@query
def weather_labels(spark: SparkSession, folder: str) -> DataFrame:
    weather = files.rounded_weather(star.weather(spark, folder))

    def text(column: str):
        return two_decimals_text(F.col(column))

    return weather.select(
        F.to_date("datetime").alias("date"),
        day_label(F.col("datetime")).alias("day_label"),
        "conditions",
        F.concat(text("tempmax"), F.lit("°C to "), text("tempmin"), F.lit("°C")).alias("temp"),
        F.concat(text("precip"), F.lit("mm")).alias("precip"),
        F.concat(text("windgust"), F.lit("m/s")).alias("windgust"),
        F.concat(text("humidity"), F.lit("%")).alias("humidity"),
    )


@query
def parse_ride_json(spark: SparkSession, folder: str) -> DataFrame:
    messages = topics.ride_messages(star.rides(spark, folder))
    sent = messages.withColumn("value", F.col("value").cast("binary"))
    return cleaning.with_coordinates(cleaning.parse_rides(sent))


@query
def parse_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Of ten messages one is cut off, one has a coordinate and one a time that can't be read."""
    sent = topics.ride_messages(star.rides(spark, folder))
    number = F.get_json_object("value", "$.ride_id").cast("long") % 10
    spoilt = (
        F.when(number == 3, F.expr("left(value, 40)"))
        .when(number == 5, F.regexp_replace("value", '"end_lng":[^,}]*', '"end_lng":"far west"'))
        .when(number == 7, F.regexp_replace("value", '"started_at":"[^"]*"', '"started_at":"soon"'))
        .otherwise(F.col("value"))
    )
    judged = rejects.judged_rides(sent.select(spoilt.alias("value")))
    fine, bad = rejects.split_to(judged, scratch_path(spark, "judged"))
    own = F.regexp_extract("value", r'"ride_id":"(\d+)"', 1)
    return fine.select("ride_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(own.alias("ride_id"), "reason")
    )


@query
def clean_rides(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_rides(star.rides(spark, folder))


@query
def rides_complete(spark: SparkSession, folder: str) -> DataFrame:
    rides = cleaning.complete_rides(star.rides(spark, folder))
    return rides.withColumn("date", F.to_date("started_at"))


@query
def ride_duration(spark: SparkSession, folder: str) -> DataFrame:
    rides = cleaning.with_duration(star.rides(spark, folder))
    return rides.select("ride_id", "started_at", "ended_at", "duration_seconds")


@query
def ride_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return priced(spark, folder).select(
        "ride_id",
        "member_casual",
        "rideable_type",
        "duration_seconds",
        "revenue",
    )


@query
def ride_coords(spark: SparkSession, folder: str) -> DataFrame:
    rides = star.rides(spark, folder)
    texts = rides.withColumns({c: F.col(c).cast("string") for c in COORDINATES})
    return cleaning.with_coordinates(texts).select("ride_id", *COORDINATES)


@query
def rides_on_day(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.rides_on_day(star.rides(spark, folder), DAY)


@query
def rides_distinct(spark: SparkSession, folder: str) -> DataFrame:
    rides = star.rides(spark, folder)
    return rides.unionAll(rides).dropDuplicates()


@query
def union_distinct_rides(spark: SparkSession, folder: str) -> DataFrame:
    rides = star.rides(spark, folder)
    started = rides.filter(F.col("start_station_id").isNotNull())
    return cleaning.union_distinct(started, cleaning.complete_rides(rides))


@query
def dedup_rides_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Copies end later or have no start; the earliest start, then end, is kept."""
    rides = star.rides(spark, folder)
    later = rides.withColumn("ended_at", F.expr("ended_at + interval 1 minute"))
    unknown = rides.withColumn("started_at", F.lit(None).cast("timestamp"))
    copies = unknown.unionByName(later).unionByName(rides)
    return cleaning.first_per_key(copies, "ride_id", ["started_at", "ended_at"])


# Figures over all rides


@query
def rides_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.rides_per_day(star.rides(spark, folder))


@query
def ride_type_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.type_counts(star.rides(spark, folder)).orderBy(F.desc("count"), "rideable_type")


@query
def station_counts_start(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.station_counts(star.rides(spark, folder), "start")


@query
def station_counts_end(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.station_counts(star.rides(spark, folder), "end")


@query
def hourly_rides_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.hourly(priced(spark, folder))


@query
def hourly_mean_line(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.hourly_mean(kpis.hourly(priced(spark, folder)))


@query
def revenue_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.revenue_by_type(priced(spark, folder))


@query
def revenue_total(spark: SparkSession, folder: str) -> DataFrame:
    rides = priced(spark, folder).withColumn("date", F.to_date("started_at"))
    return kpis.revenue_total(rides, ["date"])


@query
def revenue_per_ride(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.revenue_per_ride(priced(spark, folder))


@query
def revenue_per_ride_wide(spark: SparkSession, folder: str) -> DataFrame:
    rides = priced(spark, folder).withColumn("date", F.to_date("started_at"))
    return kpis.revenue_per_ride_wide(kpis.revenue_per_ride(rides, ["date"]), ["date"])


@query
def hex_density(spark: SparkSession, folder: str) -> DataFrame:
    return flows.hex_density(star.rides(spark, folder))


@query
def od_arcs(spark: SparkSession, folder: str) -> DataFrame:
    return flows.od_arcs(star.rides(spark, folder))


@query
def od_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows.od_flows(star.rides(spark, folder))


# Intraday snapshots


@query
def snapshot_index(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_index(star.rides(spark, folder))


@query
def snapshot_clock(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_clock(star.rides(spark, folder))


@query
def snapshot_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_type_counts(star.rides(spark, folder))


@query
def snapshot_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_revenue(priced(spark, folder))


@query
def snapshot_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_hourly(priced(spark, folder))


@query
def top_start_station(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_top_station(star.rides(spark, folder), "start")


@query
def top_end_station(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_top_station(star.rides(spark, folder), "end")


@query
def snapshot_hex_density(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_hex_density(star.rides(spark, folder))


@query
def snapshot_arcs(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_arcs(star.rides(spark, folder))


@query
def snapshot_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_kpis(priced(spark, folder))


@query
def snapshot_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The headline figures as the text a dashboard shows."""
    figures = snapshots.snapshot_kpis(priced(spark, folder))
    return figures.select(
        "date",
        "k",
        "clock",
        dollars_text(F.col("revenue")).alias("revenue"),
        dollars_text(F.col("classic_rpr")).alias("classic_rpr"),
        dollars_text(F.col("electric_rpr")).alias("electric_rpr"),
        F.format_string("Average: %.0f rides", F.rint("mean_bar")).alias("mean_bar"),
        "top_start_station",
        rides_text(F.col("top_start_rides")).alias("top_start_rides"),
        "top_end_station",
        rides_text(F.col("top_end_rides")).alias("top_end_rides"),
    )


# Training set and forecast


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return training.training_set(
        star.past_rides(spark, folder),
        star.past_weather(spark, folder),
        PAST_AFTER,
        PAST_BEFORE,
    )


@query
def training_set(spark: SparkSession, folder: str) -> DataFrame:
    return _training(spark, folder)


@query
def training_top5(spark: SparkSession, folder: str) -> DataFrame:
    return _training(spark, folder).orderBy("date").limit(5)


@query
def training_features(spark: SparkSession, folder: str) -> DataFrame:
    return training.features(_training(spark, folder))


@query
def training_split(spark: SparkSession, folder: str) -> DataFrame:
    return training.with_split(_training(spark, folder)).select("date", "count", "part")


_FITS: dict[tuple[str, str], forecast.Forecast] = {}


def _fitted(spark: SparkSession, folder: str) -> forecast.Forecast:
    """The forest of a folder's training days, fitted once in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FITS:
        _FITS[key] = forecast.fit_forecast(_training(spark, folder))
    return _FITS[key]


# Predictions differ between forests; what is compared is what holds for any of them.


def _plausible(spark: SparkSession, folder: str, predicted: Column) -> Column:
    """Averages of training labels lie within their range, rounded ones at most a half outside."""
    days = training.with_split(_training(spark, folder)).filter("part = 'train'")
    low = days.agg(F.min("count") - 0.5)
    high = days.agg(F.max("count") + 0.5)
    return predicted.between(low.scalar(), high.scalar())


@query
def forecast_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The days the forest was trained and tested on, and whether their predictions can be."""
    days = _training(spark, folder)
    scored = _fitted(spark, folder).model.transform(training.with_split(training.features(days)))
    return scored.select(
        "date", "part", "count", _plausible(spark, folder, F.col("prediction")).alias("plausible")
    )


@query
def daily_forecast(spark: SparkSession, folder: str) -> DataFrame:
    model = _fitted(spark, folder).model
    days = forecast.forecast(model, star.weather(spark, folder), FORECAST_FROM)
    labelled = F.col("label") == F.concat(F.col("predicted").cast("string"), F.lit(" rides"))
    return days.select(
        "date",
        _plausible(spark, folder, F.col("predicted")).alias("plausible"),
        labelled.alias("labelled"),
    )


@query
def forecast_r2(spark: SparkSession, folder: str) -> DataFrame:
    """Days the model fit is shown for, and whether it is 1 - SSE / SST of the held-out days."""
    fitted = _fitted(spark, folder)
    held_out = training.with_split(_training(spark, folder)).filter("part = 'test'")
    r2 = forecast.r_squared(fitted.model.transform(held_out))
    days = forecast.forecast(fitted.model, star.weather(spark, folder))
    apart = F.abs(F.lit(fitted.fit_percent) - 100 * r2.scalar())
    return days.select("date", (apart < 0.051).alias("fits"))


@query
def forecast_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Every training day walked down the forest's table of nodes, against the forest itself.

    ``same``: both predict the very same number. ``learnt``: of the days it was trained on the walked
    forest explains at least half the variance, which no constant does.
    """
    model = _fitted(spark, folder).model
    days = training.with_split(_training(spark, folder))
    nodes = trees.forest_nodes(spark, model)
    ways = trees.walk(nodes, trees.days_as_arrays(model, days), trees.deepest(model))
    scored = model.transform(days).select("date", "part", "count", "prediction")
    both = stage(scored.join(trees.predictions(ways), "date"), "walked")
    known = both.filter("part = 'train'").select("count", F.col("walked").alias("prediction"))
    learnt = F.lit(forecast.r_squared(known).scalar() >= 0.5)
    same = F.col("walked") == F.col("prediction")
    return both.select("date", "part", "count", same.alias("same"), learnt.alias("learnt"))


@query
def forecast_vs_actual(spark: SparkSession, folder: str) -> DataFrame:
    predictions = forecast.forecast(_fitted(spark, folder).model, star.weather(spark, folder))
    versus = forecast.forecast_vs_actual(
        snapshots.snapshot_index(star.rides(spark, folder)), predictions
    )
    adds_up = F.col("difference") + F.col("predicted") == F.col("completed")
    return versus.select("date", "k", "completed", adds_up.alias("adds_up"))


# Streams: publish, run until all that has arrived is handled, read back


def _raw_topic(spark: SparkSession, folder: str) -> str:
    topic = scratch_path(spark, "rides-topic")
    topics.publish(topics.ride_messages(star.rides(spark, folder)), topic, topics.RAW_PARTITION)
    return topic


def _clean_topic(spark: SparkSession, folder: str) -> str:
    topic = scratch_path(spark, "rides-topic")
    clean = cleaning.clean_rides(star.rides(spark, folder))
    topics.publish(topics.clean_ride_messages(clean), topic, topics.CLEAN_PARTITION)
    return topic


# Rides a file of the topics below holds, about; a slice of larger tables has more files.
RIDES_PER_FILE = 100_000


def _files_per_slice(rides: DataFrame, slices: int) -> int:
    return max(1, -(-rides.count() // (slices * RIDES_PER_FILE)))


def _clean_topic_twice(spark: SparkSession, folder: str, slices: int) -> tuple[str, int]:
    """Cleaned rides sent twice, each time cut into so many slices in no order of time.

    Returns the topic and the number of files in a slice.
    """
    topic = scratch_path(spark, "rides-topic")
    rides = star.rides(spark, folder)
    files_per_slice = _files_per_slice(rides, slices)
    dealt = slices * files_per_slice
    clean = cleaning.clean_rides(rides).repartition(dealt, F.xxhash64("ride_id", F.lit(0)))
    topics.publish(topics.clean_ride_messages(clean), topic, topics.CLEAN_PARTITION, 0)
    sent = spark.read.schema("value string").parquet(
        topics.batch_folder(topic, topics.CLEAN_PARTITION, 0)
    )
    again = sent.repartition(dealt, F.xxhash64("value", F.lit(1)))
    topics.publish(again, topic, topics.CLEAN_PARTITION, 1)
    return topic, files_per_slice


def _checkpoint(spark: SparkSession) -> str:
    return scratch_path(spark, "stream-checkpoint")


@query
def stream_clean(spark: SparkSession, folder: str) -> DataFrame:
    topic, target = _raw_topic(spark, folder), scratch_path(spark, "clean-topic")
    jobs.clean_stream(spark, topic, target, _checkpoint(spark)).awaitTermination()
    messages = topics.read_topic(spark, target, topics.CLEAN_PARTITION)
    return cleaning.with_coordinates(cleaning.parse_clean_rides(messages))


@query
def stream_to_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every ride is sent again a day later, over several micro-batches; the table keeps the first."""
    topic, table = scratch_path(spark, "rides-topic"), scratch_path(spark, "ride-table")
    checkpoint = _checkpoint(spark)
    known = star.rides(spark, folder)
    files_per_slice = _files_per_slice(known, 2)
    clean = cleaning.clean_rides(known)
    later = clean.withColumn("started_at", F.expr("started_at + interval 1 day"))
    for batch, rides in enumerate((clean, later)):
        dealt = rides.repartition(2 * files_per_slice, F.xxhash64("ride_id"))
        topics.publish(topics.clean_ride_messages(dealt), topic, topics.CLEAN_PARTITION, batch)
        jobs.load_rides_stream(
            spark, topic, table, checkpoint, files_per_trigger=files_per_slice
        ).awaitTermination()
    return cleaning.with_coordinates(tables.read_ride_table(spark, table))


@query
def stream_weather_ingest(spark: SparkSession, folder: str) -> DataFrame:
    topic, table = scratch_path(spark, "weather-topic"), scratch_path(spark, "weather-table")
    topics.publish(topics.weather_messages(star.weather(spark, folder)), topic)
    jobs.load_weather_stream(spark, topic, table, _checkpoint(spark)).awaitTermination()
    found = tables.read_weather_table(spark, table)
    return found.withColumns({c: F.col(c).cast("double") for c in WEATHER_MEASURES})


@query
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Slices in no order of time, one per micro-batch; rides come twice, some have no start."""
    topic, target = scratch_path(spark, "rides-topic"), scratch_path(spark, "unique-rides")
    unknown = F.col("ride_id").cast("long") % 10 == 0
    rides = star.rides(spark, folder).withColumn(
        "started_at", F.when(~unknown, F.col("started_at"))
    )
    files_per_slice = _files_per_slice(rides, 3)
    for batch in range(2):
        dealt = rides.repartition(3 * files_per_slice, F.xxhash64("ride_id", F.lit(batch)))
        topics.publish(topics.ride_messages(dealt), topic, topics.RAW_PARTITION, batch)
    jobs.dedup_stream(
        spark, topic, target, _checkpoint(spark), files_per_trigger=files_per_slice
    ).awaitTermination()
    return cleaning.with_coordinates(spark.read.parquet(target).select(*RIDE_COLUMNS))


@query
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Slices in no order of time, one per micro-batch; rides come twice and count once."""
    target = scratch_path(spark, "hours")
    topic, files_per_slice = _clean_topic_twice(spark, folder, 3)
    jobs.hourly_stream(
        spark, topic, target, _checkpoint(spark), files_per_trigger=files_per_slice
    ).awaitTermination()
    jobs.fold_hours(spark, target, 2)
    return jobs.latest_hours(spark, target)


@query
def stream_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Slices in no order of time, one per micro-batch, rides twice: figures as of all at once."""
    target = scratch_path(spark, "live")
    topic, files_per_slice = _clean_topic_twice(spark, folder, 2)
    live.snapshot_stream(
        spark, topic, target, _checkpoint(spark), files_per_trigger=files_per_slice
    ).awaitTermination()
    return live.latest_kpis(spark, target)
