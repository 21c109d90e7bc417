"""Rides and weather expressed over the star-schema tables.

Past rides and past weather come from orders and line items, current ones from events.
Everything is a projection or a daily aggregate; nothing is made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rides(spark: SparkSession, folder: str) -> DataFrame:
    """The 13 ride columns, one row per event."""
    parts = _table(spark, folder, "events").select(
        "event_id",
        "event_type",
        "user_id",
        F.col("ts").cast("timestamp").alias("started_at"),
        F.expr("cast(floor(value * 60) as bigint)").alias("seconds"),
        F.expr("cast(get_json_object(props, '$.k') as int)").alias("k"),
    )
    # Decimal literals, as an SQL reader would write them, keep the coordinates exact.
    lat = "cast(38.888 + (({0} % 20) - 10) * 0.005 as double)"
    lng = "cast(-77.021 + (({0} % 20) - 10) * 0.005 as double)"
    start_id = "case when k % 10 = 0 then null else concat('S', user_id % 20) end"
    end_id = "case when k % 7 = 0 then null else concat('S', k % 20) end"
    return parts.selectExpr(
        "cast(event_id as string) as ride_id",
        "case when event_type in ('click', 'purchase') then 'classic_bike'"
        " when event_type in ('view', 'signup') then 'electric_bike'"
        " else 'docked_bike' end as rideable_type",
        "started_at",
        "started_at + make_dt_interval(0, 0, 0, seconds) as ended_at",
        f"'Station ' || substr({start_id}, 2) as start_station_name",
        f"{start_id} as start_station_id",
        f"'Station ' || substr({end_id}, 2) as end_station_name",
        f"{end_id} as end_station_id",
        f"{lat.format('user_id')} as start_lat",
        f"{lng.format('k')} as start_lng",
        f"{lat.format('k')} as end_lat",
        f"{lng.format('user_id')} as end_lng",
        "case when user_id % 2 = 0 then 'member' else 'casual' end as member_casual",
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Current weather, one row per day of ``events``."""

    def peak(kind: str) -> str:
        return f"max(case when event_type = '{kind}' then value else 0 end) / 10"

    return (
        _table(spark, folder, "events")
        .groupBy(F.to_date("ts").cast("timestamp").alias("datetime"))
        .agg(
            F.expr("cast(max(value) / 10 as double)").alias("tempmax"),
            F.expr("cast(min(value) as double)").alias("tempmin"),
            F.expr("cast(count(*) % 100 as double)").alias("humidity"),
            F.expr(f"cast({peak('error')} as double)").alias("precip"),
            F.expr("cast(0 as double)").alias("snow"),
            F.expr(f"cast({peak('view')} as double)").alias("windspeed"),
            F.expr(f"cast({peak('click')} as double)").alias("windgust"),
            F.expr("case when count(*) % 2 = 0 then 'Clear' else 'Rain' end").alias("conditions"),
        )
    )


def past_rides(spark: SparkSession, folder: str) -> DataFrame:
    """Ride key, start time and both station ids, one row per order."""
    return _table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("ride_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("start_station_id"),
        F.expr("nullif(o_orderstatus, 'P')").alias("end_station_id"),
    )


def past_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Past weather, one row per ship day of ``lineitem``."""
    return (
        _table(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").cast("timestamp").alias("datetime"))
        .agg(
            F.max("l_quantity").alias("tempmax"),
            F.min("l_quantity").alias("tempmin"),
            F.expr("cast(sum(l_linenumber) % 100 as double)").alias("humidity"),
            F.expr("max(l_tax) * 100").alias("precip"),
            F.expr("min(l_tax) * 100").alias("snow"),
            F.expr("max(l_discount) * 100").alias("windspeed"),
            F.expr("max(l_extendedprice) / 1000").alias("windgust"),
            F.expr("case when max(l_quantity) > 45 then 'Clear' else 'Rain' end").alias(
                "conditions"
            ),
        )
    )
