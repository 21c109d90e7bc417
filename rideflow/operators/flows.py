"""Where rides start and where they go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rideflow.functions.hexagons import RADIUS_M, hex_cell
from rideflow.schemas import COORDINATES


def hex_density(rides: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Rides per hexagon of the start point; rides without one are left out."""
    cell = hex_cell(F.col("start_lat"), F.col("start_lng"), radius_m)
    located = rides.filter(F.col("start_lat").isNotNull() & F.col("start_lng").isNotNull())
    return located.groupBy(cell.q.alias("q"), cell.r.alias("r")).agg(F.count("*").alias("rides"))


def od_arcs(rides: DataFrame) -> DataFrame:
    """One arc per ride: the coordinates of both ends."""
    return rides.select("ride_id", *COORDINATES)


def od_flows(rides: DataFrame) -> DataFrame:
    """Rides per pair of named stations."""
    named = rides.dropna(subset=["start_station_name", "end_station_name"])
    return named.groupBy("start_station_name", "end_station_name").agg(
        F.count("*").alias("rides")
    )
