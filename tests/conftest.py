from __future__ import annotations

import datetime as dt

import pytest

from rideflow.schemas import RIDE_COLUMNS
from rideflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "rideflow-tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()


@pytest.fixture
def make_rides(spark):
    """Rides from dicts; what a dict leaves out gets a plain default."""

    def make(*rows: dict):
        full = []
        for number, row in enumerate(rows):
            start = row.get("started_at", dt.datetime(2024, 1, 5, 9, 0, number % 60))
            seconds = row.get("seconds", 600)
            end = None if start is None or seconds is None else start + dt.timedelta(0, seconds)
            ride = {
                "ride_id": f"r{number:05d}",
                "rideable_type": "classic_bike",
                "started_at": start,
                "ended_at": end,
                "start_station_name": "A",
                "start_station_id": "S1",
                "end_station_name": "B",
                "end_station_id": "S2",
                "start_lat": 38.9,
                "start_lng": -77.0,
                "end_lat": 38.91,
                "end_lng": -77.01,
                "member_casual": "casual",
            }
            ride.update({k: v for k, v in row.items() if k in RIDE_COLUMNS})
            full.append(tuple(ride[c] for c in RIDE_COLUMNS))
        kinds = {"started_at": "timestamp", "ended_at": "timestamp"}
        floats = {"start_lat", "start_lng", "end_lat", "end_lng"}
        schema = ", ".join(
            f"{c} {kinds.get(c, 'double' if c in floats else 'string')}" for c in RIDE_COLUMNS
        )
        return spark.createDataFrame(full, schema)

    return make
