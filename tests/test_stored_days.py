"""Joins of the stored ride table with a few weather days read only these days' folders."""

from __future__ import annotations

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from rideflow.operators import training
from rideflow.operators.cleaning import clean_rides
from rideflow.schemas import WEATHER_TABLE
from rideflow.sources import tables

DAYS = [dt.date(2024, 1, d) for d in (5, 6, 7, 8)]


@pytest.fixture
def stored(spark, make_rides, tmp_path):
    """Four days with 1 to 4 rides; rain on the second and the third, and on a day without rides."""
    noon = dt.time(12)
    rides = [
        {"started_at": dt.datetime.combine(day, noon), "end_station_id": "S2" if n else None}
        for k, day in enumerate(DAYS)
        for n in range(k + 2)
    ]
    path = str(tmp_path / "rides")
    tables.append_rides(clean_rides(make_rides(*rides)), path)
    weather = [
        (dt.datetime.combine(day, dt.time()), *[1.0 * k] * 7, "Rain" if k in (1, 2, 4) else "Clear")
        for k, day in enumerate([*DAYS, dt.date(2024, 2, 1)])
    ]
    days = spark.createDataFrame(weather, WEATHER_TABLE)
    tables.append_weather(days, str(tmp_path / "weather"))
    return path, tables.read_weather_table(spark, str(tmp_path / "weather"))


def _spoil(path, day):
    files = glob.glob(f"{path}/date={day}/*.parquet")
    assert files
    for file in files:
        with open(file, "wb") as out:
            out.write(b"not a table")


def test_days_out_of_the_selection_are_not_read(spark, stored):
    path, weather = stored
    for day in (DAYS[0], DAYS[3]):
        _spoil(path, day)
    rainy = weather.filter(F.col("conditions") == "Rain")
    found = training.stored_training_set(tables.read_ride_table(spark, path), rainy)
    assert sorted((r.date, r["count"], r.tempmax) for r in found.collect()) == [
        (DAYS[1], 2, 1.0),
        (DAYS[2], 3, 2.0),
    ]


def test_a_chosen_day_is_read(spark, stored):
    path, weather = stored
    _spoil(path, DAYS[2])
    rainy = weather.filter(F.col("conditions") == "Rain")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        training.stored_training_set(tables.read_ride_table(spark, path), rainy).collect()


def test_the_plan_prunes_days_and_columns(spark, stored):
    path, weather = stored
    rainy = weather.filter(F.col("conditions") == "Rain")
    found = training.stored_training_set(tables.read_ride_table(spark, path), rainy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "station_id" in x)
    assert "dynamicpruning" in scan and "started_at" not in scan.split("ReadSchema")[1]


def test_more_days_than_are_sent_give_the_same_rows(spark, stored, monkeypatch):
    path, weather = stored
    table = tables.read_ride_table(spark, path)
    rainy = weather.filter(F.col("conditions") == "Rain")
    want = sorted(map(tuple, training.stored_training_set(table, rainy).collect()))
    monkeypatch.setattr(training, "DAYS_TO_BROADCAST", 1)
    assert sorted(map(tuple, training.stored_training_set(table, rainy).collect())) == want


def test_no_days_and_repeated_days(spark, stored):
    path, weather = stored
    table = tables.read_ride_table(spark, path)
    none = weather.filter(F.col("conditions") == "Fog")
    assert training.stored_training_set(table, none).count() == 0
    one = weather.filter(F.col("datetime") == F.lit(DAYS[3]).cast("timestamp"))
    twice = training.stored_training_set(table, one.unionByName(one))
    assert [(r.date, r["count"]) for r in twice.collect()] == [(DAYS[3], 4)] * 2


def test_same_rows_as_the_training_set_of_unstored_rides(spark, stored):
    path, weather = stored
    table = tables.read_ride_table(spark, path)
    want = training.training_set(table.drop("date"), weather, "2024-01-01", "2024-03-01")
    got = training.stored_training_set(table, weather)
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(got) == rows(want) and len(rows(got)) == len(DAYS)
