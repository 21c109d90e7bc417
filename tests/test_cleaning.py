from __future__ import annotations

import datetime as dt

import pytest

from rideflow.operators import cleaning
from rideflow.sources import topics


def ids(df) -> set[str]:
    return {r.ride_id for r in df.select("ride_id").collect()}


def test_midnight_of_the_cut_off_is_on_neither_side(make_rides):
    midnight = dt.datetime(2024, 1, 1)
    tick = dt.timedelta(microseconds=1)
    rides = make_rides(
        {"ride_id": "before", "started_at": midnight - tick},
        {"ride_id": "at", "started_at": midnight},
        {"ride_id": "after", "started_at": midnight + tick},
        {"ride_id": "unknown", "started_at": None},
    )
    assert ids(cleaning.between(rides, "started_at", "2024-01-01", None)) == {"after"}
    assert ids(cleaning.between(rides, "started_at", None, "2024-01-01")) == {"before"}


def test_stream_and_training_drop_different_rides(make_rides):
    rides = make_rides(
        {"ride_id": "full"},
        {"ride_id": "no start", "start_station_id": None},
        {"ride_id": "no end", "end_station_id": None},
    )
    assert ids(cleaning.clean_rides(rides)) == {"full", "no end"}
    assert ids(cleaning.complete_rides(rides)) == {"full"}


def test_duration_cuts_fractions_and_may_be_negative(make_rides):
    start = dt.datetime(2024, 1, 5, 9)
    rides = make_rides(
        {"started_at": start, "ended_at": start + dt.timedelta(minutes=10, milliseconds=123)},
        {"started_at": start, "ended_at": start - dt.timedelta(seconds=30)},
        {"started_at": start, "ended_at": None},
    )
    rows = cleaning.with_duration(rides).orderBy("ride_id").collect()
    assert [r.duration_seconds for r in rows] == [600.0, -30.0, None]


def test_messages_keep_what_can_be_read(spark):
    sent = spark.createDataFrame(
        [
            ('{"ride_id": "good", "ride_type": "classic_bike", "start_lat": 38.9}',),
            ('{"ride_id": "none", "started_at": "None", "start_lat": "x"}',),
            ("{not json",),
        ],
        "value string",
    )
    parsed = cleaning.with_coordinates(cleaning.parse_rides(sent))
    rows = {r.ride_id: r for r in parsed.collect()}
    assert set(rows) == {"good", "none", None}
    assert rows["good"].rideable_type == "classic_bike"
    assert rows["good"].start_lat == 38.9
    assert rows["good"].end_station_id is None
    assert rows["none"].started_at is None
    assert rows["none"].start_lat is None
    assert all(v is None for v in rows[None])
    assert cleaning.clean_rides(cleaning.parse_rides(sent)).count() == 0


def test_messages_leave_nulls_out_and_read_back(make_rides):
    rides = make_rides({"ended_at": None}, {"start_station_name": None})
    messages = topics.ride_messages(rides)
    assert "ended_at" not in messages.first().value
    back = cleaning.with_coordinates(cleaning.parse_rides(messages))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(
        map(tuple, rides.collect()), key=repr
    )


def test_weather_day_is_iso_text(spark):
    weather = spark.sql(
        "select timestamp'2024-01-05' datetime, 1.5f tempmax, 0f tempmin, 0f humidity, 0f precip,"
        " 0f snow, 0f windspeed, cast(null as float) windgust, 'Clear' conditions"
    )
    value = topics.weather_messages(weather).first().value
    assert '"datetime":"2024-01-05T00:00:00"' in value
    assert "windgust" not in value
    assert cleaning.parse_weather(topics.weather_messages(weather)).collect() == weather.collect()


def test_first_per_key_takes_the_earliest(make_rides):
    start = dt.datetime(2024, 1, 5, 9)
    rides = make_rides(
        {"ride_id": "a", "started_at": start + dt.timedelta(seconds=1), "seconds": 60},
        {"ride_id": "a", "started_at": start, "seconds": 300},
        {"ride_id": "a", "started_at": start, "seconds": 120},
        {"ride_id": "b"},
        {"ride_id": "b"},
    )
    kept = cleaning.first_per_key(rides, "ride_id", ["started_at", "ended_at"])
    rows = {r.ride_id: r for r in kept.collect()}
    assert kept.columns == rides.columns
    assert len(rows) == kept.count() == 2
    assert rows["a"].ended_at == start + dt.timedelta(seconds=120)


def test_first_per_key_drops_copies_before_the_shuffle(make_rides):
    kept = cleaning.first_per_key(make_rides({}), "ride_id", ["started_at"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # Each task limits a key to its first row, below the shuffle.
    below = plan.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in below and "row_number(), 1, Partial" in below


def test_union_keeps_each_row_once(make_rides):
    left = make_rides({"ride_id": "a"}, {"ride_id": "b"}, {"ride_id": "b"})
    right = make_rides({"ride_id": "a"})
    assert cleaning.union_distinct(left, right).count() == 3


@pytest.mark.parametrize("day, expected", [("2024-01-05", {"a", "b"}), ("2024-01-06", {"c"})])
def test_day_filter(make_rides, day, expected):
    rides = make_rides(
        {"ride_id": "a", "started_at": dt.datetime(2024, 1, 5)},
        {"ride_id": "b", "started_at": dt.datetime(2024, 1, 5, 23, 59, 59, 999999)},
        {"ride_id": "c", "started_at": dt.datetime(2024, 1, 6)},
        {"ride_id": "d", "started_at": None},
    )
    assert ids(cleaning.on_day(rides, day)) == expected
