from __future__ import annotations

import datetime as dt
import glob
import json
import shutil

import pytest
from pyspark.sql import functions as F

from rideflow.operators.cleaning import clean_rides, to_ride_table
from rideflow.schemas import RIDE_COLUMNS, RIDE_TABLE
from rideflow.sources import files, keys, tables, topics


def test_single_file_export_has_one_part_and_a_header(make_rides, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(make_rides({}, {}).repartition(2), path, single_file=True)
    (part,) = glob.glob(f"{path}/part-*")
    with open(part) as lines:
        assert lines.readline().strip() == ",".join(RIDE_COLUMNS)


def test_fixed_schema_goes_by_position(spark, tmp_path):
    path = tmp_path / "rides.csv"
    header = ",".join(["ride_id", "rideable_type", *RIDE_COLUMNS[2:]])
    path.write_text(
        f"{header}\nr1,classic_bike,2024-01-05 09:00:00,2024-01-05 09:10:00,A,S1,B,S2,"
        "38.5,-77.25,38.75,-77.5,member\n"
    )
    row = files.read_ride_file(spark, str(path)).first()
    assert row.rideable_type == "classic_bike"
    assert row.started_at == dt.datetime(2024, 1, 5, 9)
    assert (row.start_lat, row.end_lng) == (38.5, -77.5)


def test_serving_read_coerces_and_survives_bad_text(spark, tmp_path):
    path = tmp_path / "rides.csv"
    path.write_text(
        ",".join([*RIDE_COLUMNS, "duration"])
        + "\nr1,classic_bike,2024-01-05 09:00:00,soon,A,S1,B,S2,x,-77.25,38.75,-77.5,member,12.5\n"
    )
    row = files.read_rides(spark, str(path)).first()
    assert row.started_at == dt.datetime(2024, 1, 5, 9)
    assert row.ended_at is None and row.start_lat is None
    assert (row.start_lng, row.duration) == (-77.25, 12.5)


def test_weather_is_rounded_half_to_even(spark, tmp_path):
    path = tmp_path / "weather.csv"
    path.write_text(
        "datetime,tempmax,tempmin,humidity,precip,snow,windspeed,windgust,conditions\n"
        "2024-01-05,1.125,1.375,70.004,0,,3.999,12,Rain\n"
    )
    row = files.read_weather(spark, str(path)).first()
    assert row.datetime == dt.datetime(2024, 1, 5)
    assert (row.tempmax, row.tempmin, row.humidity) == (1.12, 1.38, 70.0)
    assert (row.snow, row.windspeed, row.conditions) == (None, 4.0, "Rain")


def test_kafka_options():
    whole = topics.kafka_read_options("broker:9092", "rides")
    assert whole["subscribe"] == "rides" and whole["startingOffsets"] == "latest"
    part = topics.kafka_read_options("broker:9092", "rides", [0], "earliest", 30, 64)
    assert "subscribe" not in part
    assert json.loads(part["assign"]) == {"rides": [0]}
    assert (part["maxOffsetsPerTrigger"], part["minPartitions"]) == ("30", "64")
    assert topics.kafka_write_options("broker:9092", "rides")["topic"] == "rides"


def test_publishing_a_batch_again_replaces_it(spark, make_rides, tmp_path):
    topic = str(tmp_path / "topic")
    messages = topics.ride_messages(make_rides({}, {}))
    topics.publish(messages, topic, 0, batch=0)
    topics.publish(messages, topic, 0, batch=1)
    topics.publish(messages, topic, 0, batch=1)
    topics.publish(messages.limit(1), topic, 1)
    topics.publish(messages.limit(1), topic, 1)
    assert topics.read_topic(spark, topic).count() == 6
    assert topics.read_topic(spark, topic, 0).count() == 4
    assert topics.read_topic(spark, topic, 1).count() == 2


def test_table_keeps_one_row_per_key(spark, make_rides, tmp_path, monkeypatch):
    table = str(tmp_path / "rides")
    first = clean_rides(make_rides({"ride_id": "a"}, {"ride_id": "a"}, {"ride_id": "b"}))
    tables.append_rides(first, table)
    again = clean_rides(
        make_rides({"ride_id": "b"}, {"ride_id": "c"}, {"ride_id": None}, {"ride_id": "c"})
    )
    tables.append_rides(again, table)
    tables.append_rides(again, table)
    stored = tables.read_ride_table(spark, table)
    assert sorted(r.ride_id for r in stored.collect()) == ["a", "b", "c"]
    # The same without broadcasting the batch's keys.
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    tables.append_rides(clean_rides(make_rides({"ride_id": "c"}, {"ride_id": "d"})), table)
    stored = tables.read_ride_table(spark, table)
    assert sorted(r.ride_id for r in stored.collect()) == ["a", "b", "c", "d"]


def test_keys_of_resent_rides_are_looked_up_in_their_day(spark, make_rides, tmp_path, monkeypatch):
    table = str(tmp_path / "rides")
    first, second = dt.datetime(2024, 1, 5, 9), dt.datetime(2024, 1, 6, 9)
    sent = make_rides(
        {"ride_id": "a", "started_at": first}, {"ride_id": "b", "started_at": second}
    )
    for most in (tables.BROADCAST_BYTES, -1):
        monkeypatch.setattr(tables, "BROADCAST_BYTES", most)
        tables.append_rides(clean_rides(sent), table, resent_unchanged=True)
        tables.append_rides(clean_rides(sent.limit(1)), table, resent_unchanged=True)
    stored = tables.read_ride_table(spark, table)
    assert sorted(r.ride_id for r in stored.collect()) == ["a", "b"]


def test_table_has_the_declared_columns(make_rides):
    table = to_ride_table(clean_rides(make_rides({})))
    assert table.drop("date").schema.simpleString() == RIDE_TABLE.simpleString()
    assert table.first().duration == 600.0
    assert table.first().rideable_type == "classic_bike"


def test_a_day_is_read_from_its_folder_only(spark, make_rides, tmp_path):
    table = str(tmp_path / "rides")
    rides = make_rides(
        {"ride_id": "late", "started_at": dt.datetime(2024, 1, 5, 18)},
        {"ride_id": "early", "started_at": dt.datetime(2024, 1, 5, 6)},
        {"ride_id": "other", "started_at": dt.datetime(2024, 1, 6)},
    )
    tables.append_rides(clean_rides(rides), table)
    day = tables.read_day(spark, table, "2024-01-05")
    assert [r.ride_id for r in day.collect()] == ["early", "late"]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_weather_table_is_keyed_by_day(spark, tmp_path):
    table = str(tmp_path / "weather")
    days = spark.range(3).selectExpr(
        "timestamp_seconds(id * 86400) as datetime",
        *[f"cast(id as double) as {c}" for c in ("tempmax", "tempmin", "humidity", "precip")],
        *[f"cast(0 as double) as {c}" for c in ("snow", "windspeed", "windgust")],
        "'Clear' as conditions",
    )
    tables.append_weather(days, table)
    tables.append_weather(days.withColumn("conditions", F.lit("Rain")), table)
    stored = tables.read_weather_table(spark, table, 2).collect()
    assert [(r.datetime.day, r.conditions) for r in stored] == [(1, "Clear"), (2, "Clear")]


def test_catalog_tables_are_created_once(spark, make_rides, tmp_path):
    name, location = "rides_created_once", str(tmp_path / "rides")
    tables.create_ride_table(spark, name, location)
    rows = to_ride_table(clean_rides(make_rides({})))
    tables.insert_by_name(spark, name, rows.select(*reversed(rows.columns)))
    tables.create_ride_table(spark, name, location)
    assert spark.table(name).drop("date").first().ride_id == "r00000"
    spark.sql(f"DROP TABLE {name}")


def test_catalog_tables_may_have_a_key(spark, make_rides, tmp_path):
    name = "rides_with_a_key"
    tables.create_ride_table(spark, name, str(tmp_path / "rides"))
    first = make_rides({"ride_id": "a"}, {"ride_id": "a", "started_at": None}, {"ride_id": None})
    again = make_rides({"ride_id": "a", "seconds": 60}, {"ride_id": "b"})
    for rides in (first, again, again):
        rows = to_ride_table(clean_rides(rides))
        tables.insert_by_name(spark, name, rows, "ride_id", ["started_at"])
    stored = sorted((r.ride_id, r.duration) for r in spark.table(name).collect())
    assert stored == [("a", 600.0), ("b", 600.0)]
    spark.sql(f"DROP TABLE {name}")


def test_a_copy_without_start_time_never_wins(spark, make_rides, tmp_path):
    table = str(tmp_path / "rides")
    at = dt.datetime(2024, 1, 5, 9)
    rides = make_rides({"ride_id": "a", "started_at": None}, {"ride_id": "a", "started_at": at})
    tables.append_rides(clean_rides(rides), table)
    assert tables.read_ride_table(spark, table).first().started_at == at


def test_days_are_those_of_utc_in_any_session(spark, make_rides, tmp_path):
    table = str(tmp_path / "rides")
    hours = [dt.datetime(2024, 1, 5) + dt.timedelta(hours=h) for h in range(-3, 27)]
    rides = make_rides(*[{"ride_id": f"{i:02d}", "started_at": t} for i, t in enumerate(hours)])
    seen = []
    try:
        for number, zone in enumerate(("UTC", "America/New_York", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            tables.append_rides(clean_rides(rides), f"{table}{number}")
            for other in ("UTC", "America/New_York"):
                spark.conf.set("spark.sql.session.timeZone", other)
                day = tables.read_day(spark, f"{table}{number}", "2024-01-05")
                seen.append([r.ride_id for r in day.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(seen[0]) == 24 and all(s == seen[0] for s in seen)


def test_only_the_days_of_a_batch_are_looked_up(spark, make_rides, tmp_path, monkeypatch):
    table = str(tmp_path / "rides")
    days = [dt.datetime(2024, 1, d, 9) for d in range(1, 29)]
    rides = make_rides(*[{"ride_id": str(i), "started_at": t} for i, t in enumerate(days)])
    tables.append_rides(clean_rides(rides), table)
    fresh = to_ride_table(
        clean_rides(make_rides({"started_at": days[0]}, {"started_at": days[-1]}))
    )
    for listed in (tables.DAY_LIST, 1):
        monkeypatch.setattr(tables, "DAY_LIST", listed)
        known = tables.same_partitions(tables.read_ride_table(spark, table), fresh, "date")
        assert sorted(r.ride_id for r in known.collect()) == ["0", "27"]


def _rides_of(make_rides, days, per_day=35):
    return make_rides(
        *[
            {"ride_id": f"{d}-{i}", "started_at": dt.datetime(2024, 1, d, 9, i)}
            for d in days
            for i in range(per_day)
        ]
    )


def _ids(spark, table):
    return sorted(r.ride_id for r in tables.read_ride_table(spark, table).collect())


def _insert(spark, name, rides):
    tables.insert_by_name(spark, name, to_ride_table(clean_rides(rides)), "ride_id", ["started_at"])


def test_writers_of_all_kinds_know_each_others_keys(spark, make_rides, tmp_path):
    """Appends by path, inserts by SQL, and appends within days, in any order."""
    early, late = _rides_of(make_rides, (10, 11)), _rides_of(make_rides, (12, 13))
    both = early.unionByName(late)
    want = sorted(r.ride_id for r in both.collect())
    for number, order in enumerate(("path sql", "sql day", "day sql", "sql path")):
        name, table = f"mixed_{number}", str(tmp_path / f"rides{number}")
        tables.create_ride_table(spark, name, table)
        for rides, way in zip((early, late), order.split()):
            if way == "sql":
                _insert(spark, name, rides)
            else:
                tables.append_rides(clean_rides(rides), table, resent_unchanged=way == "day")
        tables.append_rides(clean_rides(both), table)
        _insert(spark, name, both)
        assert _ids(spark, table) == want
        assert spark.table(name).count() == len(want)
        spark.sql(f"DROP TABLE {name}")


def test_an_index_that_was_never_finished_hides_no_key(spark, make_rides, tmp_path, monkeypatch):
    """A refresh or an append that ends at any step leaves tables that the next append is right on."""
    rides = clean_rides(_rides_of(make_rides, (10, 11)))
    want = sorted(r.ride_id for r in rides.collect())
    (tmp_path / "left_index").mkdir()
    tables.create_ride_table(spark, "left_over", str(tmp_path / "left"))
    _insert(spark, "left_over", _rides_of(make_rides, (10,)))
    tables.append_rides(rides, str(tmp_path / "left"))
    assert _ids(spark, str(tmp_path / "left")) == want
    spark.sql("DROP TABLE left_over")

    table = str(tmp_path / "killed")
    tables.append_rides(clean_rides(_rides_of(make_rides, (10,))), table)

    def killed(*_):
        raise KeyboardInterrupt

    for owner, step in ((keys, "commit"), (keys, "_new_keys"), (tables, "_unknown")):
        before = keys.segments(spark, table)
        with monkeypatch.context() as m:
            m.setattr(owner, step, killed)
            with pytest.raises(KeyboardInterrupt):
                tables.append_rides(rides, table)
        if owner is keys:
            assert keys.segments(spark, table) == before
    # Rows of an append that were written in part, of which nothing else is known.
    part = to_ride_table(rides).limit(50)
    part.write.mode("append").partitionBy("date").parquet(str(tmp_path / "other"))
    tables.append_rides(rides, str(tmp_path / "other"))
    tables.append_rides(rides, table)
    assert _ids(spark, table) == want and _ids(spark, str(tmp_path / "other")) == want


def test_segments_are_few_and_so_are_their_files(spark, make_rides, tmp_path, monkeypatch):
    table = str(tmp_path / "rides")
    monkeypatch.setattr(keys, "BUCKET_KEYS", 16)
    for day in range(1, 6):
        tables.append_rides(clean_rides(_rides_of(make_rides, (day,), 12)), table)
    valid = keys.refresh(spark, table, "ride_id")
    assert sum(s["keys"] for s in valid) == 60 and len(valid) <= 3
    assert all(s["buckets"] * 16 >= s["keys"] for s in valid)
    # No more folders than the last two manifests name, no more files than buckets.
    place = tmp_path / "rides_index"
    assert len(list(place.glob("manifest-*"))) <= 2
    assert len(list(place.glob("segment-*"))) <= 2 * len(valid) + 2
    for s in valid:
        assert len(list((place / s["name"] / "keys").rglob("*.parquet"))) <= s["buckets"]
    # Only the buckets of new keys are read.
    fresh = to_ride_table(clean_rides(make_rides({"ride_id": "5-3"})))
    plan = keys.known_keys(spark, table, fresh, "ride_id")
    assert "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().executedPlan().toString()
    assert "5-3" in {r.ride_id for r in plan.collect()} and plan.count() < 60
    tables.append_rides(clean_rides(_rides_of(make_rides, range(1, 6), 12)), table)
    assert len(_ids(spark, table)) == 60


def test_a_day_that_was_replaced_is_indexed_anew(spark, make_rides, tmp_path):
    table = str(tmp_path / "rides")
    for day in (10, 11):
        tables.append_rides(clean_rides(_rides_of(make_rides, (day,), 3)), table)
    keys.refresh(spark, table, "ride_id")
    shutil.rmtree(tmp_path / "rides" / "date=2024-01-10")
    tables.append_rides(clean_rides(_rides_of(make_rides, (10, 11), 4)), table)
    assert len(_ids(spark, table)) == 8


def test_new_files_too_many_to_name_are_picked_from_the_folder(spark, make_rides, tmp_path, monkeypatch):
    table = str(tmp_path / "rides")
    monkeypatch.setattr(keys, "NAMED_FILES", 0)
    for days in ((10,), (10, 11), (10, 11, 12)):
        tables.append_rides(clean_rides(_rides_of(make_rides, days, 5)), table)
    assert len(_ids(spark, table)) == 15
    assert sum(s["keys"] for s in keys.refresh(spark, table, "ride_id")) == 15


def test_two_writers_of_one_index_do_not_both_succeed(spark, make_rides, tmp_path, monkeypatch):
    table = str(tmp_path / "rides")
    tables.append_rides(clean_rides(make_rides({})), table)
    keys.refresh(spark, table, "ride_id")
    monkeypatch.setattr(keys, "_manifests", lambda *_: [])
    with pytest.raises(RuntimeError):
        keys.commit(spark, table, [])
