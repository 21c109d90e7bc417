from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from rideflow.functions.pricing import with_revenue
from rideflow.plans import catalog
from rideflow.operators.cleaning import clean_rides, parse_clean_rides, with_duration
from rideflow.operators.kpis import hourly
from rideflow.sources import tables, topics
from rideflow.operators.snapshots import snapshot_kpis
from rideflow.streaming import jobs, live


@pytest.fixture
def paths(tmp_path):
    return {n: str(tmp_path / n) for n in ("topic", "clean", "table", "out", "check", "check2")}


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def send(rides, topic, partition=0, batch=0):
    topics.publish(topics.ride_messages(rides), topic, partition, batch)


def send_clean(rides, topic, batch=0):
    topics.publish(topics.clean_ride_messages(clean_rides(rides)), topic, 1, batch)


def clean(spark, paths):
    jobs.clean_stream(spark, paths["topic"], paths["clean"], paths["check"]).awaitTermination()
    return parse_clean_rides(topics.read_topic(spark, paths["clean"], 1))


def test_stream_equals_batch(spark, make_rides, paths):
    rides = make_rides({}, {"start_station_id": None}, {"ended_at": None}, {"rideable_type": None})
    send(rides, paths["topic"])
    junk = spark.createDataFrame([("{broken",), ('{"ride_id": "x"}',)], "value string")
    topics.publish(junk, paths["topic"], 0, batch=1)
    streamed = clean(spark, paths)
    batch = clean_rides(rides)
    assert sorted(r.ride_id for r in streamed.collect()) == sorted(
        r.ride_id for r in batch.collect()
    )
    assert sorted((r.ride_id, r.duration) for r in streamed.collect()) == sorted(
        (r.ride_id, r.duration_seconds) for r in batch.collect()
    )


def test_restart_writes_nothing_twice(spark, make_rides, paths):
    send(make_rides({"ride_id": "a"}), paths["topic"])
    assert clean(spark, paths).count() == 1
    assert clean(spark, paths).count() == 1
    send(make_rides({"ride_id": "b"}), paths["topic"], batch=1)
    assert sorted(r.ride_id for r in clean(spark, paths).collect()) == ["a", "b"]


def test_two_checkpoints_do_not_replace_each_others_messages(spark, make_rides, paths):
    send(make_rides({"ride_id": "a"}), paths["topic"])
    assert clean(spark, paths).count() == 1
    second = paths | {"topic": paths["topic"] + "2", "check": paths["check2"]}
    send(make_rides({"ride_id": "b"}), second["topic"])
    assert sorted(r.ride_id for r in clean(spark, second).collect()) == ["a", "b"]


def test_only_the_raw_partition_is_read(spark, make_rides, paths):
    send(make_rides({"ride_id": "raw"}), paths["topic"], 0)
    send_clean(make_rides({"ride_id": "already clean"}), paths["topic"])
    assert [r.ride_id for r in clean(spark, paths).collect()] == ["raw"]


def test_table_keeps_keys_unique_across_batches_and_replays(spark, make_rides, paths):
    send_clean(make_rides({"ride_id": "a"}, {"ride_id": "a"}, {"ride_id": "b"}), paths["topic"])

    def load(checkpoint):
        jobs.load_rides_stream(
            spark, paths["topic"], paths["table"], checkpoint, files_per_trigger=1
        ).awaitTermination()
        stored = tables.read_ride_table(spark, paths["table"])
        return sorted(r.ride_id for r in stored.collect())

    assert load(paths["check"]) == ["a", "b"]
    send_clean(make_rides({"ride_id": "b"}, {"ride_id": "c"}), paths["topic"], batch=1)
    assert load(paths["check"]) == ["a", "b", "c"]
    # A lost checkpoint replays everything.
    replayed = jobs.load_rides_stream(
        spark,
        paths["topic"],
        paths["table"],
        paths["check"] + "3",
        files_per_trigger=1,
        resent_unchanged=True,
    )
    replayed.awaitTermination()
    assert load(paths["check2"]) == ["a", "b", "c"]
    row = tables.read_ride_table(spark, paths["table"]).filter("ride_id = 'c'").first()
    assert (row.duration, row.rideable_type, row.start_lat) == (600.0, "classic_bike", "38.9")


def test_copies_are_dropped_within_and_across_batches(spark, make_rides, paths):
    at = dt.datetime(2024, 1, 5, 9)
    once = make_rides(*[{"ride_id": f"r{i}", "started_at": at} for i in range(5)])
    hot = make_rides(*[{"ride_id": "hot", "started_at": at}] * 300).repartition(4)
    send(once.unionAll(once).unionAll(hot), paths["topic"])

    def dedup():
        jobs.dedup_stream(
            spark, paths["topic"], paths["out"], paths["check"]
        ).awaitTermination()
        return sorted(r.ride_id for r in spark.read.parquet(paths["out"]).collect())

    assert dedup() == ["hot", "r0", "r1", "r2", "r3", "r4"]
    later = make_rides({"ride_id": "r0", "started_at": at}, {"ride_id": "new", "started_at": at})
    send(later, paths["topic"], batch=1)
    assert dedup() == ["hot", "new", "r0", "r1", "r2", "r3", "r4"]


def test_hours_grow_with_late_rides(spark, make_rides, paths):
    at = dt.datetime(2024, 1, 5, 9)
    first = make_rides({"started_at": at}, {"started_at": at + dt.timedelta(hours=2)})
    late = make_rides(
        {"ride_id": "late", "started_at": at + dt.timedelta(minutes=59)},
        {"ride_id": "untyped", "started_at": at, "rideable_type": None},
    )
    for batch, rides in enumerate((first, late)):
        send_clean(rides, paths["topic"], batch)
        jobs.hourly_stream(
            spark, paths["topic"], paths["out"], paths["check"]
        ).awaitTermination()
    got = {
        (r.hour, r.rideable_type): (r.rides, r.revenue)
        for r in jobs.latest_hours(spark, paths["out"]).collect()
    }
    batch = hourly(with_revenue(with_duration(first.unionAll(late))))
    assert got == {(r.hour, r.rideable_type): (r.rides, r.revenue) for r in batch.collect()}
    assert got[at, "classic_bike"] == (2, 3.0)


@pytest.mark.parametrize("files", [None, 1, 3])
def test_no_ride_is_too_late_however_the_input_is_cut(spark, make_rides, paths, files):
    """Six files that each span two months, copies in other files, rides without a start."""
    at = dt.datetime(2024, 1, 1, 9)
    rides = [
        {"ride_id": str(i), "started_at": None if i % 9 == 0 else at + dt.timedelta(hours=i * 37 % 1440)}
        for i in range(90)
    ]
    for batch in range(6):
        mine = [r for i, r in enumerate(rides) if (i * 5 + batch) % 6 < 2]
        send(make_rides(*mine).coalesce(1), paths["topic"], batch=batch)
        send_clean(make_rides(*mine).coalesce(1), paths["topic"], batch)
    jobs.dedup_stream(
        spark, paths["topic"], paths["out"], paths["check"], files_per_trigger=files
    ).awaitTermination()
    got = sorted(int(r.ride_id) for r in spark.read.parquet(paths["out"]).collect())
    assert got == list(range(90))
    jobs.hourly_stream(
        spark, paths["topic"], paths["table"], paths["check2"], files_per_trigger=files
    ).awaitTermination()
    batch = hourly(with_revenue(with_duration(make_rides(*rides))))
    want = {(r.hour, r.rideable_type): (r.rides, round(r.revenue, 6)) for r in batch.collect()}

    def hours():
        found = jobs.latest_hours(spark, paths["table"]).collect()
        return {(r.hour, r.rideable_type): (r.rides, round(r.revenue, 6)) for r in found}

    assert hours() == want
    for upto in (0, 1, 0):
        jobs.fold_hours(spark, paths["table"], upto)
        assert hours() == want


def test_slices_are_an_option(spark, make_rides, paths):
    rides = make_rides(*[{"ride_id": f"r{i % 7}"} for i in range(70)]).repartition(4)
    send(rides, paths["topic"])
    jobs.dedup_stream(
        spark, paths["topic"], paths["out"], paths["check"], salts=4
    ).awaitTermination()
    assert spark.read.parquet(paths["out"]).count() == 7


def test_weather_stream_keeps_one_row_per_day(spark, paths):
    days = spark.range(4).selectExpr(
        "timestamp_seconds((id % 3) * 86400) as datetime",
        *[
            f"cast(1.5 as float) as {c}"
            for c in ("tempmax", "tempmin", "humidity", "precip", "snow", "windspeed", "windgust")
        ],
        "'Clear' as conditions",
    )
    topics.publish(topics.weather_messages(days), paths["topic"])
    jobs.load_weather_stream(
        spark, paths["topic"], paths["table"], paths["check"]
    ).awaitTermination()
    stored = tables.read_weather_table(spark, paths["table"])
    assert stored.count() == 3
    assert stored.select(F.sum("tempmax")).first()[0] == 4.5


def test_a_key_is_never_forgotten_unless_a_delay_is_set(spark, make_rides, paths):
    """The clock moves past a short delay between two runs."""
    send(make_rides({"ride_id": "a"}), paths["topic"])

    def dedup(out, checkpoint, **options):
        jobs.dedup_stream(
            spark, paths["topic"], paths[out], paths[checkpoint], **options
        ).awaitTermination()
        return [r.ride_id for r in spark.read.parquet(paths[out]).collect()]

    assert dedup("out", "check") == dedup("table", "check2", delay="1 second") == ["a"]
    for batch, ride in ((1, "b"), (2, "a")):
        time.sleep(2)
        send(make_rides({"ride_id": ride}), paths["topic"], batch=batch)
        dedup("table", "check2", delay="1 second")
        dedup("out", "check")
    assert sorted(dedup("out", "check")) == ["a", "b"]
    assert sorted(dedup("table", "check2", delay="1 second")) == ["a", "a", "b"]


def test_a_target_belongs_to_one_checkpoint(spark, make_rides, paths):
    send_clean(make_rides({}), paths["topic"])
    jobs.hourly_stream(spark, paths["topic"], paths["out"], paths["check"]).awaitTermination()
    other = jobs.hourly_stream(spark, paths["topic"], paths["out"], paths["check2"])
    with pytest.raises(Exception, match="another checkpoint"):
        other.awaitTermination()
    assert jobs.latest_hours(spark, paths["out"]).first().rides == 1


def test_a_running_job_stops_in_good_order(spark, make_rides, paths, tmp_path):
    send_clean(make_rides({"ride_id": "a"}), paths["topic"])
    started = []

    def start(every):
        started.append(every)
        if every is None:
            # Arrives after the marker: the last run takes it.
            send_clean(make_rides({"ride_id": "c"}), paths["topic"], batch=2)
        query = jobs.load_rides_stream(
            spark, paths["topic"], paths["table"], paths["check"], every=every
        )
        if every is not None:
            query.processAllAvailable()
            send_clean(make_rides({"ride_id": "a"}, {"ride_id": "b"}), paths["topic"], batch=1)
            (tmp_path / "stop").touch()
        return query

    jobs.until_marked(start, "1 second", str(tmp_path / "stop"), 0.2)
    assert started == ["1 second", None]
    stored = tables.read_ride_table(spark, paths["table"])
    assert sorted(r.ride_id for r in stored.collect()) == ["a", "b", "c"]


def _day_rides(days, per_day=40):
    at = dt.datetime(2024, 1, 1, 9)
    types = ("classic_bike", "electric_bike", None)
    return [
        {
            "ride_id": f"{d}-{i:03d}", "started_at": at + dt.timedelta(days=d, seconds=i * 47 % 900),
            "rideable_type": types[i % 3], "start_station_name": "ABC"[i * i % 3], "seconds": 60 * i,
            "end_station_name": None if i % 4 == 0 else "XY"[i % 2],
        }
        for d in days for i in range(per_day)
    ]


def _plain(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_live_figures_are_those_of_all_rides_at_once(spark, make_rides, paths):
    """Days of many and of few rides, cut in many ways, with replayed batches, folded in between."""
    rides = _day_rides((0, 2)) + _day_rides((1,), 3) + _day_rides((3,), 1)
    want = _plain(snapshot_kpis(with_revenue(with_duration(make_rides(*rides)))))
    for batch in range(3):
        part = with_revenue(with_duration(make_rides(*rides[batch::3])))
        for _ in range(1 + (batch == 1)):
            live.add_batch(spark, paths["out"], part, batch)
        if batch == 1:
            live.fold(spark, paths["out"], 0)
    assert _plain(live.latest_kpis(spark, paths["out"])) == want


def test_days_a_batch_does_not_touch_are_not_read(spark, make_rides, paths, tmp_path):
    first, later = _day_rides((0, 1)), _day_rides((1,), 60)[40:]
    live.add_batch(spark, paths["out"], with_revenue(with_duration(make_rides(*first))), 0)
    for kind in ("rides", "sums"):
        for file in (tmp_path / "out" / kind / "batch=0" / "date=2024-01-01").glob("*.parquet"):
            file.write_bytes(b"not a table any more")
    for crc in (tmp_path / "out").rglob(".*.crc"):
        crc.unlink()
    live.add_batch(spark, paths["out"], with_revenue(with_duration(make_rides(*later))), 1)
    want = snapshot_kpis(with_revenue(with_duration(make_rides(*first, *later))))
    assert _plain(live.latest_kpis(spark, paths["out"])) == _plain(want)


@pytest.mark.parametrize("name, slices", [("stream_snapshots", 2), ("stream_hourly", 3)])
def test_slices_of_larger_tables_have_more_files(spark, paths, tmp_path, monkeypatch, name, slices):
    """As many micro-batches at any size, and as many tasks in each as its rides need."""
    spark.range(90).selectExpr(
        "id as event_id", "timestamp_seconds(1704445200 + id * 60) as ts", "id % 7 as user_id",
        "'click' as event_type", "cast(10 as double) as value",
        "concat('{\"k\": ', id % 9 + 1, '}') as props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "RIDES_PER_FILE", 10)
    monkeypatch.setattr(catalog, "scratch_path", lambda _, label: str(tmp_path / label))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() > 0
    for batch in range(2):
        sent = tmp_path / "rides-topic" / "partition=1" / f"batch={batch}"
        assert len(list(sent.glob("*.parquet"))) >= 90 // 10
    done = [f for f in (tmp_path / "stream-checkpoint" / "commits").iterdir() if f.name.isdigit()]
    assert len(done) == 2 * slices


def test_live_days_have_no_file_per_task(spark, make_rides, paths, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    send_clean(make_rides(*_day_rides((0, 1), 80)), paths["topic"])
    live.snapshot_stream(spark, paths["topic"], paths["out"], paths["check"]).awaitTermination()
    for kind in ("rides", "sums"):
        for day in (tmp_path / "out" / kind / "batch=0").glob("date=*"):
            assert len(list(day.glob("*.parquet"))) == 1
    want = snapshot_kpis(with_revenue(with_duration(make_rides(*_day_rides((0, 1), 80)))))
    assert _plain(live.latest_kpis(spark, paths["out"])) == _plain(want)
