"""The whole chain on the star-schema tables: files, topics, streams, tables, report."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from rideflow.__main__ import main, source, target
from rideflow.operators import forecast
from rideflow.operators.cleaning import clean_rides
from rideflow.plans import workflows
from rideflow.session import shared_dir, stage
from rideflow.sources import files, star, tables
from rideflow.streaming import jobs
from tests.oracle import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("chain")
    path = {n: str(root / n) for n in ("rides.csv", "weather.csv", "topic", "clean", "rides")}
    path |= {n: str(root / n) for n in ("weather-topic", "weather", "prepared", "report")}
    files.write_csv(star.rides(spark, FOLDER), path["rides.csv"])
    files.write_csv(star.weather(spark, FOLDER), path["weather.csv"], single_file=True)

    def run(*args: str, to: str, **options: str):
        flags = [x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", v)]
        main([*args, "--to", path[to], *flags], spark)

    def check(n):
        return {"checkpoint": str(root / f"check-{n}")}

    run("publish-rides", "--from", path["rides.csv"], to="topic")
    run("clean-rides", "--from", path["topic"], to="clean", **check(1))
    run("load-rides", "--from", path["clean"], to="rides", **check(2))
    path |= {n: str(root / n) for n in ("unique", "hours", "model")}
    run("dedup-rides", "--from", path["topic"], to="unique", **check(4))
    run("hourly", "--from", path["clean"], to="hours", files_per_trigger="1", **check(5))
    run("publish-weather", "--from", path["weather.csv"], to="weather-topic")
    run("load-weather", "--from", path["weather-topic"], to="weather", **check(3))
    run(
        "prepare",
        to="prepared",
        rides=path["rides.csv"],
        weather=path["weather.csv"],
        cut_off="2024-01-25",
    )
    run(
        "report",
        to="report",
        rides=path["rides"],
        weather=path["weather"],
        training=f"{path['prepared']}/pastdata",
        start="2024-01-10",
        model=path["model"],
    )
    return path


def test_the_table_holds_the_cleaned_rides(spark, chain):
    stored = tables.read_ride_table(spark, chain["rides"])
    clean = clean_rides(star.rides(spark, FOLDER))
    assert stored.count() == clean.count()
    expected = clean.select("ride_id", "rideable_type", "started_at", "duration_seconds")
    got = stored.select("ride_id", "rideable_type", "started_at", "duration")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_the_split_leaves_every_ride_on_one_side(spark, chain):
    future = files.read_ride_file(spark, f"{chain['prepared']}/futuredata")
    assert future.agg(F.min("started_at")).first()[0].day == 25
    days = files.read_training(spark, f"{chain['prepared']}/pastdata").collect()
    assert [d.date.day for d in days] == list(range(1, 25))
    complete = star.rides(spark, FOLDER).dropna(subset=["start_station_id", "end_station_id"])
    past = complete.filter("started_at < '2024-01-25'").count()
    assert sum(d["count"] for d in days) == past


def test_the_report_covers_every_served_day(spark, chain):
    kpis = spark.read.parquet(f"{chain['report']}/snapshot_kpis")
    days = {r.date.day for r in kpis.select("date").distinct().collect()}
    assert days == set(range(10, 31))
    versus = spark.read.parquet(f"{chain['report']}/forecast_vs_actual")
    assert versus.count() == kpis.count()
    assert versus.filter("difference != completed - predicted").count() == 0


def test_topics_may_be_on_kafka():
    options = source("kafka:a:9092,b:9092/rides", 1)
    assert options["kafka.bootstrap.servers"] == "a:9092,b:9092"
    assert options["assign"] == '{"rides": [1]}'
    assert target("kafka:a:9092/rides")["topic"] == "rides"
    assert source("/some/folder", 1) == target("/some/folder") == "/some/folder"


def test_live_jobs_see_every_ride(spark, chain):
    rides = star.rides(spark, FOLDER)
    assert spark.read.parquet(chain["unique"]).count() == rides.count()
    hours = jobs.latest_hours(spark, chain["hours"]).agg(F.sum("rides")).first()[0]
    assert hours == clean_rides(rides).count()


def test_report_loads_a_saved_model_and_leaves_nothing_behind(spark, chain, tmp_path, monkeypatch):
    def fail(*args, **options):
        raise AssertionError("the forest is fitted again")

    monkeypatch.setattr(forecast, "fit_forecast", fail)
    reads = []
    stored = tables.read_ride_table(spark, chain["rides"])
    monkeypatch.setattr(
        workflows, "stage", lambda df, label: reads.append(label) or stage(df, label)
    )
    root = f"{shared_dir(spark)}/rideflow"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    workflows.report(
        stored,
        tables.read_weather_table(spark, chain["weather"]),
        files.read_training(spark, f"{chain['prepared']}/pastdata"),
        str(tmp_path / "report"),
        "2024-01-10",
        chain["model"],
    )
    assert set(os.listdir(root)) == before and reads == ["report-rides"]
    for name in ("snapshot_kpis", "daily_forecast", "od_flows", "snapshot_arcs"):
        old, new = (spark.read.parquet(f"{p}/{name}") for p in (chain["report"], tmp_path / "report"))
        assert old.count() == new.count() > 0 and old.exceptAll(new).count() == 0


def test_report_reads_only_the_days_it_needs(spark, chain):
    table = tables.read_ride_table(spark, chain["rides"])
    seen = []

    def watch(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(workflows, "stage", watch)
        with pytest.raises(InterruptedError):
            workflows.report(table, None, None, "", "2024-01-10")
    assert re.search(r"PartitionFilters: \[[^]]*date#\d+ >= 2024-01-10", seen[0])
    assert seen[0].count("FileScan") == 1


@pytest.mark.parametrize(
    "flags",
    [
        ["hourly", "--from", "folder", "--to", "x", "--checkpoint", "c", "--min-tasks", "3"],
        ["hourly", "--from", "kafka:a/t", "--to", "x", "--checkpoint", "c", "--files-per-trigger", "3"],
        ["dedup-rides", "--from", "folder", "--to", "kafka:a/t", "--checkpoint", "c"],
        ["publish-weather", "--from", "f", "--to", "kafka:a/t", "--batch", "1"],
    ],
)
def test_flags_that_do_not_apply_are_refused(flags):
    with pytest.raises(SystemExit):
        main(flags)


def test_batch_size_and_partitions_reach_kafka():
    options = source("kafka:a:9092/rides", None, "earliest", 30, 8)
    assert options["subscribe"] == "rides" and options["maxOffsetsPerTrigger"] == "30"
    assert options["minPartitions"] == "8" and "assign" not in options
