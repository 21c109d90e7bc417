"""Ordered batches: positions, ranges of them, replacing, skew and recovery."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rideflow.sources import ordered, topics
from rideflow.streaming.jobs import clean_stream

ORDER = ["started_at", "ride_id"]


@pytest.fixture(scope="module")
def topic(spark, tmp_path_factory):
    """20,000 numbers in shuffled files, a third of them the same."""
    path = str(tmp_path_factory.mktemp("ordered") / "topic")
    n = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 20_011).alias("n")
    )
    rows = ordered.sorted_rows(n.repartition(5), ["n"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        batch = ordered.publish(rows.select(F.col("n").cast("string").alias("value")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, batch, sorted(7 if i % 3 == 0 else i * 7919 % 20_011 for i in range(20_000))


def test_positions_are_the_order(spark, topic):
    path, batch, want = topic
    got = sorted((r.position, int(r.value)) for r in ordered.read(spark, path, batch).collect())
    assert got == list(enumerate(want))


def test_equal_keys_are_spread(spark, topic):
    path, batch, _ = topic
    found = ordered.segments(spark, path, batch)
    assert len(found) == 8
    assert max(s.messages for s in found) < 2 * 20_000 / 8


def test_reading_takes_no_sort_and_no_shuffle(spark, topic):
    plan = ordered.read(spark, *topic[:2])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert "PushedFilters" in plan


@pytest.mark.parametrize("first, last", [(0, 0), (12_345, 12_999), (19_990, None), (5_000, 15_000)])
def test_ranges_of_positions(spark, topic, first, last):
    path, batch, want = topic
    rows = ordered.read(spark, path, batch, first=first, last=last).collect()
    end = len(want) - 1 if last is None else last
    got = sorted((r.position, int(r.value)) for r in rows)
    assert got == [(i, want[i]) for i in range(first, end + 1)]


def test_nothing_outside(spark, topic):
    path, batch, _ = topic
    assert ordered.read(spark, path, batch, first=20_000).isEmpty()
    assert ordered.read(spark, path, batch, first=30, last=29).isEmpty()


def test_a_range_reads_its_segments_alone(spark, topic):
    path, batch, _ = topic
    third = ordered.segments(spark, path, batch)[3]
    rows = ordered.read(spark, path, batch, first=third.first, last=third.first + 9)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(segment,{third.number})" in plan
    assert f"LessThanOrEqual(segment,{third.number})" in plan


def test_empty_batch(spark, tmp_path):
    path = str(tmp_path / "topic")
    none = spark.createDataFrame([], "value string")
    batch = ordered.publish(ordered.sorted_rows(none, ["value"]), path)
    assert ordered.segments(spark, path, batch) == []
    assert ordered.read(spark, path, batch).collect() == []


def test_sent_again_and_cut_short(spark, make_rides, tmp_path, monkeypatch):
    path = str(tmp_path / "topic")

    def send(*rides):
        rows = ordered.sorted_rows(make_rides(*rides), ORDER)
        ordered.publish(topics.ride_messages(rows), path, topics.RAW_PARTITION, "day")

    def ids():
        rows = ordered.read(spark, path, "day", topics.RAW_PARTITION)
        named = rows.select("position", F.get_json_object("value", "$.ride_id").alias("id"))
        return [r.id for r in sorted(named.collect())]

    day = dt.datetime(2024, 1, 5)
    send({"started_at": day + dt.timedelta(0, 9)}, {"started_at": day}, {"started_at": None})
    assert ids() == ["r00002", "r00001", "r00000"]
    send({"started_at": day})
    assert ids() == ["r00000"]

    # The messages are replaced, the job dies before their order is written.
    remove = ordered._remove
    monkeypatch.setattr(ordered, "_remove", lambda s, p: (remove(s, p), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        send({"started_at": day}, {"started_at": day})
    monkeypatch.undo()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ordered.read(spark, path, "day", topics.RAW_PARTITION)
    send({"started_at": day}, {"started_at": day})
    assert ids() == ["r00000", "r00001"]


def test_streams_read_it_like_any_batch(spark, make_rides, tmp_path):
    path, out = str(tmp_path / "topic"), str(tmp_path / "clean")
    rows = ordered.sorted_rows(make_rides({}, {}, {}), ORDER)
    ordered.publish(topics.ride_messages(rows), path, topics.RAW_PARTITION)
    clean_stream(spark, path, out, str(tmp_path / "c")).awaitTermination()
    assert topics.read_topic(spark, out, topics.CLEAN_PARTITION).count() == 3
    assert topics.read_topic(spark, path).count() == 3
