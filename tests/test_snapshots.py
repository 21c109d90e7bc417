"""Snapshots against a plain-Python rendition that re-evaluates every prefix."""

from __future__ import annotations

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rideflow.functions.pricing import with_revenue
from rideflow.operators import positions, snapshots
from rideflow.operators.cleaning import with_duration
from rideflow.operators.positions import order_numbers, snapshot_points


def day_of(n: int, day: int = 5, seed: int = 0, same_minute: bool = False) -> list[dict]:
    rng = random.Random(seed * 1000 + n)
    rows = []
    for i in range(n):
        second = rng.randrange(3) if same_minute else rng.randrange(86400)
        rows.append(
            {
                "ride_id": f"{day}-{rng.random()}-{i}",
                "started_at": dt.datetime(2024, 1, day) + dt.timedelta(seconds=second),
                "seconds": rng.choice([30, 90, 600, 2700, 2760, 5000]),
                "rideable_type": rng.choice(["classic_bike", "electric_bike", "docked_bike", None]),
                "member_casual": rng.choice(["casual", "member"]),
                "start_station_name": rng.choice(["A", "B", "C", None]),
                "end_station_name": rng.choice(["A", "B", None]),
            }
        )
    return rows


def prefixes(rides):
    """(date, k, i, rides so far) for every snapshot, from collected rows."""
    days = collections.defaultdict(list)
    for ride in rides:
        days[ride.started_at.date()].append(ride)
    for date, rows in days.items():
        rows.sort(key=lambda r: (r.started_at, r.ride_id))
        step = max(1, len(rows) // 8)
        for k, i in enumerate(range(0, len(rows), step)):
            yield date, k, i, rows[: i + 1]


@pytest.fixture(scope="module")
def days(spark):
    return [
        *day_of(1, 1),
        *day_of(7, 2),
        *day_of(8, 3),
        *day_of(15, 4),
        *day_of(16, 5),
        *day_of(17, 6),
        *day_of(120, 7, same_minute=True),
        *day_of(203, 8),
    ]


@pytest.fixture
def rides(make_rides, days):
    shuffled = list(days)
    random.Random(1).shuffle(shuffled)
    return with_revenue(with_duration(make_rides(*shuffled))).repartition(5)


@pytest.fixture
def many_partitions(spark):
    """Keep the few rows of a test spread out."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(params=["plain", "hot"])
def points(request, rides, many_partitions):
    hot = 0 if request.param == "hot" else 1_000_000
    return snapshot_points(rides, hot_cell_rows=hot)


def test_number_of_snapshots(rides):
    index = snapshots.snapshot_index(rides).groupBy("date").count().collect()
    counts = {r.date.day: r["count"] for r in index}
    assert counts == {1: 1, 2: 7, 3: 8, 4: 15, 5: 8, 6: 9, 7: 8, 8: 9}


def test_clock_is_the_ride_before_the_edge(rides, points):
    expected = {(d, k): p[max(i - 1, 0)].started_at for d, k, i, p in prefixes(rides.collect())}
    got = snapshots.snapshot_clock(rides, points).collect()
    assert {(r.date, r.k): r.clock_at for r in got} == expected
    assert len(got) == len(expected)


def test_each_ride_joins_its_first_snapshot(rides, points):
    expected = {}
    for _, k, _, prefix in prefixes(rides.collect()):
        for ride in prefix:
            expected.setdefault(ride.ride_id, k)
    got = snapshots.place_rides(rides, points).collect()
    assert {r.ride_id: r.k for r in got} == expected
    assert len(got) == len(expected)


def test_figures_equal_those_of_every_prefix(rides, points):
    got = {(r.date, r.k): r for r in snapshots.snapshot_kpis(rides, points).collect()}
    seen = 0
    for date, k, i, prefix in prefixes(rides.collect()):
        seen += 1
        row = got[date, k]
        assert row.completed == i + 1
        assert row.revenue == pytest.approx(sum(r.revenue for r in prefix), abs=0.006)
        bars = collections.Counter(
            (r.started_at.hour, r.rideable_type) for r in prefix if r.rideable_type
        )
        if bars:
            assert row.mean_bar == pytest.approx(sum(bars.values()) / len(bars), abs=1e-6)
        else:
            assert row.mean_bar is None
        for bike in ("classic", "electric"):
            own = [r.revenue for r in prefix if r.rideable_type == f"{bike}_bike"]
            assert row[f"{bike}_rides"] == len(own)
            if own and i > 0:
                assert row[f"{bike}_rpr"] == pytest.approx(sum(own) / len(own), abs=0.006)
            else:
                assert row[f"{bike}_rpr"] is None
        for end in ("start", "end"):
            names = collections.Counter(
                r[f"{end}_station_name"] for r in prefix if r[f"{end}_station_name"]
            )
            top = min(names, key=lambda n: (-names[n], n)) if names else None
            assert row[f"top_{end}_station"] == top
            assert row[f"top_{end}_rides"] == (names[top] if top else None)
    assert seen == len(got)


def test_nothing_needs_a_broadcast(spark, rides, points, monkeypatch):
    """Beyond the size that may be broadcast, the same figures come from shuffled joins."""
    expected = sorted(snapshots.snapshot_kpis(rides, points).collect())
    monkeypatch.setattr(positions, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = snapshots.snapshot_kpis(rides, snapshot_points(rides, hot_cell_rows=50))
        got = sorted(shuffled.collect())
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == expected
    assert "Broadcast" not in plan


def test_keys_stay_once_they_have_appeared(rides, points):
    expected = {}
    for date, k, _, prefix in prefixes(rides.collect()):
        for bike, n in collections.Counter(r.rideable_type for r in prefix).items():
            if bike:
                expected[date, k, bike] = n
    got = snapshots.snapshot_type_counts(rides, points).collect()
    assert {(r.date, r.k, r.rideable_type): r.rides for r in got} == expected


def test_maps_of_every_prefix(make_rides, days, points):
    """Hexagons and arcs of a prefix, some of its rides without a start point."""
    unplaced = [r | ({"start_lat": None} if i % 3 == 0 else {}) for i, r in enumerate(days)]
    rides = make_rides(*unplaced)
    cells, arcs = collections.defaultdict(int), {}
    for date, k, _, prefix in prefixes(rides.collect()):
        located = sum(r.start_lat is not None for r in prefix)
        if located:
            cells[date, k] = located
        for ride in prefix:
            arcs.setdefault(ride.ride_id, k)
    dense = snapshots.snapshot_hex_density(rides, points).collect()
    assert {(r.date, r.k): r.rides for r in dense} == cells
    drawn = snapshots.snapshot_arcs(rides, points).collect()
    assert {r.ride_id: r.k for r in drawn} == arcs


def test_unknown_duration_counts_as_no_revenue(make_rides):
    rides = with_revenue(with_duration(make_rides({"ended_at": None}, {"ended_at": None})))
    got = snapshots.snapshot_revenue(rides).orderBy("k").collect()
    assert [(r.rides, r.revenue) for r in got] == [(1, 0.0), (2, 0.0)]


def test_no_rides_no_snapshots(make_rides):
    none = with_revenue(with_duration(make_rides({}))).filter("ride_id is null")
    assert snapshots.snapshot_kpis(none).collect() == []
    assert snapshots.snapshot_index(none).collect() == []
    nothing = with_revenue(with_duration(make_rides({}).filter("false").limit(0)))
    assert snapshots.snapshot_clock(nothing).collect() == []


def test_rides_without_a_start_time_are_in_no_snapshot(make_rides):
    rides = make_rides({"started_at": None}, {})
    assert snapshots.snapshot_type_counts(rides).count() == 1
    assert snapshots.snapshot_index(rides).first().n == 1


def test_order_numbers_spread_copies_of_one_row(spark, many_partitions):
    copies = spark.range(0, 20_000, 1, 4).select(F.lit("g").alias("g"), F.lit("same").alias("id"))
    numbered = order_numbers(copies, ["g"], ["id"], rows=20_000, groups=1)
    parts = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 10_000
    assert sorted(r.rn for r in numbered.collect()) == list(range(20_000))


def test_order_numbers_spread_one_large_group(spark, many_partitions):
    rows = spark.range(20_000).select(
        F.lit("all").alias("g"), F.lit(1).alias("t"), F.hash("id").cast("string").alias("id")
    )
    numbered = order_numbers(rows.distinct(), ["g"], ["t", "id"], rows=20_000, groups=1)
    parts = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 10_000
    got = [r.id for r in numbered.orderBy("rn").collect()]
    assert got == sorted(got)
    assert [r.rn for r in numbered.orderBy("rn").collect()] == list(range(len(got)))
