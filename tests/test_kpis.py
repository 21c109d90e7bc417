from __future__ import annotations

import datetime as dt
from fractions import Fraction

from pyspark.sql import functions as F

from rideflow.functions.pricing import with_revenue
from rideflow.operators import flows, kpis
from rideflow.operators.cleaning import with_duration


def test_tied_stations_give_the_alphabetically_first(make_rides):
    rides = make_rides(
        {"start_station_name": "B"},
        {"start_station_name": "A"},
        {"start_station_name": None},
        {"start_station_name": None},
        {"start_station_name": None},
    )
    counts = kpis.station_counts(rides, "start")
    assert {r.start_station_name: r.rides for r in counts.collect()} == {"A": 1, "B": 1}
    top = kpis.top_station(counts, "start").first()
    assert (top.start_station_name, top.rides) == ("A", 1)


def test_unknown_type_is_not_counted(make_rides):
    rides = make_rides({"rideable_type": None}, {}, {"rideable_type": "electric_bike"}, {})
    counts = kpis.type_counts(rides).collect()
    assert {r.rideable_type: r["count"] for r in counts} == {"classic_bike": 2, "electric_bike": 1}


def test_missing_bike_type_has_no_revenue_per_ride(make_rides):
    rides = with_revenue(with_duration(make_rides({}, {})))
    row = kpis.revenue_per_ride_wide(kpis.revenue_per_ride(rides)).first()
    assert row.classic_rpr == 1.5
    assert row.electric_rpr is None


def test_ratio_from_join_and_from_one_pass_agree(make_rides):
    rides = with_revenue(with_duration(make_rides({}, {"rideable_type": "electric_bike"}, {})))
    joined = kpis.revenue_joined_to_counts(kpis.revenue_by_type(rides), kpis.type_counts(rides))
    direct = kpis.revenue_per_ride(rides)
    assert sorted(joined.select(direct.columns).collect()) == sorted(direct.collect())


def test_hourly_mean_is_over_bars(make_rides):
    at = dt.datetime(2024, 1, 5, 9)
    rides = with_revenue(
        with_duration(
            make_rides(
                {"started_at": at},
                {"started_at": at},
                {"started_at": at, "rideable_type": "electric_bike"},
                {"started_at": at + dt.timedelta(hours=1), "seconds": None},
            )
        )
    )
    hours = kpis.hourly(rides)
    assert {(r.hour.hour, r.rideable_type): (r.rides, r.revenue) for r in hours.collect()} == {
        (9, "classic_bike"): (2, 3.0),
        (9, "electric_bike"): (1, 2.5),
        (10, "classic_bike"): (1, 0.0),
    }
    mean = kpis.hourly_mean(hours).first()
    assert (mean.bars, mean.mean_rides) == (3, 1.333333)


def test_no_rides_no_revenue(make_rides):
    rides = with_revenue(with_duration(make_rides({}))).filter("false")
    assert kpis.revenue_total(rides).first().revenue == 0.0


def test_flows_need_both_stations(make_rides):
    rides = make_rides({}, {}, {"end_station_name": None}, {"start_lat": None})
    flow = flows.od_flows(rides).collect()
    assert [(r.start_station_name, r.end_station_name, r.rides) for r in flow] == [("A", "B", 3)]
    assert flows.od_arcs(rides).count() == 4
    assert [r.rides for r in flows.hex_density(rides).collect()] == [3]


def test_sums_do_not_depend_on_order_or_partitions(spark):
    """A million dollars of fares beside single units: equal to the last bit however they are cut."""
    n = 20_000
    rides = with_revenue(
        spark.range(n).select(
            F.col("id").cast("string").alias("ride_id"),
            F.when(F.col("id") % 2 == 0, "classic_bike").otherwise("electric_bike").alias("rideable_type"),
            F.when(F.col("id") % 3 == 0, "casual").otherwise("member").alias("member_casual"),
            F.lit(dt.datetime(2024, 1, 5, 9)).alias("started_at"),
            ((F.col("id") * 7919) % 100_003 * F.when(F.col("id") % 17 == 0, 997).otherwise(1))
            .cast("double").alias("duration_seconds"),
        )
    )
    exact = {"classic_bike": 0, "electric_bike": 0}
    for i in range(n):
        seconds = i * 7919 % 100_003 * (997 if i % 17 == 0 else 1)
        bike = "classic_bike" if i % 2 == 0 else "electric_bike"
        if i % 3 == 0:
            exact[bike] += 1200 + round(Fraction(seconds, 60)) * (60 if i % 2 == 0 else 180)
        else:
            exact[bike] += max(seconds - 2700, 0) if i % 2 == 0 else 2 * seconds
    for parts in (1, 7, 200):
        cut = rides.repartition(parts, F.rand(parts))
        assert {r.rideable_type: r.revenue for r in kpis.revenue_by_type(cut).collect()} == {
            b: u / 1200 for b, u in exact.items()
        }
        assert {r.rideable_type: r.rpr for r in kpis.revenue_per_ride(cut).collect()} == {
            b: u / (1200 * n / 2) for b, u in exact.items()
        }
        assert kpis.revenue_total(cut).first().revenue == round(Fraction(sum(exact.values()), 12)) / 100
        assert {r.rideable_type: r.revenue for r in kpis.hourly(cut).collect()} == {
            b: u / 1200 for b, u in exact.items()
        }
