from __future__ import annotations

import datetime as dt
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rideflow.functions import labels
from rideflow.functions.hexagons import CENTRE_LAT, CENTRE_LNG, EAST_M, NORTH_M, hex_cell
from rideflow.functions import pricing
from rideflow.functions.pricing import ride_revenue
from rideflow.functions.rounding import half_even

FARES = [
    # rider, bike, minutes, fare
    ("casual", "classic_bike", 0.5, 1.0),
    ("casual", "classic_bike", 1.5, 1.1),
    ("casual", "classic_bike", 2.5, 1.1),
    ("casual", "electric_bike", 10, 2.5),
    ("member", "classic_bike", 45, 0.0),
    ("member", "classic_bike", 46, 0.05),
    ("member", "classic_bike", -5, 0.0),
    ("member", "electric_bike", 10, 1.0),
    ("casual", "docked_bike", 10, 0.0),
    ("guest", "classic_bike", 10, 0.0),
    (None, "classic_bike", 10, 0.0),
    ("casual", None, 10, 0.0),
    ("casual", "classic_bike", None, None),
    ("casual", "electric_bike", None, None),
    ("member", "classic_bike", None, None),
    ("member", "electric_bike", None, None),
    ("member", "docked_bike", None, 0.0),
]


def test_fares(spark):
    rows = [(i, r, b, None if m is None else m * 60.0) for i, (r, b, m, _) in enumerate(FARES)]
    rides = spark.createDataFrame(rows, "i int, rider string, bike string, seconds double")
    fare = ride_revenue(F.col("rider"), F.col("bike"), F.col("seconds"))
    got = [r.fare for r in rides.select("i", fare.alias("fare")).orderBy("i").collect()]
    assert got == pytest.approx([f for *_, f in FARES])


def test_rounding_goes_to_even(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4999]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(
        half_even(F.col("x")).alias("r")
    )
    assert [r.r for r in got.collect()] == [float(round(v)) for v in values]


def test_fares_are_whole_units(spark):
    """Every fare is that of the rule in exact arithmetic, to the last bit once divided."""
    seconds = [0, 1, 29, 30, 31, 90, 150, 2699, 2700, 2701, 86_399, 10**9 + 7, -30, -90]
    rows = [(s, float(s)) for s in seconds]
    rides = spark.createDataFrame(rows, "s long, seconds double")
    for rider, bike, rule in (
        ("casual", "classic_bike", lambda s: 1 + round(Fraction(s, 60)) * Fraction(1, 20)),
        ("casual", "electric_bike", lambda s: 1 + round(Fraction(s, 60)) * Fraction(3, 20)),
        ("member", "classic_bike", lambda s: max(Fraction(s, 60) - 45, 0) * Fraction(1, 20)),
        ("member", "electric_bike", lambda s: Fraction(s, 60) * Fraction(1, 10)),
    ):
        fare = ride_revenue(F.lit(rider), F.lit(bike), F.col("seconds"))
        got = rides.select("s", fare.alias("fare"), pricing.units_of(fare).alias("units"))
        for row in got.collect():
            assert row.fare == float(rule(row.s)), (rider, bike, row.s)
            assert row.units == rule(row.s) * 1200


def test_fares_of_odd_durations(spark):
    odd = spark.createDataFrame(
        [(0, float("nan")), (1, float("inf")), (2, None), (3, 60.4)], "i int, seconds double"
    )
    fare = ride_revenue(F.lit("member"), F.lit("electric_bike"), F.col("seconds"))
    got = {r.i: r.fare for r in odd.select("i", fare.alias("fare")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 121 / 1200}


def test_half_cents_go_to_the_even_one(spark):
    sums = [(6,), (18,), (30,), (-6,), (1_200_000_000_000_006,), (1_200_000_000_000_018,)]
    got = spark.createDataFrame(sums, "u long").select(pricing.cents(F.col("u")).alias("c")).collect()
    assert [r.c for r in got] == [0.0, 0.02, 0.02, 0.0, 1e12, 1e12 + 0.02]


def test_labels(spark):
    ts = dt.datetime(2024, 1, 5, 13, 4, 30)
    row = (
        spark.createDataFrame([(ts, 12345678.9, 12.0)], "ts timestamp, big double, whole double")
        .select(
            labels.day_label(F.col("ts")).alias("day"),
            labels.clock_label(F.col("ts")).alias("clock"),
            labels.iso_text(F.col("ts")).alias("iso"),
            labels.dollars_text(F.col("big")).alias("big"),
            labels.dollars_text(F.col("whole")).alias("whole"),
            labels.dollars_text(F.lit(None).cast("double")).alias("none"),
            labels.rides_text(F.lit(7)).alias("rides"),
        )
        .first()
    )
    assert tuple(row) == (
        ts.strftime("%A, %d %B %Y"),
        ts.strftime("%I:%M %p"),
        "2024-01-05T13:04:30",
        "$12345678.9",
        "$12.0",
        None,
        "7 rides",
    )


def test_a_point_falls_into_its_nearest_hexagon(spark):
    radius = 200.0
    points = [
        (CENTRE_LAT + north / NORTH_M, CENTRE_LNG + east / EAST_M)
        for north in range(-900, 901, 130)
        for east in range(-900, 901, 110)
    ]
    cell = hex_cell(F.col("lat"), F.col("lng"), radius)
    rows = (
        spark.createDataFrame(points, "lat double, lng double")
        .select("lat", "lng", cell.q.alias("q"), cell.r.alias("r"))
        .collect()
    )

    def centre(q, r):
        return radius * 3**0.5 * (q + r / 2), radius * 1.5 * r

    def distance(row, q, r):
        east, north = (row.lng - CENTRE_LNG) * EAST_M, (row.lat - CENTRE_LAT) * NORTH_M
        x, y = centre(q, r)
        return (east - x) ** 2 + (north - y) ** 2

    for row in rows:
        near = [
            distance(row, row.q + dq, row.r + dr) for dq in (-1, 0, 1) for dr in (-1, 0, 1)
        ]
        assert distance(row, row.q, row.r) <= min(near) + 1e-6
