"""Intraday snapshots: every KPI of a day re-evaluated on growing prefixes of its rides.

Snapshot k of a day with n rides holds the rides 0..i, i = k * step, in order of start time and
ride id. A ride belongs to the first snapshot whose edge it does not come after. Snapshots then
follow from one aggregate per (day, first snapshot, key) and a running sum over the few snapshots,
so that no ride is looked at once per snapshot. ``ride_id`` is a key: de-duplicate first. (Copies
of a ride would all count from the first snapshot that holds one of them.)

Operators that need the edges take them as ``points``, to share one search between several of
them, or else look for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from rideflow.functions.hexagons import RADIUS_M, hex_cell
from rideflow.functions.labels import clock_label, day_label
from rideflow.functions.pricing import amount, cents, per_ride, total_units
from rideflow.functions.rounding import steady
from rideflow.operators.positions import Points, cell_of, small, snapshot_points, step_of
from rideflow.schemas import COORDINATES


def snapshot_index(rides: DataFrame) -> DataFrame:
    """The snapshots of each day: (date, k), rides in the day and rides completed by then."""
    days = (
        rides.filter(F.col("started_at").isNotNull())
        .groupBy(F.to_date("started_at").alias("date"))
        .agg(F.count("*").alias("n"))
        .withColumn("step", step_of(F.col("n")))
    )
    last = F.floor((F.col("n") - 1) / F.col("step"))
    return (
        days.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("i", F.col("k") * F.col("step"))
        .select(
            "date",
            F.col("k").cast("int").alias("k"),
            "n",
            "i",
            (F.col("i") + 1).alias("completed"),
        )
    )


def snapshot_clock(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """The time a snapshot shows: the start of the ride before its edge ride."""
    return _clocks(points or snapshot_points(rides)).select(
        "date",
        "k",
        "clock_at",
        clock_label(F.col("clock_at")).alias("clock"),
        day_label(F.col("date")).alias("day_label"),
    )


def _clocks(points: Points) -> DataFrame:
    return points.rides.filter(F.col("kind") == "clock").select(
        "date", "k", "i", F.col("started_at").alias("clock_at")
    )


def _stretches(points: Points) -> DataFrame:
    """For each snapshot, the stretch of rides it adds: after edge k - 1 up to edge k."""
    day = Window.partitionBy("date")
    return (
        points.rides.filter(F.col("kind") == "edge")
        .withColumn("up_to", F.struct("started_at", "ride_id"))
        .withColumn("after", F.lag("up_to").over(day.orderBy("k")))
        .withColumn("last_k", F.max("k").over(day))
        .select("date", "last_k", "k", "after", "up_to")
    )


def place_rides(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """Add ``date``, ``k`` (first snapshot that holds the ride) and ``last_k`` (of its day).

    Rides after the last edge of their day are left out, as they are in no snapshot.
    """
    points = points or snapshot_points(rides)
    ride = F.struct("started_at", "ride_id")
    dated = rides.withColumn("date", F.to_date("started_at")).alias("r")
    within = (
        (F.col("r.date") == F.col("s.date"))
        & (ride <= F.col("s.up_to"))
        & (F.col("s.after").isNull() | (ride > F.col("s.after")))
    )
    stretches = small(_stretches(points), points.count).alias("s")
    return dated.join(stretches, within).select("r.*", "s.last_k", "s.k")


def _running(deltas: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """From values per first snapshot to running sums at every snapshot since a key appeared.

    A key without new rides in a snapshot still shows its sum there: each row stands for the
    snapshots up to the key's next row.
    """
    so_far = Window.partitionBy("date", *keys).orderBy("k")
    sums = {
        m: F.sum(m).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for m in measures
    }
    until = F.coalesce(F.lead("k").over(so_far) - 1, F.col("last_k"))
    return (
        deltas.withColumn("_until", until)
        .withColumns(sums)
        .select("date", *keys, "k", "_until", *measures)
        .withColumn("k", F.explode(F.sequence("k", "_until")))
        .drop("_until")
    )


def snapshot_type_counts(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """Rides so far per bike type."""
    known = place_rides(rides, points).filter(F.col("rideable_type").isNotNull())
    deltas = known.groupBy("date", "last_k", "k", "rideable_type").agg(F.count("*").alias("rides"))
    return _running(deltas, ["rideable_type"], ["rides"])


def snapshot_revenue(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """Rides, revenue and revenue per ride so far per bike type; rides carry ``revenue``."""
    known = place_rides(rides, points).filter(F.col("rideable_type").isNotNull())
    deltas = known.groupBy("date", "last_k", "k", "rideable_type").agg(
        F.count("*").alias("rides"), total_units("revenue").alias("fare")
    )
    return (
        _running(deltas, ["rideable_type"], ["rides", "fare"])
        .withColumn("revenue", amount(F.col("fare")))
        .withColumn("rpr", per_ride(F.col("fare"), F.col("rides")))
        .drop("fare")
    )


def snapshot_hourly(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """Rides and revenue so far per clock hour and bike type."""
    known = place_rides(rides, points).filter(F.col("rideable_type").isNotNull())
    deltas = known.groupBy(
        "date", "last_k", "k", F.date_trunc("hour", "started_at").alias("hour"), "rideable_type"
    ).agg(
        F.count("ride_id").alias("rides"), total_units("revenue").alias("fare")
    )
    running = _running(deltas, ["hour", "rideable_type"], ["rides", "fare"])
    return running.withColumn("revenue", amount(F.col("fare"))).drop("fare")


def snapshot_top_station(
    rides: DataFrame, end: str = "start", points: Points | None = None
) -> DataFrame:
    """The station with most rides so far, the alphabetically first of several."""
    station = f"{end}_station_name"
    known = place_rides(rides, points).filter(F.col(station).isNotNull())
    deltas = known.groupBy("date", "last_k", "k", station).agg(F.count("ride_id").alias("rides"))
    best = F.min(F.struct((-F.col("rides")).alias("rank"), F.col(station))).alias("best")
    return (
        _running(deltas, [station], ["rides"])
        .groupBy("date", "k")
        .agg(best)
        .select("date", "k", f"best.{station}", (-F.col("best.rank")).alias("rides"))
    )


def snapshot_hex_density(
    rides: DataFrame, points: Points | None = None, radius_m: float = RADIUS_M
) -> DataFrame:
    """Rides so far per hexagon of the start point."""
    cell = hex_cell(F.col("start_lat"), F.col("start_lng"), radius_m)
    located = rides.filter(F.col("start_lat").isNotNull() & F.col("start_lng").isNotNull())
    # The edges are those of all rides, located or not.
    placed = place_rides(located, points or snapshot_points(rides))
    deltas = placed.groupBy("date", "last_k", "k", cell.q.alias("q"), cell.r.alias("r")).agg(
        F.count("*").alias("rides")
    )
    return _running(deltas, ["q", "r"], ["rides"])


def snapshot_arcs(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """One arc per ride with its first snapshot: snapshot k shows the day's arcs up to k."""
    return place_rides(rides, points).select("date", "k", "ride_id", *COORDINATES)


KEYS = ("no_bar", "no_start", "hour", "rideable_type", "start_station_name", "end_station_name")


def headline_sums(rides: DataFrame, common: Sequence[str]) -> DataFrame:
    """Rides and fares in units by hour and bike type, by start station and by end station.

    The three are grouping sets of one aggregate, within each group of the ``common`` columns.
    """
    own = [F.col(c) for c in common]
    by_bar = [*own, F.col("hour"), F.col("rideable_type")]
    by_start = [*own, F.col("start_station_name")]
    by_end = [*own, F.col("end_station_name")]
    return rides.groupingSets([by_bar, by_start, by_end], *by_bar, by_start[-1], by_end[-1]).agg(
        F.grouping("hour").alias("no_bar"),
        F.grouping("start_station_name").alias("no_start"),
        F.count("ride_id").alias("rides"),
        total_units("revenue").alias("fare"),
    )


def snapshot_kpis(rides: DataFrame, points: Points | None = None) -> DataFrame:
    """All headline figures of every snapshot, from one pass over the priced rides.

    Per-ride revenue is shown once a snapshot holds more than one ride.
    """
    points = points or snapshot_points(rides)
    placed = place_rides(rides, points).withColumn("hour", F.date_trunc("hour", "started_at"))
    return kpi_figures(headline_sums(placed, ["date", "last_k", "k"]), points)


def kpis_from_cells(sums: DataFrame, rides: DataFrame, points: Points) -> DataFrame:
    """The same from sums per minute: only rides of the minutes that hold an edge are looked at.

    ``sums`` are :func:`headline_sums` by date and ``cell``, in any number of parts that add up;
    ``rides`` has at least the rides of the minutes in which the day's edges lie, with ``cell``.
    """
    stretches = _stretches(points).withColumn("cell", cell_of(F.col("up_to.started_at")))
    day = Window.partitionBy("date").orderBy("k")
    edges = (
        stretches.withColumn("after_cell", F.lag("cell").over(day))
        .withColumnRenamed("cell", "edge_cell")
        .select("date", "last_k", "k", "after_cell", "edge_cell")
    )
    # A minute without an edge goes to the first snapshot whose edge comes after it.
    between = (
        (F.col("s.date") == F.col("e.date"))
        & (F.col("s.cell") < F.col("e.edge_cell"))
        & (F.col("e.after_cell").isNull() | (F.col("s.cell") > F.col("e.after_cell")))
    )
    whole = sums.alias("s").join(small(edges, points.count).alias("e"), between).select(
        "s.date", "e.last_k", "e.k", *[f"s.{c}" for c in KEYS], "s.rides", "s.fare"
    )
    on_edge = small(edges.select("date", F.col("edge_cell").alias("cell")).distinct(), points.count)
    near = rides.join(on_edge, ["date", "cell"], "left_semi").drop("date")
    placed = place_rides(near, points).withColumn("hour", F.date_trunc("hour", "started_at"))
    parts = whole.unionByName(headline_sums(placed, ["date", "last_k", "k"]).select(*whole.columns))
    deltas = parts.groupBy("date", "last_k", "k", *KEYS).agg(
        F.sum("rides").alias("rides"), F.sum("fare").alias("fare")
    )
    return kpi_figures(deltas, points)


def kpi_figures(deltas: DataFrame, points: Points) -> DataFrame:
    """The headline figures from what each snapshot adds to every key."""
    keys = list(KEYS)
    running = _running(deltas, keys, ["rides", "fare"])

    bar = F.col("no_bar") == 0
    typed = bar & F.col("rideable_type").isNotNull()
    start = (F.col("no_start") == 0) & F.col("start_station_name").isNotNull()
    end = (F.col("no_bar") == 1) & (F.col("no_start") == 1) & F.col("end_station_name").isNotNull()

    def total(when, measure):
        return F.sum(F.when(when, F.col(measure)))

    def best(when, station):
        return F.min(F.when(when, F.struct((-F.col("rides")).alias("rank"), F.col(station))))

    def of(bike):
        return typed & (F.col("rideable_type") == bike)

    figures = running.groupBy("date", "k").agg(
        total(bar, "fare").alias("fare"),
        total(of("classic_bike"), "rides").alias("classic_rides"),
        total(of("electric_bike"), "rides").alias("electric_rides"),
        total(of("classic_bike"), "fare").alias("classic_fare"),
        total(of("electric_bike"), "fare").alias("electric_fare"),
        F.avg(F.when(typed, F.col("rides"))).alias("mean_bar"),
        best(start, "start_station_name").alias("top_start"),
        best(end, "end_station_name").alias("top_end"),
    )
    several = F.col("completed") > 1

    def each(bike):
        return F.when(several, cents(F.col(f"{bike}_fare"), F.col(f"{bike}_rides")))

    return (
        figures.join(small(_clocks(points), points.count), ["date", "k"])
        .withColumn("completed", F.col("i") + 1)
        .select(
            "date",
            "k",
            "completed",
            clock_label(F.col("clock_at")).alias("clock"),
            cents(F.col("fare")).alias("revenue"),
            F.coalesce("classic_rides", F.lit(0)).alias("classic_rides"),
            F.coalesce("electric_rides", F.lit(0)).alias("electric_rides"),
            each("classic").alias("classic_rpr"),
            each("electric").alias("electric_rpr"),
            steady(F.col("mean_bar")).alias("mean_bar"),
            F.col("top_start.start_station_name").alias("top_start_station"),
            (-F.col("top_start.rank")).alias("top_start_rides"),
            F.col("top_end.end_station_name").alias("top_end_station"),
            (-F.col("top_end.rank")).alias("top_end_rides"),
        )
    )
