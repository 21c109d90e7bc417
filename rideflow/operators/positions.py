"""Exact positions in a day's rides without sorting or collecting the day.

The dashboard looks at a day at a few positions only. So instead of numbering every ride, a
histogram of start minutes locates the minute each wanted position falls into, and only the rides
of those minutes are put in order. The histogram is aggregated before it is shuffled, to at most
days times minutes; the rides put in order are those of a few dozen minutes a day.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from rideflow.session import stage

CELL_SECONDS = 60
# Above this many rides in one start minute the minute is ordered by many tasks.
HOT_CELL_ROWS = 1_000_000
# Rows a task sorts when many tasks order one minute.
ROWS_PER_TASK = 2_000_000
# Tables of marks up to this many rows (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 500_000


def step_of(n):
    """Rides from one snapshot to the next: an eighth of the day, at least one."""
    return F.greatest(F.lit(1), F.floor(n / F.lit(8)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcasting if its counted size allows it, else leave the join to AQE."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def order_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int, groups: int
) -> DataFrame:
    """Number rows within ``group`` by ``order`` from 0, as ``rn``, for groups of any size.

    Rows are range-partitioned, so a large group spreads over many tasks, and so do rows that are
    equal in ``order``: a running id, in no particular order, sets them apart. The split is written
    out once because both passes below rely on it: sizes per partition, then positions. ``rows``
    and ``groups`` are upper bounds; they set the number of partitions and bound the table of
    sizes, which has a row per group and one more per partition border.
    """
    keys = [*group, *order, "_tie"]
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, rows // ROWS_PER_TASK + 1)
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = stage(placed, "ordered")
    spans = placed.groupBy(*group, "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_rows")
    spans = spans.withColumn("_earlier", earlier).drop("_rows")
    return (
        placed.join(small(spans, groups + parts), [*group, "_part"])
        .withColumn("rn", F.col("_earlier") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_earlier")
    )


def cell_of(time: Column, cell_seconds: int = CELL_SECONDS) -> Column:
    """Number of the time's cell; cells before 1970 too hold the times from their begin on."""
    micros = F.unix_micros(time)
    size = F.lit(cell_seconds * 1000000)
    return ((micros - F.pmod(micros, size)) / size).cast("long")


def _with_cell(rides: DataFrame, cell_seconds: int) -> DataFrame:
    return rides.withColumn("cell", cell_of(F.col("started_at"), cell_seconds))


def day_cells(rides: DataFrame, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Rides per day and start minute: date, ``cell``, ``cell_rows``."""
    dated = rides.filter(F.col("started_at").isNotNull()).select(
        F.to_date("started_at").alias("date"), "started_at"
    )
    return _with_cell(dated, cell_seconds).groupBy("date", "cell").agg(
        F.count("*").alias("cell_rows")
    )


def snapshot_marks(cells: DataFrame) -> DataFrame:
    """Where each snapshot of each day lies: its edge ride i and its clock ride max(i - 1, 0).

    From the rides per day and start minute, one row per (date, k, kind): the start minute the ride
    falls into (``cell``), how many rides that minute has (``cell_rows``), and the ride's position
    among them (``local``).
    """
    day = Window.partitionBy("date")
    cells = (
        cells.withColumn("n", F.sum("cell_rows").over(day))
        .withColumn("before", F.sum("cell_rows").over(day.orderBy("cell")) - F.col("cell_rows"))
        .withColumn("step", step_of(F.col("n")))
    )
    # The edges i in [before, before + rows] own this minute, or the position just before does.
    first_k = F.ceil(F.col("before") / F.col("step"))
    last_k = F.least(
        F.floor((F.col("before") + F.col("cell_rows")) / F.col("step")),
        F.floor((F.col("n") - 1) / F.col("step")),
    )
    near = (
        cells.withColumn("first_k", first_k)
        .withColumn("last_k", last_k)
        .filter(F.col("first_k") <= F.col("last_k"))
        .withColumn("k", F.explode(F.sequence("first_k", "last_k")))
        .withColumn("i", F.col("k") * F.col("step"))
    )
    edge = F.struct(F.lit("edge").alias("kind"), F.col("i").alias("position"))
    clock = F.struct(
        F.lit("clock").alias("kind"), F.greatest(F.col("i") - 1, F.lit(0)).alias("position")
    )
    return (
        near.withColumn("mark", F.explode(F.array(edge, clock)))
        .select(
            "date",
            "n",
            F.col("k").cast("int").alias("k"),
            "i",
            "mark.kind",
            "cell",
            "cell_rows",
            (F.col("mark.position") - F.col("before")).alias("local"),
        )
        .filter((F.col("local") >= 0) & (F.col("local") < F.col("cell_rows")))
    )


class Points(NamedTuple):
    """The edge and clock ride of every snapshot, a written table, and its number of rows."""

    rides: DataFrame
    count: int


def snapshot_points(
    rides: DataFrame,
    cell_seconds: int = CELL_SECONDS,
    hot_cell_rows: int = HOT_CELL_ROWS,
    cells: DataFrame | None = None,
) -> Points:
    """Find the edge and clock ride of every snapshot.

    The histogram ``cells`` is made from the rides unless it is at hand.

    Columns: date, n, k, i, kind ("edge" or "clock"), started_at, ride_id. Both steps end in a
    written table of a few dozen rows a day: the first, so that the number of marks and the size
    of the fullest minute are known before the rides are touched again; the second, so that any
    number of uses does not repeat the search.
    """
    size = Observation()
    marks = stage(
        snapshot_marks(day_cells(rides, cell_seconds) if cells is None else cells).observe(
            size,
            F.count("*").alias("marks"),
            F.coalesce(F.max("cell_rows"), F.lit(0)).alias("fullest"),
            F.coalesce(F.sum("cell_rows"), F.lit(0)).alias("rows"),
        ),
        "marks",
    )
    marks_n = size.get["marks"]
    candidates = _with_cell(
        rides.filter(F.col("started_at").isNotNull()).select(
            F.to_date("started_at").alias("date"), "started_at", "ride_id"
        ),
        cell_seconds,
    ).join(small(marks.select("date", "cell"), marks_n), ["date", "cell"], "left_semi")
    if size.get["fullest"] <= hot_cell_rows:
        order = Window.partitionBy("date", "cell").orderBy("started_at", "ride_id")
        numbered = candidates.withColumn("rn", F.row_number().over(order) - 1)
    else:
        numbered = order_numbers(
            candidates,
            ["date", "cell"],
            ["started_at", "ride_id"],
            rows=size.get["rows"],
            groups=marks_n,
        )
    found = numbered.withColumnRenamed("rn", "local").join(
        small(marks, marks_n), ["date", "cell", "local"]
    )
    points = found.select("date", "n", "k", "i", "kind", "started_at", "ride_id")
    return Points(stage(points, "points"), marks_n)
