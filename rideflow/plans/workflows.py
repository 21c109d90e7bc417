"""The batch ends of the job chain: preparing files, and reporting on rides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rideflow.functions.pricing import with_revenue
from rideflow.operators import flows, forecast, snapshots
from rideflow.operators.cleaning import between, with_coordinates, with_duration
from rideflow.operators.positions import snapshot_points
from rideflow.operators.training import training_set
from rideflow.schemas import COORDINATES
from rideflow.session import run_folder, stage
from rideflow.sources import files

# The strict bounds that split rides and weather into past and future.
CUT_OFF = "2024-01-01"
PAST_AFTER = "2022-12-31"
FUTURE_WEATHER_AFTER = "2023-12-31"


def prepare(
    spark: SparkSession,
    rides_path: str,
    weather_path: str,
    out: str,
    cut_off: str = CUT_OFF,
    past_after: str = PAST_AFTER,
    future_weather_after: str = FUTURE_WEATHER_AFTER,
    single_file: bool = False,
) -> None:
    """Split ride and weather files at the cut-off and write the training set.

    Writes ``futuredata``, ``futureweatherdata`` and ``pastdata`` under ``out``. The two weather
    results are one row per day and go into one file each; rides do so only on request.
    """
    rides = files.read_ride_file(spark, rides_path)
    weather = files.read_weather_file(spark, weather_path)
    files.write_csv(
        between(rides, "started_at", cut_off, None),
        f"{out}/futuredata",
        single_file,
        ["started_at", "ride_id"],
    )
    files.write_csv(
        between(weather, "datetime", future_weather_after, None),
        f"{out}/futureweatherdata",
        True,
        ["datetime"],
    )
    files.write_csv(
        training_set(rides, weather, past_after, cut_off), f"{out}/pastdata", True, ["date"]
    )


# What the figures of the report need of a ride.
REPORT_COLUMNS = (
    "ride_id",
    "rideable_type",
    "started_at",
    "start_station_name",
    "end_station_name",
    *COORDINATES,
    "revenue",
)


def report(
    rides: DataFrame,
    weather: DataFrame,
    training: DataFrame,
    out: str,
    start: str | None = None,
    model: str | None = None,
) -> float:
    """Write the figures behind the dashboard as Parquet under ``out``; return the model fit.

    ``rides`` are those of the ride table or of a serving file, with ``duration`` in seconds if
    they carry one. Days before ``start`` are skipped; of a table laid out by ``date`` their folders
    aren't read. With ``model`` the forest is loaded from that path, or fitted and saved there if
    there is none.

    The rides are read, parsed and priced once, into a narrow table that all figures are taken from;
    it and all other intermediate tables are gone at the end.
    """
    spark = rides.sparkSession
    if start is not None:
        first = F.lit(start).cast("date")
        if "date" in rides.columns:
            rides = rides.filter(F.col("date") >= first)
        rides = rides.filter(F.to_date("started_at") >= first)
    if "duration" in rides.columns:
        rides = rides.withColumnRenamed("duration", "duration_seconds")
    else:
        rides = with_duration(rides)
    with run_folder(spark):
        priced = with_coordinates(with_revenue(rides)).select(*REPORT_COLUMNS)
        rides = stage(priced, "report-rides")
        fitted = forecast.fit_or_load(training, model)
        predictions = forecast.forecast(fitted.model, weather, start)
        points = snapshot_points(rides)
        results = {
            "snapshot_kpis": snapshots.snapshot_kpis(rides, points),
            "snapshot_type_counts": snapshots.snapshot_type_counts(rides, points),
            "snapshot_revenue": snapshots.snapshot_revenue(rides, points),
            "snapshot_hourly": snapshots.snapshot_hourly(rides, points),
            "daily_forecast": predictions,
            "forecast_vs_actual": forecast.forecast_vs_actual(
                snapshots.snapshot_index(rides), predictions
            ),
            "snapshot_hex_density": snapshots.snapshot_hex_density(rides, points),
            "snapshot_arcs": snapshots.snapshot_arcs(rides, points),
            "hex_density": flows.hex_density(rides),
            "od_flows": flows.od_flows(rides),
        }
        for name, result in results.items():
            result.write.mode("overwrite").parquet(f"{out}/{name}")
    return fitted.fit_percent
