from __future__ import annotations

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from rideflow.operators import forecast, training
from rideflow.schemas import WEATHER_MEASURES


@pytest.fixture(scope="module")
def planted(spark):
    """Days whose ride count follows the temperature and drops with rain."""
    return spark.range(300).select(
        F.expr("date_add(date'2023-01-01', cast(id as int))").alias("date"),
        (F.rand(1) * 30).alias("tempmax"),
        F.lit(1.0).alias("tempmin"),
        F.lit(50.0).alias("humidity"),
        F.when(F.rand(2) < 0.3, 10.0).otherwise(0.0).alias("precip"),
        F.lit(0.0).alias("snow"),
        F.rand(3).alias("windspeed"),
        F.rand(4).alias("windgust"),
    ).withColumn("count", (100 + 20 * F.col("tempmax") - 15 * F.col("precip")).cast("long"))


@pytest.fixture(scope="module")
def fitted(planted):
    return forecast.fit_forecast(planted, trees=20)


def test_fit_finds_the_planted_signal(fitted):
    assert 90 < fitted.fit_percent <= 100
    assert round(fitted.fit_percent, 1) == fitted.fit_percent


def test_same_seed_same_forest(spark, planted):
    def predictions(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            shuffled = planted.repartition(7, F.rand(int(partitions)))
            model = forecast.fit_forecast(shuffled, trees=5, max_depth=8).model
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        weather = planted.withColumnRenamed("date", "datetime")
        return sorted(forecast.forecast(model, weather).collect())

    assert predictions("3") == predictions("40")


def test_forecast_covers_all_days_in_whole_rides(spark, planted, fitted):
    weather = planted.drop("count").withColumnRenamed("date", "datetime")
    days = forecast.forecast(fitted.model, weather, "2023-06-01")
    first = days.agg(F.min("date")).first()[0]
    assert first == dt.date(2023, 6, 1)
    assert dict(days.dtypes)["predicted"] == "bigint"
    near = days.join(planted, "date").select(F.avg(F.abs(F.col("predicted") - F.col("count"))))
    assert near.first()[0] < 40
    row = days.first()
    assert row.label == f"{row.predicted} rides"


def test_a_day_with_missing_weather_still_gets_a_forecast(planted, fitted):
    weather = planted.withColumnRenamed("date", "datetime").withColumn(
        "windgust", F.lit(None).cast("double")
    )
    assert forecast.forecast(fitted.model, weather).count() == planted.count()


def test_training_days_may_miss_weather(planted):
    gaps = planted.withColumn(
        "windgust", F.when(F.dayofmonth("date") > 3, F.col("windgust"))
    )
    assert forecast.fit_forecast(gaps, trees=5).fit_percent > 80


def test_model_can_be_saved(planted, fitted, tmp_path):
    path = str(tmp_path / "model")
    forecast.save_forecast(fitted.model, path)
    weather = planted.withColumnRenamed("date", "datetime")
    loaded = forecast.forecast(forecast.load_forecast(path), weather).collect()
    assert sorted(loaded) == sorted(forecast.forecast(fitted.model, weather).collect())


def test_split_is_the_same_on_every_run_and_takes_a_fifth(planted):
    parts = {p: n for p, n in training.with_split(planted).groupBy("part").count().collect()}
    assert parts == {"test": 60, "train": 240}
    train, test = training.random_split(planted)
    assert train.count() + test.count() == 300
    assert 30 < test.count() < 90


def test_training_needs_both_rides_and_weather(spark, make_rides):
    noon = dt.datetime(2023, 5, 1, 12)
    day = dt.timedelta(days=1)
    rides = make_rides(
        {"started_at": noon},
        {"started_at": noon, "end_station_id": None},
        {"started_at": noon + day},
        {"started_at": dt.datetime(2022, 12, 31)},
        {"started_at": dt.datetime(2022, 12, 31, 5)},
        {"started_at": dt.datetime(2024, 1, 1)},
    )
    measures = ", ".join(f"1.0D as {c}" for c in WEATHER_MEASURES)
    weather = spark.sql(
        f"select d as datetime, {measures}, 'Clear' as conditions from values"
        " (timestamp'2022-12-31'), (timestamp'2023-05-01'), (timestamp'2023-05-03'),"
        " (timestamp'2024-01-01') as t(d)"
    )
    got = training.training_set(rides, weather, "2022-12-31", "2024-01-01").collect()
    assert [(r.date, r["count"]) for r in got] == [(dt.date(2023, 5, 1), 1)]


def test_difference_at_each_snapshot(spark):
    index = spark.sql("select date'2024-01-05' date, 0 k, 10L n, 0L i, 1L completed")
    predictions = spark.sql("select date'2024-01-05' date, 7L predicted, '7 rides' label")
    row = forecast.forecast_vs_actual(index, predictions).first()
    assert (row.completed, row.predicted, row.difference) == (1, 7, -6)


def test_a_saved_forest_serves_only_the_days_it_was_fitted_on(spark, tmp_path, monkeypatch):
    path, options = str(tmp_path / "model"), {"trees": 2, "max_depth": 3}
    rows = [
        (dt.date(2020, 1, 1) + dt.timedelta(d), *[float(d * k % 17) for k in range(1, 8)], d % 17 + 3)
        for d in range(60)
    ]
    names = ["date", *training.FEATURES, training.LABEL]
    days = spark.createDataFrame(rows, names)
    fits = []
    fit = forecast.fit_forecast
    monkeypatch.setattr(forecast, "fit_forecast", lambda *a, **k: fits.append(1) or fit(*a, **k))
    first = forecast.fit_or_load(days, path, **options)
    again = forecast.fit_or_load(days.orderBy("count"), path, **options)
    assert len(fits) == 1 and again.fit_percent == first.fit_percent
    changed = spark.createDataFrame([*rows[:-1], (*rows[-1][:-1], 99)], names)
    forecast.fit_or_load(changed, path, **options)
    assert len(fits) == 2
    forecast.fit_or_load(changed, path, trees=3, max_depth=3)
    forecast.fit_or_load(changed.union(changed.limit(1)), path, **options)
    assert len(fits) == 4
    # A model whose saving ended early is fitted anew.
    shutil.rmtree(tmp_path / "model" / "fingerprint")
    forecast.fit_or_load(changed.union(changed.limit(1)), path, **options)
    assert len(fits) == 5
