"""Ride-volume forecast: a random forest on daily weather."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from rideflow.functions.labels import rides_text
from rideflow.functions.rounding import half_even
from rideflow.operators.training import FEATURES, LABEL, with_split
from rideflow.session import stage

# A hundred trees on all features. Depth 30 is MLlib's limit; trees grow until leaves
# are pure long before that on daily data.
TREES = 100
MAX_DEPTH = 30
MAX_BINS = 256


class Forecast(NamedTuple):
    model: PipelineModel
    fit_percent: float


def forest(seed: int = 42, trees: int = TREES, max_depth: int = MAX_DEPTH) -> Pipeline:
    """Median for missing measures, features side by side, trees on top."""
    filled = [f"{c}_filled" for c in FEATURES]
    return Pipeline(
        stages=[
            Imputer(inputCols=list(FEATURES), outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="features"),
            RandomForestRegressor(
                labelCol=LABEL,
                numTrees=trees,
                maxDepth=max_depth,
                maxBins=MAX_BINS,
                featureSubsetStrategy="all",
                # Split many tree nodes per pass over the days.
                maxMemoryInMB=1024,
                seed=seed,
            ),
        ]
    )


def fit_forecast(
    training: DataFrame, seed: int = 42, trees: int = TREES, max_depth: int = MAX_DEPTH
) -> Forecast:
    """Fit on 80 % of the days; the fit is R² on the rest, in percent with one decimal.

    The training set has one row per day, so it is small whatever the number of rides. It is
    written out because the forest passes over it many times: as a small table it is read by a
    few tasks, not by one for each partition of the shuffle that made it. Being in date order, it
    gives the same forest for the same seed.
    """
    days = with_split(training.select("date", *FEATURES, LABEL)).orderBy("date")
    days = stage(days, "training")
    model = forest(seed, trees, max_depth).fit(days.filter(F.col("part") == "train"))
    return Forecast(model, fit_percent(model, days))


def fit_percent(model: PipelineModel, training: DataFrame) -> float:
    """R² on the held-out days, in percent with one decimal."""
    days = with_split(training.select("date", *FEATURES, LABEL))
    scored = model.transform(days.filter(F.col("part") == "test"))
    r2 = RegressionEvaluator(labelCol=LABEL, metricName="r2").evaluate(scored)
    return round(r2 * 100, 1)


def fingerprint(training: DataFrame, **options: int) -> str:
    """What a forest depends on, as text: the days in any order, and the settings.

    Equal days add up to the same sum; their number tells repeated ones.
    """
    row = F.xxhash64(*[F.col(c).cast("string") for c in ("date", *FEATURES, LABEL)])
    found = training.agg(
        F.count("*").alias("days"), F.sum(row.cast("decimal(38,0)")).alias("sum")
    ).first()
    settings = {"seed": 42, "trees": TREES, "max_depth": MAX_DEPTH, "max_bins": MAX_BINS} | options
    return f"{found['days']} {found['sum']} {sorted(settings.items())}"


def fit_or_load(training: DataFrame, path: str | None = None, **options: int) -> Forecast:
    """The forest saved at ``path`` if it was fitted on these days with these settings.

    Otherwise it is fitted and saved there. The fit reported is that on these days.
    """
    if path is None:
        return fit_forecast(training, **options)
    days = stage(training.select("date", *FEATURES, LABEL), "training")
    mark, place = fingerprint(days, **options), f"{path}/fingerprint"
    spark = training.sparkSession
    if _exists(spark, place) and spark.read.text(place).first()[0] == mark:
        model = load_forecast(path)
        return Forecast(model, fit_percent(model, days))
    fitted = fit_forecast(days, **options)
    save_forecast(fitted.model, path)
    # Last: a model that was saved in part has none.
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(place)
    return fitted


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def r_squared(scored: DataFrame) -> DataFrame:
    """One row: 1 - SSE / SST of predictions against labels."""
    mean = scored.agg(F.avg(LABEL).alias("mean"))
    error = F.sum((F.col(LABEL) - F.col("prediction")) ** 2)
    spread = F.sum((F.col(LABEL) - F.col("mean")) ** 2)
    return scored.withColumn("mean", mean.scalar()).agg((1 - error / spread).alias("r2"))


def forecast(model: PipelineModel, weather: DataFrame, start: str | None = None) -> DataFrame:
    """Predicted whole rides for every weather day from ``start`` on, all days at once."""
    days = weather.select(F.to_date("datetime").alias("date"), *FEATURES)
    if start is not None:
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
    predicted = half_even(F.col("prediction")).cast("long")
    return (
        model.transform(days)
        .select("date", predicted.alias("predicted"))
        .withColumn("label", rides_text(F.col("predicted")))
    )


def forecast_vs_actual(index: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rides completed at each snapshot against the day's forecast."""
    difference = F.col("completed") - F.col("predicted")
    return index.join(predictions.select("date", "predicted"), "date").select(
        "date",
        "k",
        "completed",
        "predicted",
        difference.alias("difference"),
        F.concat(difference.cast("string"), F.lit(" (Predicted)")).alias("label"),
    )


def save_forecast(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_forecast(path: str) -> PipelineModel:
    return PipelineModel.load(path)
