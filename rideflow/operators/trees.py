"""The fitted forest as a table, and predictions made from that table.

A node is a row of ``tree``, ``node`` (0 is the root), ``feature`` (its index, null in a leaf),
``threshold``, ``left``, ``right``, ``value`` and ``rows`` (training rows that reached it). A day goes
left where its feature is at most the threshold. The table explains a forecast without the library
that fitted it, and checks that library's predictions.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rideflow.operators.training import FEATURES
from rideflow.session import scratch_path


def forest_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Every node of every tree, read from the forest as it is stored."""
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    node = F.col("nodeData")
    split = node["split"]
    inner = node["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        node["prediction"].alias("value"),
        node["rawCount"].alias("rows"),
    )


def deepest(model: PipelineModel) -> int:
    return max(tree.depth for tree in model.stages[-1].trees)


def days_as_arrays(model: PipelineModel, days: DataFrame, key: str = "date") -> DataFrame:
    """``key`` and ``x``, the features in the forest's order with missing ones filled."""
    filled = PipelineModel(model.stages[:-1]).transform(days.select(key, *FEATURES))
    return filled.select(key, vector_to_array("features").alias("x"))


def _leaf(nodes: Column, x: Column, depth: int) -> Column:
    """Number of the leaf ``x`` ends in; ``nodes`` are a tree's, by number."""

    def step(at: Column, _: Column) -> Column:
        here = F.get(nodes, at)
        goes_left = F.get(x, here["feature"]) <= here["threshold"]
        return (
            F.when(here["feature"].isNull(), at)
            .when(goes_left, here["left"])
            .otherwise(here["right"])
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step)


def walk(nodes: DataFrame, days: DataFrame, depth: int, key: str = "date") -> DataFrame:
    """A row per day and tree: the leaf the day ends in, its value and training rows.

    ``days`` are rows of ``key`` and the array ``x``; no tree is deeper than ``depth``. A tree is one
    row, an array of at most two nodes for each training day, so all steps down it are taken within
    one join; that the days meet all trees is what a forest is.
    """
    fields = ("node", "feature", "threshold", "left", "right", "value", "rows")
    trees = nodes.groupBy("tree").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes")
    )
    last = nodes.agg(F.max("tree")).scalar()
    each = days.withColumn("tree", F.explode(F.sequence(F.lit(0), last)))
    end = F.get("nodes", _leaf(F.col("nodes"), F.col("x"), depth))
    return each.join(trees, "tree").select(key, "tree", end.alias("end")).select(
        key, "tree", F.col("end.node").alias("leaf"), "end.value", "end.rows"
    )


def predictions(walked: DataFrame, key: str = "date") -> DataFrame:
    """The mean over the trees, added up in their order as the forest itself does."""
    ends = F.array_sort(F.collect_list(F.struct("tree", "value")))
    total = F.aggregate(ends, F.lit(0.0), lambda sum_, e: sum_ + e["value"])
    return walked.groupBy(key).agg((total / F.count("*")).alias("walked"))


def spread(walked: DataFrame, key: str = "date") -> DataFrame:
    """How far the trees are apart on a day: the least, the greatest and the deviation."""
    return walked.groupBy(key).agg(
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.stddev_pop("value").alias("deviation"),
    )


def feature_use(nodes: DataFrame) -> DataFrame:
    """Splits by feature, and the training rows they parted."""
    names = F.array(*[F.lit(c) for c in FEATURES])
    return (
        nodes.filter(F.col("feature").isNotNull())
        .groupBy(F.get(names, F.col("feature")).alias("feature"))
        .agg(F.count("*").alias("splits"), F.sum("rows").alias("rows"))
    )
