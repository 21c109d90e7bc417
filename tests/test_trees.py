"""The forest as a table: hand-made trees, the library's predictions, what a forest must have learnt."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rideflow.operators import forecast, trees
from rideflow.operators.training import FEATURES

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, rows long"


@pytest.fixture(scope="module")
def planted(spark):
    """Three hundred days; rides follow the warmth and halve on days with rain, some of it unknown."""
    return spark.range(300).select(
        F.expr("date_add(date'2023-01-01', cast(id as int))").alias("date"),
        (F.rand(1) * 30).alias("tempmax"),
        F.rand(2).alias("tempmin"),
        F.lit(50.0).alias("humidity"),
        F.expr("case when id % 11 = 0 then null when id % 4 = 0 then 10.0 else 0.0 end").alias("precip"),
        F.lit(0.0).alias("snow"),
        F.rand(3).alias("windspeed"),
        F.rand(4).alias("windgust"),
    ).withColumn(
        "count", F.expr("cast((100 + 20 * tempmax) * if(precip > 5, 0.5, 1) as long)")
    ).cache()


@pytest.fixture(scope="module")
def model(planted):
    return forecast.fit_forecast(planted, trees=20).model


def _walk(spark, model, days):
    nodes = trees.forest_nodes(spark, model)
    return trees.walk(nodes, trees.days_as_arrays(model, days), trees.deepest(model))


def test_hand_made_trees(spark):
    nodes = spark.createDataFrame(
        [
            (0, 0, 1, 5.0, 1, 2, 0.0, 9),
            (0, 1, None, None, None, None, 10.0, 4),
            (0, 2, 0, 1.0, 3, 4, 0.0, 5),
            (0, 3, None, None, None, None, 20.0, 3),
            (0, 4, None, None, None, None, 30.0, 2),
            (1, 0, None, None, None, None, 7.0, 9),
        ],
        NODES,
    ).repartition(3)
    days = spark.createDataFrame(
        [("low", [0.0, 5.0]), ("edge", [1.0, 5.5]), ("high", [1.5, 6.0])], "date string, x array<double>"
    )
    ways = trees.walk(nodes, days, 2)
    got = {(r.date, r.tree): (r.leaf, r.value, r.rows) for r in ways.collect()}
    assert got == {
        ("low", 0): (1, 10.0, 4),
        ("edge", 0): (3, 20.0, 3),
        ("high", 0): (4, 30.0, 2),
        **{(d, 1): (0, 7.0, 9) for d in ("low", "edge", "high")},
    }
    assert {r.date: r.walked for r in trees.predictions(ways).collect()} == {
        "low": 8.5, "edge": 13.5, "high": 18.5
    }
    (low,) = trees.spread(ways).filter("date = 'low'").collect()
    assert (low.least, low.greatest, low.deviation) == (7.0, 10.0, 1.5)


def test_walk_equals_the_forest(spark, model, planted):
    scored = model.transform(planted).select("date", "prediction")
    walked = trees.predictions(_walk(spark, model, planted))
    pairs = scored.join(walked, "date").collect()
    assert len(pairs) == 300
    assert all(r.walked == r.prediction for r in pairs)


def test_every_way_ends_in_a_leaf(spark, model, planted):
    """Every day ends in a leaf of each tree."""
    ways = _walk(spark, model, planted)
    nodes = trees.forest_nodes(spark, model).filter("feature is null")
    assert ways.count() == 300 * 20
    leaves = nodes.select("tree", F.col("node").alias("leaf"))
    assert ways.join(leaves, ["tree", "leaf"], "left_anti").isEmpty()


def test_nodes_form_trees(spark, model):
    nodes = trees.forest_nodes(spark, model)
    inner = nodes.filter("feature is not null")
    below = inner.select("tree", F.explode(F.array("left", "right")).alias("node"))
    children = nodes.filter("node > 0").select("tree", "node")
    assert below.exceptAll(children).isEmpty() and children.exceptAll(below).isEmpty()
    assert nodes.filter("node = 0").count() == 20


def test_planted_relation_is_found(spark, model):
    nodes = trees.forest_nodes(spark, model)
    used = {r.feature: r.rows for r in trees.feature_use(nodes).collect()}
    assert set(used) <= set(FEATURES)
    assert "humidity" not in used and "snow" not in used
    noise = max(used.get(c, 0) for c in ("tempmin", "windspeed", "windgust"))
    assert used["tempmax"] > noise and used["precip"] > 0
    roots = nodes.filter("node = 0").select("feature").distinct().collect()
    assert {FEATURES[r.feature] for r in roots} <= {"tempmax", "precip"}


def test_a_forest_that_learnt_nothing_shows(spark, planted):
    """All labels at random against the weather, trees of one leaf: no variance explained."""
    stump = forecast.fit_forecast(planted, trees=3, max_depth=0).model
    walked = trees.predictions(_walk(spark, stump, planted))
    known = planted.join(walked, "date").withColumnRenamed("walked", "prediction")
    assert forecast.r_squared(known).first().r2 < 0.5
