import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.operators import histogram_trees, keyed, trees
from roadpulse.schemas import FEATURES


def made(spark, n, seed=0, steps=6):
    draw = np.random.default_rng(seed)
    rows = {}
    for _ in range(n):
        x = (float(draw.integers(0, steps)) / 2, float(draw.integers(0, 4)), float(draw.integers(0, 24)), float(draw.integers(0, 7)))
        label = 1 + int((x[0] > 1) + (x[2] > 11) * (x[3] < 5) + (draw.random() < 0.1))
        key = (int(draw.integers(2, 4)), "TRAFFIC_1", *x, label)
        rows[key] = rows.get(key, 0) + 1
    return spark.createDataFrame(
        [(*k, c) for k, c in rows.items()], "station_id int, target string, temperature double, niederschlag double, hour double, week_day double, label int, n long"
    )


def same(one, other):
    one, other = ({(r.station_id, r.target, r.tree): r for r in df.collect()} for df in (one, other))
    assert set(one) == set(other) and one
    for key, a in one.items():
        b = other[key]
        assert (a.feature, a.threshold, a.lower) == (b.feature, b.threshold, b.lower)
        assert np.allclose(a.share, b.share, atol=1e-6) and np.allclose(a.importance, b.importance, atol=1e-9)


@pytest.mark.parametrize("depth,leaf,split", [(2, 1, 2), (4, 5, 20), (None, 3, 2)])
def test_equal_to_the_exact_tree_where_values_are_bins(spark, depth, leaf, split):
    points = made(spark, 400).repartition(3)
    settings = trees.fixed_settings(points, depth, leaf, split)
    same(histogram_trees.fit(points, settings), trees.fit(points, settings))


def test_bins_are_bounded_and_even(spark):
    draw = np.random.default_rng(1)
    rows = [(2, "T", float(v), 0.0, float(k % 24), 1.0, 1, 1) for k, v in enumerate(draw.normal(0, 10, 5000))]
    points = spark.createDataFrame(rows, "station_id int, target string, temperature double, niederschlag double, hour double, week_day double, label int, n long")
    (edges,) = histogram_trees.bin_edges(points, 32).collect()
    bins = [list(map(tuple, f)) for f in edges.edges]
    assert len(bins[0]) <= 32 and len(bins[1]) == 1 and len(bins[2]) == 24 and bins[2][3] == (3.0, 3.0)
    assert all(a[0] <= a[1] < b[0] <= b[1] for a, b in zip(bins[0], bins[0][1:]))
    values = np.array([r[2] for r in rows])
    weights = [((values >= low) & (values <= high)).sum() for low, high in bins[0]]
    assert sum(weights) == 5000 and max(weights) < 5000 / 32 * 1.5
    placed = histogram_trees.binned(points, histogram_trees.bin_edges(points, 32))
    assert placed.agg(F.sum("n")).first()[0] == 5000


def test_no_task_holds_a_key(spark):
    points = made(spark, 300)
    level = histogram_trees._cut_level(
        histogram_trees.binned(points, histogram_trees.bin_edges(points)).select("*", F.lit(0).alias("tree"), F.lit(0).alias("node")),
        trees.fixed_settings(points, 2), 0, 4, 1,
    )
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Pandas" not in plan and "Python" not in plan


def test_forest(spark):
    points = made(spark, 600, seed=3)
    forest = histogram_trees.fit_forest(points, 4, together=4)
    assert forest.count() == 8 and forest.select("feature").distinct().count() > 4
    asked = points.select(*keyed.KEYS, *FEATURES).distinct()
    guessed = points.join(trees.predict(forest, asked, FEATURES), [*keyed.KEYS, *FEATURES])
    right = guessed.agg(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
    assert right > 0.8


def test_draws_are_poisson(spark):
    n = F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.lit(100))
    drawn = spark.range(20000).select("id", histogram_trees._drawn(n, F.col("id")).alias("d"))
    for rest, mean in ((0, 3), (1, 100)):
        found = drawn.where(F.col("id") % 2 == rest).agg(F.avg("d"), F.var_pop("d"), F.min("d")).first()
        assert abs(found[0] - mean) < 0.05 * mean and abs(found[1] - mean) < 0.1 * mean and found[2] >= 0


def test_empty(spark):
    points = made(spark, 50)
    assert histogram_trees.fit(points.limit(0), trees.fixed_settings(points, 2)).count() == 0


def test_trees_walked_in_the_jvm_decide_alike(spark):
    points = made(spark, 500).repartition(3)
    asked = made(spark, 200, seed=9, steps=9).withColumn("ask", F.monotonically_increasing_id())
    asked = asked.unionByName(asked.limit(3).withColumn("station_id", F.lit(99)))
    bushes = [trees.fit_simple(points), trees.fit_forest(points, 23), trees.fit_simple(points, max_depth=0)]
    for models in bushes:
        got, want = trees.predict_native(models, asked), trees.predict(models, asked.select("station_id", "target", *FEATURES).distinct(), FEATURES)
        rows = [sorted(tuple(r) for r in df.select(*keyed.KEYS, *FEATURES, "predicted").collect()) for df in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 100
    stored = spark.createDataFrame(models.collect(), models.schema)
    plan = trees.predict_native(stored, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
