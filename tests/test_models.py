from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadpulse.operators import ensemble, keyed, neighbours, neural, trees
from roadpulse.operators.keyed import KEYS
from roadpulse.schemas import FEATURES

ROWS = "station_id int, target string, temperature double, niederschlag double, hour int, week_day int, label int"


def _rows(n, rule, seed=0, station=2, target="TRAFFIC_1", coarse=False):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        warm = float(draw.integers(-5, 6)) if coarse else round(float(draw.normal(10, 8)), 1)
        wet = float(draw.integers(0, 2)) if coarse else round(float(draw.exponential(1)), 1)
        hour, day = int(draw.integers(0, 24)), int(draw.integers(0, 7))
        out.append((station, target, warm, wet, hour, day, rule(warm, wet, hour, day, draw)))
    return out


def _noise(*args):
    return int(args[-1].integers(1, 5))


def _by_hour(warm, wet, hour, day, draw):
    return 1 + hour // 6


def _points(spark, rows, **options):
    return keyed.bounded_points(keyed.exact_points(spark.createDataFrame(rows, ROWS), ["label"]), ["label"], **options)


def _brute_neighbours(train, queries, k):
    x = np.array([r[2:6] for r in train], dtype=float)
    label = np.array([r[6] for r in train])
    result = {}
    for q in queries:
        square = ((x - np.array(q[2:6], dtype=float)) ** 2).sum(axis=1)
        order = np.lexsort((label, square))[:k]
        votes = []
        for size in range(1, k + 1):
            counts = np.bincount(label[order[:size]], minlength=5)
            votes.append(int(counts.argmax()))
        result[tuple(float(v) for v in q[2:6])] = votes
    return result


@pytest.mark.parametrize("n, coarse, k", [(400, False, 4), (400, True, 4), (3, False, 4), (60, True, 7)])
def test_neighbours_against_brute_force(spark, n, coarse, k):
    train, asked = _rows(n, _noise, 1, coarse=coarse), _rows(80, _noise, 2, coarse=coarse)
    far = [(2, "TRAFFIC_1", 90000.0, -70000.0, 0, 0, 1), (2, "TRAFFIC_1", -300.0, 0.0, 23, 6, 1)]
    points = keyed.exact_points(spark.createDataFrame(train, ROWS), ["label"])
    queries = keyed.exact_points(spark.createDataFrame(asked + far, ROWS), [])
    got = {tuple(r[f] for f in FEATURES): [r[f"predicted_{i}"] for i in range(1, k + 1)] for r in neighbours.predict(points, queries, KEYS, k).collect()}
    assert got == _brute_neighbours(train, asked + far, k)


def test_neighbours_keep_keys_apart(spark):
    train = _rows(50, lambda *a: 1) + _rows(50, lambda *a: 3, station=5)
    points = keyed.exact_points(spark.createDataFrame(train, ROWS), ["label"])
    got = neighbours.predict(points, points.select(*KEYS, *FEATURES).distinct(), KEYS, 2)
    assert {(r.station_id, r.predicted_2) for r in got.collect()} == {(2, 1), (5, 3)}


def _gini(label):
    share = np.bincount(label, minlength=5) / len(label)
    return len(label) * (1 - (share**2).sum())


def _brute_tree(x, label, depth, min_leaf, min_split):
    """Plain recursive search, as nested tuples."""
    counts = np.bincount(label, minlength=5)
    if depth == 0 or len(label) < min_split or counts.max() == len(label):
        return int(counts.argmax())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < min_leaf:
                continue
            cost = round(_gini(label[low]) + _gini(label[~low]), 9)
            if best is None or cost < best[0]:
                best = (cost, f, cut)
    if best is None:
        return int(counts.argmax())
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], *[_brute_tree(x[side], label[side], depth - 1, min_leaf, min_split) for side in (low, ~low)])


def _follow(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth, leaf, split", [(2, 1, 2), (4, 10, 2), (None, 5, 40), (3, 1, 100), (None, 1, 2)])
def test_tree_against_brute_force(spark, depth, leaf, split):
    rows = _rows(250, lambda w, r, h, d, g: 1 + (h // 8 + (w > 10)) % 4 if g.random() < 0.8 else _noise(g), 3)
    points = _points(spark, rows)
    model = trees.fit(points, trees.fixed_settings(points, depth, leaf, split))
    x, label = np.array([r[2:6] for r in rows], dtype=float), np.array([r[6] for r in rows])
    expected = _brute_tree(x, label, 99 if depth is None else depth, leaf, split)
    got = trees.predict(model, points.select(*KEYS, *FEATURES).distinct(), FEATURES).collect()
    agree = [r.predicted == _follow(expected, [r[f] for f in FEATURES]) for r in got]
    # Cuts of equal worth may be rounded apart by the brute force; elsewhere the trees are the same.
    assert np.mean(agree) > 0.97


def test_constant_label_and_single_row(spark):
    points = _points(spark, _rows(30, lambda *a: 3) + _rows(1, lambda *a: 2, station=7))
    model = trees.fit_simple(points)
    assert {r.station_id: len(r.feature) for r in model.collect()} == {2: 1, 7: 1}
    got = trees.predict(model, points.select(*KEYS, *FEATURES).distinct(), FEATURES)
    assert {(r.station_id, r.predicted) for r in got.collect()} == {(2, 3), (7, 2)}
    assert all(r.importance == 0 for r in trees.importances(model).collect())
    assert neighbours.predict(points.drop("total"), points.select(*KEYS, *FEATURES), KEYS, 2).count() == 31


def test_search_reads_limited_trees_off_the_full_one(spark):
    rows = _rows(300, lambda w, r, h, d, g: _by_hour(w, r, h, d, g) if g.random() < 0.7 else _noise(g), 4)
    points = _points(spark, rows)
    grid = {"max_depth": [None, 2], "min_leaf": [1, 20], "min_split": [2, 50]}
    scores = {(r.max_depth, r.min_leaf, r.min_split): r.accuracy for r in trees.search(points, grid=grid).collect()}
    assert len(scores) == 8
    fold = (trees.stable_hash("fold101", *[F.col(f) for f in FEATURES]) % 3).cast("int")
    folded = points.withColumn("fold", fold)
    for depth, leaf, split in product(*grid.values()):
        rates = []
        for held in range(3):
            inside, outside = folded.where(F.col("fold") != held).drop("fold"), folded.where(F.col("fold") == held)
            model = trees.fit(inside, trees.fixed_settings(inside, depth, leaf, split))
            guess = outside.join(trees.predict(model, outside, FEATURES), [*KEYS, *FEATURES])
            rates.append(guess.agg(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0])
        assert scores[depth, leaf, split] == pytest.approx(np.mean(rates)), (depth, leaf, split)
    assert trees.search(points, grid=grid, sample=3).count() == 3


def test_planted_signal_is_learnt(spark):
    train, test = _points(spark, _rows(500, _by_hour, 5)), _points(spark, _rows(200, _by_hour, 6))
    queries = test.select(*KEYS, *FEATURES).distinct()
    for model in (trees.fit_optimised(train), trees.fit_forest(train, n_trees=40)):
        hits = test.join(trees.predict(model, queries, FEATURES), [*KEYS, *FEATURES])
        assert hits.where("label = predicted").count() / hits.count() > 0.95
    importance = {r.feature: r.importance for r in trees.importances(trees.fit_optimised(train)).collect()}
    assert importance["hour"] > 0.9 and sum(importance.values()) == pytest.approx(1, abs=1e-4)


def test_forest_does_not_depend_on_the_partitioning(spark):
    points = _points(spark, _rows(150, _noise, 7))
    first, again = (trees.fit_forest(points.repartition(p), n_trees=9, blocks=3).orderBy("tree").collect() for p in (1, 7))
    assert first == again and [r.tree for r in first] == list(range(9))


def test_points_of_a_crowded_key_stay_bounded(spark):
    rows = _rows(3000, _by_hour, 8) + _rows(50, _by_hour, 9, station=5)
    points = _points(spark, rows, budget=400, bins=4)
    crowded = points.where("station_id = 2")
    assert crowded.agg(F.sum("n")).first()[0] == 3000
    assert crowded.select("temperature").distinct().count() <= 4 and crowded.select("niederschlag").distinct().count() <= 4
    exact = points.where("station_id = 5").select(*FEATURES).distinct().count()
    assert exact == len({r[2:6] for r in rows if r[0] == 5})


def test_scoring_in_portions(spark):
    points = _points(spark, _rows(300, _by_hour, 10))
    model, queries = trees.fit_simple(points), points.select(*KEYS, *FEATURES).distinct()
    whole = trees.predict(model, queries, FEATURES)

    def same(models, rows):
        return rows[[*KEYS, *FEATURES]].assign(size=len(rows))

    schema = "station_id int, target string, temperature double, niederschlag double, hour double, week_day double, size int"
    cut = keyed.score(model, queries, same, schema, FEATURES, rows_per_task=20)
    assert cut.count() == whole.count() and cut.agg(F.max("size")).first()[0] < 60


def test_gradient():
    draw = np.random.default_rng(1)
    x, y, weight = draw.normal(size=(7, 3)), draw.normal(size=7), draw.integers(1, 4, 7).astype(float)
    flat = draw.normal(0, 0.3, sum(int(np.prod(s)) for s in neural._shapes(3)))
    slope = neural._gradient(neural._unpack(flat, 3), x, y, weight)
    for i in draw.integers(0, len(flat), 25):
        moved = [flat.copy(), flat.copy()]
        moved[0][i] += 1e-5
        moved[1][i] -= 1e-5
        up, down = (neural._loss(neural._unpack(m, 3), x, y, weight) for m in moved)
        assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_network_learns(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(600):
        hour = int(draw.integers(0, 24))
        x = [float(hour == h) for h in range(24)] + [float(draw.normal())]
        rows.append((2, "COUNT_1", "test" if i % 5 == 0 else "train", x, hour / 23, 1, x[-1], 0.0, float(hour), 0.0))
    features = ", ".join(f"{f} double" for f in FEATURES)
    points = spark.createDataFrame(rows, f"station_id int, target string, split string, x array<double>, y double, n long, {features}")
    model = neural.fit(points).first()
    assert len(model.loss) == 10 and len(model.test_loss) == 10
    variance = np.var([r[4] for r in rows])
    assert model.test_loss[-1] < variance / 10 and model.loss[-1] < model.loss[0]
    out = neural.predict_scaled(neural.fit(points), points.withColumn("id", F.monotonically_increasing_id()), ["id"])
    assert out.count() == 600


def test_ensemble_order(spark):
    frames = {name: spark.createDataFrame([(1, v)], "id int, predicted int") for name, v in (("tree", 4), ("forest", 2), ("neighbours", 1))}
    side = ensemble.aligned(frames, ["id"])
    assert ensemble.vote(side, ensemble.TRAINING_ORDER).first().ensemble == 4
    assert ensemble.vote(side, ensemble.SCORING_ORDER).first().ensemble == 2


def test_crowded_points_lie_in_small_leaves(spark):
    """100,000 points within 1/64 of each other, and a key of equal values: no leaf holds more than its bound."""
    draw = np.random.default_rng(11)
    close = draw.random((100_000, 2)) / 64
    rows = [(2, "TRAFFIC_1", float(a), float(b), 3.0, 1.0, 1 + i % 4, 1) for i, (a, b) in enumerate(close)]
    rows += [(5, "TRAFFIC_1", 1.0, 0.0, 3.0, 1.0, label, 5000) for label in (1, 2, 3)]
    schema = "station_id int, target string, temperature double, niederschlag double, hour double, week_day double, label int, n long"
    train = spark.createDataFrame(pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]), schema)
    tree = neighbours.partition(train, KEYS)
    sizes = tree.points.groupBy(*KEYS, "leaf").count()
    assert sizes.agg(F.max("count")).first()[0] <= neighbours.LEAF and tree.points.count() == len(rows)
    assert tree.nodes.agg(F.max(F.size("children"))).first()[0] <= neighbours.PARTS and 2 <= tree.depth <= 3
    asked = [(2, "TRAFFIC_1", *q, 3.0, 1.0) for q in [(0.001, 0.002), (0.015, 0.0), (3.0, -1.0), (0.008, 0.008)]] + [(5, "TRAFFIC_1", 0.0, 0.0, 0.0, 0.0)]
    queries = spark.createDataFrame(asked, schema.partition(", label")[0])
    got = {}
    for r in neighbours.nearest(train, queries, KEYS, 3).collect():
        got.setdefault((r.station_id, r.temperature, r.niederschlag), []).append((r.square, r.label))
    for s, _, a, b, *_ in asked[:-1]:
        square = (close[:, 0] - a) ** 2 + (close[:, 1] - b) ** 2
        best = sorted((square[i], 1 + i % 4) for i in np.argsort(square)[:3])
        assert [label for _, label in sorted(got[s, a, b])] == [label for _, label in best]
        assert np.allclose([v for v, _ in sorted(got[s, a, b])], [v for v, _ in best])
    assert got[5, 0.0, 0.0] == [(1 + 9 + 1, 1)]


def _grown_plainly(x, label, weights, min_leaf):
    """One tree by plain recursion over all cuts: `(feature, threshold)` of its inner nodes, level by level."""
    level, found = [np.flatnonzero(weights)], []
    while level:
        below = []
        for rows in level:
            counts = np.bincount(label[rows], weights[rows], 4)
            n, best = counts.sum(), None
            if counts.max() < n and n >= 2 * min_leaf:
                for f in range(x.shape[1]):
                    values = np.unique(x[rows, f])
                    for low, high in zip(values[:-1], values[1:]):
                        left = np.bincount(label[rows], weights[rows] * (x[rows, f] <= low), 4)
                        right = counts - left
                        if min(left.sum(), right.sum()) >= min_leaf:
                            purity = (left**2).sum() / left.sum() + (right**2).sum() / right.sum()
                            if best is None or purity > best[0]:
                                best = (purity, f, (low + high) / 2)
            if best is not None:
                found.append(best[1:])
                above = x[rows, best[1]] > best[2]
                below += [rows[~above], rows[above]]
        level = below
    return found


@pytest.mark.parametrize("times", [1, 1_000, 100_000, 5_000_000_000])
def test_packed_counts_of_any_size(times):
    """Class counts share words as long as they fit; larger ones get more words, with the same trees."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 60), rng.integers(0, 3, 60), rng.integers(0, 24, 60), rng.integers(0, 7, 60)]).astype(float)
    label, weights = rng.integers(0, 4, 60), rng.integers(0, 5, (3, 60)) * times
    for leaf in (1, 4 * times):
        nodes, _ = trees._grow(x, label, weights, np.full(3, leaf))
        for t in range(3):
            mine = (nodes["tree"] == t) & (nodes["feature"] >= 0)
            assert list(zip(nodes["feature"][mine].tolist(), nodes["threshold"][mine].tolist())) == _grown_plainly(x, label, weights[t], leaf)


def test_search_alike_by_key_and_by_fold(spark):
    """With many keys a key's folds are searched in one group, with few in one each: the scores are the same."""
    rng = np.random.default_rng(7)
    keys = 3 * spark.sparkContext.defaultParallelism
    rows = [(k, "TRAFFIC_1", float(rng.integers(0, 9)), 0.0, float(rng.integers(0, 24)), float(rng.integers(0, 7)), int(rng.integers(1, 5)), 1, 1.0) for k in range(keys) for _ in range(12)]
    rows = list({(r[0], *r[2:6]): r for r in rows}.values())
    points = spark.createDataFrame(rows, "station_id int, target string, temperature double, niederschlag double, hour double, week_day double, label int, n long, total double")
    wanted = {tuple(r) for r in trees.search(points.where("station_id < 2")).collect()}
    assert wanted == {tuple(r) for r in trees.search(points).where("station_id < 2").collect()}
    assert len(wanted) == 2 * 256


def test_rows_are_joined_by_shuffling(spark):
    """A table whose rows follow the input's is small on disk, and must not go through the driver all the same."""
    points = spark.range(1000).selectExpr("cast(id % 7 as int) station_id", "'TRAFFIC_1' target", *[f"cast(id % {m} as double) {f}" for m, f in zip((97, 13, 24, 7), FEATURES)]).distinct()
    labelled = points.selectExpr("*", "1 label", "1L n")
    models = spark.range(7).selectExpr("cast(id as int) station_id", "'TRAFFIC_1' target")
    scored = keyed.score(models, points, lambda a, b: b[["station_id"]], "station_id int", FEATURES)
    for made in (neighbours.nearest(labelled, points, KEYS, 3), scored):
        plan = made._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert any("SortMergeJoin" in line for line in joins)
    assert "BroadcastHashJoin" not in neighbours.nearest(labelled, points, KEYS, 3)._jdf.queryExecution().executedPlan().toString()


def test_groups_pass_as_arrow_tables(spark, capsys):
    """A key is small: turning its group into a pandas frame took longer than growing a tree or walking it."""
    points = _points(spark, _rows(60, _by_hour, 10))
    queries = points.select(*KEYS, *FEATURES).distinct()
    model = trees.fit_simple(points)
    for made in (model, trees.search(points), trees.predict(model, queries, FEATURES)):
        made.explain()
        plan = capsys.readouterr().out
        assert "GroupsInArrow" in plan and "GroupsInPandas" not in plan


def test_score_column_in_portions(spark):
    points = _points(spark, _rows(100, _by_hour, 10))
    model, queries = trees.fit_simple(points), points.select(*KEYS, *FEATURES).distinct()
    other = queries.withColumn("station_id", F.col("station_id") + 1000)
    cut = keyed.score_column(model, queries.unionByName(other), lambda m, q: [q.num_rows] * q.num_rows, "size int", [*KEYS, *FEATURES], FEATURES, rows_per_task=20)
    rows = cut.collect()
    assert len(rows) == queries.count() and max(r["size"] for r in rows) < 60  # a key without a model has no rows


def test_a_tree_is_the_same_whichever_are_grown_with_it(spark):
    """How many keys there are and how large they are decides which trees are grown together, never what they are."""
    points = _points(spark, _rows(150, _noise, 7))
    settings = trees.fixed_settings(points, None)
    made = [trees.fit(points, settings, 12, True, 2, blocks=blocks, cells=cells).orderBy("tree").collect() for blocks, cells in ((1, 2_000_000), (3, 2_000_000), (1, 700))]
    assert made[0] == made[1] == made[2] and len(made[0]) == 12
    other = points.unionByName(points.withColumn("station_id", F.explode(F.sequence(F.lit(100), F.lit(130)))))
    assert trees.fit_forest(points, 40).orderBy("tree").collect() == trees.fit_forest(other, 40).where("station_id = 2").orderBy("tree").collect()


def test_a_search_does_not_depend_on_what_is_grown_together(spark):
    points = _points(spark, _rows(120, _noise, 3))
    assert {tuple(r) for r in trees.search(points).collect()} == {tuple(r) for r in trees.search(points, cells=500).collect()}


def test_models_are_dealt_to_their_queries_once(spark):
    """A forest is larger than its queries: only what few keys of several portions need is joined to it, and without a shuffle."""
    points = _points(spark, _rows(100, _by_hour, 10))
    queries = points.select(*KEYS, *FEATURES).distinct()
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    model = spark.createDataFrame(trees.fit_simple(points).collect(), trees.MODEL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trees.predict(model, queries, FEATURES)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        lost = model.unionByName(model.withColumn("station_id", F.lit(None).cast("int")))
        asked = queries.unionByName(queries.withColumn("station_id", F.lit(None).cast("int")))
        assert trees.predict(lost, asked, FEATURES).count() == queries.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forest_metrics_writes_no_trees(spark, sf, monkeypatch):
    from roadpulse.plans import queries

    written, cut = [], queries.cut_lineage
    monkeypatch.setattr(queries, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    queries.QUERIES["forest_metrics"](spark, sf)
    assert written and not any("threshold" in columns for columns in written)
