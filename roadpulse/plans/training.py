"""Training of all models of all stations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators import ensemble, filters, keyed, metrics, neighbours, neural, sampling, scaling, trees
from roadpulse.operators.keyed import KEYS
from roadpulse.schemas import COUNT_TARGETS, FEATURES, LEVEL_TARGETS
from roadpulse.session import by_merge, cut_lineage


@dataclass(frozen=True)
class Settings:
    seed: int = 101
    n_trees: int = 200
    neighbours: int = 4
    epochs: int = 10
    budget: int = 200_000
    """Distinct points of a key up to which `tree_points` keeps exact values. Training does not go by it: all its models are
    fitted on exact points, whatever the key's size."""
    split_first: bool = True
    """False resamples before the split, as older runs did: copies of a row then sit on both sides."""


@dataclass(frozen=True)
class Trained:
    """Model tables by name, keyed by station and target, and the scores."""

    models: dict[str, DataFrame]
    metrics: DataFrame


def observed(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Usable rows of the known stations that have more than one row; rows with gaps are left out of training."""
    known = observations.join(stations.select("station_id"), "station_id", "left_semi")
    return filters.complete_rows(filters.eligible(known))


def level_samples(rows: DataFrame, settings: Settings) -> DataFrame:
    """Balanced train and test rows `(keys, split, features, label)` of the two level targets."""
    narrow = rows.select("station_id", "obs_id", *FEATURES, "traffic_1", "traffic_2")
    if settings.split_first:
        split = sampling.holdout(sampling.long_targets(narrow, LEVEL_TARGETS), settings.seed)
        drawn = sampling.balanced_resample(split, [*KEYS, "split"], settings.seed)
    else:
        drawn = sampling.balanced_resample(sampling.long_targets(narrow, LEVEL_TARGETS), KEYS, settings.seed)
        drawn = sampling.holdout(drawn.drop("obs_id").withColumnRenamed("draw_id", "obs_id"), settings.seed)
    return drawn.select(*KEYS, "split", *FEATURES, "label")


def level_points(rows: DataFrame, settings: Settings) -> DataFrame:
    return keyed.exact_points(level_samples(rows, settings), ["split", "label"])


def tree_points(points: DataFrame, settings: Settings) -> DataFrame:
    """Train points of a bounded number a key, see Settings.budget."""
    return keyed.bounded_points(points.where(F.col("split") == "train"), ["label"], settings.budget)


def train_points(points: DataFrame) -> DataFrame:
    """What the trees of training are fitted on: all train points. The calendar bounds them, as a station has one row per hour."""
    return points.where(F.col("split") == "train").select(*KEYS, *FEATURES, "label", "n")


def train_levels(points: DataFrame, settings: Settings) -> Trained:
    """Optimised tree, forest and neighbours, with the accuracies of these, of the simple tree and of the vote, and what
    each feature adds to the trees; `points` are used many times and should be written before."""
    queries = points.select(*KEYS, *FEATURES).distinct()
    memory = train_points(points)
    best = cut_lineage(trees.best_settings(trees.search(memory, settings.seed)).select(*KEYS, "max_depth", "min_leaf", "min_split"))
    simple, tree = cut_lineage(trees.fit_simple(memory)), cut_lineage(trees.fit(memory, best))
    forest = cut_lineage(trees.fit_forest(memory, settings.n_trees, settings.seed))
    voted = cut_lineage(neighbours.predict(memory, queries, KEYS, settings.neighbours))
    near = best_neighbours(points, voted, settings.neighbours)
    chosen = chosen_neighbours(voted, near, settings.neighbours)
    on = [*KEYS, *FEATURES]
    predictions = {
        "simple_tree": trees.predict(simple, queries, FEATURES),
        "tree": trees.predict(tree, queries, FEATURES),
        "forest": trees.predict(forest, queries, FEATURES),
        "neighbours": chosen,
    }
    voted_all = ensemble.vote(ensemble.aligned(predictions, on), ensemble.TRAINING_ORDER)
    scored = by_merge(points).join(voted_all, on)
    models = ["simple_tree", *ensemble.TRAINING_ORDER, "ensemble"]
    pairs = [piece for name in models for piece in (F.lit(name), F.col(name))]
    long = scored.select(*KEYS, "split", "label", "n", F.stack(F.lit(len(models)), *pairs).alias("model", "predicted"))
    accuracies = metrics.accuracy(long, [*KEYS, "model", "split"], weight="n")
    report = accuracies.select(*KEYS, "model", "split", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    for name, model in (("simple_tree", simple), ("tree", tree), ("forest", forest)):
        shares = trees.importances(model)
        named = F.concat(F.lit("importance of "), F.col("feature"))
        report = report.unionByName(shares.select(*KEYS, F.lit(name).alias("model"), F.lit("train").alias("split"), named.alias("metric"), F.col("importance").alias("value")))
    kept = {"tree": tree, "forest": forest, "neighbours": by_merge(memory).join(near.select(*KEYS, "k"), KEYS)}
    return Trained(kept, report)


def best_neighbours(points: DataFrame, voted: DataFrame, k: int) -> DataFrame:
    """The k of each key with the best test accuracy, the smallest among equals, and its train accuracy."""
    pairs = [piece for size in range(1, k + 1) for piece in (F.lit(size), F.col(f"predicted_{size}"))]
    long = by_merge(points).join(voted, [*KEYS, *FEATURES]).select(
        *KEYS, "split", "label", "n", F.stack(F.lit(k), *pairs).alias("k", "predicted")
    )
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = []
    for side in ("train", "test"):
        here = F.col("split") == side
        share = F.try_divide(F.sum(F.when(here, hit)), F.sum(F.when(here, F.col("n"))))
        sides.append(share.alias(f"{side}_accuracy"))
    rates = long.groupBy(*KEYS, "k").agg(*sides)
    # Ranked as they are, rounded for display.
    best = metrics.best_of(rates, KEYS, "test_accuracy", ["k"])
    return best.withColumns({c: F.bround(c, 3) for c in ("train_accuracy", "test_accuracy")})


def chosen_neighbours(voted: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Each key's prediction with its own k."""
    options = F.array(*[F.col(f"predicted_{size}") for size in range(1, k + 1)])
    return by_merge(voted).join(best.select(*KEYS, "k"), KEYS).withColumn("predicted", F.get(options, F.col("k") - 1))


def count_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    narrow = rows.select("station_id", "obs_id", *FEATURES, "count_1", "count_2")
    return sampling.holdout(sampling.long_targets(narrow, COUNT_TARGETS), settings.seed)


def count_scalers(long: DataFrame) -> DataFrame:
    return scaling.fit_features(long, KEYS).join(scaling.fit_minmax(long, KEYS, "label"), KEYS)


def network_points(points: DataFrame, scalers: DataFrame) -> DataFrame:
    """`(keys, split, features, x, y, n)`: input vector and mean scaled count of each point."""
    return points.join(scalers, KEYS).select(
        *KEYS,
        "split",
        *FEATURES,
        scaling.feature_vector().alias("x"),
        scaling.minmax(F.col("total") / F.col("n")).alias("y"),
        "n",
    )


def fit_network(exact: DataFrame, scalers: DataFrame, settings: Settings) -> DataFrame:
    """Fitted on the exact points: the calendar bounds them, as a station has one row per hour."""
    return neural.fit(network_points(exact, scalers), settings.epochs, seed=settings.seed)


def network_losses(scored: DataFrame) -> DataFrame:
    """Mean squared error over the rows themselves, on the scaled counts: `(keys, split, loss)`.

    `scored` has the key's scalers, a row's count as `label`, the number of equal rows `n` and the output `scaled`.
    """
    loss = metrics.mean_squared_error(scored.withColumn("wanted", scaling.minmax(F.col("label"))), [*KEYS, "split"], "wanted", "scaled", weight="n")
    return loss.withColumnRenamed("mean_squared_error", "loss")


def network_output(network: DataFrame, exact: DataFrame, scalers: DataFrame) -> DataFrame:
    """Scaled output for each distinct feature row, with the key's scalers."""
    asked = network_points(exact, scalers).select(*KEYS, *FEATURES, "x").dropDuplicates([*KEYS, *FEATURES])
    return neural.predict_scaled(network, asked, FEATURES).join(scalers, KEYS)


def train_counts(rows: DataFrame, settings: Settings) -> Trained:
    long = count_rows(rows, settings)
    scalers = cut_lineage(count_scalers(long))
    cases = cut_lineage(keyed.exact_points(long, ["split", "label"]))
    exact = cases.groupBy(*KEYS, "split", *FEATURES).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    network = cut_lineage(fit_network(exact, scalers, settings))
    guessed = network_output(network, exact, scalers)
    scored = by_merge(cases).join(guessed, [*KEYS, *FEATURES])
    scored = scored.withColumn("vehicles", scaling.undo_minmax(F.col("scaled")))
    error = metrics.mean_percentage_error(scored, [*KEYS, "split"], "label", "vehicles", weight="n")
    report = error.select(
        *KEYS, F.lit("network").alias("model"), "split",
        F.lit("percentage_error").alias("metric"), F.col("mean_percentage_error").alias("value"),
    )
    losses = network_losses(scored).select(
        *KEYS, F.lit("network").alias("model"), "split", F.lit("loss").alias("metric"), F.col("loss").alias("value")
    )
    return Trained({"network": network, "scalers": scalers}, report.unionByName(losses))


def train(observations: DataFrame, stations: DataFrame, settings: Settings = Settings()) -> Trained:
    """Classifiers and regressors of every station with usable history."""
    rows = cut_lineage(observed(observations, stations))
    levels = train_levels(cut_lineage(level_points(rows, settings)), settings)
    counts = train_counts(rows, settings)
    return Trained({**levels.models, **counts.models}, levels.metrics.unionByName(counts.metrics))
