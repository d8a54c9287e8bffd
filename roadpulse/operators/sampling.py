"""Holdout split and class-balanced resampling. Every draw is a hash of the row, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.hashing import stable_hash
from roadpulse.operators.filters import position_within, range_sizes
from roadpulse.session import by_merge


def holdout(df: DataFrame, seed: int = 101, parts: int = 5) -> DataFrame:
    """`split` is test for one row in `parts`."""
    in_test = stable_hash(f"holdout{seed}", F.col("obs_id")) % parts == 0
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def long_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """One row per target, the target's value as `label`."""
    kept = [c for c in df.columns if c.upper() not in ("TRAFFIC_1", "TRAFFIC_2", "COUNT_1", "COUNT_2")]
    pairs = [piece for t in targets for piece in (F.lit(t), F.col(t.lower()))]
    return df.select(*kept, F.stack(F.lit(len(targets)), *pairs).alias("target", "label"))


def class_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "label").agg(F.count("*").alias("n_rows"))


def balanced_resample(df: DataFrame, keys: list[str], seed: int = 101, width: int = 8192) -> DataFrame:
    """As many draws as rows: a class at random among those present, then one of its rows at random.

    Each row makes one draw, `draw_id`. The draw meets its row on (key, class, position), so a large class
    spreads over as many tasks as it has rows.
    """
    sizes = range_sizes(df, [*keys, "label"], "obs_id", width)
    counted = sizes.groupBy(*keys, "label").agg(F.sum("_size").alias("n_rows"))
    # Four levels at most, so the list of a key is short.
    classes = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "n_rows"))).alias("_classes"))
    # Hashed before the join, in the tasks that read the rows.
    throws = df.select(
        *keys,
        "obs_id",
        stable_hash(f"class{seed}", F.col("target"), F.col("obs_id")).alias("_throw_1"),
        stable_hash(f"row{seed}", F.col("target"), F.col("obs_id")).alias("_throw_2"),
    )
    draws = (
        by_merge(throws).join(classes, keys)
        .withColumn("_class", F.get("_classes", (F.col("_throw_1") % F.size("_classes")).cast("int")))
        .select(
            *keys,
            F.col("obs_id").alias("draw_id"),
            F.col("_class.label").alias("label"),
            (F.col("_throw_2") % F.col("_class.n_rows")).alias("_position"),
        )
    )
    placed = position_within(df, [*keys, "label"], "obs_id", "_position", width, sizes)
    return by_merge(draws).join(placed, [*keys, "label", "_position"]).drop("_position")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with their side; empty when both hold the same rows."""
    right = right.select(*left.columns)
    gone = left.exceptAll(right).withColumn("side", F.lit("left"))
    return gone.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
