"""Work per (station, target): bounded training sets and scoring in bounded portions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from roadpulse.schemas import FEATURES
from roadpulse.session import by_merge

KEYS = ["station_id", "target"]


def over_tasks(df: DataFrame, *columns: str) -> DataFrame:
    """Keyed fits are heavy in time and light in bytes, so their partitions must not be merged by size."""
    spark = df.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *columns)


def exact_points(rows: DataFrame, group: list[str]) -> DataFrame:
    """Equal rows as one point with their number `n` and the sum `total` of `label`.

    `group` names the columns beside keys and features that tell points apart.
    """
    doubles = [F.col(f).cast("double").alias(f) for f in FEATURES]
    return rows.groupBy(*KEYS, *group, *doubles).agg(F.count("*").alias("n"), F.sum("label").cast("double").alias("total"))


def bounded_points(exact: DataFrame, group: list[str], budget: int = 200_000, bins: int = 32) -> DataFrame:
    """Points for fitting, a set per key whose size has a bound.

    Up to `budget` points a key keeps its exact values. Beyond, temperature and rain go to `bins` quantile steps each,
    so a key holds at most 24 x 7 x bins x bins points (172,032 with 32 bins) for each value of the `group` columns, four times
    that with the four levels; every row still counts. The steps come from sketches, which depend on the order in which parts are
    merged: above the budget rerun tasks may cut elsewhere within the sketch's accuracy.
    """
    steps = [(i + 0.5) / bins for i in range(bins)]
    sizes = exact.groupBy(*KEYS).agg(
        F.count("*").alias("points"),
        *[F.array_distinct(F.percentile_approx(c, steps, 1000)).alias(f"{c}_steps") for c in ("temperature", "niederschlag")],
    )
    sized = exact.join(sizes, KEYS)
    for c in ("temperature", "niederschlag"):
        ladder = F.col(f"{c}_steps")
        below = F.size(F.filter(ladder, lambda s: s <= F.col(c)))
        step = F.element_at(ladder, F.greatest(below, F.lit(1)))
        sized = sized.withColumn(c, F.when(F.col("points") > budget, step).otherwise(F.col(c)))
    return sized.groupBy(*KEYS, *group, *FEATURES).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def flat(table: pa.Table, name: str) -> np.ndarray:
    """The elements of a list column, one row after another."""
    return table[name].combine_chunks().flatten().to_numpy()


def in_order(table: pa.Table, by: list[str]) -> pa.Table:
    return table.take(np.lexsort([table[c].to_numpy(zero_copy_only=False) for c in reversed(by)]))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of a list column: the elements up to each end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def _met(models: DataFrame, queries: DataFrame, spread: list[str], rows_per_task: int) -> PandasCogroupedOps:
    """Portions of each key's queries, with a copy of its models each."""
    portions = F.ceil(F.count("*") / F.lit(rows_per_task)).cast("int").alias("_portions")
    sizes = queries.groupBy(*KEYS).agg(portions)
    cut = by_merge(queries).join(sizes, KEYS).withColumn("_portion", F.pmod(F.hash(*spread), F.col("_portions"))).drop("_portions")
    # Only keys of more than one portion, of which there are few: models can be large, and must not be dealt twice.
    several = F.broadcast(sizes.where(F.col("_portions") > 1))
    last = F.coalesce("_portions", F.lit(1)) - 1
    copied = models.dropna(subset=KEYS).join(several, KEYS, "left").withColumn("_portion", F.explode(F.sequence(F.lit(0), last)))
    keys = [*KEYS, "_portion"]
    return over_tasks(cut, *keys).groupBy(*keys).cogroup(over_tasks(copied.drop("_portions"), *keys).groupBy(*keys))


def score(
    models: DataFrame,
    queries: DataFrame,
    function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    spread: list[str],
    rows_per_task: int = 50_000,
) -> DataFrame:
    """`function(models, queries)` for each key. A key with many queries is cut into portions by a hash of `spread`,
    each of which meets a copy of the key's models."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[field.split()[0] for field in schema.split(", ")])
        return function(right, left)

    return _met(models, queries, spread, rows_per_task).applyInPandas(one, schema)


def score_column(
    models: DataFrame,
    queries: DataFrame,
    function: Callable[[pa.Table, pa.Table], np.ndarray],
    result: str,
    carried: list[str],
    spread: list[str],
    rows_per_task: int = 50_000,
) -> DataFrame:
    """As `score`, for a function that gives one value a query: the columns `carried` of `queries` and `result`, a name and type.

    Keys are many and small, so they pass as Arrow tables: turning each into pandas frames took longer than most scores.
    """
    types = dict(queries.dtypes)
    name, kind = result.split()
    arrow = {"int": pa.int32(), "double": pa.float64()}[kind]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        made = function(right, left) if left.num_rows and right.num_rows else []
        return left.slice(0, len(made)).select(carried).append_column(name, pa.array(made, arrow))

    schema = ", ".join([*[f"{c} {types[c]}" for c in carried], result])
    return _met(models, queries, spread, rows_per_task).applyInArrow(one, schema)
