"""Row selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions import calendar


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def null_counts(df: DataFrame) -> DataFrame:
    """One row, one column per input column."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])


def station_sizes(observations: DataFrame) -> DataFrame:
    return observations.groupBy("station_id").agg(F.count("*").alias("n_rows"))


def eligible(observations: DataFrame) -> DataFrame:
    """Rows of the stations that have more than one."""
    usable = station_sizes(observations).where(F.col("n_rows") > 1).select("station_id")
    return observations.join(usable, "station_id", "left_semi")


def with_history(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Stations whose history is usable, with its size."""
    return stations.join(station_sizes(observations).where(F.col("n_rows") > 1), "station_id")


def by_direction(df: DataFrame) -> DataFrame:
    """`_1` and `_2` column pairs to one row per direction."""
    kept = [c for c in df.columns if c not in ("traffic_1", "traffic_2", "count_1", "count_2")]
    return df.select(*kept, F.stack(F.lit(2), F.lit(1), F.col("traffic_1"), F.col("count_1"), F.lit(2), F.col("traffic_2"), F.col("count_2")).alias("direction", "level", "count"))


def facts(history: DataFrame, predictions: DataFrame, today: str) -> DataFrame:
    """History before today and predictions from today on, as one table."""
    cut = calendar.ts_literal(f"{today} 00:00:00")
    past = history.where(F.col("ts") < cut).withColumn("origin", F.lit("history"))
    future = predictions.where(F.col("ts") >= cut).withColumn("origin", F.lit("prediction"))
    return past.unionByName(future)


def facts_at(history: DataFrame, predictions: DataFrame, today: str, instant: str) -> DataFrame:
    """The side of the fact view that holds an instant: history before today, predictions from today on."""
    return history if instant < f"{today} 00:00:00" else predictions


def range_sizes(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Rows of each key per range of `width` order values."""
    return df.groupBy(*keys, F.floor(F.col(order) / width).alias("_range")).agg(F.count("*").alias("_size"))


def position_within(
    df: DataFrame, keys: list[str], order: str, alias: str, width: int, sizes: DataFrame | None = None
) -> DataFrame:
    """0-based position of each row in its key's order of `order`, a whole number unique within the key.

    A key is cut into ranges of `width` order values: rows are ranked inside a range and the ranges' sizes give
    the offset, so no task sorts more than `width` rows of one key, however many it has.
    """
    sizes = range_sizes(df, keys, order, width) if sizes is None else sizes
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        df.withColumn("_range", F.floor(F.col(order) / width))
        .withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_range"])
        .withColumn(alias, (F.col("_before") + F.col("_rank") - 1).cast("bigint"))
        .drop("_range", "_rank", "_before")
    )


def station_index(stations: DataFrame) -> DataFrame:
    """Position of each station in the order of its id."""
    return position_within(stations, [], "station_id", "station_index", width=65_536)
