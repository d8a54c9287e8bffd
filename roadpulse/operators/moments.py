"""Scalers and encoders kept up to date day by day.

What a fit needs of a day is one small row per key: counts, means, squared deviations, extremes and distinct values. Rows of
several days combine into what a fit over all their readings gives, so a new day is read once and no older day again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.sources.snapshots import path_exists


def daily_moments(df: DataFrame, keys: list[str], numbers: list[str], classes: list[str], ts: str = "ts") -> DataFrame:
    """One row per key and day. A column without any value on a day has n = 0 and neither mean nor extremes there."""
    made: list[Column] = []
    for c in numbers:
        n = F.count(c)
        made += [n.alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * n).alias(f"{c}_m2")]
        made += [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    made += [F.collect_set(c).alias(f"{c}_set") for c in classes]
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n_rows"), *made)


def save_days(moments: DataFrame, path: str) -> None:
    """Put the days that `moments` holds in place of what is stored of them; all other days stay."""
    spread = moments.repartition("day")
    spread.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored days; raises when nothing is stored."""
    if not path_exists(spark, path):
        raise LookupError(f"no moments under {path}")
    return spark.read.parquet(path)


def combine(moments: DataFrame, keys: list[str], numbers: list[str], classes: list[str]) -> DataFrame:
    """Per key what `scaling.fit_zscore`, `fit_minmax` and `fit_onehot` give over all readings of its days.

    Squared deviations add up about the common mean (M2 of a day plus n times the square of the day's distance), so nothing
    cancels. Window and aggregation share one shuffle of one row per key and day.
    """
    whole = Window.partitionBy(*keys)
    means = {c: F.sum(F.col(f"{c}_mean") * F.col(f"{c}_n")).over(whole) / F.nullif(F.sum(f"{c}_n").over(whole), F.lit(0)) for c in numbers}
    centred = moments.withColumns({f"_{c}_mean": mean for c, mean in means.items()})
    made: list[Column] = [F.sum("n_rows").alias("n_rows")]
    for c in numbers:
        apart = F.col(f"{c}_n") * F.pow(F.col(f"{c}_mean") - F.col(f"_{c}_mean"), F.lit(2.0))
        spread = F.sqrt(F.sum(F.col(f"{c}_m2") + apart) / F.nullif(F.sum(f"{c}_n"), F.lit(0)))
        made += [F.first(f"_{c}_mean").alias(f"{c}_mean"), _not_zero(spread).alias(f"{c}_std")]
        made += [F.min(f"{c}_low").alias(f"{c}_low"), F.max(f"{c}_high").alias(f"{c}_high")]
    # Hours and week days: a key's lists hold 24 and 7 values a day at most.
    made += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}_set")))).alias(f"{c}_values") for c in classes]
    return centred.groupBy(*keys).agg(*made)


def _not_zero(spread: Column) -> Column:
    """A constant column scales by 1."""
    return F.when(spread == 0, F.lit(1.0)).otherwise(spread)
