"""Prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import schemas
from roadpulse.functions import calendar, labels
from roadpulse.session import cut_lineage
from roadpulse.sources.history import resolve
from roadpulse.sources.snapshots import path_exists


def export_columns(predictions: DataFrame) -> DataFrame:
    """The fixed column order of a prediction file, after the keys."""
    ts = F.col("ts")
    return predictions.select(
        "station_id",
        F.col("traffic_1").cast("int").alias("TRAFFIC_1"),
        F.col("traffic_2").cast("int").alias("TRAFFIC_2"),
        F.dayofmonth(ts).alias("DAY"),
        F.month(ts).alias("MONTH"),
        F.year(ts).alias("YEAR"),
        F.hour(ts).alias("HOUR"),
        F.col("count_1").cast("int").alias("COUNT_1"),
        F.col("count_2").cast("int").alias("COUNT_2"),
    )


def write_prediction_files(predictions: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per station code, rows in time order; only the stations at hand are replaced."""
    out = export_columns(predictions).withColumn("station_code", labels.station_code(F.col("station_id")))
    (
        out.drop("station_id")
        .repartition("station_code")
        .sortWithinPartitions("station_code", "YEAR", "MONTH", "DAY", "HOUR")
        .write.mode("overwrite")
        .option("header", True)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("station_code")
        .format(fmt)
        .save(path)
    )


def read_prediction_files(
    spark: SparkSession, path: str, fmt: str = "csv", container: str | None = None, account: str | None = None
) -> DataFrame:
    """Station folders, or flat `<code>.csv` and `<code>_predictions.csv` files; the code comes from the path."""
    reader = spark.read.schema(schemas.PREDICTIONS).option("header", True).option("recursiveFileLookup", True)
    raw = reader.option("pathGlobFilter", f"*.{fmt}").format(fmt).load(resolve(path, container, account))
    file = F.col("_metadata.file_path")
    code = F.coalesce(
        F.nullif(F.regexp_extract(file, r"station_code=(\d+)", 1), F.lit("")),
        F.regexp_extract(file, r"(\d+)(?:_predictions)?\.\w+$", 1),
    )
    day = F.make_date("YEAR", "MONTH", "DAY")
    return raw.select(
        code.try_cast("int").alias("station_id"),
        calendar.instant(day, F.col("HOUR")).alias("ts"),
        F.col("TRAFFIC_1").alias("traffic_1"),
        F.col("TRAFFIC_2").alias("traffic_2"),
        F.col("COUNT_1").alias("count_1"),
        F.col("COUNT_2").alias("count_2"),
    )


def write_prediction_table(predictions: DataFrame, path: str) -> None:
    """Parquet by zone and day: few large files however many stations. A refreshed station-day replaces itself, and the
    other stations of its zone and day stay.

    Only the zones and days at hand are read back and written again; Spark swaps them when the job commits.
    """
    spark = predictions.sparkSession
    rows = predictions.withColumn("day", F.to_date("ts"))
    if path_exists(spark, path):
        rows = cut_lineage(rows)
        held = spark.read.parquet(path)
        touched, renewed = rows.select("weather_index", "day").distinct(), rows.select("station_id", "weather_index", "day").distinct()
        kept = held.join(touched, ["weather_index", "day"], "left_semi").join(renewed, ["station_id", "weather_index", "day"], "left_anti")
        # Written aside first: a table is not read while it is replaced.
        rows = cut_lineage(rows.unionByName(kept, allowMissingColumns=True))
    (
        rows.repartition("weather_index", "day", F.pmod(F.hash("station_id"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("weather_index", "day")
        .parquet(path)
    )
