"""Station history and station metadata on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import schemas
from roadpulse.functions import calendar


def resolve(path: str, container: str | None = None, account: str | None = None) -> str:
    """A plain path or URI as it is; a blob container and account become an abfss URI for the same reader."""
    if container is None:
        return path
    if not account:
        raise ValueError("a container needs its storage account")
    return f"abfss://{container}@{account}.dfs.core.windows.net/{path.lstrip('/')}"


def read_history(
    spark: SparkSession, path: str, lenient: bool = False, container: str | None = None, account: str | None = None
) -> DataFrame:
    """All stations' hourly CSV files in one scan; the file name or a station_code folder gives the station. With
    `container` and `account`, `path` is one in blob storage.

    The header must name the expected columns. A missing path raises. `ingest_order` rises along each file.
    """
    raw = (
        spark.read.schema(schemas.HISTORY)
        .option("header", True)
        .option("enforceSchema", False)
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .csv(resolve(path, container, account))
    )
    code = F.coalesce(
        F.nullif(F.regexp_extract("_metadata.file_path", r"/station_code=(\d+)/", 1), F.lit("")),
        F.regexp_extract("_metadata.file_name", r"^(\d+)", 1),
    )
    return raw.select(
        code.try_cast("int").alias("station_id"),
        code.alias("station_code"),
        calendar.parse_date_hours(F.col("DATE_HOURS"), lenient).alias("ts"),
        F.col("DATE_HOURS").alias("date_hours"),
        F.col("TEMPERATURE").alias("temperature"),
        F.col("NIEDERSCHLAG").alias("niederschlag"),
        F.col("TRAFFIC_1").alias("traffic_1"),
        F.col("TRAFFIC_2").alias("traffic_2"),
        F.col("COUNT_1").alias("count_1"),
        F.col("COUNT_2").alias("count_2"),
        F.monotonically_increasing_id().alias("ingest_order"),
    )


def read_station(spark: SparkSession, folder: str, station_code: str) -> DataFrame:
    """One station's file alone."""
    return read_history(spark, f"{folder}/{station_code}.csv")


def read_stations(spark: SparkSession, path: str, container: str | None = None, account: str | None = None) -> DataFrame:
    raw = (
        spark.read.schema(schemas.STATIONS)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", "ISO-8859-1")
        .csv(resolve(path, container, account))
    )
    return raw.toDF(*[name.lower() for name in raw.columns]).withColumnRenamed("siti_codsito", "station_id")
