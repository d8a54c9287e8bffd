"""The given star-schema tables seen as road-sensor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions import calendar
from roadpulse.sources import panel as panels

TODAY = "2024-01-25"
STATION_USERS = 10
"""Users that make up one sensor: the number of stations grows with the data."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def station_of_user() -> Column:
    return (2 + F.floor(F.col("user_id") / STATION_USERS)).cast("int").alias("station_id")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    direction = (1 + F.col("event_id") % 2).cast("int").alias("direction")
    return table(spark, folder, "events").select(station_of_user(), "ts", direction)


def weather_readings(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("event_type") != "signup")
    return events.select(station_of_user(), "ts", "value")


def panel(spark: SparkSession, folder: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Same rows as `hourly_panel(readings, weather_readings)` from a single scan.

    `since` and `before` are days; they cut the readings themselves, so the scan skips the others and levels compare
    with the peak of the days at hand.
    """
    even = F.col("event_id") % 2 == 0
    measured = F.when(F.col("event_type") != "signup", F.col("value"))
    events = table(spark, folder, "events")
    if since is not None:
        events = events.where(F.col("ts") >= calendar.ts_literal(f"{since} 00:00:00"))
    if before is not None:
        events = events.where(F.col("ts") < calendar.ts_literal(f"{before} 00:00:00"))
    counted = (
        events.groupBy(station_of_user(), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.count_if(even).cast("int").alias("count_1"),
            F.count_if(~even).cast("int").alias("count_2"),
            *panels._climate(measured),
        )
    )
    return panels.with_levels(counted)


def history(spark: SparkSession, folder: str, today: str = TODAY) -> DataFrame:
    """What is known before today: levels do not see the peaks of later days."""
    return panel(spark, folder, before=today)


def predictions(spark: SparkSession, folder: str, today: str = TODAY) -> DataFrame:
    """The panel's last days stand in for stored predictions."""
    return panel(spark, folder, since=today)


def stations(spark: SparkSession, folder: str) -> DataFrame:
    """One sensor per supplier; zone 8 is unknown on purpose."""
    key = F.col("s_suppkey")
    return (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            (key + 2).cast("int").alias("station_id"),
            (1 + F.col("s_nationkey") % 8).cast("int").alias("weather_index"),
            (46.0 + (key % 100) / F.lit(128.0)).alias("latitude"),
            (10.0 + (key % 64) / F.lit(32.0)).alias("longitude"),
            F.concat("s_name", F.lit(" I")).alias("abitato_sito_i"),
            F.concat("s_name", F.lit(" D")).alias("abitato_sito_d"),
            F.concat(F.lit("Via "), "n_name").alias("fw_name_custom_i"),
            F.concat(F.lit("Straße "), "n_name").alias("fw_name_custom_d"),
            F.concat("n_name", F.lit(" nord")).alias("descrizione_i_1"),
            F.concat("n_name", F.lit(" Nord")).alias("descrizione_d_1"),
            F.concat("n_name", F.lit(" sud")).alias("descrizione_i_2"),
            F.concat("n_name", F.lit(" Süd")).alias("descrizione_d_2"),
            F.concat(F.lit("Stazione "), F.col("s_nationkey").cast("string")).alias("name_i"),
            F.concat(F.lit("Station "), F.col("s_nationkey").cast("string")).alias("name_d"),
        )
    )


def bulletins(spark: SparkSession, folder: str, today: str = TODAY) -> DataFrame:
    """One JSON bulletin per weather zone: `(weather_index, json)`, days in order."""
    day = F.to_date("ts").alias("day")
    zone = (1 + F.col("user_id") % 7).cast("int").alias("weather_index")
    hour = F.hour("ts")
    offset = calendar.days_ahead(F.col("day"), today)
    slots = [(0, 6), (7, 12), (13, 18), (19, 23)]
    daily = (
        table(spark, folder, "events")
        .where(F.col("ts") >= calendar.ts_literal(f"{today} 00:00:00"))
        .groupBy(zone, day)
        .agg(
            F.floor(F.max("value") / 10).cast("double").alias("tmax"),
            F.floor(F.min("value") / 10).cast("double").alias("tmin"),
            (F.count_if(F.col("event_type") == "error") % 4).cast("double").alias("rain_from"),
            (F.count_if(F.col("event_type") == "click") % 5).cast("double").alias("rain_more"),
            *[(F.count_if(hour.between(a, b)) % 4).cast("int").alias(f"slot_{i}") for i, (a, b) in enumerate(slots, 1)],
        )
    )
    near = offset < 2
    only_third = (offset == 4) & (F.col("weather_index") == 7)
    entry = F.struct(
        F.concat(F.col("day").cast("string"), F.lit("T00:00:00")).alias("date"),
        F.col("tmax").alias("temperatureMax"),
        F.col("tmin").alias("temperatureMin"),
        F.col("rain_from").alias("rainFrom"),
        (F.col("rain_from") + F.col("rain_more")).alias("rainTo"),
        F.col("slot_1").alias("rainTimespan1"),
        F.col("slot_2").alias("rainTimespan2"),
        F.when(near | only_third, F.col("slot_3")).alias("rainTimespan3"),
        F.when(near, F.col("slot_4")).alias("rainTimespan4"),
    )
    # A bulletin holds a handful of days, so the list of one zone is short whatever the number of events.
    return daily.groupBy("weather_index").agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("forecasts"))).alias("json")
    )
