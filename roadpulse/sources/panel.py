"""Hourly panel: raw readings and weather readings brought to one row per station and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions import calendar
from roadpulse.schemas import LEVELS


def hourly_panel(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """`readings(station_id, ts, direction)` counted per hour, `weather(station_id, ts, value)` averaged and summed.

    Both sides are reduced before they meet, so a busy station costs one partial row per map task.
    """
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    counts = readings.groupBy("station_id", hour).agg(
        F.count_if(F.col("direction") == 1).cast("int").alias("count_1"),
        F.count_if(F.col("direction") == 2).cast("int").alias("count_2"),
    )
    climate = weather.groupBy("station_id", hour).agg(*_climate(F.col("value")))
    return with_levels(counts.join(climate, ["station_id", "ts"], "left"))


def _climate(value: Column) -> list[Column]:
    """Sums of whole hundredths, so the result does not depend on the order of addition."""
    cents = F.round(value * 100).cast("bigint")
    total = F.sum(cents).cast("double")
    return [
        (total / (F.count(cents) * F.lit(100.0))).alias("temperature"),
        (total / F.lit(10000.0)).alias("niederschlag"),
    ]


def with_levels(panel: DataFrame) -> DataFrame:
    """Traffic level 1..4 of each direction: the hour's share of the station's peak, plus calendar and row id."""
    # The peaks come from the reduced rows, of which a station has one per hour, so the readings are scanned once.
    station = Window.partitionBy("station_id")
    top = LEVELS[-1]

    def level(direction: int) -> Column:
        peak = F.max(f"count_{direction}").over(station)
        share = F.floor(F.col(f"count_{direction}") * top / (peak + 1)).cast("int")
        return (F.least(F.lit(top - 1), share) + 1).cast("int")

    return panel.select(
        "station_id",
        "ts",
        "count_1",
        "count_2",
        "temperature",
        "niederschlag",
        level(1).alias("traffic_1"),
        level(2).alias("traffic_2"),
        F.hour("ts").alias("hour"),
        calendar.week_day(F.col("ts")).alias("week_day"),
        observation_id().alias("obs_id"),
    )


def observation_id() -> Column:
    """One number per station and hour."""
    return F.col("station_id").cast("bigint") * 10_000_000 + calendar.hours_since_epoch(F.col("ts"))
