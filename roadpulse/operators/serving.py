"""Lookups, map and heatmap."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse import schemas
from roadpulse.functions import calendar, labels
from roadpulse.operators.filters import by_direction


def latest_per_hour(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; `max_by` combines on the map side, so repeats never travel."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def traffic_at(facts: DataFrame, stations: DataFrame, instant: str, direction: int) -> DataFrame:
    """Level of every station in the hour of `instant`, -1 where there is none."""
    hour = F.date_trunc("hour", calendar.ts_literal(instant)).cast("timestamp_ntz")
    at = facts.where(F.col("ts") == hour).select("station_id", F.col(f"traffic_{direction}").alias("level"))
    return stations.join(at, "station_id", "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def markers(facts: DataFrame, stations: DataFrame, instant: str, direction: int) -> DataFrame:
    """Map markers coloured by the level of the hour."""
    return traffic_at(facts, stations, instant, direction).select(
        "station_id", "latitude", "longitude", "level", labels.level_icon(F.col("level")).alias("icon")
    )


def station_markers(indexed_stations: DataFrame) -> DataFrame:
    """Uncoloured markers with their text."""
    return indexed_stations.select(
        "station_id",
        "station_index",
        F.struct(
            F.lit(schemas.ICON_DEFAULT).alias("icon"),
            F.col("latitude").alias("lat"),
            F.col("longitude").alias("lng"),
            labels.infobox(F.col("station_index")).alias("infobox"),
        ).alias("marker"),
    )


def by_date(facts: DataFrame) -> DataFrame:
    """Per station and day the hours in order: at most 24 entries once each hour is there once."""
    entry = F.struct(F.hour("ts").alias("hour"), "traffic_1", "traffic_2", "count_1", "count_2")
    return facts.groupBy("station_id", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(entry)).alias("hours")
    )


def station_series(facts: DataFrame) -> DataFrame:
    """Eight parallel lists per station and year, in time order: at most 8784 entries each."""
    entry = F.struct("ts", "traffic_1", "traffic_2", "count_1", "count_2")
    grouped = facts.groupBy("station_id", F.year("ts").alias("year")).agg(
        F.sort_array(F.collect_list(entry)).alias("rows")
    )

    def values(field):
        return F.transform("rows", field)

    return grouped.select(
        "station_id",
        "year",
        values(lambda r: r["traffic_1"]).alias("traffic_1"),
        values(lambda r: r["traffic_2"]).alias("traffic_2"),
        values(lambda r: F.dayofmonth(r["ts"])).alias("days"),
        values(lambda r: F.month(r["ts"])).alias("months"),
        values(lambda r: F.year(r["ts"])).alias("years"),
        values(lambda r: F.hour(r["ts"])).alias("hours"),
        values(lambda r: r["count_1"]).alias("count_1"),
        values(lambda r: r["count_2"]).alias("count_2"),
    )


def heatmap_cells(facts: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The heatmap in long form, for any range of days: one row per station, direction, day and hour that has a value."""
    window = facts
    if first is not None:
        window = window.where(F.col("ts") >= calendar.ts_literal(f"{first} 00:00:00"))
    if last is not None:
        window = window.where(F.to_date("ts") <= calendar.date_literal(last))
    cells = by_direction(window.select("station_id", "ts", "traffic_1", "traffic_2", "count_1", "count_2"))
    return cells.groupBy("station_id", "direction", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("count").isNotNull(), F.greatest("count", F.lit(0)))).alias("count"),
        F.max(labels.level_colour_class(F.col("level"))).alias("colour"),
    )


def days_of(first: str, last: str) -> list[str]:
    """The days of a range, which become the columns of `heatmap`."""
    start, stop = date.fromisoformat(first), date.fromisoformat(last)
    return [str(start + timedelta(days=k)) for k in range((stop - start).days + 1)]


def heatmap(facts: DataFrame, days: list[str], station_id: int | None = None, direction: int | None = None) -> DataFrame:
    """Hour by date: level, clamped count and colour class of each cell, for every station and direction at once.

    Each station shows all 24 hours. The dates are given, so the pivot needs no pass to find them.
    """
    window = facts.where(F.to_date("ts").isin([calendar.date_literal(d) for d in days]))
    if station_id is not None:
        window = window.where(F.col("station_id") == station_id)
    cells = by_direction(window.select("station_id", "ts", "traffic_1", "traffic_2", "count_1", "count_2"))
    if direction is not None:
        cells = cells.where(F.col("direction") == direction)
    cells = cells.select(
        "station_id", "direction", F.hour("ts").alias("hour"), F.to_date("ts").cast("string").alias("day"), "level", "count"
    )
    frame = cells.select("station_id", "direction").distinct()
    frame = frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    blank = frame.select("*", *[F.lit(None).cast(t).alias(c) for c, t in [("day", "string"), ("level", "int"), ("count", "int")]])
    return (
        cells.unionByName(blank)
        .groupBy("station_id", "direction", "hour")
        .pivot("day", days)
        .agg(
            F.max("level").alias("level"),
            F.max(F.when(F.col("count").isNotNull(), F.greatest("count", F.lit(0)))).alias("count"),
            F.max(labels.level_colour_class(F.col("level"))).alias("colour"),
        )
    )


def day_headers(facts: DataFrame) -> DataFrame:
    days = facts.select(F.to_date("ts").alias("day")).distinct()
    return days.select("day", calendar.day_header(F.col("day")).alias("header"))


def export_order(df: DataFrame) -> DataFrame:
    """Total order, for exports only."""
    return df.orderBy("station_id", "ts")
