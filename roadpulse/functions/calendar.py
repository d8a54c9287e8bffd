"""Date and hour expressions. All instants are wall-clock hours, kept as timestamp without zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_literal(day: str | dt.date) -> Column:
    return F.lit(str(day)).cast("date")


def ts_literal(instant: str | dt.datetime) -> Column:
    return F.lit(str(instant)).cast("timestamp_ntz")


def parse_date_hours(text: Column, lenient: bool = False) -> Column:
    """`180101_00` to an instant. Malformed text raises, or gives null when lenient."""
    if not lenient:
        return F.to_timestamp_ntz(text, F.lit("yyMMdd_HH"))
    day = F.try_to_date(F.substring(text, 1, 6), "yyMMdd")
    hour = F.substring(text, 8, 2).try_cast("int")
    shaped = text.rlike(r"^\d{6}_\d{2}$") & hour.between(0, 23)
    return F.when(shaped, day.cast("timestamp_ntz") + F.make_interval(hours=hour))


def parse_iso(text: Column) -> Column:
    """`2024-01-25T00:00:00` to an instant."""
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def week_day(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def hours_since_epoch(ts: Column) -> Column:
    return F.datediff(ts, date_literal("1970-01-01")).cast("bigint") * 24 + F.hour(ts)


def instant(day: Column, hour: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_interval(hours=hour)


def plain_date(ts: Column) -> Column:
    """Year-month-day without padding."""
    return F.concat_ws("-", F.year(ts), F.month(ts), F.dayofmonth(ts))


def lookup_key(ts: Column) -> Column:
    """The viewer's key of one hour, such as `2024-1-5:8:00`."""
    return F.concat(plain_date(ts), F.lit(":"), F.hour(ts).cast("string"), F.lit(":00"))


def day_header(day: Column) -> Column:
    return F.concat(F.date_format(day, "EEEE"), F.lit(", "), plain_date(day))


def days_ahead(ts: Column, today: str | dt.date) -> Column:
    """Signed number of days between `today` and the instant."""
    return F.datediff(F.to_date(ts), date_literal(today))


def slider_hour(minutes: Column) -> Column:
    return F.floor(minutes / 60).cast("int")


def slider_minute(minutes: Column) -> Column:
    return F.lpad((minutes % 60).cast("string"), 2, "0")
