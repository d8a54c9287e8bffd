"""Texts of stations, zones, levels and directions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse import schemas
from roadpulse.functions import text


def station_code(station_id: Column) -> Column:
    """Zero-padded to 8 digits; longer ids stay whole."""
    text = station_id.cast("string")
    return F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text)


def _by_level(level: Column, values: dict, default=None) -> Column:
    expression = F.lit(default)
    for key, value in values.items():
        expression = F.when(level == key, F.lit(value)).otherwise(expression)
    return expression


def level_icon(level: Column) -> Column:
    return _by_level(level, schemas.ICON_BY_LEVEL, schemas.ICON_DEFAULT)


def level_colour_class(level: Column) -> Column:
    return _by_level(level, {k: name for k, (name, _) in schemas.COLOUR_BY_LEVEL.items()})


def level_rgb(level: Column) -> Column:
    """struct<r,g,b>, null for an unknown level."""
    channels = [
        _by_level(level, {k: rgb[i] for k, (_, rgb) in schemas.COLOUR_BY_LEVEL.items()}).alias("rgb"[i]) for i in range(3)
    ]
    return F.when(level.isin(schemas.LEVELS), F.struct(*channels))


def check_language(lang: str) -> str:
    if lang not in schemas.WEATHER_ZONES:
        raise ValueError(f"language must be one of {sorted(schemas.WEATHER_ZONES)}, not {lang!r}")
    return lang


def weather_zone(index: Column, lang: str) -> Column:
    """Name of a weather zone, a message for an unknown one. Seven fixed names need no join."""
    return _by_level(index, schemas.WEATHER_ZONES[check_language(lang)], schemas.WEATHER_ZONE_UNKNOWN)


def infobox(station_index: Column) -> Column:
    """The marker's text; a missing label is left out."""
    pieces = re.split(r"\{(\w+)\}", schemas.INFOBOX)
    columns = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            columns.append(F.lit(piece))
        elif piece == "station_index":
            columns.append(station_index.cast("string"))
        else:
            columns.append(F.coalesce(F.col(piece), F.lit("")))
    return F.concat(*columns)


def _decoded(name: str) -> Column:
    return text.decode_entities(F.col(name))


def station_label() -> Column:
    return F.concat_ws("/", _decoded("abitato_sito_i"), _decoded("abitato_sito_d"))


def _route(start: int, end: int) -> Column:
    return F.concat(
        F.lit("From: "),
        F.concat_ws(" / ", _decoded(f"descrizione_i_{start}"), _decoded(f"descrizione_d_{start}")),
        F.lit(" to: "),
        F.concat_ws("/", _decoded(f"descrizione_i_{end}"), _decoded(f"descrizione_d_{end}")),
    )


def direction_label(direction: int) -> Column:
    """Direction 1 runs from end 2 to end 1, as on the map."""
    return _route(2, 1) if direction == 1 else _route(1, 2)


def console_route(direction: int) -> Column:
    """The training log names direction 1 from end 1 to end 2, Italian only."""
    start, end = (1, 2) if direction == 1 else (2, 1)
    return F.concat(F.lit("From "), F.col(f"descrizione_i_{start}"), F.lit(" to "), F.col(f"descrizione_i_{end}"))
