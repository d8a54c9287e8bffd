"""Text helpers of the viewer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.schemas import HTML_ENTITIES


def join_with_colons(items: Column) -> Column:
    """Every item followed by a colon."""
    return F.when(F.size(items) > 0, F.concat(F.array_join(items, ":"), F.lit(":"))).otherwise(F.lit(""))


def split_colons(text: Column) -> Column:
    """Inverse of join_with_colons: the last, empty piece goes."""
    pieces = F.split(text, ":")
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def decode_entities(text: Column) -> Column:
    """Entities are replaced one after the other, `&amp;` first."""
    for name, char in HTML_ENTITIES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def url_parameter(url: Column, name: str) -> Column:
    """Value of a query-string parameter, the last one if repeated, null if absent."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    hits = F.filter(F.split(query, "&"), lambda item: F.substring_index(item, "=", 1) == F.lit(name))
    return F.try_element_at(F.split(F.try_element_at(hits, F.lit(-1)), "="), F.lit(2))
