"""Randomness that depends on the row and a seed only, never on the partitioning or the task."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(salt: str | Column, *parts: Column) -> Column:
    """32 hash bits as bigint; any engine with md5 gives the same number."""
    text = F.concat_ws(":", F.lit(salt), *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(salt: str | Column, *parts: Column) -> Column:
    """Uniform in (0, 1)."""
    return (stable_hash(salt, *parts) + F.lit(0.5)) / F.lit(4294967296.0)


def _normal(salt_u: str | Column, salt_v: str | Column, *parts: Column) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(salt_u, *parts)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(salt_v, *parts))


def standard_normal(salt: str, *parts: Column) -> Column:
    """Box-Muller from two hashes."""
    return _normal(salt + ":u", salt + ":v", *parts)


def standard_normals(salts: list[str], *parts: Column) -> Column:
    """The `standard_normal` of each salt, as an array: one loop, as code written out for many draws is too long for the JVM to compile."""
    pairs = F.array(*[F.struct(F.lit(salt + ":u").alias("u"), F.lit(salt + ":v").alias("v")) for salt in salts])
    return F.transform(pairs, lambda pair: _normal(pair["u"], pair["v"], *parts))
