"""Difference of two tables by a tree of checksums: only ranges whose checksums differ are compared row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.sampling import differing_rows
from roadpulse.session import cut_lineage

_SUMS = ["rows", "low", "high"]
_HALF = 0xFFFFFFFF


def range_checksums(df: DataFrame, order: str, width: int) -> DataFrame:
    """`(range, rows, low, high)`: per range of `width` values of `order`, the number of rows and the sums of both halves of the
    rows' hashes. Sums do not depend on the order of rows, count repeated ones, and those of ranges add up to those of wider ones.

    Rows without an order value share the null range. A range of up to 2^31 rows cannot overflow.
    """
    # Names and values both count: a null and a value next to it must not swap places unseen.
    packed = F.xxhash64(*[F.col(c) for c in df.columns], F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in df.columns]))
    return (
        df.select(F.floor(F.col(order) / F.lit(width)).cast("long").alias("range"), packed.alias("_hash"))
        .groupBy("range")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.col("_hash").bitwiseAND(F.lit(_HALF))).alias("low"),
            F.sum(F.shiftrightunsigned("_hash", 32)).alias("high"),
        )
    )


def _rolled_up(sums: DataFrame, fan: int) -> DataFrame:
    wider = F.floor(F.col("range") / F.lit(fan)).cast("long").alias("range")
    return sums.groupBy(wider).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _unlike(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges that only one side has, or whose checksums differ."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _SUMS])
    met = a.join(b, F.col("a.range").eqNullSafe(F.col("b.range")), "full_outer").where(~same)
    return met.select(F.coalesce("a.range", "b.range").alias("range"))


def _under(sums: DataFrame, wider: DataFrame, fan: int) -> DataFrame:
    parent = F.floor(F.col("range") / F.lit(fan)).cast("long")
    named = wider.select(F.col("range").alias("_wider"))
    return sums.join(named, parent.eqNullSafe(F.col("_wider")), "left_semi")


def unlike_ranges(left: DataFrame, right: DataFrame, fan: int = 64, levels: int = 3) -> DataFrame:
    """Ranges in which two checksum tables differ, found from the widest ranges down: a wide range that agrees ends there."""
    sides = [[left, right]]
    for _ in range(levels - 1):
        sides.append([_rolled_up(s, fan) for s in sides[-1]])
    found = _unlike(*sides[-1])
    for pair in reversed(sides[:-1]):
        found = _unlike(*[_under(s, found, fan) for s in pair])
    return found


def range_diff(left: DataFrame, right: DataFrame, order: str, width: int = 4096, fan: int = 64) -> DataFrame:
    """The rows of `differing_rows`, with only the ranges shuffled whose checksums differ.

    `order` is a whole number. Equal tables end after the checksums. Two unlike ranges count as equal if 64 bits of sums and
    their numbers of rows agree by chance.
    """
    right = right.select(*left.columns)
    sums = [cut_lineage(range_checksums(side, order, width)) for side in (left, right)]
    ranges = cut_lineage(unlike_ranges(*sums, fan=fan))
    empty = left.limit(0).withColumn("side", F.lit("left"))
    if ranges.isEmpty():
        return empty

    def at_odds(side: DataFrame) -> DataFrame:
        named = ranges.select(F.col("range").alias("_range"))
        return side.join(named, F.floor(F.col(order) / F.lit(width)).cast("long").eqNullSafe(F.col("_range")), "left_semi")

    return differing_rows(at_odds(left), at_odds(right))
