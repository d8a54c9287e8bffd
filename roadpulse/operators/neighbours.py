"""Exact k nearest neighbours without comparing all pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.schemas import FEATURES
from roadpulse.session import by_merge, cut_lineage

LEAF = 64
"""Points of a leaf at most."""
PARTS = 64
"""Children of a node at most."""

_ROOT = "0"


@dataclass(frozen=True)
class Tree:
    """A k-d partition tree per key.

    `points` are the training points with their `leaf`. `nodes` has a row per inner node with its `children`: their name, the lowest
    and highest value of each feature, and how many rows they hold. `depth` is the number of levels below the roots.
    """

    points: DataFrame
    nodes: DataFrame | None
    depth: int


def partition(train: DataFrame, keys: list[str], leaf: int = LEAF, parts: int = PARTS) -> Tree:
    """Cut each key's points into leaves of at most `leaf` points, whatever the key's size and however close they lie.

    A round cuts every node that is too large at quantiles of its widest feature into up to `parts` children, so the rounds are
    the logarithm of the largest key. Points are distinct but for their label, of which there are few: fewer than `leaf`.
    """
    points = train.select(*keys, *FEATURES, "label", "n", F.lit(_ROOT).alias("leaf"), F.lit(True).alias("fresh"))
    levels: list[DataFrame] = []
    while True:
        spans = F.array(*[F.struct((F.max(f) - F.min(f)).alias("span"), F.lit(-i).alias("f")) for i, f in enumerate(FEATURES)])
        sizes = points.where("fresh").groupBy(*keys, "leaf").agg(F.count("*").alias("size"), F.array_max(spans)["f"].alias("f"))
        large = cut_lineage(sizes.where(F.col("size") > leaf).withColumn("f", -F.col("f")))
        if large.isEmpty():
            break
        value = F.get(F.array(*FEATURES), F.col("f"))
        steps = [(i + 1) / parts for i in range(parts - 1)]
        inside = by_merge(points.where("fresh")).join(large, [*keys, "leaf"]).withColumn("value", value)
        cuts = inside.groupBy(*keys, "leaf", "size", "f").agg(
            F.percentile_approx("value", steps, 1000).alias("steps"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        # Twice as many parts as needed at least, so that most children are leaves.
        stride = F.greatest(F.lit(1), F.floor(F.lit(parts * leaf) / (2 * F.col("size")))).cast("int")
        taken = F.filter("steps", lambda v, i: ((i + 1) % stride == 0) & (v < F.col("high")))
        middle = F.array((F.col("low") + F.col("high")) / 2)
        cuts = cuts.select(*keys, "leaf", "f", F.when(F.size(taken) > 0, F.array_distinct(taken)).otherwise(middle).alias("cuts"))
        below = F.size(F.filter("cuts", lambda c: c < value))
        child = F.concat_ws(".", "leaf", below.cast("string"))
        placed = by_merge(points).join(cuts, [*keys, "leaf"], "left")
        points = cut_lineage(
            placed.select(*keys, *FEATURES, "label", "n", F.col("leaf").alias("node"), F.when(F.col("cuts").isNotNull(), child).otherwise(F.col("leaf")).alias("leaf"), F.col("cuts").isNotNull().alias("fresh"))
        )
        boxes = points.where("fresh").groupBy(*keys, "node", "leaf").agg(
            F.array(*[F.min(f) for f in FEATURES]).alias("low"), F.array(*[F.max(f) for f in FEATURES]).alias("high"), F.sum("n").alias("rows")
        )
        levels.append(cut_lineage(boxes.groupBy(*keys, "node").agg(F.collect_list(F.struct("leaf", "low", "high", "rows")).alias("children"))))
        points = points.drop("node")
    nodes = None
    for level in levels:
        nodes = level if nodes is None else nodes.unionByName(level)
    return Tree(points.drop("fresh"), nodes, len(levels))


def _gaps(child: Column, farthest: bool) -> Column:
    """Squared distance from the query to the nearest or farthest point of a child's box."""
    total = F.lit(0.0)
    for i, f in enumerate(FEATURES):
        low, high = F.get(child["low"], F.lit(i)) - F.col(f), F.col(f) - F.get(child["high"], F.lit(i))
        gap = F.greatest(F.abs(low), F.abs(high)) if farthest else F.greatest(low, high, F.lit(0.0))
        total = total + gap * gap
    return total


def _reached(k: int) -> Column:
    """A bound on the squared k-th distance: the least reach of boxes that hold k rows together; null if all hold fewer."""
    reaches = F.array_sort(F.transform("children", lambda c: F.struct(_gaps(c, True).alias("reach"), c["rows"].alias("rows"))))
    none = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("double").alias("reach"))

    def add(s: Column, c: Column) -> Column:
        enough = s["rows"] >= k
        return F.struct((s["rows"] + c["rows"]).alias("rows"), F.when(enough, s["reach"]).otherwise(c["reach"]).alias("reach"))

    return F.aggregate(reaches, none, add, lambda s: F.when(s["rows"] >= k, s["reach"]))


def _square() -> Column:
    """Squared distance between a query and a training point."""
    total = F.lit(0.0)
    for f in FEATURES:
        gap = F.col(f) - F.col(f"train_{f}")
        total = total + gap * gap
    return total


def nearest(train: DataFrame, queries: DataFrame, keys: list[str], k: int, leaf: int = LEAF) -> DataFrame:
    """The k nearest training rows of each query, as `(query, square, label, n, before)`.

    `train` holds distinct points `(keys, features, label, n)`, `queries` distinct points `(keys, features)`.
    Equal distances go to the smaller label. A point stands for `n` rows and `before` rows come ahead of it.

    1. Training points lie in the leaves of a partition tree.
    2. A query goes down to the leaf nearest to it. The boxes that it passes, and the points of that leaf, bound its k-th distance.
    3. It goes down again to every leaf within that bound and meets the points there. So the pairs measured follow the
       number of near points, not the key's size, and nothing depends on how close points lie.
    """
    query = [*keys, *FEATURES]
    tree = partition(train, keys, leaf)
    order = Window.partitionBy(*query).orderBy("square", "label")
    points = tree.points.withColumnsRenamed({f: f"train_{f}" for f in FEATURES})

    home = queries.select(*query, F.lit(_ROOT).alias("leaf"), F.lit(None).cast("double").alias("reach"))
    for _ in range(tree.depth):
        inner = by_merge(home).join(tree.nodes.withColumnRenamed("node", "leaf"), [*keys, "leaf"], "left")
        near = F.array_min(F.transform("children", lambda c: F.struct(_gaps(c, False).alias("gap"), c["leaf"].alias("leaf"))))["leaf"]
        home = inner.select(*query, F.coalesce(near, F.col("leaf")).alias("leaf"), F.least(F.col("reach"), _reached(k)).alias("reach"))
    home = cut_lineage(home)
    # The k-th of the home leaf's points, where it has so many.
    met = by_merge(home).join(points, [*keys, "leaf"]).select(*query, "reach", "label", _square().alias("square"))
    met = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy(*query)
    bounds = met.agg(F.max("reach").alias("reach"), F.when(F.count("*") == k, F.max("square")).alias("square"))
    # The slack keeps rounding from losing a leaf at the rim; the measured squares decide.
    bound = F.least("reach", "square") * (1 + 1e-9) + 1e-9
    within = cut_lineage(bounds.select(*query, F.lit(_ROOT).alias("leaf"), bound.alias("bound_square")))
    for _ in range(tree.depth):
        inner = by_merge(within).join(tree.nodes.withColumnRenamed("node", "leaf"), [*keys, "leaf"], "left")
        hit = F.filter("children", lambda c: F.col("bound_square").isNull() | (_gaps(c, False) <= F.col("bound_square")))
        names = F.coalesce(F.transform(hit, lambda c: c["leaf"]), F.array("leaf"))
        within = inner.select(*query, F.explode(names).alias("leaf"), "bound_square")
    measured = (
        by_merge(within).join(points, [*keys, "leaf"])
        .select(*query, "bound_square", "label", "n", _square().alias("square"))
        .where(F.col("bound_square").isNull() | (F.col("square") <= F.col("bound_square")))
    )
    closest = measured.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        closest.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("before") < k)
        .select(*query, "square", "label", "n", "before")
    )


def vote(neighbours: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Most frequent label among the first 1..k rows, as `predicted_1`..`predicted_k`; ties go to the smaller label."""
    query = [*keys, *FEATURES]
    taken = [
        F.sum(F.greatest(F.least(F.col("n"), F.lit(size) - F.col("before")), F.lit(0))).alias(f"votes_{size}")
        for size in range(1, k + 1)
    ]
    tally = neighbours.groupBy(*query, "label").agg(*taken)
    winners = [
        F.max_by("label", F.struct(F.col(f"votes_{size}"), -F.col("label"))).alias(f"predicted_{size}")
        for size in range(1, k + 1)
    ]
    return tally.groupBy(*query).agg(*winners)


def predict(train: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    return vote(nearest(train, queries, keys, k), keys, k)
