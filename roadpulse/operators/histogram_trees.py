"""Trees of keys of any size, grown level by level over all tasks.

Every feature of a key is cut into bins of about equal weight. A level of all trees of all keys is one shuffle: tasks
add up class counts per node, feature and bin, and the best cut of a node is read off the running sums of its bins. So no
task holds a key's points, and what travels follows bins and open nodes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.hashing import stable_hash, uniform
from roadpulse.operators import trees
from roadpulse.operators.keyed import KEYS
from roadpulse.schemas import FEATURES, LEVELS
from roadpulse.session import cut_lineage

BINS = 64
CELLS = 1024
"""Different values of a feature up to which bins are made of the values themselves; beyond, of as many steps of equal width."""
_NODE = [*KEYS, "tree", "node"]
_COUNTS = [f"c{label}" for label in LEVELS]


def bin_edges(points: DataFrame, bins: int = BINS) -> DataFrame:
    """`(keys, edges)`: for each feature, the bins in order as structs of their lowest and highest value.

    Cells of values are counted by aggregation, so counts of parts of the data add up, and cells are merged to `bins` bins of about
    equal weight; a feature with fewer cells keeps them all. A key has a bounded number of cells.
    """
    pairs = [piece for i, f in enumerate(FEATURES) for piece in (F.lit(i), F.col(f).cast("double"))]
    long = points.select(*KEYS, "n", F.stack(F.lit(len(FEATURES)), *pairs).alias("f", "v"))
    values = long.groupBy(*KEYS, "f", "v").agg(F.sum("n").alias("n"))
    spans = values.groupBy(*KEYS, "f").agg(F.count("*").alias("values"), F.min("v").alias("least"), F.max("v").alias("most"))
    step = F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * CELLS).cast("double")
    cell = F.when(F.col("values") <= CELLS, F.col("v")).otherwise(step).alias("cell")
    cells = values.join(spans, [*KEYS, "f"]).groupBy(*KEYS, "f", cell)
    cells = cells.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n"))
    feature = Window.partitionBy(*KEYS, "f")
    before = F.coalesce(F.sum("n").over(feature.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.floor(before * bins / F.sum("n").over(feature))
    place = F.when(F.count("*").over(feature) <= bins, F.row_number().over(feature.orderBy("cell"))).otherwise(share)
    merged = cells.withColumn("bin", place).groupBy(*KEYS, "f", "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    listed = merged.groupBy(*KEYS, "f").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("bins"))
    return listed.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "bins"))), lambda x: x["bins"]).alias("edges"))


def binned(points: DataFrame, edges: DataFrame) -> DataFrame:
    """`(keys, label, bins, n)`: the place of each feature's value among its bins, equal points as one."""

    def place(i: int, value: Column) -> Column:
        return F.size(F.filter(F.get("edges", F.lit(i)), lambda b: b["high"] < value))

    places = [place(i, F.col(f)) for i, f in enumerate(FEATURES)]
    return points.join(edges, KEYS).select(*KEYS, "label", F.array(*places).alias("bins"), "n").groupBy(*KEYS, "label", "bins").agg(F.sum("n").alias("n"))


def _drawn(n: Column, *parts: Column) -> Column:
    """How often a bootstrap draws a point that stands for `n` rows: a Poisson number, from a hash of the point.

    Up to 30 rows by inversion, beyond from the normal distribution it tends to.
    """
    u = uniform("bootstrap", *parts)
    start = F.struct(F.exp(-n.cast("double")).alias("p"), F.exp(-n.cast("double")).alias("sum"), F.lit(0).alias("k"))

    def further(s: Column, i: Column) -> Column:
        p = s["p"] * n / i
        return F.when(s["sum"] >= u, s).otherwise(F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), i.alias("k")))

    counted = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, further, lambda s: s["k"])
    normal = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * uniform("bootstrap:v", *parts))
    return F.when(n <= 30, counted).otherwise(F.greatest(F.round(n + F.sqrt(n.cast("double")) * normal), F.lit(0))).cast("bigint")


def fit(points: DataFrame, settings: DataFrame, bins: int = BINS, n_trees: int = 1, bootstrap: bool = False, tried: int = len(FEATURES), seed: int = 101) -> DataFrame:
    """The model table of `trees.fit` (trees.MODEL), grown on the bins of `points(keys, features, label, n)`.

    A cut lies midway between the bins that hold points of the node on either side, so where every value is a bin the tree
    is that of `trees.fit`. `tried` features of a node, chosen by a hash, come before the others. Null features have no
    place here: rows must be complete.
    """
    edges = cut_lineage(bin_edges(points, bins))
    rows = binned(points, edges).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    if bootstrap:
        rows = rows.withColumn("n", _drawn(F.col("n"), F.lit(seed), *[F.col(k) for k in KEYS], F.col("tree"), F.col("label"), F.col("bins"))).where("n > 0")
    rows = cut_lineage(rows.withColumn("node", F.lit(0)))
    levels: list[DataFrame] = []
    while not rows.isEmpty():
        level = cut_lineage(_cut_level(rows, settings, len(levels), tried, seed))
        levels.append(level)
        cuts = level.where(F.col("f").isNotNull()).select(*_NODE, "f", "bin", "lower")
        above = (F.get("bins", F.col("f")) > F.col("bin")).cast("int")
        rows = cut_lineage(rows.join(cuts, _NODE).select(*KEYS, "tree", (F.col("lower") + above).alias("node"), "label", "bins", "n"))
    if not levels:
        return points.sparkSession.createDataFrame([], trees.MODEL)
    return _model(reduce(DataFrame.unionByName, levels), edges)


def _cut_level(rows: DataFrame, settings: DataFrame, depth: int, tried: int, seed: int) -> DataFrame:
    """The nodes of one level with class counts, best cut and the number of their lower child."""
    counted = rows.select(*_NODE, F.posexplode("bins").alias("f", "bin"), "label", "n").groupBy(*_NODE, "f", "bin")
    counts = counted.agg(*[F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(c) for label, c in zip(LEVELS, _COUNTS)])
    feature = Window.partitionBy(*_NODE, "f")
    in_order = feature.orderBy("bin")
    sums = counts.select(
        *_NODE, "f", "bin", F.lead("bin").over(in_order).alias("following"),
        *[F.sum(c).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"left_{c}") for c in _COUNTS],
        *[F.sum(c).over(feature).alias(c) for c in _COUNTS],
    ).join(settings, KEYS)

    def total(names: list[Column]) -> Column:
        return reduce(Column.__add__, names)

    def squares(names: list[Column]) -> Column:
        doubles = [c.cast("double") for c in names]
        return total([c * c for c in doubles]) / total(doubles)

    whole, left = [F.col(c) for c in _COUNTS], [F.col(f"left_{c}") for c in _COUNTS]
    right = [a - b for a, b in zip(whole, left)]
    n, leaf = total(whole), F.col("min_leaf")
    is_open = (F.greatest(*whole) < n) & (n >= F.greatest("min_split", 2 * leaf)) & (F.lit(depth) < F.coalesce("max_depth", F.lit(trees.NO_LIMIT)))
    fits = F.col("following").isNotNull() & is_open & (total(left) >= leaf) & (total(right) >= leaf)
    lots = [stable_hash(f"feature{seed}", *[F.col(c) for c in _NODE], F.lit(i)) for i in range(len(FEATURES))]
    turn = F.lit(0)
    if tried < len(FEATURES):
        lot = F.get(F.array(*lots), F.col("f"))
        turn = (F.size(F.filter(F.array(*lots), lambda x: x < lot)) >= tried).cast("int")
    # Features whose turn it is come first, then the purest cut; among equals the first feature and the lowest cut.
    purity = F.when(fits, squares(left) + squares(right))
    cut = F.struct((-turn).alias("turn"), purity.alias("purity"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), "following")
    nodes = sums.groupBy(*_NODE).agg(F.max(F.when(fits, cut)).alias("cut"), *[F.first(c).alias(c) for c in _COUNTS])
    tree = Window.partitionBy(*KEYS, "tree")
    ahead = F.count("cut").over(tree.orderBy("node")).cast("int")
    lower = F.min("node").over(tree) + F.count("*").over(tree).cast("int") + 2 * (ahead - 1)
    return nodes.select(
        *_NODE, *_COUNTS, (-F.col("cut.f")).alias("f"), (-F.col("cut.bin")).alias("bin"), F.col("cut.following").alias("following"),
        F.when(F.col("cut").isNotNull(), lower).alias("lower"), (F.col("cut.purity") - squares(whole)).alias("lost"),
    )


def _model(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bins = F.get("edges", F.col("f"))
    threshold = (F.get(bins, F.col("bin"))["high"] + F.get(bins, F.col("following"))["low"]) / 2
    n = reduce(Column.__add__, [F.col(c) for c in _COUNTS])
    shares = F.array(*[(F.col(c) / n).cast("float") for c in _COUNTS])
    told = nodes.join(edges, KEYS).select(*_NODE, "f", threshold.alias("threshold"), "lower", shares.alias("share"), "lost")
    listed = told.groupBy(*KEYS, "tree").agg(F.sort_array(F.collect_list(F.struct("node", "f", "threshold", "lower", "share", "lost"))).alias("nodes"))

    def lost(where: Column) -> Column:
        return F.aggregate(F.filter("nodes", lambda x: x["f"].isNotNull() & (F.isnull(where) | x["f"].eqNullSafe(where))), F.lit(0.0), lambda s, x: s + x["lost"])

    whole = lost(F.lit(None).cast("int"))
    return listed.select(
        *KEYS,
        "tree",
        F.transform("nodes", lambda x: F.coalesce(x["f"], F.lit(-1)).cast("tinyint")).alias("feature"),
        F.transform("nodes", lambda x: F.coalesce(x["threshold"], F.lit(0.0))).alias("threshold"),
        F.transform("nodes", lambda x: F.coalesce(x["lower"], F.lit(-1))).alias("lower"),
        F.flatten(F.transform("nodes", lambda x: x["share"])).alias("share"),
        F.array(*[F.when(whole > 0, lost(F.lit(i)) / whole).otherwise(F.lit(0.0)) for i in range(len(FEATURES))]).alias("importance"),
    )


def fit_simple(points: DataFrame, max_depth: int = 2, bins: int = BINS) -> DataFrame:
    return fit(points, trees.fixed_settings(points, max_depth), bins)


def fit_forest(points: DataFrame, n_trees: int = 200, seed: int = 101, bins: int = BINS, together: int = 20) -> DataFrame:
    """Bootstrap trees without limits, each node trying two features first; `together` trees are grown at a time."""
    settings = trees.fixed_settings(points, None)
    parts = []
    for start in range(0, n_trees, together):
        grown = fit(points, settings, bins, min(together, n_trees - start), bootstrap=True, tried=2, seed=seed + start)
        parts.append(cut_lineage(grown.withColumn("tree", F.col("tree") + F.lit(start))))
    return reduce(DataFrame.unionByName, parts)
