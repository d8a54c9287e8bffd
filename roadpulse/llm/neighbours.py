"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions, whose cells of width w form a bucket of several directions per table.
A query visits its own bucket and the buckets it most likely just missed, in the order of estimated success. Exact
cosines are taken inside the visited buckets, and the best of all tables are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import tasks
from roadpulse.session import cut_lineage

NEAREST = 5
RECALL = 0.95
#: Vectors and queries that the search's parameters are chosen on, whatever the size of the table.
FIT_VECTORS, FIT_QUERIES = 2000, 100
#: Vectors of a bucket that a task meets at once; a larger bucket is split.
SPLIT = 20_000
#: What is tried: cells per table, their width, buckets visited per table, and tables at most.
TRIED = [(cells, width, probes) for cells in (4, 8, 12) for width in (1.6, 2.5) for probes in (32, 200)]
TABLES = 12


@dataclass
class Hashing:
    """`tables` tables of `cells` directions each: directions, offsets, the width of a cell and the visits per table."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    tables: int
    cells: int
    probes: int

    @staticmethod
    def draw(dimension: int, tables: int, cells: int, width: float, probes: int, seed: int = 7) -> Hashing:
        random = np.random.default_rng(seed)
        directions = random.standard_normal((dimension, tables * cells))
        return Hashing(directions, random.random(tables * cells) * width, width, tables, cells, probes)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Place on each direction in cells, by vector, table and direction."""
        return ((unit @ self.directions + self.offsets) / self.width).reshape(len(unit), self.tables, self.cells)

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """A number for the table and its cells (the last axis)."""
        key = np.zeros(cells.shape[:-1], np.uint64)
        key += np.arange(self.tables, dtype=np.uint64)[: cells.shape[1]] if cells.ndim == 3 else np.uint64(0)
        for j in range(self.cells):
            key = (key ^ cells[..., j].astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.astype(np.int64)

    def visits(self, place: np.ndarray) -> np.ndarray:
        """The cells of the buckets to visit in one table: the own one, then steps across the nearest borders first."""
        own = np.floor(place)
        low = place - own
        steps = sorted([(low[j] ** 2, j, -1) for j in range(self.cells)] + [((1 - low[j]) ** 2, j, 1) for j in range(self.cells)])
        out, heap = [own], [(steps[0][0], (0,))]
        while heap and len(out) < self.probes:
            cost, chosen = heapq.heappop(heap)
            dims = [steps[i][1] for i in chosen]
            if len(set(dims)) == len(dims):
                cells = own.copy()
                for i in chosen:
                    cells[steps[i][1]] += steps[i][2]
                out.append(cells)
            last = chosen[-1]
            if last + 1 < len(steps):
                heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
        return np.array(out)

    def visited(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each query the buckets it visits, over all tables."""
        out = []
        for place in self.places(unit):
            cells = np.stack([np.pad(v, ((0, self.probes - len(v)), (0, 0)), mode="edge") for v in map(self.visits, place)], axis=1)
            out.append(np.unique(self.buckets(cells)))
        return out


def usable(vectors: DataFrame, identifier: str, vector: str) -> DataFrame:
    """`(id, v)`: rows with an id whose vector is not null, has no null or non-finite component and is not zero."""
    taken = vectors.select(F.col(identifier).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return taken.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite & some, F.lit(False)))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """`(rep, v, ids)`: each different vector once, with the `keep` smallest ids that have it; no other of its ids can be
    among the nearest of any query. Spark limits the ranks before the shuffle, so a vector that fills the table does too."""
    one = rows.dropDuplicates(["id", "v"])
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return (
        one.withColumn("rank", rank)
        .where(F.col("rank") <= keep)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("rep"), "v", "ids")
    )


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which changes no digit of a cosine and keeps its squares in range."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def choose(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, recall: float = RECALL, tables: int = TABLES) -> Hashing:
    """Cells, their width, visits and tables that find `recall` of the nearest of a sample of queries among all vectors.

    The sample is bounded: `FIT_QUERIES` queries, whose true neighbours are taken from all vectors, and `FIT_VECTORS`
    vectors, which tell what share of the table a query meets. The setting that meets least is taken.
    """
    asked = queries.select("v").orderBy(F.xxhash64("v"), "v").limit(FIT_QUERIES).toPandas()["v"]
    shown = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(FIT_VECTORS).toPandas()["v"]
    dimension = len(shown.iloc[0])
    q, some = _unit(np.stack(asked.to_list())), _unit(np.stack(shown.to_list()))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, held = np.full((len(q), 0), -2.0), np.zeros((len(q), 0, dimension))
        for batch in batches:
            own = _unit(_matrix(batch.column(0)))
            score = q @ own.T
            score[score > 1 - 1e-12] = -2.0  # the query itself
            near = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
            top = np.concatenate([top, np.take_along_axis(score, near, axis=1)], axis=1)
            held = np.concatenate([held, own[near]], axis=1)
            order = np.argsort(-top, axis=1, kind="stable")[:, :nearest]
            top, held = np.take_along_axis(top, order, axis=1), np.take_along_axis(held, order[:, :, None], axis=1)
        k = top.shape[1]
        arrays = [
            pa.array(np.repeat(np.arange(len(q)), k).astype(np.int32)), pa.array(top.ravel()),
            pa.array(held.reshape(len(q) * k, dimension).tolist(), pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["q", "score", "v"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    found = vectors.select("v").mapInArrow(best, "q int, score double, v array<double>")
    found = found.withColumn("rank", rank).where((F.col("rank") <= nearest) & (F.col("score") > -2)).toPandas()
    if found.empty:
        return Hashing.draw(dimension, 1, 1, 4.0, 1)
    pairs, near = found["q"].to_numpy(), np.stack(found["v"].to_list())
    best_cost, chosen = None, None
    for cells, width, probes in TRIED:
        drawn = Hashing.draw(dimension, tables, cells, width, probes)
        made = _trial(drawn, q, some, pairs, near, recall)
        if made is not None and (best_cost is None or made[0] < best_cost):
            best_cost, used = made[0], made[1] * cells
            chosen = Hashing(drawn.directions[:, :used], drawn.offsets[:used], width, made[1], cells, probes)
    # Where no setting reaches the recall, cells so wide that few borders are left.
    return chosen or Hashing.draw(dimension, 2, 1, 8.0, 3)


def _trial(drawn: Hashing, q: np.ndarray, some: np.ndarray, pairs: np.ndarray, near: np.ndarray, recall: float) -> tuple[float, int] | None:
    """Cost of a setting, and how many of its tables reach `recall`; None if all do not."""
    own_near, own_some = drawn.buckets(np.floor(drawn.places(near))), drawn.buckets(np.floor(drawn.places(some)))
    hit, met = np.zeros(len(pairs), bool), np.zeros((len(q), len(some)), bool)
    at = drawn.places(q)
    for t in range(drawn.tables):
        keys = []
        for i in range(len(q)):
            cells = drawn.visits(at[i, t])
            wide = np.zeros((len(cells), t + 1, drawn.cells))
            wide[:, t] = cells
            keys.append(drawn.buckets(wide)[:, t])
        hit |= np.array([own_near[k, t] in set(keys[i].tolist()) for k, i in enumerate(pairs.tolist())])
        for i, k in enumerate(keys):
            met[i] |= np.isin(own_some[:, t], k)
        if hit.mean() >= recall:
            # The share of the table met counts most, as it is what grows with the square; then vectors carried once per
            # table, and buckets visited.
            return met.mean() * 200 + (t + 1) + (t + 1) * drawn.probes * 0.02, t + 1
    return None


def search(vectors: DataFrame, queries: DataFrame, identifier: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, hashing: Hashing | None = None) -> DataFrame:
    """`(query_id, rank, <identifier>, score)`: the nearest rows of `vectors` found for each row of `queries` by cosine.

    A row is no candidate of a query with its id. Equal scores go to the smaller id. Rows whose vector or id is null, whose
    vector is zero or holds a null or non-finite component take no part; nor, for a query, do vectors of another length.
    Repeated rows count once. A query without candidates has no row; empty tables give no rows. Other columns are not read.
    """
    keep = nearest + 1
    rows = usable(vectors, identifier, vector)
    held = cut_lineage(distinct_vectors(rows, keep))
    asking = usable(queries, identifier, vector).dropDuplicates(["id", "v"])
    asked = cut_lineage(asking.groupBy("v").agg(F.min("id").alias("rep")))
    kind = rows.schema["id"].dataType.simpleString()
    spark = vectors.sparkSession
    out = None
    for dimension in [r["n"] for r in held.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        own, want = held.where(F.size("v") == dimension), asked.where(F.size("v") == dimension)
        if want.isEmpty():
            continue
        part = _search(own, want, hashing or choose(own, want, nearest), keep, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {identifier} {kind}, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = out.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(top))
    named = best.where(F.col("place") <= keep).join(held.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("candidate"))
    # Every row with a query's vector asks for itself.
    same = asking.join(asked.select("v", F.col("rep").alias("q")), "v").select(F.col("id").alias("query_id"), "q")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate")
    ranked = same.join(named, "q").where(F.col("query_id") != F.col("candidate")).groupBy("query_id", "candidate").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("candidate").alias(identifier), "score")


def _cell(buckets: np.ndarray, cells: int) -> np.ndarray:
    """The group of buckets that a bucket belongs to."""
    mixed = buckets.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(cells)).astype(np.int32)


def _raw(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def _search(held: DataFrame, asked: DataFrame, hashing: Hashing, keep: int, kind: str) -> DataFrame:
    """`(q, rep, score)`: for each query the `keep` best of every group of buckets."""
    spark = held.sparkSession
    made = spark.sparkContext.broadcast(hashing)
    cells = tasks(spark, 4 * spark.sparkContext.defaultParallelism)
    asked = asked.select("rep", "v").repartition(cells, "rep")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                b = batch.slice(start, 2000)
                matrix = _matrix(b.column(1))
                buckets = made.value.buckets(np.floor(made.value.places(_unit(matrix))))
                raw = _raw(matrix)
                for t in range(buckets.shape[1]):
                    own = np.ascontiguousarray(buckets[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(_cell(own, cells)), pa.array(own), b.column(0), raw], names=["cell", "bucket", "rep", "raw"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and group of buckets, with those of the group that the query visits."""
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                b = batch.slice(start, 200)
                matrix = _matrix(b.column(1))
                rows, place, visits = [], [], []
                for k, keys in enumerate(made.value.visited(_unit(matrix))):
                    at = _cell(keys, cells)
                    for cell in np.unique(at).tolist():
                        rows.append(cell)
                        place.append(k)
                        visits.append(keys[at == cell])
                taken = pa.array(place, pa.int64())
                arrays = [pa.array(rows, pa.int32()), pa.array(visits, pa.list_(pa.int64())), b.column(0).take(taken), _raw(matrix).take(taken)]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "buckets", "q", "raw"])

    entries = cut_lineage(held.select("rep", "v").mapInArrow(index, f"cell int, bucket long, rep {kind}, raw binary"))
    probes = asked.mapInArrow(probe, f"cell int, buckets array<long>, q {kind}, raw binary")
    large = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
    large = cut_lineage(large.select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    if not large.isEmpty():
        # A bucket of many vectors is split over groups by a hash of the vector, and its queries visit every part.
        probes = cut_lineage(probes)
        split = F.pmod(F.hash("bucket", F.pmod(F.hash("rep"), F.col("parts"))), F.lit(cells))
        entries = entries.join(large, "bucket", "left").withColumn("cell", F.coalesce(split, F.col("cell")))
        visits = probes.select(F.explode("buckets").alias("bucket"), "q", "raw").join(large, "bucket")
        copies = visits.select("bucket", "q", "raw", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("split"))
        moved = copies.select(F.pmod(F.hash("bucket", "split"), F.lit(cells)).alias("cell"), F.array("bucket").alias("buckets"), "q", "raw")
        probes = probes.unionByName(moved)
    left, right = entries.select("cell", "bucket", "rep", "raw"), probes.select("cell", "buckets", "q", "raw")
    both = left.repartition(cells, "cell").groupBy("cell").cogroup(right.repartition(cells, "cell").groupBy("cell"))

    def nearest(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(asking):
            order = np.argsort(own["bucket"].to_numpy(), kind="stable")
            buckets = own["bucket"].to_numpy()[order]
            reps, first, code = np.unique(own["rep"].to_numpy()[order], return_index=True, return_inverse=True)
            v = _scaled(np.frombuffer(b"".join(own["raw"].to_numpy()[order[first]]), np.float64).reshape(len(reps), -1))
            v_norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            visits: dict[object, list[np.ndarray]] = {}
            for name, some in zip(asking["q"], asking["buckets"], strict=True):
                visits.setdefault(name, []).append(np.asarray(some, np.int64))
            raw = dict(zip(asking["q"], asking["raw"], strict=True))
            for name, parts in visits.items():
                visited = np.unique(np.concatenate(parts))
                low, high = np.searchsorted(buckets, visited), np.searchsorted(buckets, visited, side="right")
                met = np.unique(np.concatenate([code[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
                if not len(met):
                    continue
                q = _scaled(np.frombuffer(raw[name], np.float64).reshape(1, -1))[0]
                some = v[met]
                score = np.einsum("ij,j->i", some, q) / (v_norm[met] * np.sqrt(np.einsum("i,i->", q, q)))
                best = np.lexsort((reps[met], -score))[:keep]
                out += [(name, reps[met[k]], float(score[k])) for k in best.tolist()]
        return pd.DataFrame(out, columns=["q", "rep", "score"])

    return both.applyInPandas(nearest, f"q {kind}, rep {kind}, score double")
