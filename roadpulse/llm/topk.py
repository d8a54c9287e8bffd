"""Exact search for the largest inner products by a uniform threshold in three phases.

The dimensions are dealt out to `LISTS` lists; a list scores a vector by its own dimensions, and a vector's score is the sum over
the lists. Vectors and queries are cut into blocks, and a task holds one list of one block of each.

1. Every task hands in the best of its own scores for each query. These vectors are scored in full, and the score that
   enough of them reach is a safe cutoff: no vector below it can be among the best.
2. The cutoff goes to all lists. A vector whose score reaches it has a share of at least the cutoff divided by the
   number of lists in one of them, so each list hands in the vectors that reach this share, and no other can be missed.
3. A vector that some lists have not handed in has less than the share there. Where that bound still leaves it a chance, the lists are
   asked for its missing scores.

Scores may be negative, so an unseen share has no lower bound: that is why the first phase scores its vectors in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import tasks
from roadpulse.llm.neighbours import distinct_vectors
from roadpulse.session import cut_lineage

NEAREST = 5
SCALE = 256
LISTS = 2
#: Whole numbers of a block of vectors, and of a block of queries: tables are cut into as many blocks as that takes.
BLOCK_NUMBERS, QUERY_NUMBERS = 1 << 20, 1 << 19
#: Scores that a task holds at once.
SCORES = 2_000_000
#: Vectors whose squares sum up to this or more take no part: their scores need not fit a long.
SQUARES = 1e18
#: Below every score of a list: what a list hands in where a query has no cutoff.
EVERYTHING = -(1 << 60)
#: Up to this product of lengths all sums in double precision are whole numbers and exact.
EXACT = float(1 << 53)

BLOCK = ["dim", "list", "v_block", "q_block"]


def quantised(vectors: DataFrame, identifier: str, vector: str, scale: int = SCALE) -> DataFrame:
    """`(id, v)`: floor(scale * x) of each component, for rows with an id and a vector that is not null or empty, holds no null or
    non-finite component and whose whole numbers have squares that sum to less than `SQUARES`."""
    taken = vectors.select(F.col(identifier).alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and size(x) > 0")
    finite = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    length = F.aggregate("x", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale))
    return taken.where(finite).where(length < SQUARES).select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def search(vectors: DataFrame, queries: DataFrame, identifier: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, scale: int = SCALE, lists: int = LISTS) -> DataFrame:
    """`(query_id, rank, <identifier>, score)`: the `nearest` rows of `vectors` with the largest inner product of whole numbers
    floor(scale * x), for each row of `queries`; equal scores go to the smaller id.

    A row is no candidate of itself, and vectors of another length are none. Rows whose id or vector is null, whose vector is
    empty, holds a null or non-finite component or is too long (`SQUARES`) take no part. Rows that agree in id and whole numbers
    count once; those that agree in the id alone are different rows, each with a search and ranks of its own. A query
    without candidates has no row; empty tables give no rows. Other columns are not read.
    """
    keep = nearest + 1
    # Numbers given once, in the tables as written: ids need not tell vectors apart.
    number = F.monotonically_increasing_id().alias("rep")
    held = cut_lineage(distinct_vectors(quantised(vectors, identifier, vector, scale), keep).select(number, "v", "ids"))
    asking = quantised(queries, identifier, vector, scale).dropDuplicates(["id", "v"])
    asked = cut_lineage(asking.select("v").distinct().select(number, "v"))
    found = totals(held.select("rep", "v"), asked, keep, lists).join(held.select("rep", "ids"), "rep")
    top = Window.partitionBy("q").orderBy(F.desc("total"), F.col("ids")[0])
    best = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= keep)
    named = best.select("q", "rep", F.col("total").alias("score"), F.explode("ids").alias("candidate"))
    # Every row with a query's vector asks for itself, and is left out where the vector found is its own.
    own = asked.select("v", F.col("rep").alias("q")).join(held.select("v", F.col("rep").alias("own")), "v", "left")
    same = asking.join(own, "v").select(F.col("id").alias("query_id"), "q", "own")
    met = same.join(named, "q").where((F.col("query_id") != F.col("candidate")) | ~F.col("rep").eqNullSafe(F.col("own")))
    last = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "candidate")
    ranked = met.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("candidate").alias(identifier), "score")


def totals(held: DataFrame, asked: DataFrame, keep: int, lists: int = LISTS) -> DataFrame:
    """`(q, rep, total)`: for each query the vectors that can be among its `keep` best, with their whole scores.

    `held` and `asked` have different vectors `v` under different numbers `rep`. All with the `keep` largest scores are there.
    """
    kind = held.schema["rep"].dataType.simpleString()
    lists_of = _Lists(held, asked, lists, kind)

    # 1. The best of each list and block, scored in full.
    seen = lists_of.visit(lists_of.queries(), _best(keep), f"q {kind}, rep {kind}").distinct()
    first = cut_lineage(lists_of.resolve(seen.withColumn("seen", F.array().cast("array<int>"))))
    cutoff = _nth(first, keep, "cutoff")

    # 2. All that reach the share of a list.
    share = F.expr("cutoff div lists + if(cutoff % lists > 0, 1, 0)")  # rounded up, in whole numbers
    told = lists_of.queries().join(cutoff, "q", "left").withColumn("share", F.coalesce(share, F.lit(EVERYTHING)))
    found = lists_of.visit(told, _sufficient, f"q {kind}, rep {kind}, list int, lists int, share long, score long")
    known = cut_lineage(
        found.groupBy("q", "rep").agg(
            F.sum("score").alias("known"), F.collect_list("list").alias("seen"), F.first("lists").alias("lists"), F.first("share").alias("share")
        )
    )
    whole = known.where(F.size("seen") == F.col("lists")).select("q", "rep", F.col("known").alias("total"))

    # 3. What the missing lists would have to add, where that can be enough.
    better = _nth(first.unionByName(whole).distinct(), keep, "cutoff")
    part = known.where(F.size("seen") < F.col("lists")).join(better, "q", "left")
    unseen = (F.col("lists") - F.size("seen")) * (F.col("share") - 1)
    left = cut_lineage(part.where(F.col("cutoff").isNull() | (F.col("known") + unseen >= F.col("cutoff"))).select("q", "rep", "known", "seen"))
    added = lists_of.resolve(left.select("q", "rep", "seen")).withColumnRenamed("total", "added")
    rest = left.join(added, ["q", "rep"]).select("q", "rep", (F.col("known") + F.col("added")).alias("total"))
    return whole.unionByName(rest)


def _nth(scored: DataFrame, n: int, name: str) -> DataFrame:
    """The n-th largest total of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total")))
    return scored.withColumn("place", place).where(F.col("place") <= n).where(F.col("place") == n).select("q", F.col("total").alias(name))


class _Lists:
    """Vectors and queries, cut into lists and blocks, as tables on disk."""

    def __init__(self, held: DataFrame, asked: DataFrame, lists: int, kind: str) -> None:
        spark, self.kind = held.sparkSession, kind
        n, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        m = asked.count()
        busy = 2 * spark.sparkContext.defaultParallelism
        # As many blocks as their size asks for; a small table is cut to keep all tasks busy.
        self.v_blocks = max(-(-n * width // BLOCK_NUMBERS), min(busy, -(-n // 1024)), 1)
        self.q_blocks = max(-(-m * width // QUERY_NUMBERS), 1)
        self.tasks = tasks(spark, 2 * self.v_blocks * self.q_blocks)
        self.vectors = cut_lineage(_cut(held, lists, kind, "rep").withColumn("v_block", self._block("rep", self.v_blocks)))
        self.asked = cut_lineage(_cut(asked, lists, kind, "q").withColumn("q_block", self._block("q", self.q_blocks)))

    @staticmethod
    def _block(name: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")

    def queries(self) -> DataFrame:
        """Every query's lists, once for each block of vectors."""
        return self.asked.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(self.v_blocks - 1))))

    def visit(self, queries: DataFrame, function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """`function(vectors, queries)` for each list of each pair of blocks."""
        copies = self.vectors.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(self.q_blocks - 1))))
        left, right = (df.repartition(self.tasks, *BLOCK).groupBy(*BLOCK) for df in (copies, queries))
        names = [field.split()[0] for field in schema.split(", ")]

        def one(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if own.empty or asking.empty:
                return pd.DataFrame(columns=names)
            return function(own, asking)[names]

        return left.cogroup(right).applyInPandas(one, schema)

    def resolve(self, pairs: DataFrame) -> DataFrame:
        """`(q, rep, total)`: the scores of `pairs(q, rep, seen)` added up over the lists that have not been `seen`."""
        placed = pairs.withColumn("v_block", self._block("rep", self.v_blocks))
        # A query asks a block for as many vectors as the block has, at most.
        wanted = placed.groupBy("q", "v_block").agg(F.collect_list(F.struct("rep", "seen")).alias("pairs"))
        asked = self.asked.join(wanted, "q")
        here = F.filter("pairs", lambda p: ~F.array_contains(p["seen"], F.col("list")))
        asked = asked.withColumn("wanted", F.transform(here, lambda p: p["rep"])).drop("pairs").where(F.size("wanted") > 0)
        scored = self.visit(asked, _asked_for, f"q {self.kind}, rep {self.kind}, score long")
        return scored.groupBy("q", "rep").agg(F.sum("score").alias("total"))


def _cut(vectors: DataFrame, lists: int, kind: str, name: str) -> DataFrame:
    """`(dim, list, lists, length, <name>, raw)`: the whole numbers of each list, and the length of the whole vector."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1)], np.int64)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                length = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
                used = min(lists, dim)
                for k in range(used):
                    own = np.ascontiguousarray(matrix[:, dim * k // used : dim * (k + 1) // used])
                    flat = [pa.array(np.full(len(part), v, np.int32)) for v in (dim, k, used)]
                    raw = pa.array([row.tobytes() for row in own], pa.binary())
                    yield pa.RecordBatch.from_arrays([*flat, pa.array(length), part.column(0), raw], names=["dim", "list", "lists", "length", name, "raw"])

    return vectors.select("rep", "v").mapInArrow(cut, f"dim int, list int, lists int, length double, {name} {kind}, raw binary")


def _numbers(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["raw"]), np.int64).reshape(len(pdf), -1)


def _products(own: pd.DataFrame, asking: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of all vectors for some queries at a time, exact whole numbers either way."""
    exact = own["length"].max() * asking["length"].max() * (1 + 1e-9) < EXACT
    v, q = _numbers(own), _numbers(asking)
    if exact:
        v, q = v.astype(np.float64), q.astype(np.float64)
    step = max(1, SCORES // len(own))
    for i in range(0, len(asking), step):
        some = slice(i, i + step)
        yield some, q[some] @ v.T


def _best(keep: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        reps, names, out = own["rep"].to_numpy(), asking["q"].to_numpy(), []
        most = min(keep, len(own))
        for some, score in _products(own, asking):
            place = np.argpartition(score, len(own) - most, axis=1)[:, len(own) - most :]
            out.append(pd.DataFrame({"q": np.repeat(names[some], most), "rep": reps[place].ravel()}))
        return pd.concat(out)

    return best


def _sufficient(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """All vectors that have a list's share of the query's cutoff."""
    reps, names, shares, out = own["rep"].to_numpy(), asking["q"].to_numpy(), asking["share"].to_numpy(), []
    lists, number = int(own["lists"].iloc[0]), int(own["list"].iloc[0])
    for some, score in _products(own, asking):
        score = score.astype(np.int64)
        row, place = np.nonzero(score >= shares[some][:, None])
        out.append(pd.DataFrame({"q": names[some][row], "rep": reps[place], "share": shares[some][row], "score": score[row, place]}))
    return pd.concat(out).assign(list=np.int32(number), lists=np.int32(lists))


def _asked_for(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """Scores of the vectors that each query wants."""
    v, q, out = _numbers(own), _numbers(asking), []
    place = pd.Series(np.arange(len(own)), index=own["rep"])
    for k, (name, wanted) in enumerate(zip(asking["q"], asking["wanted"], strict=True)):
        out.append(pd.DataFrame({"q": name, "rep": wanted, "score": v[place.loc[list(wanted)].to_numpy()] @ q[k]}))
    return pd.concat(out)


ORACLE = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON (q.vec_id <> c.vec_id OR q.v <> c.v) AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
