"""Near duplicates by a Jaccard join on word n-grams.

MinHash signatures are cut into bands, whose number and rows are chosen for a target recall; texts meet where a band's hash is
equal, and their full n-gram sets decide. Texts with the same set are one node from the start. Small buckets give
pairs; the members of large ones are compared in blocks, which count links and hand on a spanning forest, so that a group
of thousands of near copies never becomes a table of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import free_name, lean, tasks, to_all, words
from roadpulse.session import cut_lineage

SIZE = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Hash functions a signature may have.
HASHES = 128
#: Texts of a bucket up to which its pairs are listed; a larger bucket goes to blocks.
SMALL = 16
#: N-grams and texts that a block of a large group has at most, on average.
BLOCK, BLOCK_TEXTS = 150_000, 1500

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows per band for which a pair of `similarity` shares a band with chance `recall`."""
    for rows in range(hashes, 0, -1):
        equal = similarity**rows
        count = 1 if equal >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-equal)) if equal > 1e-12 else hashes + 1
        if count * rows <= hashes:
            return count, rows
    raise ValueError("no number of bands reaches the recall with so few hashes")


class _Hashes(dict):
    """A 64-bit hash for each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(found: list[bytes], size: int, hash_of: _Hashes) -> np.ndarray:
    """Sorted hashes of the different n-grams of a text; a shorter text that has words is one n-gram."""
    if not found:
        return np.zeros(0, np.uint64)
    single = np.fromiter(map(hash_of.__getitem__, found), np.uint64, len(found))
    size = min(size, len(single))
    grams = np.zeros(len(single) - size + 1, np.uint64)
    for k in range(size):
        grams = (grams ^ (grams >> np.uint64(31))) * _STEP + single[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(grams ^ (grams >> np.uint64(32)))


def _signatures(sets: list[np.ndarray], count: int, rows: int) -> np.ndarray:
    """Band hashes of non-empty sets: `count` columns, each a hash of the band's number and its `rows` least values."""
    random = np.random.default_rng(11)
    factors = random.integers(0, 1 << 63, count * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, count * rows, dtype=np.uint64)
    out = np.zeros((len(sets), count), np.uint64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 50_000):
            size += len(sets[stop])
            stop += 1
        whole = np.concatenate(sets[start:stop])
        firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : stop - 1]])]).astype(np.int64)
        for band in range(count):
            key = np.full(stop - start, band + 1, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                least = np.minimum.reduceat(whole * factors[k] + shifts[k], firsts)
                key = (key ^ least) * _STEP
                key ^= key >> np.uint64(29)
            out[start:stop, band] = key
        start = stop
    return out


def _parts(texts: list[str | None], most: int = 500_000) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def signed(docs: DataFrame, text: str, size: int, count: int, rows: int) -> DataFrame:
    """`(id, text_key, content, n, bands)`: content names the n-gram set; it is null where there is none."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = _Hashes()
        for batch in batches:
            start = 0
            for part in _parts(batch.column(2).to_pylist()):
                sets = [shingles(words(t), size, hash_of) for t in part]
                full = [k for k, s in enumerate(sets) if len(s)]
                signature = _signatures([sets[k] for k in full], count, rows).astype(np.int64)
                content, listed = [None] * len(sets), [None] * len(sets)
                for k, row in zip(full, signature, strict=True):
                    content[k], listed[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row
                own = batch.slice(start, len(part))
                arrays = [own.column(0), own.column(1), pa.array(content, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(listed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_key", "content", "n", "bands"])
                start += len(part)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text_key", text).mapInArrow(lean(over), f"id {kind}, text_key binary, content binary, n long, bands array<long>")


def n_gram_sets(texts: DataFrame, size: int) -> DataFrame:
    """`(content, grams)` of `texts(content, text)`."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = _Hashes()
        for batch in batches:
            start = 0
            for part in _parts(batch.column(1).to_pylist()):
                sets = [shingles(words(t), size, hash_of).astype(np.int64) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(sets, pa.list_(pa.int64()))], names=["content", "grams"])
                start += len(part)

    return texts.select("content", "text").mapInArrow(lean(over), "content binary, grams array<long>")


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for the nodes of `edges(a, b)`: the least node each is connected with.

    Large and small stars in turn hang every node on the least neighbour until nothing changes. Each round is written to
    the shared folder; the least neighbour is pre-aggregated, so a hub costs a row per task, and joined as a table of its
    own, so Spark can send it to all tasks or split a hub's edges over several.
    """
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if before == state or not state["n"]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("own"))
        pairs = hung.select("a", "b").unionByName(hung.select(F.col("own").alias("a"), "b"))
        edges = cut_lineage(pairs.where(F.col("a") != F.col("b")).distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _block_links(sets: list[np.ndarray], side: np.ndarray, weights: np.ndarray, similarity: float, same: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For sets on sides 0 and 1 (`same`: all on one), each set's links to the other side, weighted, and a spanning
    forest of them. Shared n-grams are counted by products of 0/1 matrices over the n-grams that several sets have."""
    sizes = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[gram] > 1
    column = np.cumsum(times > 1)[gram[keep]] - 1
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left = np.arange(len(sets)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    place = np.zeros(len(sets), np.int64)
    place[left] = np.arange(len(left))
    if not same:
        place[right] = np.arange(len(right))
    shared = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, start), np.searchsorted(column, start + width)
        rows, cols = owner[lo:hi], column[lo:hi] - start
        a = np.zeros((len(left), width), np.float32)
        if same:
            a[rows, cols] = 1
            shared += a @ a.T
        else:
            b = np.zeros((len(right), width), np.float32)
            at = side[rows] == 0
            a[place[rows[at]], cols[at]] = 1
            b[place[rows[~at]], cols[~at]] = 1
            shared += a @ b.T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    linked = shared >= np.float32(similarity) * union - np.float32(1e-3)
    linked &= shared.astype(np.float64) / union >= similarity - 1e-12
    if same:
        np.fill_diagonal(linked, False)
    counts = np.zeros(len(sets), np.int64)
    counts[left] += linked @ weights[right]
    if not same:
        counts[right] += linked.T @ weights[left]
    label = np.arange(len(sets))
    while True:
        old = label.copy()
        far = np.where(linked, label[right][None, :], len(sets)).min(axis=1, initial=len(sets))
        label[left] = np.minimum(label[left], far)
        far = np.where(linked, label[left][:, None], len(sets)).min(axis=0, initial=len(sets))
        label[right] = np.minimum(label[right], far)
        label = label[label]
        if (label == old).all():
            break
    return counts, [(k, int(root)) for k, root in enumerate(label) if k != root]


def _large_groups(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """`(content, links, other)`: parts of link counts and edges of a spanning forest, from blocks of large groups."""
    spark = members.sparkSession
    sized = members.join(nodes.select("content", "n", "copies"), "content")
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("parts")
    totals = sized.groupBy("root").agg(parts)
    placed = sized.join(totals, "root").withColumn("own", F.pmod(F.hash("content"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = placed.select("root", "content", "copies", "own", other).select(
        "root", "content", "copies", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    full = spread.join(sets, "content")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        same = group["i"].iloc[0] == group["j"].iloc[0]
        group = group.sort_values("content").reset_index(drop=True)
        side = group["side"].to_numpy()
        content = group["content"].to_numpy()
        if not same and (side.min() == side.max()):
            return pd.DataFrame([], columns=["content", "links", "other"])
        counts, edges = _block_links([np.asarray(g) for g in group["grams"]], side, group["copies"].to_numpy(), similarity, same)
        linked = np.flatnonzero(counts)
        rows = [(content[k], int(counts[k]), None) for k in linked.tolist()] + [(content[a], 0, content[b]) for a, b in edges]
        return pd.DataFrame(rows, columns=["content", "links", "other"])

    keys = ["root", "i", "j"]
    return full.repartition(tasks(spark), *keys).groupBy(*keys).applyInPandas(compare, "content binary, links long, other binary")


def classes(docs: DataFrame, identifier: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs`: `(<identifier>, class_id, n_links, class_size)`.

    Rows are linked if the Jaccard similarity of their word n-gram sets reaches `similarity`; a class is what links
    connect, `class_id` its least id, `n_links` the number of other rows a row is linked with. Pairs of at least `similarity` meet
    with chance `recall` or more; those that meet are decided on their full sets. A text of fewer than `size` words is one
    n-gram. Null and empty texts, and those without words, are alike to nothing: each row is a class of its own. Repeated
    rows are linked; a null id counts as a row but names a class only if no row of it has an id. An empty table gives no
    rows; other columns are not read.
    """
    return _classes(docs, identifier, text, size, similarity, recall).select(F.col("id").alias(identifier), "class_id", "n_links", "class_size")


def _classes(docs: DataFrame, identifier: str, text: str, size: int, similarity: float, recall: float) -> DataFrame:
    count, rows = bands(similarity, recall)
    source = docs.select(F.col(identifier).alias("id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("text_key"), F.col(text).alias("text"))
    known = cut_lineage(signed(source, "text", size, count, rows))
    filled = known.where(F.col("content").isNotNull())
    nodes = cut_lineage(
        filled.groupBy("content").agg(
            F.count("*").alias("copies"), F.min("id").alias("least_id"), F.min(F.struct("text_key", "id")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
    )
    member = nodes.select("content", F.explode("bands").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count("*").alias("met"), F.min("content").alias("first")).where(F.col("met") > 1)
    met = cut_lineage(member.join(crowded, "bucket").select("bucket", "content", "met", "first"))

    # One row of each set that may have a partner hands in its text, however many copies there are.
    chosen = met.select("content").distinct().join(nodes.select("content", "row"), "content")
    chosen = to_all(cut_lineage(chosen.select("content", F.col("row.text_key").alias("own_key"), F.col("row.id").alias("own_id"))))
    own = source.join(chosen, (F.col("text_key") == F.col("own_key")) & F.col("id").eqNullSafe(F.col("own_id")))
    texts = own.groupBy("content").agg(F.first("text").alias("text"))
    sets = cut_lineage(n_gram_sets(texts, size))

    large = met.where(F.col("met") > SMALL)
    groups = cut_lineage(components(large.select(F.col("content").alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", "content"))
    blocks = cut_lineage(_large_groups(groups, nodes, sets, similarity))

    listed = met.where(F.col("met") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_set("content")).alias("all"))
    first = listed.select(F.posexplode("all").alias("k", "a"), "all")
    pairs = first.select("a", F.explode(F.slice("all", F.col("k") + 2, F.lit(SMALL))).alias("b")).distinct()
    near = nodes.select("content", "n", "copies")
    pairs = pairs.join(near.toDF("a", "n_a", "copies_a"), "a").join(near.toDF("b", "n_b", "copies_b"), "b")
    pairs = pairs.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    pairs = pairs.join(groups.toDF("a", "root_a"), "a", "left").join(groups.toDF("b", "root_b"), "b", "left")
    pairs = pairs.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).select("a", "b", "n_a", "n_b", "copies_a", "copies_b")
    both = pairs.join(sets.toDF("b", "grams_b"), "b").join(sets.toDF("a", "grams_a"), "a")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    linked = both.withColumn("shared", shared).where(F.col("shared") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("shared")) - 1e-9)
    linked = cut_lineage(linked.select("a", "b", "copies_a", "copies_b"))

    forest = linked.select("a", "b").unionByName(blocks.where("other is not null").select(F.col("content").alias("a"), F.col("other").alias("b")))
    roots = components(forest)
    one = linked.select(F.col("a").alias("content"), F.col("copies_b").alias("links")).unionByName(linked.select(F.col("b").alias("content"), F.col("copies_a").alias("links")))
    links = one.unionByName(blocks.select("content", "links")).groupBy("content").agg(F.sum("links").alias("links"))
    graph = nodes.select("content", "copies", "least_id").join(links, "content", "left")
    graph = graph.join(roots.withColumnRenamed("node", "content"), "content", "left")
    graph = cut_lineage(graph.select("content", F.coalesce("root", "content").alias("root"), "copies", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = graph.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    decided = graph.join(named, "root").select("content", "class_id", "n_links", "class_size", "root")
    out = known.select("id", "text_key", "content").join(decided, "content", "left")
    return out.select(
        "id", "text_key", "content", "root",
        F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, identifier: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` less all but one of each class, with the columns of `docs`.

    The row with the least id stays (a null id comes last); of rows that share it, the one with the least text, then any one.
    Rows without words are classes of their own and stay.
    """
    made = cut_lineage(_classes(docs, identifier, text, size, similarity, RECALL).where(F.col("class_size") > 1))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    best = made.groupBy("root").agg(F.min(rank).alias("least"))
    judged = made.join(best, "root").withColumn("stays", F.col("least").eqNullSafe(rank))
    gone = to_all(cut_lineage(judged.where(~F.col("stays")).select("id", "text_key").distinct()).toDF("_gone_id", "_gone_key"))
    again = cut_lineage(judged.where("stays").groupBy("id", "text_key").agg(F.count("*").alias("times")).where(F.col("times") > 1))
    key = free_name(docs, "_text_key")
    left = docs.withColumn(key, F.unhex(F.md5(F.col(text).cast("binary"))))

    def same() -> Column:
        return F.col(key).eqNullSafe(F.col("_gone_key")) & F.col(identifier).eqNullSafe(F.col("_gone_id"))

    kept = left.join(gone, same(), "left_anti")
    if not again.isEmpty():
        repeated = again.select(F.col("id").alias("_gone_id"), F.col("text_key").alias("_gone_key"))
        once = kept.join(repeated, same(), "left_semi").dropDuplicates([key, identifier])
        kept = kept.join(repeated, same(), "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE c * 10 >= (nx.n + ny.n - c) * 8),
reach AS (SELECT r, r AS s FROM d UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.s = links.x),
class AS (SELECT reach.r, min(o.doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d o ON o.r = reach.s GROUP BY reach.r),
degree AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, CAST(class_size AS BIGINT) AS class_size
FROM d JOIN class USING (r) LEFT JOIN degree USING (r)
"""
