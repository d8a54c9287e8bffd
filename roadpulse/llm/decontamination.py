"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by blocks of documents. A block numbers its words through, leaving a gap after each document, and keeps
for every term the places it stands at. A phrase is looked up by its rarest term first: the places of each further term,
less its offset, are intersected with what is left. A block meets only the phrases whose rarest term it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import free_name, from_varint, lean, portions, tasks, varint, words
from roadpulse.session import cut_lineage

WINDOW = 10
#: Words of a block; one longer document is a block of its own.
BLOCK_WORDS = 1_000_000
#: Windows that meet a block in one task.
CHUNK_WINDOWS = 20_000
#: The term under which a block keeps where its documents begin; no word is empty.
STARTS = b""

POSTINGS = "part int, block int, term binary, n long, places binary"
DOCUMENTS = "part int, block int, slot int, n_words long, doc binary"


@dataclass
class Index:
    """`postings(part, block, term, n, places)` and `documents(part, block, slot, n_words, <id>)`, both tables on disk.

    `part` and `block` name a block, `slot` a document in it, in order of their first places.
    """

    postings: DataFrame
    documents: DataFrame
    identifier: str


class _Block:
    """A block in the making. Words become numbers as their document comes in, so that no text is held."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []
        self.ids: list[object] = []
        self.size = 0

    def add(self, key: object, found: list[bytes]) -> None:
        numbers = self.numbers
        self.pieces.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
        self.ids.append(key)
        self.size += len(found)

    def packed(self) -> tuple[list[bytes], list[int], list[bytes], list[int]]:
        """Terms in order, how often each stands, and its packed places; the documents' starts come first. And the
        documents' numbers of words."""
        lengths = np.array([len(p) for p in self.pieces], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        term = np.concatenate(self.pieces).astype(np.int64)
        self.pieces = []
        keyed = term << 32 | (np.arange(len(term)) + np.repeat(np.arange(len(lengths)), lengths))
        del term
        keyed.sort()
        # Each array goes before the next stage needs room: a block's peak is what its executor must hold.
        term = (keyed >> 32).astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        del term
        keyed &= 0xFFFFFFFF
        gaps = np.diff(keyed, prepend=0)
        gaps[first] = keyed[first]
        stop = np.append(first[1:], len(keyed)) if len(first) else first
        del keyed
        data, ends = varint(gaps)
        del gaps
        bounds = np.concatenate([[0], ends])
        raw = data.tobytes()
        packed = [raw[a:b] for a, b in zip(bounds[first].tolist(), bounds[stop].tolist(), strict=True)]
        head = varint(np.diff(starts, prepend=0))[0].tobytes()
        return [STARTS, *self.numbers], [len(starts), *(stop - first).tolist()], [head, *packed], lengths.tolist()


def places(packed: bytes) -> np.ndarray:
    return np.cumsum(from_varint(packed))


def build_index(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> Index:
    """Index every word of every text of `docs`. Null and empty texts are documents without words.

    Ids may repeat or be null: a document is known by block and slot. Both parts come from one pass over the texts,
    written to the shared folder, so a task that runs again leaves one copy.
    """
    source = docs.select(F.col(identifier).alias("id"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for portion in portions(batch, 1):
                for key, t in zip(portion.column(0).to_pylist(), portion.column(1).to_pylist(), strict=True):
                    block.add(key, words(t))
                    if block.size >= BLOCK_WORDS or len(block.ids) >= BLOCK_WORDS // 10:
                        yield from rows(part, number, block)
                        number, block = number + 1, _Block()
        if block.ids:
            yield from rows(part, number, block)

    kind = pa.field("id", _arrow_kind(source))

    def rows(part: int, block: int, made: _Block) -> Iterator[pa.RecordBatch]:
        ids = made.ids
        terms, counts, packed, lengths = made.packed()
        for start in range(0, max(len(terms), len(ids)), 100_000):
            t, c, p = (x[start : start + 100_000] for x in (terms, counts, packed))
            own = ids[start : start + 100_000]
            n, m = len(t), len(own)
            slots = list(range(start, start + m))
            arrays = [
                pa.array([part] * (n + m), pa.int32()), pa.array([block] * (n + m), pa.int32()),
                pa.array([*t, *[None] * m], pa.binary()),
                pa.array([*c, *lengths[start : start + 100_000]], pa.int64()),
                pa.array([*p, *[None] * m], pa.binary()), pa.array([*[None] * n, *slots], pa.int32()),
                pa.array([*[None] * n, *own], kind.type),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "term", "n", "places", "slot", "id"])

    made = source.mapInArrow(lean(build), f"{POSTINGS}, slot int, id {source.schema['id'].dataType.simpleString()}")
    table = cut_lineage(made)
    documents = table.where(F.col("slot").isNotNull()).select("part", "block", "slot", F.col("n").alias("n_words"), "id")
    return Index(table.where(F.col("term").isNotNull()).select("part", "block", "term", "n", "places"), documents, identifier)


def _arrow_kind(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)


def test_windows(items: DataFrame, identifier: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`(number, item, start, terms)`: every `size` consecutive words of an item; an item of fewer, but not none, is one
    window. `number` tells items apart, as ids may repeat or be null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, key, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = words(t)
                starts = list(range(max(1, len(found) - size + 1))) if found else []
                for i in range(0, len(starts), 10_000):
                    own = starts[i : i + 10_000]
                    arrays = [
                        pa.array([number] * len(own), pa.int64()), pa.array([key] * len(own), pa.string()), pa.array(own, pa.int64()),
                        pa.array([found[s : s + size] for s in own], pa.list_(pa.binary())),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["number", "item", "start", "terms"])

    taken = items.select(F.monotonically_increasing_id(), F.col(identifier).cast("string"), F.col(text))
    return taken.mapInArrow(lean(cut), "number long, item string, start long, terms array<binary>")


test_windows.__test__ = False


def _runs(start: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Union of [s, s + size) for sorted starts."""
    if not len(start):
        return []
    breaks = np.flatnonzero(start[1:] > start[:-1] + size) + 1
    return [(int(p[0]), int(p[-1]) + size) for p in np.split(start, breaks)]


def phrase(terms: list[bytes], order: list[int], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Places where `terms` stand in a row: the list of the rarest, narrowed by each further one less its offset."""
    left = None
    for k in order:
        own = lists.get(terms[k])
        if own is None:
            return np.zeros(0, np.int64)
        if left is None:
            left = own - k
            left = left[left >= 0]
        else:
            at = np.searchsorted(own, left + k)
            left = left[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == left + k)]
        if not len(left):
            break
    return left


def near(terms: list[bytes], order: list[int], lists: dict[bytes, np.ndarray], span: int) -> list[tuple[int, int]]:
    """Stretches of at most `span` places that hold all different `terms` in any order, each from a first to a last term."""
    distinct = list(dict.fromkeys(terms[k] for k in order))
    if any(t not in lists for t in distinct):
        return []
    anchors = lists[distinct[0]]
    starts = anchors
    for t in distinct[1:]:
        own = lists[t]
        low, high = np.searchsorted(own, anchors - span + 1), np.searchsorted(own, anchors + span)
        anchors = anchors[high > low]
        if not len(anchors):
            return []
    for t in distinct:
        own = lists[t]
        place = np.searchsorted(anchors, own)
        after = anchors[np.minimum(place, len(anchors) - 1)] - own
        starts = np.union1d(starts, own[(after >= 0) & (after < span)])
    end = starts.copy()
    good = np.ones(len(starts), bool)
    for t in distinct:
        own = lists[t]
        at = np.searchsorted(own, starts)
        good &= at < len(own)
        end = np.maximum(end, own[np.minimum(at, len(own) - 1)])
    good &= end - starts < span
    starts, end = starts[good], end[good] + 1
    least = np.append(end[:-1] < end[1:], True) if len(end) else np.zeros(0, bool)  # of those that end alike the shortest
    return list(zip(starts[least].tolist(), end[least].tolist(), strict=True))


def search(index: Index, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """`(part, block, slot, item, first, last)`: the stretches [first, last) of a document's words that match an item.

    Without `slop` a match is a window's words in a row, and windows of an item that overlap or touch make one stretch. With it, a
    match holds all different words of a window, in any order, within the window's length plus `slop` words.
    """
    spark = windows.sparkSession
    windows = cut_lineage(windows)
    chunks = max(1, -(-windows.count() // CHUNK_WINDOWS))
    chunk = F.pmod(F.hash("number", F.floor(F.col("start") / 1000)), F.lit(chunks)).alias("chunk")
    numbered = windows.select(chunk, "number", "start", "terms")
    wanted = numbered.select("chunk", F.explode("terms").alias("term")).distinct()
    terms = wanted.select("term").distinct()
    common = index.postings.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_all"))
    common = cut_lineage(wanted.join(common, "term"))
    # Postings of the test terms, for each chunk that asks for them, and where the block's documents start.
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    starts = index.postings.where(F.length("term") == 0).select("part", "block", every, "term", F.lit(0).cast("long").alias("n_all"), "places")
    lists = index.postings.join(common, "term").select("part", "block", "chunk", "term", "n_all", "places").unionByName(starts)
    # A window goes to the blocks that hold its rarest term; a term that no document holds rules its window out.
    spread = numbered.select("chunk", "number", "start", "terms", F.posexplode("terms").alias("k", "term"))
    known = spread.join(common.select("chunk", "term", "n_all"), ["chunk", "term"], "left")
    rarest = known.groupBy("chunk", "number", "start", "terms").agg(
        F.min(F.struct(F.coalesce("n_all", F.lit(0)).alias("n"), "term")).alias("least")
    )
    rarest = rarest.where(F.col("least.n") > 0).select("chunk", "number", "start", "terms", F.col("least.term").alias("term"))
    holding = index.postings.select(F.col("part").alias("in_part"), F.col("block").alias("in_block"), "term")
    asked = holding.join(rarest, "term").select("in_part", "in_block", F.col("chunk").alias("in_chunk"), "number", "start", "terms")
    keys, asked_keys, size = ["part", "block", "chunk"], ["in_part", "in_block", "in_chunk"], tasks(spark)
    both = lists.repartition(size, *keys).groupBy(*keys).cogroup(asked.repartition(size, *asked_keys).groupBy(*asked_keys))

    def one(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            rank = dict(zip(own["term"], own["n_all"], strict=True))
            packed = dict(zip(own["term"], own["places"], strict=True))
            lists = _Lists(packed)
            heads = lists[STARTS]
            for number, group in asking.groupby("number", sort=False):
                found, size = [], len(group["terms"].iloc[0])
                for whole in group["terms"]:
                    terms = list(whole)
                    order = sorted(range(len(terms)), key=lambda k: (rank.get(terms[k], 0), k))
                    if any(t not in packed for t in terms):
                        continue
                    if slop is None:
                        found.append(phrase(terms, order, lists))
                    else:
                        found += near(terms, order, lists, len(terms) + slop)
                if slop is None:
                    spans = _runs(np.unique(np.concatenate(found)), size) if found else []
                else:
                    spans = sorted(set(found))
                for a, b in spans:
                    slot = int(np.searchsorted(heads, a, side="right")) - 1
                    if slot + 1 < len(heads) and b > heads[slot + 1]:
                        continue  # words of two documents
                    out.append((int(own["part"].iloc[0]), int(own["block"].iloc[0]), slot, number, a - int(heads[slot]), b - int(heads[slot])))
        return pd.DataFrame(out, columns=["part", "block", "slot", "number", "first", "last"])

    found = both.applyInPandas(one, "part int, block int, slot int, number long, first long, last long")
    named = windows.select("number", "item").distinct()
    return found.join(named, "number").select("part", "block", "slot", "item", "first", "last")


class _Lists(dict):
    """Places of a term, unpacked when first asked for."""

    def __init__(self, packed: dict[bytes, bytes]) -> None:
        super().__init__()
        self.packed = packed

    def __contains__(self, term: object) -> bool:
        return term in self.packed

    def get(self, term: bytes, default: object = None) -> object:
        return self[term] if term in self.packed else default

    def __missing__(self, term: bytes) -> np.ndarray:
        self[term] = found = places(self.packed[term])
        return found


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """`(<doc_id>, item, first, last)`: exact (or, with `slop`, proximity) matches of `items` in `docs`; see `search`."""
    index = build_index(docs, doc_id, text)
    found = search(index, test_windows(items, item_id, item_text, size), slop)
    return found.join(index.documents, ["part", "block", "slot"]).select(F.col("id").alias(doc_id), "item", "first", "last")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: `(<doc_id>, n_words, n_hit, items)`.

    `n_hit` counts the words inside any exact match, each once; `items` are the ids of the matched items as sorted strings
    (a null id matches but is not named). Null and empty texts have no words. Repeated rows and ids each keep their row;
    without items, or with empty ones, nothing is hit; an empty table stays empty. Other columns are not read.
    """
    index = build_index(docs, doc_id, text)
    found = search(index, test_windows(items, item_id, item_text, size))
    return _per_document(index, found).select(F.col("id").alias(doc_id), "n_words", "n_hit", "items")


def _per_document(index: Index, found: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    keys = ["part", "block", "slot"]
    ahead = Window.partitionBy(*keys).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("last").over(ahead), F.lit(0))
    new = found.withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest("first", covered)))
    per = new.groupBy(*keys).agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    return index.documents.join(per, keys, "left").withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    )


def reject(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of `docs` that hold no window of any item, with the columns of `docs`.

    Rows are told apart by a checksum of their text, so that repeated or null ids do no harm.
    """
    key = free_name(docs, "_text_key")
    keyed = docs.withColumn(key, F.sha2(F.col(text), 256))
    bad = matches(keyed, items, key, text, item_id, item_text, size).select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT DISTINCT r, item_id, i, k FROM grams JOIN win USING (k, s)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n, string_agg(t, ',' ORDER BY t) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
