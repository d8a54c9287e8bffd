"""Token ids packed into rows of equal length, best fit decreasing.

Documents become token ids; what is longer than a row is cut, and its rest packed like a short document. Pieces go, from
long to short, to the open row with the least room that still takes them; a segment tree over the possible amounts of
room finds that row. Tasks pack portions of their documents, so no row needs another task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: An id that the vocabulary leaves free.
PAD = 50_256
LENGTH = 2048
#: Tokens that are packed together.
PORTION = 2_000_000

SCHEMA = (
    "part int, portion int, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
    "docs array<{kind}>, doc_rows array<long>, doc_offsets array<long>"
)


class Room:
    """Open rows by the room they have left: a segment tree counts them, the leaves hold them."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest room of at least `least`, and that room; it is open no more."""
        tree, node = self.tree, least + self.size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not tree[node]:
                    node += 1
        room = node - self.size
        row = self.rows[room].pop()
        self._change(room, -1)
        return row, room


def pack(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Rows of pieces `(document, offset, size)`, each of `length` tokens at most; every token of every document once."""
    pieces = [(min(length, n - at), k, at) for k, n in enumerate(lengths) for at in range(0, n, length)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    room, rows = Room(length), []
    for size, k, at in pieces:
        found = room.take(size)
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        row, left = found
        rows[row].append((k, at, size))
        if left > size:
            room.add(left - size, row)
    return rows


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack_tokens(
    docs: DataFrame, identifier: str = "doc_id", text: str = "text", length: int = LENGTH, path: str = VOCABULARY, pad: int = PAD
) -> DataFrame:
    """Rows of `length` token ids.

    `input_ids` and `position_ids` hold `length` little-endian unsigned 16-bit numbers (32-bit if `pad` or `length` needs
    them): the ids, filled up with `pad`, and the positions, which start from 0 at each piece. `cu_seqlens` are the places
    where pieces begin and the last one ends. `docs`, `doc_rows` and `doc_offsets` say for each piece which document it is
    from, that document's number among all (ids may repeat or be null) and its first token there; so all texts can be put together
    again. `(part, portion)` names the matrix a row belongs to, `row` its place there.

    Null and empty texts have no tokens and so no piece. Every row of `docs` is packed on its own, repeated ones too; an
    empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(identifier).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType
    wide = "<u2" if max(pad, length) < 1 << 16 else "<u4"
    ids_kind = to_arrow_type(kind)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, portion = TaskContext.get().partitionId(), 0
        encode = tokenizer(path).encode_to_numpy
        held, size, seen = [], 0, part << 40
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    ids = encode(t, disallowed_special=()).astype(wide)
                    held.append((key, seen, ids))
                    size += len(ids)
                seen += 1
                if size >= PORTION:
                    yield from rows(part, portion, held)
                    held, size, portion = [], 0, portion + 1
        if held:
            yield from rows(part, portion, held)

    def rows(part: int, portion: int, held: list) -> Iterator[pa.RecordBatch]:
        packed = pack([len(ids) for _, _, ids in held], length)
        steps = np.arange(length, dtype=wide)
        for start in range(0, len(packed), 2000):
            own = packed[start : start + 2000]
            matrix = np.full((len(own), length), pad, wide)
            positions = np.zeros((len(own), length), wide)
            bounds = []
            for r, pieces in enumerate(own):
                at, ends = 0, [0]
                for k, offset, size in pieces:
                    matrix[r, at : at + size] = held[k][2][offset : offset + size]
                    positions[r, at : at + size] = steps[:size]
                    at += size
                    ends.append(at)
                bounds.append(ends)
            arrays = [
                pa.array([part] * len(own), pa.int32()), pa.array([portion] * len(own), pa.int32()),
                pa.array(range(start, start + len(own)), pa.int32()), pa.array([b[-1] for b in bounds], pa.int32()),
                pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x.tobytes() for x in positions], pa.binary()),
                pa.array(bounds, pa.list_(pa.int32())), pa.array([[held[k][0] for k, _, _ in p] for p in own], pa.list_(ids_kind)),
                pa.array([[held[k][1] for k, _, _ in p] for p in own], pa.list_(pa.int64())),
                pa.array([[offset for _, offset, _ in p] for p in own], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return source.mapInArrow(over, SCHEMA.format(kind=kind.simpleString()))
