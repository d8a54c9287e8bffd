"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII capitals become small letters; every other ASCII character that is no digit or letter becomes a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Bytes of text that a worker turns into Python objects at a time.
PORTION_BYTES = 4_000_000

#: What a worker keeps between tasks, with the module it is for.
_KEPT: list[tuple[str, Callable]] = []


def words(text: str | None) -> list[bytes]:
    """Words of a whole text: runs of digits, ASCII letters (lower-cased) and any other character beyond ASCII."""
    return [] if text is None else text.encode().translate(WORD_BYTES).split()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(spark: SparkSession, least: int = 0) -> int:
    """A number of shuffle partitions that follows the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least, 2)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if `df` already has such a column (names count as equal whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def to_all(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df`, a written table, marked for sending to all tasks if it has at most `rows` rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def crc_part(identifier: Column) -> Column:
    """0 to 3: the part of the rows an id belongs to, from its checksum as text. Part 2 is held out; null has no part."""
    return F.crc32(identifier.cast("string").cast("binary")) % 4


def crc_part_of(identifier: object) -> int:
    """The same part, outside Spark."""
    return zlib.crc32(str(identifier).encode()) % 4


def map_text(df: DataFrame, text: str, result: T.StructType, make: object, *args: object) -> DataFrame:
    """`df` with the fields of `result` appended, computed from the column `text`.

    `make(*args)` is called once per task and returns a function from a list of texts (None for null) to a list of
    columns, each a list or an Arrow array. All other columns pass through untouched, whatever their names; a result
    name that `df` already has gets a trailing underscore, see `free_name`.
    """
    names = [free_name(df, field.name) for field in result]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, f.dataType, True) for n, f in zip(names, result, strict=True)]])
    place = df.columns.index(text)
    kinds = [_arrow(field.dataType) for field in result]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make(*args)
        for whole in batches:
            for batch in portions(whole, place):
                made = function(batch.column(place).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return df.mapInArrow(lean(over, make.__module__), schema)


def kept(function: Callable) -> Callable:
    """Results that a worker keeps between the tasks of one operator: those of the module that `function` is from."""
    cached = functools.lru_cache(maxsize=2)(function)
    _KEPT.append((function.__module__, cached))
    return cached


def forget(owner: str | None) -> None:
    """Drop what operators other than `owner` keep in this worker."""
    for module, cached in _KEPT:
        if module != owner:
            cached.cache_clear()


def give_back() -> None:
    """Return freed memory to the system. A worker serves one stage after another, and keeps what the last one has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """`function` over the batches of a task, returning freed memory before and after.

    An executor keeps more workers than it has cores where stages call several functions, and lets them take turns: what an idle
    one holds adds to the others. What other operators than `owner`, the function's module if not given, have kept goes first.
    """
    owner = owner or function.__module__

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        forget(owner)
        give_back()
        yield from function(batches)
        give_back()

    return run


def portions(batch: pa.RecordBatch, place: int, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts have about `most` bytes together; one longer text is a slice of its own."""
    sizes = np.cumsum([n or 0 for n in pc.binary_length(batch.column(place)).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _arrow(kind: T.DataType) -> pa.DataType:
    return {
        T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(),
    }[kind]


def varint(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits each, lowest first; the high bit says that more follow.

    Returns the bytes of all numbers and the place where each number ends.
    """
    values = numbers.astype(np.uint64)
    length = np.ones(len(values), np.int8)
    rest = values >> np.uint64(7)
    while rest.any():
        length += rest > 0
        rest >>= np.uint64(7)
    del rest
    ends = np.cumsum(length, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - length
    for i in range(int(length.max()) if len(length) else 0):
        here = length > i
        low = (values[here] >> np.uint64(7 * i)) & np.uint64(0x7F)
        out[start[here] + i] = (low | np.where(length[here] > i + 1, np.uint64(0x80), np.uint64(0))).astype(np.uint8)
    return out, ends


def from_varint(data: bytes) -> np.ndarray:
    """The numbers behind `varint` bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 0x80
    group = np.concatenate([[0], np.cumsum(last)[:-1]])
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - first[group])
    out = np.zeros(int(last.sum()), np.int64)
    np.add.at(out, group, (raw & 0x7F).astype(np.int64) << shift)
    return out
