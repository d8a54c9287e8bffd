"""Byte-level BPE encoding and decoding.

Text is split into pre-tokens. Tier one looks a pre-token up whole, in a minimal perfect hash over the vocabulary. Tier
two merges the bytes of the others: a heap gives the pair of lowest rank, a linked list joins its sides.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadpulse.llm.common import kept, map_text

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pre-tokens whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000

_MASK = (1 << 64) - 1
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, one displacement for about four keys.

    Buckets go in order of falling size; each takes the first displacement that sends its keys to free slots. A bucket
    of one key keeps its slot itself, as a negative number, so that the last free slots need no search.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.size = len(keys)
        self.buckets = max(1, self.size // 4)
        self.moves = array("q", bytes(8 * self.buckets))
        self.keys: list[bytes | None] = [None] * self.size
        self.places = array("q", bytes(8 * self.size))
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        taken = np.zeros(self.size, bool)
        free = None
        for bucket, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) > 1:
                move, slots = self._displacement(np.array([hashes[i] for i in own], np.uint64), taken)
            else:
                free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
                slots = [next(free)]
                move = -slots[0] - 1
            self.moves[bucket] = move
            for i, slot in zip(own, slots, strict=True):
                taken[slot], self.keys[slot], self.places[slot] = True, keys[i], i

    def _displacement(self, hashes: np.ndarray, taken: np.ndarray) -> tuple[int, list[int]]:
        first = 0
        while True:
            moves = np.arange(first, first + 64, dtype=np.uint64)
            mixed = (hashes[None, :] ^ (moves * np.uint64(_STEP))[:, None]) * np.uint64(_MIX)
            slots = ((mixed >> np.uint64(32)) * np.uint64(self.size)) >> np.uint64(32)
            ordered = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                return first + k, slots[k].astype(np.int64).tolist()
            first += 64

    def find(self, key: bytes) -> int:
        """The place of `key` in the list given, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        move = self.moves[h % self.buckets]
        slot = -move - 1 if move < 0 else (((((h ^ (move * _STEP & _MASK)) * _MIX) & _MASK) >> 32) * self.size) >> 32
        return self.places[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always join the neighbouring parts whose union has the lowest rank, leftmost on a tie.

    A part starts at i and ends where the next begins. An entry of the heap is stale if a side has grown since.
    """
    size = len(piece)
    get = ranks.get
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = [(rank, i, i + 1, i + 2) for i in range(size - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, j, end = pop(heap)
        if after[i] != j or j >= size or after[j] != end:
            continue
        after[i], after[j] = end, -1
        if end < size:
            before[end] = i
            further = after[end]
            if (rank := get(piece[i:further])) is not None:
                push(heap, (rank, i, end, further))
        k = before[i]
        if k >= 0 and (rank := get(piece[k:end])) is not None:
            push(heap, (rank, k, i, end))
    out = []
    i = 0
    while i < size:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Vocabulary:
    """Ranks of a rank file, the perfect hash over its entries and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        entries = list(self.ranks)
        self.ids = [self.ranks[k] for k in entries]
        self.whole = PerfectHash(entries)
        self.bytes_of: list[bytes | None] = [None] * (max(self.ids) + 1)
        for key, rank in self.ranks.items():
            self.bytes_of[rank] = key

    def encode_piece(self, piece: bytes) -> list[int]:
        place = self.whole.find(piece)
        return [self.ids[place]] if place >= 0 else merge(piece, self.ranks)

    def decode(self, ids: bytes) -> bytes:
        """Bytes behind little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Remembered(dict):
    """Packed ids of pre-tokens met before. When a generation is full it becomes the old one, which then goes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, token: str) -> bytes:
        packed = self.old.get(token)
        if packed is None:
            packed = np.array(self.vocabulary.encode_piece(token.encode()), "<u4").tobytes()
        if len(token) <= 100:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[token] = packed
        return packed


@kept
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Kept by each worker between tasks."""
    return Vocabulary(path)


@kept
def _remembered(path: str) -> Remembered:
    return Remembered(vocabulary(path))


def encoder(path: str, pattern: str) -> Callable[[list[str | None]], list[list]]:
    split, ids = regex.compile(pattern).findall, _remembered(path)
    return lambda texts: [[b"".join(map(ids.__getitem__, split(t))) if t else b"" for t in texts]]


def decoder(path: str) -> Callable[[list[bytes | None]], list[list]]:
    decode = vocabulary(path).decode
    return lambda rows: [[decode(ids) if ids else b"" for ids in rows]]


def encode(df: DataFrame, text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`df` with the column `ids`: the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Rows are independent: repeated rows give repeated results, an empty table gives an
    empty one, and other columns pass through. `path` is a rank file that every executor can open. Letters and digits
    are those of the Unicode version of the `regex` library; characters newer than version 16 may split otherwise than
    in libraries with older tables.
    """
    return map_text(df, text, T.StructType([T.StructField("ids", T.BinaryType())]), encoder, path, pattern)


def decode(df: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """`df` with the column `decoded`: the bytes behind `ids`; none for null. An id outside the vocabulary raises."""
    return map_text(df, ids, T.StructType([T.StructField("decoded", T.BinaryType())]), decoder, path)
