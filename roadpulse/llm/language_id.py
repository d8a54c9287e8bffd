"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the product of their probabilities; a forward pass adds them up without listing them. The
piece probabilities are fitted by expectation maximisation on the word counts of all labelled rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.common import WORD_BYTES, kept, lean, map_text
from roadpulse.session import cut_lineage

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
UNDETERMINED = "und"
#: Words of more bytes, and words whose probability comes near the least number a double holds, are followed in logarithms.
LINEAR, LEAST = 40, 1e-250
#: Mean log probability per byte of bytes drawn at random. Texts below it are rejected, see `reject`.
FLOOR = -float(np.log(256))
#: Characters of text handled together, and words a worker remembers the scores of.
PORTION, REMEMBERED = 2_000_000, 300_000
#: Words whose segmentations a worker counts together: words of like length share their steps, the more the better.
TOGETHER = 60_000

_BASE, _MIX_A, _MIX_B, _BITS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 18
#: Bits of the table that tells most substrings that are no piece.
_FILTER = 20

#: For a length of pieces: where the finds of each start begin, and the row and place of each find.
Finds = tuple[np.ndarray, np.ndarray, np.ndarray]


def spoken(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text that hold more than digits."""
    return [] if not text else [w for w in text.lower().encode().translate(WORD_BYTES).split() if not w.isdigit()]


class Pieces:
    """The vocabulary's pieces by place, found for all substrings of many words at once.

    `longest` is the length of the longest piece that can be part of a word (see `spoken`): one without ASCII capitals and
    marks, and without a space behind its first byte. Longer pieces, such as runs of spaces, match nothing in a word.
    Substrings are told apart by a 64-bit rolling hash; each piece sits in one of its two places in a cuckoo table. Few substrings
    are pieces, so a small table of marks is asked first.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.pieces = [base64.b64decode(line.split()[0]) for line in lines]
        self.longest = max(len(p) for p in self.pieces if b" " not in p[1:] and p.translate(WORD_BYTES) == p)
        self.keys = np.zeros((2, 1 << _BITS), np.uint64)
        self.places = np.full((2, 1 << _BITS), len(self.pieces), np.int32)
        self._fill()
        self.marks = np.zeros(1 << _FILTER, bool)
        filled = self.places < len(self.pieces)
        self.marks[self.keys[filled] >> np.uint64(64 - _FILTER)] = True

    def _fill(self) -> None:
        mask = (1 << 64) - 1
        for place, piece in enumerate(self.pieces):
            h = 0
            for c in piece:
                h = (h * _BASE + c + 1) & mask
            side = 0
            for _ in range(500):
                slot = ((h * (_MIX_B if side else _MIX_A)) & mask) >> (64 - _BITS)
                held, holder = int(self.keys[side, slot]), int(self.places[side, slot])
                self.keys[side, slot], self.places[side, slot] = h, place
                if holder == len(self.pieces):
                    break
                h, place, side = held, holder, 1 - side
            else:
                raise ValueError("the pieces do not fit the table")

    def finds(self, matrix: np.ndarray, lengths: np.ndarray) -> list[Finds]:
        """For each length 1..longest, the pieces inside the words, in order of the byte they start at and of the word."""
        n, width = matrix.shape
        prefix = np.zeros((width + 1, n), np.uint64)
        base, none = np.uint64(_BASE), len(self.pieces)
        for j, column in enumerate(matrix.T):
            prefix[j + 1] = prefix[j] * base + column + np.uint64(1)
        out = []
        for size in range(1, min(self.longest, width) + 1):
            h = (prefix[size:] - prefix[:-size] * np.uint64(pow(_BASE, size, 1 << 64))).ravel()
            at = np.flatnonzero(self.marks[h >> np.uint64(64 - _FILTER)])
            start, row = np.divmod(at, n)
            inside = lengths[row] >= start + size
            if not inside.all():
                at, start, row = at[inside], start[inside], row[inside]
            h = h[at]
            a, b = (h * np.uint64(_MIX_A)) >> np.uint64(64 - _BITS), (h * np.uint64(_MIX_B)) >> np.uint64(64 - _BITS)
            place = np.where(self.keys[0][a] == h, self.places[0][a], none)
            place = np.where(self.keys[1][b] == h, self.places[1][b], place)
            real = place < none
            if not real.all():
                start, row, place = start[real], row[real], place[real]
            out.append((np.searchsorted(start, np.arange(width - size + 2)), row, place))
        return out

    def of(self, matrix: np.ndarray, lengths: np.ndarray | None = None) -> list[np.ndarray]:
        """For each length 1..longest, the place of the piece that starts at each byte, or the number of pieces."""
        n, width = matrix.shape
        out, lengths = [], np.full(n, width) if lengths is None else lengths
        for size, (bounds, row, place) in enumerate(self.finds(matrix, lengths), 1):
            found = np.full((n, width - size + 1), len(self.pieces), np.int32)
            found[row, np.repeat(np.arange(width - size + 1), np.diff(bounds))] = place
            out.append(found)
        return out


@kept
def pieces(path: str = VOCABULARY) -> Pieces:
    return Pieces(path)


def _groups(found: list[bytes], cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words of like length, their bytes behind a space, padded to a matrix, and their lengths."""
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        most = start + max(1, cells // int(lengths[order[start]]))
        fits = lengths[order[start:most]] * np.arange(1, len(order[start:most]) + 1) <= cells
        stop = start + (int(fits.argmin()) if not fits.all() else len(fits))
        here = order[start : max(stop, start + 1)]
        own = lengths[here]
        width = int(own[-1])
        flat = np.frombuffer(b" " + b" ".join([found[i] for i in here.tolist()]) + bytes(width), np.uint8)
        place = np.arange(width)
        matrix = flat[(np.cumsum(own) - own)[:, None] + place]
        matrix[place >= own[:, None]] = 0
        yield here, matrix, own
        start += len(here)


def _rows(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The rows at different places in rising order: all of them as they are."""
    return values if len(row) == len(values) else values.take(row, 0)


def _add(values: np.ndarray, row: np.ndarray, more: np.ndarray) -> None:
    """Add to the rows at different places in rising order."""
    if len(row) == len(values):
        values += more
    else:
        values[row] = values.take(row, 0) + more


def word_scores(found: list[bytes], vocabulary: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: the forward pass over all segmentations.

    `chances` has a row per piece and one of zeros at the end. The last values are rescaled as they go, and words whose
    values come near nothing all the same are followed in logarithms, so that none under- or overflows.
    """
    out = np.zeros((len(found), chances.shape[1]))
    tiny = []
    for here, matrix, lengths in _groups(found):
        at = vocabulary.finds(matrix, lengths)
        n, width = matrix.shape
        ring = [np.zeros((n, chances.shape[1])) for _ in range(len(at) + 1)]
        ring[0][:] = 1.0
        scale = np.zeros((n, chances.shape[1]))
        lost = np.zeros(n, bool)
        for j in range(1, width + 1):
            total = np.zeros((n, chances.shape[1]))
            for size in range(1, min(j, len(at)) + 1):
                bounds, row, place = at[size - 1]
                one = slice(bounds[j - size], bounds[j - size + 1])
                if one.stop > one.start:
                    _add(total, row[one], _rows(ring[(j - size) % len(ring)], row[one]) * chances.take(place[one], 0))
            ring[j % len(ring)] = total
            ended = lengths == j
            if ended.any():
                lost |= ended & (total < LEAST).any(axis=1)
                out[here[ended]] = np.log(np.maximum(total[ended], LEAST)) + scale[ended]
            if j % 8 == 0 and j < width:
                top = np.maximum.reduce(ring)
                lost |= (lengths > j) & (top < LEAST).any(axis=1)
                np.maximum(top, LEAST, out=top)
                scale += np.log(top)
                for values in ring:
                    values /= top
        tiny += here[lost].tolist()
    if tiny:
        logs = _logs(chances)
        for here, matrix, lengths in _groups([found[k] for k in tiny]):
            forward = _log_forward(vocabulary.of(matrix, lengths), logs, matrix.shape)
            out[np.array(tiny)[here]] = forward[lengths, np.arange(len(here))]
    return out


def _logs(chances: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(chances)


def _log_forward(at: list[np.ndarray], logs: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Log probability of the beginnings of words, by their length."""
    n, width = shape
    forward = np.full((width + 1, n, logs.shape[1]), -np.inf)
    forward[0] = 0.0
    for j in range(1, width + 1):
        for size in range(1, min(j, len(at)) + 1):
            forward[j] = np.logaddexp(forward[j], forward[j - size] + logs[at[size - 1][:, j - size]])
    return forward


def _log_expected(found: list[bytes], counts: np.ndarray, vocabulary: Pieces, chances: np.ndarray, out: np.ndarray) -> None:
    """What `expected` does, in logarithms; added to `out`."""
    size_all, logs = len(vocabulary.pieces), _logs(chances)
    for here, matrix, lengths in _groups(found):
        at = vocabulary.of(matrix, lengths)
        n, width = matrix.shape
        forward = _log_forward(at, logs, matrix.shape)
        whole = forward[lengths, np.arange(n)]
        backward = np.full_like(forward, -np.inf)
        for i in range(width, -1, -1):
            backward[i][lengths == i] = 0.0
            for size in range(1, min(width - i, len(at)) + 1):
                piece = at[size - 1][:, i]
                onward = logs[piece] + backward[i + size]
                backward[i] = np.logaddexp(backward[i], onward)
                real = np.flatnonzero((piece < size_all) & (lengths >= i + size))
                if len(real):
                    np.add.at(out, piece[real], np.exp((forward[i] + onward - whole)[real]) * counts[here[real]])


def expected(found: list[bytes], counts: np.ndarray, vocabulary: Pieces, chances: np.ndarray) -> np.ndarray:
    """How often each piece is used in each language over all segmentations of the counted words (forward-backward)."""
    size_all, languages = len(vocabulary.pieces), chances.shape[1]
    out = np.zeros((size_all, languages))
    tiny = [k for k, w in enumerate(found) if len(w) > LINEAR]
    short = np.array([k for k, w in enumerate(found) if len(w) <= LINEAR], np.int64)
    for group, matrix, lengths in _groups([found[k] for k in short.tolist()]):
        here = short[group]
        at = vocabulary.finds(matrix, lengths)
        n, width = matrix.shape
        forward = np.zeros((width + 1, n, languages))
        forward[0] = 1.0
        for j in range(1, width + 1):
            for size in range(1, min(j, len(at)) + 1):
                bounds, row, place = at[size - 1]
                row, place = row[bounds[j - size] : bounds[j - size + 1]], place[bounds[j - size] : bounds[j - size + 1]]
                if len(row):
                    _add(forward[j], row, _rows(forward[j - size], row) * chances.take(place, 0))
        whole = forward[lengths, np.arange(n)]
        lost = ((whole < LEAST) & (counts[here] > 0)).any(axis=1)
        tiny += here[lost].tolist()
        share = np.divide(counts[here], whole, out=np.zeros_like(whole), where=(whole >= LEAST) & ~lost[:, None])
        backward = np.zeros((width + 1, n, languages))
        used, weights = [], []
        for i in range(width, -1, -1):
            backward[i][lengths == i] = 1.0
            for size in range(1, min(width - i, len(at)) + 1):
                bounds, row, place = at[size - 1]
                row, place = row[bounds[i] : bounds[i + 1]], place[bounds[i] : bounds[i + 1]]
                if len(row):
                    onward = chances.take(place, 0) * _rows(backward[i + size], row)
                    _add(backward[i], row, onward)
                    used.append(place)
                    weights.append(_rows(forward[i], row) * onward * _rows(share, row))
        places, amounts = np.concatenate(used), np.concatenate(weights)
        for k in range(languages):
            out[:, k] += np.bincount(places, amounts[:, k], size_all)
    if tiny:
        _log_expected([found[k] for k in tiny], counts[tiny], vocabulary, chances, out)
    return out


@dataclass
class Model:
    """Languages in order, the log share of each, and a row of piece probabilities per piece, with zeros at the end."""

    languages: list[str]
    shares: np.ndarray
    chances: np.ndarray
    path: str = VOCABULARY


def word_counts(rows: DataFrame, text: str, language: str) -> DataFrame:
    """`(language, word, n)` over all rows: counted within portions of a task first, then summed by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(spoken(t)).items():
                    held[name, word] += n
                if len(held) >= 400_000:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    taken = rows.select(F.col(text).cast("string"), F.col(language).cast("string")).where(F.col(language).isNotNull())
    return taken.mapInArrow(lean(count), "language string, word binary, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    names, found = [k[0] for k in held], [k[1] for k in held]
    arrays = [pa.array(names, pa.string()), pa.array(found, pa.binary()), pa.array(list(held.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["language", "word", "n"])


def fit(
    rows: DataFrame, text: str = "text", language: str = "lang", path: str = VOCABULARY, rounds: int = 3, smoothing: float = 0.01
) -> Model:
    """Fit piece probabilities on all `rows` whose language is not null.

    The word counts are one table in the shared folder; every round sums its expected piece counts in parallel, so the
    driver only meets a number per piece and language. `smoothing` is added to each of these.
    """
    spark = rows.sparkSession
    counts = cut_lineage(word_counts(rows, text, language))
    sums = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sums)
    vocabulary = pieces(path)
    size = len(vocabulary.pieces)
    total = sum(sums.values())
    shares = np.array([np.log(sums[k] / total) for k in languages])
    chances = np.full((size + 1, len(languages)), 1.0 / size)
    chances[size] = 0.0
    if not languages:
        return Model([], shares, chances, path)
    # A word's counts side by side, so that its segmentations are followed once for all languages.
    wide = counts.groupBy("word").agg(*[F.sum(F.when(F.col("language") == k, F.col("n"))).alias(f"n{i}") for i, k in enumerate(languages)])
    wide = cut_lineage(wide)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(chances)

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, sums = pieces(path), np.zeros((size, len(languages)))
            for whole in _joined(batches, TOGETHER):
                amounts = np.column_stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in whole.columns[1:]])
                sums += expected(whole.column(0).to_pylist(), amounts, known, held.value)
            place, k = np.nonzero(sums)
            arrays = [pa.array(place.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[place, k])]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "k", "amount"])

        portions = wide.coalesce(max(spark.sparkContext.defaultParallelism, 1))
        made = portions.mapInArrow(lean(add), "piece int, k int, amount double").groupBy("piece", "k").agg(F.sum("amount").alias("amount"))
        grown = made.toPandas()
        amounts = np.zeros((size, len(languages)))
        amounts[grown["piece"].to_numpy(), grown["k"].to_numpy()] = grown["amount"].to_numpy()
        chances[:size] = (amounts + smoothing) / (amounts.sum(axis=0) + smoothing * size)
        held.unpersist()
    return Model(languages, shares, chances, path)


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of at least `rows` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


class _Scores:
    """Scores of words met before, as rows of one matrix; all are forgotten when the matrix is full."""

    def __init__(self, model: Model) -> None:
        self.model, self.places = model, {}
        self.matrix = np.zeros((REMEMBERED, len(model.languages)))

    def totals(self, texts: list[list[bytes]]) -> np.ndarray:
        new = set()
        for found in texts:
            new.update(found)
        if len(self.places) + len(new.difference(self.places)) > len(self.matrix):
            self.places.clear()
            if len(new) > len(self.matrix):
                self.matrix = np.zeros((len(new), self.matrix.shape[1]))
        fresh = sorted(new.difference(self.places))
        if fresh:
            start = len(self.places)
            self.matrix[start : start + len(fresh)] = word_scores(fresh, pieces(self.model.path), self.model.chances)
            self.places.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        place = self.places.__getitem__
        return np.array([self.matrix[np.fromiter(map(place, found), np.int64, len(found))].sum(axis=0) for found in texts])


def identifier(held: object, fluency: bool = False) -> Callable[[list[str | None]], list[list]]:
    """Language and score of texts; with `fluency` also the mean log probability per byte in that language."""
    model: Model = held.value
    scores = _Scores(model) if model.languages else None

    def portion(texts: list[str | None]) -> list[tuple[str, float, float]]:
        if scores is None:
            return [(UNDETERMINED, 0.0, -np.inf)] * len(texts)
        found = [spoken(t) for t in texts]
        plain = scores.totals(found)
        out = []
        for t, listed, alone, total in zip(texts, found, plain, plain + model.shares, strict=True):
            if not t or not any(map(str.isalpha, t)):
                out.append((UNDETERMINED, 0.0, -np.inf))
            else:
                best = int(total.argmax())
                size = sum(map(len, listed)) + len(listed)
                out.append((model.languages[best], float(1.0 / np.exp(total - total[best]).sum()), float(alone[best] / max(size, 1))))
        return out

    def run(texts: list[str | None]) -> list[list]:
        made: list[tuple[str, float, float]] = []
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= PORTION:
                made += portion(held)
                held, size = [], 0
        made += portion(held) if held else []
        return [[m[k] for m in made] for k in range(3 if fluency else 2)]

    return run


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with `lang_pred` and `score`, the share of that language in the total probability (0 to 1).

    `und` with score 0 where the text is null or has no letter, or where the model has no language. Equal scores go to
    the first language in order. Rows are independent: repeated rows repeat, an empty table stays empty, and other
    columns pass through (a taken name gets an underscore).
    """
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_text(df, text, result, identifier, df.sparkSession.sparkContext.broadcast(model))


def reject(df: DataFrame, model: Model, text: str = "text", floor: float = FLOOR) -> DataFrame:
    """The rows of `df` whose language can be told, with the columns of `df`.

    A row goes if its text is null or has no letter, if the model has no language, or if the words of the text have a mean log probability of
    less than `floor` per byte, the space before each word included, in their best language: they belong to none of the languages.
    """
    names = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("fluency", T.DoubleType())]
    result = T.StructType([T.StructField(name, kind) for name, kind in names])
    made = map_text(df, text, result, identifier, df.sparkSession.sparkContext.broadcast(model), True)
    return made.where((F.col(made.columns[-3]) != UNDETERMINED) & (F.col(made.columns[-1]) >= floor)).select(*[F.col(f"`{c}`") for c in df.columns])
