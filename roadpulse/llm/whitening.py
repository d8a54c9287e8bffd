"""Whitening by a bidiagonal qd solver.

Centred rows are reduced to one triangle R by QR of blocks, first within tasks and then among their triangles, so no product
of the data with itself, which would square its condition, is formed. Householder reflections make R bidiagonal. The dqds
iteration finds its singular values to high relative accuracy, and twisted factorisations give each one's direction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.session import cut_lineage

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers beyond this, and vectors with such, take no part.
LARGEST = float(1 << 52)
#: Rows that a task turns to numbers at once, and first meeting places of what the tasks hand in.
ROWS, PLACES = 4096, 256
EPS = float(np.finfo(float).eps)


def usable(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector is not null or empty and holds no null, non-finite or too large component."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LARGEST))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.coalesce(fits, F.lit(False)))


def whiten(vectors: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row per row of `vectors` and component: `(<identifier>, component, n, deviation, whitened, explained, identity_error)`.

    A component c counts as the whole number x = floor(scale * c) + offset. `n` is the number of rows fitted, `deviation` the exact
    sum of (n * x - S)^2 over the dimensions, S being their sums (null if it does not fit a long), `whitened` the centred
    row projected on the component's direction over the root of its variance, `explained` the variance's share of all,
    and `identity_error` the largest entry of the whitened covariance less the identity.

    Rows whose vector is null, empty, or holds a null, non-finite or too large (`LARGEST`) component take no part. Null
    and repeated ids and repeated rows each keep their rows and count in the fit. Vectors of each length are fitted apart.
    A component without variance (less than rounding leaves) is null when whitened and adds nothing to the error; where nothing varies
    `explained` is null too. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    taken = vectors.select(F.col(identifier).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut_lineage(usable(taken, "v", scale))
    parts = []
    for dimension, fitted in sorted(centres(rows, scale, offset).items()):
        own = rows.where(F.size("v") == dimension)
        centred = _Centred(*fitted, scale, offset)
        singular, directions = solve(triangle(own, centred, dimension))
        parts.append(_project(own, centred, singular, directions, components, identifier))
    if not parts:
        kind = taken.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"{identifier} {kind}, {RESULT}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def centres(rows: DataFrame, scale: int, offset: int) -> dict[int, tuple[int, list[int]]]:
    """By length of the vectors: how many there are, and the exact sums of each dimension. A row per dimension leaves the tasks."""
    x = F.transform("v", lambda c: (F.floor(c * F.lit(float(scale))) + offset).cast("decimal(20,0)"))
    long = rows.select(F.size("v").alias("dim"), F.posexplode(x).alias("at", "x"))
    sums = long.groupBy("dim", "at").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "at").collect():
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


class _Centred:
    """Rows as whole numbers less the whole part of their mean; `rest` over n is the remainder."""

    def __init__(self, n: int, sums: list[int], scale: int, offset: int) -> None:
        self.n, self.scale, self.offset = n, float(scale), offset
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def whole(self, matrix: np.ndarray) -> np.ndarray:
        return np.floor(matrix * self.scale).astype(np.int64) + self.offset - self.base

    def rows(self, whole: np.ndarray) -> np.ndarray:
        """Centred rows; only the remainder is rounded."""
        return whole - self.rest / self.n

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2; None where a long does not hold them."""
        largest = (int(np.abs(whole).max(initial=0)) + 1) * self.n
        if largest * largest * whole.shape[1] < 1 << 63:
            gaps = whole * self.n - self.rest
            return (gaps * gaps).sum(axis=1).tolist()
        sums = (sum((self.n * x - r) ** 2 for x, r in zip(row, self.rest.tolist(), strict=True)) for row in whole.tolist())
        return [s if s < 1 << 63 else None for s in sums]


def _matrices(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(place).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _gathered(handed: DataFrame, join: Callable[[list[bytes]], bytes]) -> bytes:
    """What all tasks hand in, `(part, raw)`, joined at `PLACES` places and then into one."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "raw": [join(pdf.sort_values("part")["raw"].tolist())]})

    met = handed.groupBy(F.pmod("part", F.lit(PLACES))).applyInPandas(lambda p: one(p).assign(part=p["part"].min()), "part int, raw binary")
    return met.groupBy().applyInPandas(one, "part int, raw binary").first()["raw"]


def triangle(rows: DataFrame, centred: _Centred, dimension: int) -> np.ndarray:
    """R of the QR of all centred rows: a task folds its blocks into one triangle, and triangles are folded alike."""

    def shape(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.float64).reshape(-1, dimension)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros((0, dimension))
        for _, matrix in _matrices(batches, 0):
            held = np.linalg.qr(np.concatenate([held, centred.rows(centred.whole(matrix))]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["part", "raw"])

    def join(raws: list[bytes]) -> bytes:
        return np.linalg.qr(np.concatenate([shape(r) for r in raws]), mode="r").tobytes()

    found = shape(_gathered(rows.select("v").mapInArrow(fold, "part int, raw binary"), join))
    return np.concatenate([found, np.zeros((dimension - len(found), dimension))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(a, b, p)`: the diagonals of an upper bidiagonal B with r = U B p', by Householder reflections from either side."""
    work, size = r.astype(float).copy(), len(r)
    p = np.eye(size)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        largest = np.abs(x).max(initial=0.0)
        if largest == 0 or np.abs(x[1:]).max(initial=0.0) == 0:
            return None
        u = x / largest
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        return u / np.sqrt(u @ u)

    for k in range(size):
        u = reflector(work[k:, k])
        if u is not None:
            work[k:, k:] -= 2 * np.outer(u, u @ work[k:, k:])
        if k + 1 < size:
            u = reflector(work[k, k + 1 :])
            if u is not None:
                work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ u, u)
                p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ u, u)
    return np.diag(work).copy(), np.diag(work, 1).copy(), p


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, rising, of a bidiagonal with squared diagonals `q` (positive) and `e`.

    A shift is the least eigenvalue of the lowest two rows; one that would make a value negative is taken back, and the next step is
    shifted by what the step without shift proves to be safe: the reciprocal of the trace of the inverse.
    """
    q, e, out = q.astype(float).tolist(), e.astype(float).tolist(), []
    taken, safe, wary, steps = 0.0, 0.0, False, 0
    while q:
        last = len(q) - 1
        if last == 0 or e[last - 1] <= (EPS / 4) ** 2 * (taken + q[last]) or e[last - 1] <= 1e-300:
            out.append(taken + q.pop())
            if e:
                e.pop()
            safe, wary = 0.0, False
            continue
        steps += 1
        if steps > 100_000 + 1000 * len(out):
            raise ArithmeticError("the singular values do not converge")
        if last == 1:
            # Both at once, without a difference of like numbers.
            half = (q[0] + q[1] + e[0]) / 2
            large = half + np.sqrt(max(half * half - q[0] * q[1], 0.0))
            out += [taken + q[0] * q[1] / large, taken + large]
            return np.sort(out)
        if q[0] < q[last] and steps % 30 == 1:
            # The small end goes below, where values converge.
            q.reverse()
            e.reverse()
        # The lowest two rows of B B'.
        one, two, off = q[last - 1] + e[last - 1], q[last], q[last] * e[last - 1]
        mean, root = (one + two) / 2, np.hypot((one - two) / 2, np.sqrt(off))
        shift = safe if wary else max(0.0, (one * two - off) / (mean + root) * (1 - 4 * EPS)) if mean + root > 0 else 0.0
        made = _step(q, e, shift)
        if made is None:
            shift, made = 0.0, _step(q, e, 0.0)
        q, e, smallest, inverse = made
        taken += shift
        # Without a shift the pivots are the reciprocal diagonal of the inverse, and their bound holds for the next step.
        wary = shift == 0.0 and not wary
        safe = (1 - 16 * EPS * len(q)) / inverse if shift == 0.0 and smallest > 0 else 0.0
    return np.sort(out)


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float] | None:
    """One differential qd step, None if the shift was too large. Also the least pivot and the sum of reciprocal ones."""
    d, smallest, inverse = q[0] - shift, np.inf, 0.0
    new_q, new_e = [], []
    for k, off in enumerate(e):
        if d < 0:
            return None
        smallest, inverse = min(smallest, d), inverse + (1 / d if d > 0 else np.inf)
        top = d + off
        ratio = q[k + 1] / top if top > 0 else np.inf
        if ratio == np.inf:
            return None if shift > 0 else ([max(x, 1e-290) for x in q], e, 0.0, np.inf)
        new_q.append(top)
        new_e.append(off * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, min(smallest, d), inverse + (1 / d if d > 0 else np.inf)


def direction(q: np.ndarray, low: np.ndarray, value: float, used: np.ndarray) -> tuple[np.ndarray, int]:
    """Eigenvector of L diag(q) L' (L having `low` below a unit diagonal) by the factorisation twisted where it is nearest to
    singular, and that place; `used` is the weight that vectors of like values already have in each place."""
    n, tiny = len(q), 1e-290
    s, down = np.zeros(n), np.zeros(n - 1)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > tiny else -tiny
        down[k] = q[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    p, up = np.zeros(n), np.zeros(n - 1)
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = q[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        t = q[k] / pivot
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    gamma = np.abs(s + p + value)
    place = int(np.argmax(np.maximum(1 - used, 0) / np.maximum(gamma, tiny)))
    z = np.zeros(n)
    z[place] = 1
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(place - 1, -1, -1):
            z[k] = -down[k] * z[k + 1]
        for k in range(place, n - 1):
            z[k + 1] = -up[k] * z[k]
    z = np.nan_to_num(z, nan=0.0, posinf=1e300, neginf=-1e300)
    z /= np.abs(z).max()
    return z / np.sqrt(z @ z), place


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            z = z - (z @ other) * other
    return z


def solve(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a square r, falling, and its right singular vectors as columns."""
    size = len(r)
    largest = np.abs(r).max(initial=0.0)
    if largest == 0 or not np.isfinite(largest):
        return np.zeros(size), np.eye(size)
    a, b, p = bidiagonal(r / largest)
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    # Far below rounding; keeps every pivot apart from zero.
    a = np.where(np.abs(a) < 1e-25 * scale, 1e-25 * scale, a)
    values, vectors = np.zeros(size), np.zeros((size, size))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= 4 * EPS * scale) + 1).tolist(), size]
    for low, high in zip(cuts, cuts[1:]):
        q, e = a[low:high] ** 2, b[low : high - 1] ** 2
        found = dqds(q, e)
        values[low:high] = np.sqrt(found)
        ratio = b[low : high - 1] / a[low : high - 1]
        made: list[np.ndarray] = []
        for k, value in enumerate(found.tolist()):
            near = [z for j, z in enumerate(made) if z is not None and found[k] - found[j] <= 1e-5 * found[k]]
            used = np.minimum(sum((z * z for z in near), np.zeros(high - low)), 1)
            for _ in range(min(8, high - low)):
                z, place = direction(q, ratio, value, used)
                z = _apart(z, near)
                if z @ z > 1e-6:
                    break
                used[place] = 1  # the direction of a like value again: twist elsewhere
            made.append(z / np.sqrt(z @ z) if z @ z > 1e-6 else None)
        # Directions of one value that no twist tells apart are what the others leave.
        for k in [k for k, z in enumerate(made) if z is None]:
            known = [z for z in made if z is not None]
            free = np.argmin(sum((z * z for z in known), np.zeros(high - low)))
            z = _apart(np.eye(high - low)[free], known)
            made[k] = z / np.sqrt(z @ z)
        vectors[low:high, low:high] = np.array(made).T
    order = np.argsort(-values, kind="stable")
    return values[order] * largest, (p @ vectors)[:, order]


def _project(rows: DataFrame, centred: _Centred, singular: np.ndarray, directions: np.ndarray, components: int, identifier: str) -> DataFrame:
    n, used = centred.n, min(components, len(singular))
    # What is left of rounding is no variance.
    varies = (singular > 4 * len(singular) * EPS * singular[0]) & (singular > 0)
    good = varies[:used]
    weights = np.where(good, directions[:, :used] * (np.sqrt(n) / np.where(good, singular[:used], 1)), np.nan)
    whole = float((singular**2).sum())
    shares = [float(s * s / whole) if whole > 0 else None for s in singular[:used]]
    error = _identity_error(rows, centred, weights[:, good])
    kind = rows.schema["id"]
    schema = T.StructType([T.StructField(identifier, kind.dataType), *T.StructType.fromDDL(RESULT).fields])
    names = schema.names

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in _matrices(batches, 1):
            own = centred.whole(matrix)
            white = (centred.rows(own) @ np.nan_to_num(weights)).ravel()
            taken = pa.array(np.repeat(np.arange(len(part)), used))
            arrays = [
                part.column(0).take(taken), pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), len(part))),
                pa.array(np.full(len(taken), n, np.int64)), pa.array(centred.deviations(own), pa.int64()).take(taken),
                pa.array(white, pa.float64(), mask=np.tile(~good, len(part))), pa.array(shares * len(part), pa.float64()),
                pa.array(np.full(len(taken), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select("id", "v").mapInArrow(out, schema)


def _identity_error(rows: DataFrame, centred: _Centred, weights: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, from their means and centred products."""
    width = weights.shape[1]
    if not width:
        return 0.0

    def packed(n: float, mean: np.ndarray, products: np.ndarray) -> bytes:
        return np.concatenate([[n], mean, products.ravel()]).tobytes()

    def unpacked(raw: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        found = np.frombuffer(raw, np.float64)
        return found[0], found[1 : width + 1], found[width + 1 :].reshape(width, width)

    def merged(one: bytes, other: bytes) -> bytes:
        (n, mean, products), (m, mean_2, products_2) = unpacked(one), unpacked(other)
        gap, whole = mean_2 - mean, n + m
        return packed(whole, mean + gap * (m / whole), products + products_2 + np.outer(gap, gap) * (n * m / whole))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for _, matrix in _matrices(batches, 0):
            white = centred.rows(centred.whole(matrix)) @ weights
            mean = white.mean(axis=0)
            own = packed(len(white), mean, (white - mean).T @ (white - mean))
            held = own if held is None else merged(held, own)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held], pa.binary())], names=["part", "raw"])

    def join(raws: list[bytes]) -> bytes:
        held = raws[0]
        for raw in raws[1:]:
            held = merged(held, raw)
        return held

    n, _, products = unpacked(_gathered(rows.select("v").mapInArrow(fold, "part int, raw binary"), join))
    return float(np.abs(products / n - np.eye(width)).max())
