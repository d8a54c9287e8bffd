"""Toxicity scores from a lexicon that tolerates misspelling.

The lexicon is learned from labelled rows: words, and stems that begin several words. Its trie is intersected with
Levenshtein automata of its entries; the states met are kept as a deterministic automaton, so a word of a text costs a
table lookup per character. Each hit is weighed by a window of words around it, which tells quotation from abuse, and a
logistic regression turns the sums into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.common import lean, map_text
from roadpulse.session import cut_lineage

#: Labelled rows the lexicon and the weights are fitted on, chosen by a hash of the id; see `fit`.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Words on either side of a hit that tell how it is meant.
WINDOW = 8
REMEMBERED = 300_000

WORD = re.compile(r"[^\W_]+")
#: Fixed word lists of the context: who is spoken to, and who is quoted or what is talked about.
ADDRESS = frozenset("you your youre u ur du dich dir euch ihr tu te toi vous eres usted ustedes ti".split())
REPORT = frozenset(
    "said says called calls wrote quoted quote word words term insult insults slur meaning means reported "
    "sagte sagt nannte schrieb zitat wort dit disait cita mot terme insulte dijo dice llamó palabra insulto".split()
)
OPEN, CLOSE = "\"“„«‹‘'", "\"”“»›’'"

EXACT, STEM, NEAR = 1, 2, 3
#: What is counted in fitting: whole words, beginnings of longer words, beginnings of words.
WHOLE, BEGUN, BEGINNING = 0, 1, 2


def errors_allowed(word: str) -> int:
    """Edits a misspelled form of a lexicon word may have."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Automaton:
    """Lexicon trie times Levenshtein automata, made deterministic as its states are met.

    A state is a set of (trie node, edits so far). A letter is matched, replaced, inserted, swapped with the next or left
    out. An unedited stem accepts any word that goes on after it.
    """

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stems: list[bool] = [False]
        self.most = [0]
        for entry, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            self._add(entry, stem)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.sure: list[bool] = []
        self.start = self._state(self._closed({(0, 0, "")}))

    def _add(self, entry: str, stem: bool) -> None:
        allowed = 0 if stem else errors_allowed(entry)
        node = 0
        self.most[0] = max(self.most[0], allowed)
        for c in entry:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append(-1)
                self.stems.append(False)
                self.most.append(0)
            node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
        if stem:
            self.stems[node] = True
        else:
            self.ends[node] = allowed

    def _closed(self, positions: set[tuple[int, int, str]]) -> frozenset:
        """With what leaving out letters of the lexicon word reaches; only the fewest edits per node count."""
        fewest: dict[tuple[int, str], int] = {}
        left = list(positions)
        while left:
            node, edits, owed = left.pop()
            if edits > self.most[node] or fewest.get((node, owed), 99) <= edits:
                continue
            fewest[node, owed] = edits
            if not owed:
                left += [(child, edits + 1, "") for child in self.children[node].values()]
        return frozenset((node, edits, owed) for (node, owed), edits in fewest.items())

    def _state(self, positions: frozenset) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.moves.append({})
            at = [(n, e) for n, e, owed in positions if not owed]
            self.sure.append(any(self.stems[n] and e == 0 for n, e in at))
            best = min((e for n, e in at if 0 <= e <= self.ends[n]), default=None)
            self.accepts.append(0 if best is None else EXACT if best == 0 else NEAR)
        return self.states[positions]

    def _after(self, state: int, c: str) -> int:
        new: set[tuple[int, int, str]] = set()
        for node, edits, owed in self.sets[state]:
            if owed:  # the second letter of a swapped pair
                if owed == c:
                    new.add((node, edits, ""))
                continue
            for letter, child in self.children[node].items():
                new.add((child, edits if letter == c else edits + 1, ""))
                if letter != c and c in self.children[child]:
                    new.add((self.children[child][c], edits + 1, letter))
            new.add((node, edits + 1, ""))
        return self._state(self._closed(new))

    def kind(self, word: str) -> int:
        """EXACT, STEM, NEAR or 0 for a lower-cased word."""
        state = self.start
        for c in word:
            if self.sure[state]:
                return STEM
            following = self.moves[state].get(c)
            if following is None:
                following = self.moves[state][c] = self._after(state, c)
            state = following
            if not self.sets[state]:
                return 0
        return self.accepts[state]


class Remembered(dict):
    """Kinds of words met before; two generations, of which the older goes."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, word: str) -> int:
        kind = self.old.get(word)
        if kind is None:
            kind = self.automaton.kind(word)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = kind
        return kind


#: The features of a text, and the weight each has before any row is seen (the bias has none).
FEATURES = ["exact", "stem", "near", "quoted", "addressed", "dense", "share"]
PRIOR = np.array([2.0, 2.0, 1.5, -1.0, 0.3, 0.3, 0.0])


def features(text: str | None, kinds: Remembered) -> list[float] | None:
    """Sums over the hits of a whole text, or None without hits.

    A hit inside quotation marks within its window, or near a word of reporting, counts as quoted and not by its kind.
    """
    if not text:
        return None
    lowered = text.lower()
    found = WORD.findall(lowered)
    kind_of = list(map(kinds.__getitem__, found))
    if not any(kind_of):
        return None
    spans = [m.span() for m in WORD.finditer(lowered)]
    hits = [i for i, k in enumerate(kind_of) if k]
    sums = dict.fromkeys(FEATURES, 0.0)
    for i in hits:
        first, last = max(0, i - WINDOW), min(len(found), i + WINDOW + 1)
        around = found[first:i] + found[i + 1 : last]
        before = lowered[spans[first][0] : spans[i][0]]
        after = lowered[spans[i][1] : spans[last - 1][1] + 2]
        marks = any(_marked(before, after, a, b) for a, b in zip(OPEN, CLOSE, strict=True))
        if marks or any(w in REPORT for w in found[max(0, i - 3) : i]):
            sums["quoted"] += 1
        else:
            sums[("exact", "stem", "near")[kind_of[i] - 1]] += 1
            sums["addressed"] += any(w in ADDRESS for w in around)
            sums["dense"] += any(kind_of[first:i]) or any(kind_of[i + 1 : last])
    out = [math.log1p(sums[name]) for name in FEATURES[:-1]]
    return [*out, math.log(len(hits) / len(found))]


def _marked(before: str, after: str, opening: str, closing: str) -> bool:
    """Whether an opening mark stands before a word's beginning and its closing mark after a word's end, unbroken by lines."""
    head, tail = before.rpartition("\n")[2], after.partition("\n")[0]
    if opening == closing:
        starts = len(re.findall(r"(?:^|\s)" + re.escape(opening), head))
        ends = len(re.findall(re.escape(closing) + r"(?:\s|$|[.,;:!?])", head))
        return starts > ends and bool(re.search(re.escape(closing) + r"(?:\s|$|[.,;:!?])", tail))
    return head.rfind(opening) > head.rfind(closing) and closing in tail


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -2.0
    without: float = 0.05
    """Share of label 1 among texts without hits."""

    def score(self, made: list[float] | None) -> float:
        if made is None:
            return self.without
        return float(1 / (1 + np.exp(-(self.bias + np.dot(self.weights, made)))))


def sample(docs: DataFrame, labels: DataFrame, identifier: str, text: str, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` labelled rows `(text, label)`, by a hash of the id; rows without label or text stay out.

    Equal hashes fall back to the ids and labels themselves, and an id that repeats counts with its least text, so the
    sample is bounded and does not depend on the partitioning.
    """
    known = labels.select(F.col(identifier).alias("_id"), F.col(label).cast("int").alias("label")).where("label is not null")
    texts = docs.select(F.col(identifier).alias("_id"), F.col(text).alias("text")).where("text is not null")
    chosen = known.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "label").limit(rows)
    # At most `rows` ids and labels go to every task, so that the texts need no shuffle.
    met = texts.join(F.broadcast(chosen), "_id")
    return met.groupBy("_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def sketch(text: str, size: int = 5) -> int:
    """The least hash of the runs of `size` words of a text: near copies mostly share it, other texts do not."""
    found = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(found[k : k + size]).encode()) for k in range(max(1, len(found) - size + 1))), default=0)


def fit(rows: DataFrame, least: int = 5, odds: float = 8.0, chance: float = 0.05, lone: float = 0.8) -> Model:
    """Learn lexicon and weights from `rows(text, label)`, a bounded sample (see `sample`).

    A word or a stem of 2 to 9 letters enters if at least `least` texts of label 1 hold it, their share is `odds` times that among the
    others, and twice the log likelihood ratio of the two counts reaches what chance gives to any of all the terms tried with probability
    `chance` at most; so the proof asked for grows with the number of terms. Texts of one label and one `sketch`, as near copies are,
    count together as one text. A stem stands for all longer words it begins; if one next letter leads to `lone` of
    its texts, the longer beginning takes its place. Repeated rows count once.
    Tasks count portions of texts; the counts are summed by a shuffle and only the chosen terms come to the driver.
    """
    rows = rows.distinct().persist()
    try:
        return _fit(rows, least, odds, chance, lone)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, least: int, odds: float, chance: float, lone: float) -> Model:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=["text", "label", "sketch"])

    portions = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    marked = cut_lineage(rows.mapInArrow(lean(mark), "text string, label int, sketch long"))
    strong = _strong(marked.repartition(portions, "sketch").sortWithinPartitions("sketch", "label"), least, odds, chance)
    if strong is None:
        sides = {r["label"] for r in rows.select("label").distinct().collect()}
        return Model([], [], without=1.0 if 1 in sides else 0.0)
    words = {r["term"] for r in strong if r["kind"] == WHOLE}
    begun = {r["term"]: r["bad"] for r in strong if r["kind"] == BEGUN}
    longer: dict[str, int] = {}
    for r in strong:
        if r["kind"] == BEGINNING:
            longer[r["term"][:-1]] = max(longer.get(r["term"][:-1], 0), r["bad"])
    stems: list[str] = []
    for stem in sorted((s for s, n in begun.items() if longer.get(s, 0) < lone * n), key=lambda s: (len(s), s)):
        if not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    words = {w for w in words if not any(w != s and w.startswith(s) for s in stems)}
    model = Model(sorted(words), stems)
    _weigh(model, rows)
    return model


def _strong(marked: DataFrame, least: int, odds: float, chance: float) -> list | None:
    """The terms that tell label 1, with their counts, or None if one of the labels is missing."""
    groups = marked.select("sketch", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()
    sizes = {r["label"]: r["n"] for r in groups}
    bad, good = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    if not bad or not good:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        before, met = None, set()
        for batch in batches:
            for t, y, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, y) != before:
                    before, met = (k, y), set()
                found = {w for w in WORD.findall(t.lower()) if len(w) > 2}
                terms = {(w, WHOLE) for w in found}
                terms |= {(w[:n], BEGUN) for w in found for n in range(2, min(len(w), 10))}
                terms |= {(w[:n], BEGINNING) for w in found for n in range(3, min(len(w), 10) + 1)}
                for term in terms - met:
                    pair = held.setdefault(term, [0, 0])
                    pair[y == 1] += 1
                met |= terms
                if len(held) > 300_000:
                    yield _terms(held)
                    held = {}
        yield _terms(held)

    counted = marked.mapInArrow(lean(count), "term string, kind int, good long, bad long").groupBy("term", "kind")
    counted = counted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counted = cut_lineage(counted.where(F.col("good") + F.col("bad") >= least))
    tried = counted.count()
    # A likelihood ratio beyond x comes by chance with probability exp(-x / 2) at most.
    proof = 2 * math.log(max(tried, 1) / chance)
    strong = counted.where((F.col("bad") >= least) & ((F.col("bad") + 0.5) / (bad + 1) >= odds * (F.col("good") + 0.5) / (good + 1))).collect()
    return [r for r in strong if _likelihood(r["bad"], bad, r["good"], good) >= proof]


def _likelihood(a: int, of_a: int, b: int, of_b: int) -> float:
    """Twice the log likelihood ratio of two shares against one common share."""
    p = (a + b) / (of_a + of_b)

    def part(x: int, n: int, q: float) -> float:
        return sum(k * math.log(k / (n * w)) for k, w in ((x, q), (n - x, 1 - q)) if k)

    return 2 * (part(a, of_a, p) + part(b, of_b, p))


def _terms(held: dict) -> pa.RecordBatch:
    arrays = [
        pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()),
        pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "kind", "good", "bad"])


def _weigh(model: Model, rows: DataFrame, strength: float = 1.0) -> None:
    """Logistic regression over the sample's texts with hits, held to the prior weights by `strength`."""
    words, stems = model.words, model.stems

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Remembered(Automaton(words, stems))
        for batch in batches:
            made = [features(t, kinds) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    made = rows.mapInArrow(lean(make), "x array<double>, y int").toPandas()
    without = made[made["x"].isnull()]
    model.without = float((without["y"].sum() + 0.5 * 0.05) / (len(without) + 0.5))
    hit = made[~made["x"].isnull()]
    if hit.empty:
        return
    x, y = np.array(hit["x"].tolist()), (hit["y"] == 1).to_numpy(float)
    wide, prior = np.column_stack([x, np.ones(len(x))]), np.append(PRIOR, 0.0)
    weights, pull = prior.copy(), np.append(np.full(len(PRIOR), strength), 0.01)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(wide @ weights, -30, 30)))
        slope = wide.T @ (y - p) - pull * (weights - prior)
        curve = (wide * (p * (1 - p))[:, None]).T @ wide + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.weights, model.bias = weights[:-1], float(weights[-1])


def scorer(model: Model) -> Callable[[list[str | None]], list[list]]:
    kinds = Remembered(Automaton(model.words, model.stems))
    return lambda texts: [[model.score(features(t, kinds)) for t in texts]]


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with `toxicity`, the estimated chance of label 1 from 0 to 1, over each whole text.

    Null and empty texts and those without a hit get the share of label 1 among such texts. Rows are independent:
    repeated rows repeat, an empty table stays empty, and other columns pass through (a taken name gets an underscore).
    """
    return map_text(df, text, T.StructType([T.StructField("toxicity", T.DoubleType())]), scorer, model)


def reject(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that score below `threshold`, with the columns of `df`."""
    made = score(df, model, text)
    return made.where(F.col(made.columns[-1]) < threshold).select(*[F.col(f"`{c}`") for c in df.columns])
