import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import language_id as li
from roadpulse.llm.common import crc_part, crc_part_of
from roadpulse.llm.queries import QUERIES


def splits(word, known):
    """All ways to cut a word into pieces, as lists of places."""
    if not word:
        return [[]]
    return [[known[word[:k]], *rest] for k in range(1, min(len(word), li.pieces().longest) + 1) if word[:k] in known for rest in splits(word[k:], known)]


@pytest.fixture(scope="module")
def known():
    return {p: k for k, p in enumerate(li.pieces().pieces)}


@pytest.fixture(scope="module")
def chances():
    size = len(li.pieces().pieces)
    made = np.random.default_rng(2).random((size + 1, 3))
    made[size] = 0
    return made / made.sum(axis=0)


WORDS = [b"a", b"the", b"ndthe", "thé".encode(), b"\xff\x00", b"qzx", b"straits", "für".encode()]


def test_pieces_are_found(known):
    word = b" straits"
    matrix = np.frombuffer(word, np.uint8).reshape(1, -1)
    for size, at in enumerate(li.pieces().of(matrix), 1):
        assert at[0].tolist() == [known.get(word[i : i + size], len(known)) for i in range(len(word) - size + 1)]


def test_forward_sums_all_segmentations(known, chances):
    made = li.word_scores(WORDS, li.pieces(), chances)
    for word, got in zip(WORDS, made):
        want = sum(np.prod(chances[s], axis=0) for s in splits(b" " + word, known))
        assert np.allclose(got, np.log(want))


def test_long_words_neither_under_nor_overflow(known, chances):
    for word in (b"ab" * 100, b"the" * 300, bytes(range(128, 256)) * 8):
        whole = b" " + word
        logs = [np.zeros(3)]
        for j in range(1, len(whole) + 1):
            ways = [(s, whole[j - s : j]) for s in range(1, min(j, li.pieces().longest) + 1)]
            logs.append(np.logaddexp.reduce([logs[j - s] + np.log(chances[known[p]]) for s, p in ways if p in known]))
        assert np.allclose(li.word_scores([b"x", word], li.pieces(), chances)[1], logs[-1])


def test_expected_counts(known, chances):
    counts = np.arange(1.0, 1 + 3 * len(WORDS)).reshape(-1, 3)
    made = li.expected(WORDS, counts, li.pieces(), chances)
    want = np.zeros_like(made)
    for word, n in zip(WORDS, counts):
        ways = splits(b" " + word, known)
        weight = np.array([np.prod(chances[s], axis=0) for s in ways])
        for s, w in zip(ways, weight / weight.sum(axis=0)):
            for place in s:
                want[place] += w * n
    assert np.allclose(made, want)


def test_checksum_part(spark):
    rows = spark.range(200).select("id", crc_part(F.col("id")).alias("p")).collect()
    assert [r["p"] for r in rows] == [crc_part_of(r["id"]) for r in rows]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    made = QUERIES["op6_language_id"](spark, d).collect()
    assert len(made) == len(truth)
    held = [r for r in made if r["held_out"]]
    assert [r["doc_id"] for r in held] and all(crc_part_of(r["doc_id"]) == 2 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in made)


def test_hard_rows(spark):
    schema = "text string, lang string, score string, lang_pred int"
    rows = [("the cat and the dog", "en", "s", 1), ("le chat et le chien", "fr", None, None), (None, "en", None, None), ("", "fr", None, None), ("word", None, None, None)]
    model = li.fit(spark.createDataFrame(rows * 3, schema))
    assert model.languages == ["en", "fr"]
    asked = [("le chien", "x", "y", 1), (None, None, None, None), ("", "a", "b", 2), ("12 34 !?", "c", "d", 3), ("dog", None, None, 4), ("dog", None, None, 4), ("the cat " * 60_000, "z", "", 5)]
    df = spark.createDataFrame(asked, schema).coalesce(1)
    made = li.identify(df, model)
    assert made.columns == ["text", "lang", "score", "lang_pred", "lang_pred_", "score_"]
    assert [r["lang_pred_"] for r in made.collect()] == ["fr", "und", "und", "und", "en", "en", "en"]
    left = li.reject(df, model)
    assert left.columns == df.columns and left.count() == 4
    empty = df.limit(0)
    assert li.identify(empty, model).count() == 0
    nothing = li.fit(empty)
    assert nothing.languages == [] and {r["lang_pred_"] for r in li.identify(df, nothing).collect()} == {"und"}


def test_portions_do_not_change_results(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = li.fit(spark.read.parquet(f"{d}/documents.parquet"))
    whole = {r["doc_id"]: round(r["score"], 9) for r in li.identify(docs, model).collect()}
    monkeypatch.setattr(li, "PORTION", 500)
    monkeypatch.setattr(li, "REMEMBERED", 50)
    held = type("Held", (), {"value": model})()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = li.identifier(held)(list(texts.values()))[1]
    assert {k: round(s, 9) for k, s in zip(texts, made)} == whole


def test_rare_words_are_followed_in_logarithms(known, chances):
    small = np.where(chances < np.median(chances), 1e-30, chances)
    small[-1] = 0
    words = [bytes(range(128, 256)), "слово".encode() * 30, b"the", b"qzxjk" * 7]
    logs = li._logs(small)
    for word, got in zip(words, li.word_scores(words, li.pieces(), small)):
        matrix = np.frombuffer(b" " + word, np.uint8)[None]
        assert np.allclose(got, li._log_forward(li.pieces().of(matrix), logs, matrix.shape)[-1, 0])


def test_expected_counts_of_long_words(known, chances, monkeypatch):
    found, counts = [*WORDS, b"straitsthe" * 3], np.arange(1.0, 1 + 3 * (len(WORDS) + 1)).reshape(-1, 3)
    plain = li.expected(found, counts, li.pieces(), chances)
    monkeypatch.setattr(li, "LINEAR", 0)
    assert np.allclose(li.expected(found, counts, li.pieces(), chances), plain)
    long = li.expected([b"the" * 200], np.ones((1, 3)), li.pieces(), chances)
    lengths = np.array([len(p) for p in li.pieces().pieces])
    assert np.allclose(lengths @ long, 601)


def test_all_pieces_that_words_can_hold_are_found(known):
    longest = max((p for p in known if len(p) == li.pieces().longest and li.spoken(p.decode("utf-8", "ignore"))), key=len)
    matrix = np.frombuffer(longest, np.uint8)[None]
    assert li.pieces().of(matrix)[-1][0].tolist() == [known[longest]]
    assert all(not li.spoken(p.decode("utf-8", "ignore")) or len(li.spoken(p.decode("utf-8", "ignore"))[0]) <= li.pieces().longest or p.lower() != p for p in known)


def test_texts_of_no_language_are_rejected(spark):
    model = li.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(1, "x%$#@ 1234 ^^^^"), (2, "qqq zzzx vvvk"), (3, "the red car stood in the town"), (4, "Ein Wort"), (5, None), (6, "xkqj wvzx kjqv")]
    kept = li.reject(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4}


def test_pieces_are_found_inside_words_only():
    """The finds of a group are the pieces of each word, each once, whatever the padding."""
    words, known = [b"a", b"the", b"strassenbahn", "gr\u00f6\u00dfe".encode()], li.pieces()
    places = {p: k for k, p in enumerate(known.pieces)}
    for here, matrix, lengths in li._groups(words):
        made = set()
        for size, (bounds, row, place) in enumerate(known.finds(matrix, lengths), 1):
            for start in range(len(bounds) - 1):
                made |= {(int(here[r]), start, size, int(p)) for r, p in zip(row[bounds[start] : bounds[start + 1]], place[bounds[start] : bounds[start + 1]])}
        wanted = set()
        for k in here.tolist():
            word = b" " + words[k]
            wanted |= {(k, i, j - i, places[word[i:j]]) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in places and j - i <= known.longest}
        assert made == wanted


def test_batches_are_counted_together():
    """Fitting meets tables of many words, however small Spark's batches are."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 10))], names=["n"]) for k in range(0, 100, 10)]
    made = list(li._joined(iter(batches), 35))
    assert [t.num_rows for t in made] == [40, 40, 20] and sum((t.column(0).to_pylist() for t in made), []) == list(range(100))
    assert list(li._joined(iter([]), 35)) == []
