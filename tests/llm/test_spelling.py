import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import spelling


def edits(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, times=10):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    counts = {}
    while len(counts) < 250:
        counts["".join(draw.choice("abà") for _ in range(draw.randint(1, 6)))] = 10 ** draw.randint(0, 4) + draw.randint(0, 3)
    got = rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)))
    assert len(got) == len(counts) and set(got) == brute(counts)


def test_runs_of_equal_letters_and_ties(spark):
    counts = {"aaaa": 500, "aaa": 50, "aa": 5, "aaab": 500, "baaa": 500, "abab": 1, "xyz": 7}
    got = {r[0]: r for r in rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert set(got.values()) == brute(counts)
    assert got["aaa"][1:3] == ("aaaa", "aaaa") and got["aa"][1:3] == ("aaa", "aaaa") and got["aaa"][4] == 4
    assert got["xyz"][1:] == (None, "xyz", 7, 0, None)


def test_long_chains_end(spark):
    counts = {"a" * (k + 1): 10**k for k in range(12)}
    got = {r[0]: r for r in rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert {r[2] for r in got.values()} == {"a" * 12}


def test_texts(spark):
    """Null, empty and long texts, null and repeated ids, repeated rows, clashing and further columns."""
    draw = random.Random(4)
    base = ["Straßenname", "ÜBERGANG", "mañanas", "longest", "x" * 40, "short", "l'università", "don×t÷it"]
    docs = [(k % 40, " ".join(draw.choice(base) for _ in range(draw.randint(0, 60)))) for k in range(80)]
    docs += [(None, "mañanas longest longest"), (7, None), (8, ""), (9, "abcdefgh " * 5000), (9, "abcdefgh")] + docs[:3]
    df = spark.createDataFrame([(t, i, "w", 1, "k") for i, t in docs], "text string, doc_id long, word string, n int, key string")
    found = spelling.runs(df)
    got = rows(spelling.variants(spelling.vocabulary(found.select(spelling.slipped(F.col("id"), F.col("run")).alias("word")))))
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert len(got) == len(counts) and set(got) == brute(counts)
    assert {"Übergang", "università"} <= set(counts) and "übergang" not in counts  # only A to Z become small


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.runs(empty).select(F.col("run").alias("word")))).count() == 0
    none = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.runs(none).select(F.col("run").alias("word")))).count() == 0


def test_a_group_is_bounded_by_the_alphabet(spark):
    """All words of three letters over an alphabet: no key holds more of them than letters and one."""
    words = ["".join(w) for k in (2, 3) for w in itertools.product("abcde", repeat=k)]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert spelling.rotations(df).groupBy("key").count().agg(F.max("count")).first()[0] == 6
