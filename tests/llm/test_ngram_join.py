import random

import numpy as np
import pytest

from roadpulse.llm import ngram_join as nj
from roadpulse.llm.common import words


def grams(text, size=5):
    found = words(text)
    size = min(size, len(found)) or 1
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()


def brute(rows, similarity=nj.SIMILARITY):
    """(class_id, n_links, class_size) per row, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-12] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, left = {i}, [i]
        while left:
            for j in linked[left.pop()]:
                if j not in seen:
                    seen.add(j)
                    left.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(linked[i]), len(seen)))
    return sorted(out, key=str)


def copies(seed, groups, spread=6):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(1, 150))]
        for _ in range(draw.choice([1, 1, 2, spread])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                own[draw.randrange(len(own))] = f"x{draw.randint(0, 9)}"
            rows.append((len(rows) + 10, " ".join(own)))
    draw.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        count, rows = nj.bands(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** count >= 0.999 and count * rows <= nj.HASHES
    assert nj.bands() == (24, 5)


@pytest.mark.parametrize("seed,small,block", [(1, 16, 150_000), (2, 2, 150_000), (3, 2, 300), (4, 4, 60)])
def test_against_all_pairs(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = copies(seed, 40, spread=25)
    rows += [(1, None), (2, ""), (3, " .,! "), (4, "two words"), (5, "Two, words!"), (None, rows[0][1]), (None, None), rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(nj.classes(df)) == brute(rows)


def test_a_chain_is_one_class(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[4 * k :], *[f"z{j}" for j in range(4 * k)]])) for k in range(30)]
    made = nj.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(made) == brute(rows)
    assert {r[1] for r in got(made)} == {0}


def test_keep_one(spark):
    rows = copies(9, 30)
    rows += [(900, None), (901, ""), (902, "same text here"), (902, "same text here"), (903, "same text here"), (None, "same text here"), (None, "null id twice"), (None, "null id twice")]
    schema = "doc_id long, text string, content string, root int, id int"
    df = spark.createDataFrame([(*r, "c", 1, k) for k, r in enumerate(rows)], schema).repartition(4)
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {r[1] for r in brute(rows)}
    assert sorted(str(k) for k, _ in left) == sorted(map(str, want))
    assert (902, "same text here") in left and (None, "null id twice") in left


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.classes(empty).count() == 0 and nj.keep_one(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    made = {r["node"]: r["root"] for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {x: find(x) for x in linked}


@pytest.mark.parametrize("same", [True, False])
def test_blocks(same):
    random_ = np.random.default_rng(4)
    sets = [np.unique(random_.choice(40, random_.integers(1, 40))) for _ in range(60)]
    sets += [s[1:] if len(s) > 6 else s for s in sets[:30]]
    side = np.zeros(len(sets), np.int64) if same else random_.integers(0, 2, len(sets))
    weights = random_.integers(1, 4, len(sets))
    counts, edges = nj._block_links(sets, side, weights, 0.8, same)
    pairs = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and (same or side[i] != side[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert counts.tolist() == [sum(int(weights[j]) for a, j in pairs if a == i) for i in range(len(sets))]
    label = list(range(len(sets)))
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    joined = list(range(len(sets)))
    for a, b in edges:
        joined[a] = b
    assert joined == label
