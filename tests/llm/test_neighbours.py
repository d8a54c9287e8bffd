import numpy as np
import pytest

from roadpulse.llm import neighbours
from roadpulse.llm.queries import QUERIES


def brute(rows, queries, nearest=5):
    out = {}
    good = [(i, neighbours._scaled(np.asarray([v], float))[0]) for i, v in rows if usable(i, v)]
    for q, v in queries:
        if not usable(q, v):
            continue
        v = neighbours._scaled(np.asarray([v], float))[0]
        scored = {(-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), i) for i, w in good if i != q and len(w) == len(v)}
        if scored:
            out[q] = sorted((round(s, 12), i) for s, i in scored)[:nearest]
    return out


def usable(i, v):
    return i is not None and v is not None and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))


def found(df, name="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((round(-r["score"], 12), r[name]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got.get(q, [])}) for q in want)
    return hits / sum(len(v) for v in want.values())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = found(QUERIES["op10_neighbours"](spark, path))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_copies_ties_and_bad_rows(spark):
    random = np.random.default_rng(0)
    rows = [(k, random.standard_normal(8).round(3).tolist()) for k in range(200)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000 + k, [2 * x for x in rows[1][1]]) for k in range(3)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] + [1.0] * 7), (3004, [None] + [1.0] * 7), (None, [1.0] * 8), (3005, [1.0, 2.0])]
    rows += [rows[5], (1e9, [1e300] * 8), (1e9 + 1, [1e-300] * 7 + [0.0])]
    rows = [(None if i is None else int(i), v, "x", 0.5) for i, v in rows]
    schema = "vec_id long, embedding array<double>, query_id string, score double"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = found(neighbours.search(df, df.where("vec_id % 50 = 0 or vec_id >= 3000"), nearest=5))
    want = brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] >= 3000)])
    assert set(got) <= set(want) and 3005 not in got
    assert recall(got, want) >= 0.9
    for q in (0, 1000, 1050, 1100):
        assert got[q] == want[q]


def test_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SPLIT", 10)
    random = np.random.default_rng(1)
    rows = [(k, (random.standard_normal(6) + 3).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = neighbours.Hashing.draw(6, 1, 1, 1000.0, 1)
    asked = df.where("vec_id % 50 = 0")
    assert found(neighbours.search(df, asked, hashing=one)) == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_order_of_visits():
    hashing = neighbours.Hashing.draw(4, 1, 3, 1.0, 27)
    place = np.array([0.2, 5.6, -1.1])
    cells = hashing.visits(place)

    def cost(v):
        return sum({0: 0.0, -1: (place[j] - np.floor(place[j])) ** 2, 1: (1 - place[j] + np.floor(place[j])) ** 2}[int(x)] for j, x in enumerate(v - np.floor(place)))

    costs = [cost(v) for v in cells]
    assert costs == sorted(costs) and len({tuple(v) for v in cells}) == 27


def test_empty_and_tiny(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(empty, empty).count() == 0
    two = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(two, two.where("vec_id = 50")).collect()] == [(50, 1, 51)]
    assert neighbours.search(two.where("vec_id = 50"), two.where("vec_id = 50")).count() == 0
