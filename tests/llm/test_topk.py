import numpy as np
import pytest

from roadpulse.llm import topk
from roadpulse.session import cut_lineage


def whole(v, scale=256):
    """The whole numbers of a vector that takes part, else None."""
    if not v or any(x is None or not np.isfinite(x) for x in v):
        return None
    if sum(x * scale * (x * scale) for x in v) >= topk.SQUARES:
        return None
    return [int(np.floor(x * scale)) for x in v]


def brute(rows, asking, nearest=5):
    held = {(i, tuple(whole(v))) for i, v in rows if i is not None and whole(v)}
    out = []
    for q, v in {(i, tuple(whole(v))) for i, v in asking if i is not None and whole(v)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if (i, w) != (q, v) and len(w) == len(v))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:nearest])]
    return sorted(out)


def check(df, asking, rows, asked, **options):
    assert sorted(tuple(r) for r in topk.search(df, asking, **options).collect()) == brute(rows, asked)


@pytest.mark.parametrize("lists", [1, 2, 3, 5])
def test_against_all_pairs(spark, monkeypatch, lists):
    """Many small blocks, scores of either sign, copies, ties and vectors of another length."""
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(topk, "QUERY_NUMBERS", 30)
    random = np.random.default_rng(lists)
    rows = [(k, random.normal(-0.1, 0.3, 7).tolist()) for k in range(150)]
    rows += [(k, random.integers(-1, 2, 7).astype(float).tolist()) for k in range(150, 300)]
    rows += [(k, [0.5, -0.5, 0.25]) for k in range(300, 330)] + [(k, [float(k - 340)]) for k in range(330, 350)]
    asked = [r for r in rows if r[0] % 10 == 0]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    check(df, df.where("vec_id % 10 = 0"), rows, asked, lists=lists)


def test_bad_rows_and_copies(spark):
    random = np.random.default_rng(1)
    rows = [(k, random.normal(0, 1, 6).round(2).tolist()) for k in range(60)] + [(100 + k, [0.5] * 6) for k in range(200)]
    rows += [(1000, None), (1050, []), (1100, [None] * 6), (1150, [float("nan")] * 6), (1200, [float("inf")] * 6), (1250, [1e300] * 6), (None, [9.0] * 6)]
    rows += [(1300, [0.0] * 6), (1350, [-9.0] * 6), rows[50], rows[50], (50, [0.25] * 6)]
    df = spark.createDataFrame([(v, i, "q", 0.5, 3) for i, v in rows], "embedding array<double>, vec_id long, query_id string, score double, rank int")
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    check(df, df.where("vec_id % 50 = 0"), rows, asked)


def test_numbers_beyond_double_precision(spark):
    random = np.random.default_rng(2)
    rows = [(k, (random.integers(-(1 << 20), 1 << 20, 4) + random.integers(0, 256, 4) / 256).astype(float).tolist()) for k in range(40)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), rows, rows[:4])


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert topk.search(empty, empty).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, schema)
    assert topk.search(empty, df).count() == 0 and topk.search(df, empty).count() == 0
    assert topk.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    check(df, df, rows, rows)


def test_the_cutoff_spares_most_pairs(spark):
    """Vectors that look like some query are handed in, the rest of the table is not."""
    random = np.random.default_rng(3)
    near = random.integers(-50, 50, (20, 8))
    far = random.integers(-10, 10, (2000, 8))
    matrix = np.concatenate([near, near + random.integers(-3, 4, near.shape), near + random.integers(-3, 4, near.shape), near * 2, near * 3, far])
    held = cut_lineage(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(matrix)], "rep long, v array<long>"))
    asked = cut_lineage(held.where("rep < 20"))
    got = topk.totals(held, asked, 3).collect()
    assert len(got) < 0.05 * 20 * len(matrix)
    scores = near @ matrix.T
    for q in range(20):
        mine = {r["rep"]: r["total"] for r in got if r["q"] == q}
        assert all(scores[q, rep] == total for rep, total in mine.items())
        assert sorted(mine.values())[-3:] == sorted(scores[q].tolist())[-3:]
