import numpy as np
import pytest

from roadpulse.llm import whitening
from roadpulse.llm.queries import QUERIES

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def check(df, rows, components=32):
    """Against the eigenvectors of the covariance, formed here outright."""
    assert df.columns == COLUMNS
    got = df.toPandas()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, width = x.shape
    sums = x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = min(components, width)
    assert len(got) == n * used and (got["n"] == n).all() and got["component"].min() == 1 and got["component"].max() == used
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    want = {}
    for (i, _), gaps in zip(rows, n * x - sums):
        want.setdefault(i, []).append(sum(int(g) ** 2 for g in gaps))
    assert sorted(got[got["component"] == 1]["deviation"].tolist()) == sorted(d for ds in want.values() for d in ds)
    for k in range(used):
        one = got[got["component"] == k + 1]
        if values[k] < 1e-20 * max(values[0], 1e-300) or values[0] < 1e-20 or values[k] < 1e-12 * values[0]:
            assert one["whitened"].isna().all()
            continue
        assert np.allclose(one["explained"], values[k] / values.sum(), rtol=1e-9)
        own = np.sort(one["whitened"].to_numpy())
        true = centred @ vectors[:, k] / np.sqrt(values[k])
        assert np.allclose(own, np.sort(true), atol=1e-7) or np.allclose(own, np.sort(-true), atol=1e-7)
        assert abs((own**2).mean() - 1) < 1e-9
    return got


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_given_vectors(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = check(QUERIES["op12_whitening"](spark, path), rows)
    # One sign for all rows: components of one row belong together.
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(wide.T @ wide / len(wide) - np.eye(32)).max() < 1e-9


def test_bad_rows_repeats_and_clashing_names(spark):
    random = np.random.default_rng(0)
    rows = [(k, random.normal(0, 1, 5).tolist()) for k in range(40)] + [(None, [0.5] * 5), (3, [0.25] * 5)] + [(7, [0.125] * 5)] * 30
    bad = [(100, None), (101, []), (102, [None] * 5), (103, [float("nan")] * 5), (104, [float("-inf")] + [0.0] * 4), (105, [1e300] * 5)]
    df = spark.createDataFrame([(v, i, "w", 2, 0.5) for i, v in rows + bad], "embedding array<double>, vec_id long, whitened string, n int, v double")
    check(whitening.whiten(df.repartition(7)), rows)


def test_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(k, [float(k), 1.0, -float(k)]) for k in range(6)]  # one direction varies
    got = check(whitening.whiten(spark.createDataFrame(rows, schema)), rows)
    assert got[got["component"] == 1]["explained"].iloc[0] == pytest.approx(1) and got["whitened"].isna().sum() == 12
    same = whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], schema)).toPandas()
    assert len(same) == 6 and same["whitened"].isna().all() and same["explained"].isna().all() and (same["deviation"] == 0).all()
    one = whitening.whiten(spark.createDataFrame([(1, [1.0])], schema)).collect()
    assert [tuple(r)[:5] for r in one] == [(1, 1, 1, 0, None)]
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []


def test_lengths_are_fitted_apart(spark):
    random = np.random.default_rng(1)
    short = [(k, random.normal(0, 1, 2).tolist()) for k in range(20)]
    long = [(100 + k, random.normal(0, 1, 40).tolist()) for k in range(90)]
    got = whitening.whiten(spark.createDataFrame(short + long, "vec_id long, embedding array<double>"))
    check(got.where("vec_id < 100"), short)
    check(got.where("vec_id >= 100"), long)


def test_deviations_beyond_a_long():
    centred = whitening._Centred(3, [10**15 * 3, 1], 64, 0)
    assert centred.deviations(np.array([[5, 0], [1 << 50, 0]], np.int64)) == [15 * 15 + 1, None]
    assert centred.deviations(np.array([[5, 0]], np.int64)) == [15 * 15 + 1]


def cases():
    random = np.random.default_rng(2)
    turn, _ = np.linalg.qr(random.normal(size=(30, 30)))
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 12.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield np.triu(random.normal(size=(50, 50)))
    yield np.linalg.qr(random.normal(size=(400, 64)), mode="r")
    yield np.diag(np.r_[np.full(12, 3.0), np.full(10, 2.0), np.full(8, 1e-9)]) @ turn.T  # clusters
    yield np.diag(10.0 ** -np.arange(30)) @ turn.T
    yield np.diag(10.0 ** np.arange(-29, 1)) @ turn.T
    yield np.linalg.cholesky(wilkinson).T
    yield np.diag(np.full(40, 2.0)) + np.diag(np.full(39, -1e-7), 1)
    yield np.eye(8)
    yield np.zeros((3, 3))
    yield np.ones((6, 6))
    yield np.array([[2.0]])


@pytest.mark.parametrize("r", list(cases()))
def test_solver(r):
    values, vectors = whitening.solve(r)
    top = max(values[0], 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(r))).max() < 1e-11
    assert np.abs(values - np.linalg.svd(r, compute_uv=False)).max() < 1e-13 * max(top, 1)
    assert np.abs((r @ vectors).T @ (r @ vectors) - np.diag(values**2)).max() < 1e-11 * max(top**2, 1)


def test_small_singular_values_are_accurate():
    """Squared diagonals over thirty orders of magnitude keep all their digits."""
    from fractions import Fraction

    q, e = np.array([1.0, 1e-10, 1e-20, 1e-30]), np.array([1e-6, 1e-16, 1e-26])
    values = whitening.dqds(q, e)
    product = np.prod([Fraction(float(v)) for v in values])
    assert abs(float(product / (Fraction(1.0) * Fraction(1e-10) * Fraction(1e-20) * Fraction(1e-30))) - 1) < 1e-13
