import datetime as dt

import numpy as np
import pytest

from xsecta.operators import gram, solve


def table(spark, x):
    """Long form of dates by names; nan is missing."""
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=t), f"N{i:02d}", float(v)) for t, row in enumerate(x) for i, v in enumerate(row) if not np.isnan(v)]
    return spark.createDataFrame(rows, "date date, ticker string, ret double")


def matrix(rows, n, c="c"):
    s = np.zeros((n, n))
    for r in rows:
        i, j = int(r.ticker_i[1:]), int(r.ticker_j[1:])
        assert i <= j
        s[i, j] = s[j, i] = r[c]
    return s


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(gram, "NAMES", 3)
    monkeypatch.setattr(gram, "DATES", 4)


def test_pair_sums_by_blocks_are_pairwise(spark, small_blocks):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(17, 8))
    x[rng.random(x.shape) < 0.2] = np.nan
    got = matrix(gram.covariance(table(spark, x)).collect(), 8)
    for i in range(8):
        for j in range(8):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert abs(got[i, j] - np.cov(x[both, i], x[both, j])[0, 1]) < 1e-12


def test_ledoit_wolf_equals_the_dense_form(spark, small_blocks):
    x = np.random.default_rng(1).normal(size=(20, 7)) * [1, 2, 1, 1, 3, 1, 1]
    assert np.allclose(matrix(gram.ledoit_wolf(table(spark, x)).collect(), 7), solve.shrunk(x))
    one = matrix(gram.ledoit_wolf(table(spark, x[:1])).collect(), 7)
    assert np.allclose(one, 1e-8 * np.eye(7))


@pytest.mark.parametrize("dates", [5, 30])
def test_repair_and_axes_from_either_side(spark, small_blocks, dates):
    x = np.random.default_rng(dates).normal(size=(dates, 9))
    s = np.cov(x, rowvar=False)
    rets = table(spark, x)
    assert np.allclose(matrix(gram.repaired_covariance(rets, share=0.05).collect(), 9), solve.eigen_floor(s, share=0.05))
    lead = np.zeros((2, 9))
    for r in gram.sample_axes(rets, 2).collect():
        lead[r.k, int(r.ticker[1:])] = r.v
    vectors = np.linalg.eigh(s)[1][:, -2:]
    assert np.allclose(lead.T @ lead, vectors @ vectors.T)


def test_axes_beyond_their_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(gram, "SIDE", 2)
    with pytest.raises(ValueError):
        gram.sample_axes(table(spark, np.ones((4, 4))))


def test_weights_come_from_axes_that_travel_with_the_names(spark):
    rng = np.random.default_rng(3)
    x, mu = rng.normal(size=(40, 12)) / 100, rng.normal(size=12)
    rets = table(spark, x)
    alpha = spark.createDataFrame([(dt.date(2020, 3, 1), f"N{i:02d}", float(m)) for i, m in enumerate(mu)], "date date, ticker string, weight double")
    betas = spark.createDataFrame([(f"N{i:02d}", 1.0) for i in range(12)], "ticker string, beta double")
    rows = solve.optimal_weights(alpha, gram.sample_axes(rets), betas).orderBy("ticker").collect()
    w = np.array([r.weight for r in rows])
    best, _ = solve.mean_variance_status(mu, solve.eigen_floor(np.cov(x, rowvar=False)), np.ones(12))
    assert {r.status for r in rows} <= {"solved", "fallback"} and abs(w @ mu - best @ mu) < 1e-3 and abs(w.sum()) < 1e-5
