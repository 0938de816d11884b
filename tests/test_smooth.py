"""The chosen penalty and the curve it gives, against plain matrix algebra."""

from __future__ import annotations

import numpy as np
import pytest

from obsweave.models import smooth


def columns(rng, n):
    x = np.column_stack([np.ones(n), rng.normal(size=(n, 6)) * [1, 10, 0.1, 1, 1, 3]])
    x[:, 4] = x[:, 1] + 1e-3 * x[:, 4]  # nearly the same column twice
    return x


def scores(x, w, z, lam):
    """Effective parameters, weighted residual sum and score with the hat matrix written out."""
    a = x.T @ (w[:, None] * x)
    pen = a + lam * np.diag([0.0, *np.diag(a)[1:]])
    hat = np.linalg.solve(pen, (x * w[:, None]).T)
    r = z - x @ (hat @ z)
    edf, rss = np.trace(x @ hat), (w * r * r).sum()
    return edf, rss, len(z) * rss / (len(z) - edf) ** 2


def test_path_equals_the_hat_matrix():
    rng = np.random.default_rng(7)
    x, w, z = columns(rng, 120), rng.uniform(0.2, 3, 120), rng.normal(size=120)
    z = z + 0.4 * x[:, 1] - 2 * x[:, 3]
    sums = x.T @ (w[:, None] * x), x.T @ (w * z), float((w * z * z).sum()), 120.0
    some = [1e-4, 1e-2, 0.3, 7.0, 1e3]
    assert smooth.penalty_path(*sums, some) == pytest.approx(np.array([scores(x, w, z, v) for v in some]), rel=1e-7)
    chosen = smooth.best_penalty(*sums)
    grid = np.geomspace(1e-10, 1e4, 3000)
    by_hand = grid[int(np.argmin([scores(x, w, z, v)[2] for v in grid]))]
    assert chosen == pytest.approx(by_hand, rel=0.03) and 1e-9 < chosen < 1e3


def test_fit_and_curve_equal_matrix_algebra(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, 500)
    y = rng.poisson(np.exp(1 + np.sin(2 * x)))
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, v double, n_records long")
    model = smooth.fit_smooth(df, terms=("v",), k=8, surface=0)
    lam, cols = model.notes["ridge"], smooth.basis(df, ("v",), model.notes["k"], 0)
    rows = df.select("id", "n_records", *[c.alias(k) for k, c in cols.items()], ).orderBy("id").toPandas()
    m = np.column_stack([np.ones(500), rows[list(cols)].to_numpy()])
    b = np.zeros(m.shape[1])
    b[0] = np.log(y.mean())
    theta = model.theta or np.inf
    for _ in range(200):
        mu = np.exp(m @ b)
        w = mu / (1 + mu / theta)
        a = m.T @ (w[:, None] * m)
        b = np.linalg.solve(a + lam * np.diag([0.0, *np.diag(a)[1:]]), m.T @ (w * (m @ b + (y - mu) / mu)))
    assert [model.intercept, *model.coef] == pytest.approx(b.tolist(), rel=2e-3, abs=2e-4)
    z = m @ b + (y - np.exp(m @ b)) / np.exp(m @ b)
    grid = np.geomspace(lam / 30, lam * 30, 400)
    assert lam == pytest.approx(grid[int(np.argmin([scores(m, w, z, v)[2] for v in grid]))], rel=0.05)
    assert model.notes["edf"] == pytest.approx(scores(m, w, z, lam)[0], rel=1e-3)
    fitted = smooth.smooth_columns(df, ("v",), model.notes["k"], 0).select("id", model.mean().alias("m")).orderBy("id").toPandas()["m"]
    assert np.abs(fitted - np.exp(m @ b)).max() < 0.02
    # eight knots follow the wave
    assert np.sqrt(np.mean((np.log(fitted) - (1 + np.sin(2 * x))) ** 2)) < 0.25


def test_a_given_penalty_is_kept(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(v), int(rng.poisson(3))) for i, v in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "id long, v double, n_records long")
    assert smooth.fit_smooth(df, terms=("v",), surface=0, ridge=0.5).notes["ridge"] == 0.5
