"""Distribution functions on arrays, uniform numbers by counter, and quantile residuals against single draws."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.functions import tails
from obsweave.models import glm


def mass(family, k, mu, theta):
    """The probability of one count, by the formula."""
    if family == "poisson":
        return math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
    if family == "binomial":
        return {0: 1 - mu, 1: mu}.get(k, 0.0)
    p = theta / (theta + mu)
    return math.exp(math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1) + theta * math.log(p) + k * math.log1p(-p))


@pytest.mark.parametrize("family, means, theta", [
    ("poisson", (1e-6, 0.3, 4.0, 60.0, 900.0), None), ("negbin", (1e-6, 0.3, 4.0, 60.0, 900.0), 0.05),
    ("negbin", (0.3, 40.0, 900.0), 2.5), ("negbin", (0.3, 40.0), 5000.0), ("binomial", (0.01, 0.5, 0.99), None)])
def test_sums_of_masses(family, means, theta):
    ks = [-1, 0, 1, 2, 5, 17, 80, 950]
    for mu in means:
        got = tails.count_cdf(family, np.array(ks), np.full(len(ks), mu), theta)
        want = [math.fsum(mass(family, k, mu, theta) for k in range(top + 1)) for top in ks]
        assert got == pytest.approx(want, abs=1e-10)


def test_far_tails_settle():
    assert tails.gamma_upper(np.array([1e6, 1e6, 3.0]), np.array([1e6, 2e6, 0.0])) == pytest.approx([0.5, 0.0, 1.0], abs=5e-4)
    assert tails.beta_lower(np.array([1e5]), np.array([1e5]), np.array([0.5]))[0] == pytest.approx(0.5, abs=1e-9)
    assert len(tails.count_cdf("poisson", np.array([]), np.array([]))) == 0


def single(key, j):
    """One number of the generator in whole-number arithmetic."""
    full = (1 << 64) - 1

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        return z ^ z >> 31

    z = mix(mix(key & full) + (j + 1) * 0x9E3779B97F4A7C15 & full)
    return ((z >> 12) + 0.5) / 2**52


def test_uniforms_by_counter():
    keys = np.array([0, -1, 12345, -(2**63), 2**63 - 1])
    got = tails.uniforms(keys, 6)
    assert got.tolist() == [[single(int(k), j) for j in range(6)] for k in keys]
    many = tails.uniforms(np.arange(2000), 100)
    assert abs(many.mean() - 0.5) < 0.003 and abs(many.var() - 1 / 12) < 0.001
    assert abs(np.corrcoef(many[:-1, 0], many[1:, 0])[0, 1]) < 0.1 and 0 < many.min() and many.max() < 1


@pytest.mark.parametrize("family, theta", [("negbin", 1.7), ("poisson", None), ("binomial", None)])
def test_residuals_equal_single_draws(spark, family, theta):
    """Every simulated response by running up its distribution function, one draw after the other."""
    rng = np.random.default_rng(5)
    coef = 0.8 if family != "binomial" else 0.4
    rows = [(i, float(v), float(rng.integers(2 if family == "binomial" else 9))) for i, v in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame([*rows, (40, 0.1, None), (41, None, 1.0)], "id long, x1 double, n_records double")
    model = glm.Fitted(family, ("x1",), 0.5, (coef,), (0.1, 0.1), 40, 0.0, theta)
    n = 60
    got = {r["id"]: r["u"] for r in glm.quantile_residuals(df.repartition(3), model, n).collect()}
    assert got[40] is None and got[41] is None
    facts = df.select("id", "n_records", model.mean().alias("mu"), F.xxhash64(F.lit(123), "id").alias("key")).where("id < 40")
    for r in facts.collect():
        sims = []
        for j in range(n):
            u, k, total = single(r["key"], j), 0, mass(family, 0, r["mu"], theta)
            while total < u:
                k += 1
                total += mass(family, k, r["mu"], theta)
            sims.append(k)
        low, high = (sum(f) / n for f in zip(*((s < r["n_records"], s <= r["n_records"]) for s in sims)))
        assert got[r["id"]] == pytest.approx(low + single(r["key"], n) * (high - low), abs=1e-9)
