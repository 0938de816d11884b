"""Outliers by bounds against comparing every place, and the work they take."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from obsweave.operators.outliers import _unit, group_bounds, outlier_locations


def rule(pdf, mult=5):
    """Outlier places of one species by all distances."""
    v = _unit(pdf.lon, pdf.lat)
    chord = np.sqrt(np.maximum(0, ((v[:, :, None] - v[:, None, :]) ** 2).sum(axis=0)))
    d = 2 * 6371008.8 * np.arcsin(np.minimum(1, chord / 2))
    w = pdf.n.to_numpy()
    mean = np.round(d @ w / (w.sum() - 1), 3)
    q1, q3 = np.quantile(np.repeat(mean, w), [0.25, 0.75])
    return {(a, b) for a, b, m in zip(pdf.lon, pdf.lat, mean) if m > q3 + mult * (q3 - q1)}


def sets(rng, n):
    """Even, clustered, with far places, both sides of the globe, weights that differ, near-ties."""
    even = rng.uniform([30, -5], [42, 5], (n, 2))
    clusters = rng.normal(0, 0.02, (n, 2)) + rng.uniform([-60, -40], [60, 40], (4, 2))[rng.integers(0, 4, n)]
    dense = rng.normal([36.8, -1.3], 0.3, (n, 2))
    far = np.concatenate([dense[: n - 9], rng.uniform([-170, -60], [170, 60], (9, 2))])
    poles = np.stack([rng.uniform(-180, 180, n), np.where(rng.random(n) < 0.5, 89.5, -89.5) + rng.uniform(-0.4, 0.4, n)], 1)
    ladder = np.stack([36 + np.linspace(0, 1, n) ** 6 * 30, np.zeros(n)], 1)
    line = np.stack([np.full(n, 20.0), np.linspace(-0.001, 0.001, n)], 1)
    out = {"even": even, "clusters": clusters, "far": far, "poles": poles, "ladder": ladder, "line": line}
    frames = []
    for name, at in out.items():
        n_rec = rng.integers(1, 9, len(at)) if name != "far" else np.where(rng.random(len(at)) < 0.01, 500, 1)
        frames.append(pd.DataFrame({"species": name, "lon": at[:, 0], "lat": at[:, 1], "n": n_rec}))
    return pd.concat(frames).drop_duplicates(["species", "lon", "lat"])


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for k in range(300):
        width = 10.0 ** rng.uniform(-5, 1.8)
        at = rng.uniform(-70, 70, 2)
        g = rng.normal(at, width, (rng.integers(1, 30), 2)).clip(-89, 89)
        w = rng.integers(1, 5, len(g)).astype(float)
        v = _unit(g[:, 0], g[:, 1])
        c = (v * w).sum(axis=1) / w.sum()
        spread = w.sum() * (max(0, 1 - c @ c) + 1e-15)
        radius = np.sqrt(((v - c[:, None]) ** 2).sum(axis=0)).max() + 1e-9
        p = rng.uniform([-180, -89], [180, 89], (20, 2))
        p[:5] = g[0] + rng.normal(0, width, (5, 2))
        p[5] = [g[0][0] + 180, -g[0][1]]
        x = _unit(p[:, 0], p[:, 1])
        chord = np.sqrt(((x[:, :, None] - v[:, None, :]) ** 2).sum(axis=0))
        true = 2 * 6371008.8 * np.arcsin(np.minimum(1, chord / 2)) @ w
        low, high = group_bounds(x, c[:, None], np.array([w.sum()]), np.array([spread]), np.array([radius]))
        assert (low <= true + 1e-3 + 1e-9 * true).all() and (true <= high + 1e-3 + 1e-9 * true).all()


@pytest.mark.parametrize("mult", [5, 0.5])
def test_bounds_decide_as_all_pairs_do(spark, mult):
    pdf = sets(np.random.default_rng(3), 900)
    df = spark.createDataFrame(pdf).repartition(4)
    pairs = []
    got = {tuple(r) for r in outlier_locations(df, mult=mult, exact_places=50, pairs=pairs).collect()}
    want = {(s, *p) for s, own in pdf.groupby("species") for p in rule(own, mult)}
    assert got == want and len(want) > 9
    assert sum(pairs) < 6 * 900 * 900 * (0.5 if mult == 5 else 1.5)


def test_work_grows_slower_than_n_to_three_halves(spark):
    sizes, work = (4000, 32_000), []
    for n in sizes:
        rng = np.random.default_rng(5)
        dense = np.concatenate([rng.normal([36.8, -1.3], 0.5, (n - 20, 2)), rng.uniform([-170, -60], [170, 60], (20, 2))])
        pairs = []
        df = spark.createDataFrame(pd.DataFrame({"species": "s", "lon": dense[:, 0], "lat": dense[:, 1], "n": 1}))
        found = outlier_locations(df, exact_places=50, pairs=pairs).count()
        assert 15 <= found <= 20
        work.append(sum(pairs))
    assert math.log(work[1] / work[0]) / math.log(sizes[1] / sizes[0]) < 1.5
    assert work[1] < sizes[1] ** 2 / 50


def test_python_is_handed_a_few_mb_at_a_time(spark, monkeypatch):
    from obsweave.operators import outliers
    from obsweave.plans import session

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    plain = outliers.cut
    monkeypatch.setattr(outliers, "cut", lambda df, stage="stage": seen.append(spark.conf.get(name, None)) or plain(df, stage))
    before = spark.conf.get(name, None)
    pdf = sets(np.random.default_rng(7), 60)
    outlier_locations(spark.createDataFrame(pdf), exact_places=50)
    assert seen and all(s is not None and int(s) <= session.BATCH_BYTES for s in seen)
    assert spark.conf.get(name, None) == before


def test_buckets_and_bounds_are_arrays_of_numbers():
    """Structures would reach Python as one dictionary per group."""
    from obsweave.operators import outliers

    for fn in (outliers._buckets, outliers._block_bounds):
        assert all(f.dataType.elementType.typeName() == "double" for f in fn.returnType.fields)
