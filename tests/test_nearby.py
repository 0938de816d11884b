"""Nearest neighbours in a tree with small leaves: crowded places, ties, missing coordinates, both join paths."""

from __future__ import annotations

import math
import random

import pytest

from obsweave.models import design
from obsweave.operators import nearby
from tests.test_operators import km


def crowded(n: int, seed: int) -> list[tuple]:
    """Nine of ten points in one cell of 0.01 degrees, a tenth of those at one place."""
    rng = random.Random(seed)
    out = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n // 10)]
    out += [(20.003, 60.004)] * (n // 10)
    return out + [(20 + rng.random() / 100, 60 + rng.random() / 100) for _ in range(n - len(out))]


def frame(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double")


def brute(left, right, k, dist, exclude):
    out = {}
    for i, a in enumerate(left):
        near = sorted((round(dist(a, b), 6), j) for j, b in enumerate(right) if not (exclude and i == j))
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("metric", ["haversine", "planar"])
@pytest.mark.parametrize("small", [nearby.SMALL_LEVEL, 0])
def test_crowded_points_equal_brute_force(spark, metric, small, monkeypatch):
    monkeypatch.setattr(nearby, "SMALL_LEVEL", small)
    points = crowded(700, 5)
    dist = km if metric == "haversine" else lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) * 111
    left = points[::9] + [(0.0, 0.0), (179.99, -10.0), (20.003, 60.004)]
    got: dict[int, list] = {}
    rows = nearby.knn(frame(spark, left), frame(spark, points), 4, metric, exclude_same=True).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["lid"], []).append((r["km"], r["rid"]))
    want = brute(left, points, 4, dist, True)
    assert got.keys() == want.keys()
    for i, near in want.items():
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in near], abs=2e-6)
        if near[0][0] == near[-1][0] == 0:  # points at one place: ties follow the id
            assert got[i] == near


def test_leaves_are_small_wherever_points_are(spark):
    points = [(float(x), float(y)) for x, y in crowded(5000, 6)]
    df = frame(spark, points).selectExpr("id AS rid", "lon AS x", "lat AS y").distinct()
    levels = nearby.point_tree(df)
    sizes = [r["n"] for r in levels[0].collect()]
    assert sum(sizes) == df.count() and max(sizes) <= nearby.LEAF
    assert len(sizes) == -(-df.count() // nearby.LEAF)
    for level in levels[1:]:
        assert max(len(r["below"]) for r in level.collect()) <= nearby.FAN
    assert levels[-1].count() <= nearby.FAN
    for r in levels[0].collect():
        assert all(r["x0"] <= p["x"] <= r["x1"] and r["y0"] <= p["y"] <= r["y1"] for p in r["below"])


def test_points_without_coordinates_and_empty_tables(spark):
    none = frame(spark, [])
    some = frame(spark, [(1.0, 2.0), (None, 2.0), (1.0, None), (float("nan"), 0.0), (math.inf, 0.0), (500.0, -300.0)])
    assert nearby.knn(some, none).count() == 0 and nearby.knn(none, some).count() == 0
    rows = {r["lid"]: (r["rid"], r["km"]) for r in nearby.knn(some, some, 1, "planar").collect()}
    assert rows == {0: (0, 0.0), 5: (5, 0.0)}
    near = nearby.knn(some, some, 3, "planar", exclude_same=True).collect()
    assert {(r["lid"], r["rid"]) for r in near} == {(0, 5), (5, 0)}


def test_city_distances_alike_on_both_paths(spark, monkeypatch):
    cells = frame(spark, crowded(200, 8)).selectExpr("id", "lon AS lon_c", "lat AS lat_c")
    cities = frame(spark, crowded(60, 9))
    monkeypatch.setattr(design, "raster_lookup", lambda cells, *_: cells)
    by_list = design.covariates(cells, None, None, cities, bands=())
    monkeypatch.setattr(design, "MAX_TOWNS", 0)
    by_tree = design.covariates(cells, None, None, cities, bands=())
    value = lambda df: {r["id"]: r["dist_to_city_km"] for r in df.collect()}
    assert value(by_list) == value(by_tree)
