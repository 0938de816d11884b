"""Hand-computed values, brute-force checks and invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsweave.columns import EARTH_RADIUS_M, Columns
from obsweave.functions import pvalues, special
from obsweave.functions.geo import hex_centre, hex_key
from obsweave.models import design, glm
from obsweave.operators import accumulation, cells, environment, nearby, polygons, taxonomic, temporal
from obsweave.operators.outliers import outlier_locations
from obsweave.plans import running
from obsweave.plans.running import exact_quantiles, running_sums
from obsweave.plans.skew import attach
from obsweave.sources.reference import RASTER_SCHEMA, RasterGrid

COLS = Columns()


def km(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def one(df):
    return df.collect()[0]


# ---------------------------------------------------------------- statistics


def test_gini_goldens(spark):
    g = lambda v: one(taxonomic.gini(spark.createDataFrame([(x,) for x in v], "x long"), "x"))["gini"]
    assert g([1, 2, 3, 4]) == pytest.approx(0.25)
    assert g([5, 5, 5]) == pytest.approx(0)
    assert g([0, 0, 0, 9]) == pytest.approx(3 / 4)


def test_diversity_goldens(spark):
    r = one(taxonomic.diversity(spark.createDataFrame([(5,), (5,)], "x long"), "x"))
    assert (r["simpson"], r["shannon"], r["pielou"]) == pytest.approx((0.5, math.log(2), 1))
    assert one(taxonomic.diversity(spark.createDataFrame([(5,)], "x long"), "x"))["pielou"] is None


def test_mann_kendall_golden(spark):
    df = spark.createDataFrame([(y, float(y)) for y in range(1, 5)], "y int, v double")
    r = one(temporal.mann_kendall(df, "v", "y"))
    assert (r["s_stat"], r["n"]) == (6, 4) and r["tau"] == pytest.approx(1)
    assert r["var_s"] == pytest.approx(4 * 3 * 13 / 18)


def test_gap_golden(spark):
    df = spark.createDataFrame([(2000, 1), (2001, 1), (2005, 1)], "year int, n_records long")
    r = one(temporal.gap_summary(df))
    assert (r["longest_gap"], r["n_gap_runs"], r["years_without_data"], r["completeness_pct"]) == (3, 1, 3, 50.0)


def test_chi_square_golden(spark):
    r = one(temporal.chisq_uniform(spark.createDataFrame([(10,), (20,), (30,)], "n_records long")))
    assert (r["chi_squared"], r["df"]) == (pytest.approx(10), 2)
    assert r["p_value"] == pytest.approx(math.exp(-5))


def test_ks_goldens(spark):
    rows = [("v", "Sampled", x) for x in (1.0, 2.0, 3.0)] + [("v", "Available", x) for x in (4.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "variable string, type string, value double")
    assert one(environment.ks_two_sample(df))["d"] == 1.0
    same = df.withColumn("value", F.pmod(F.col("value") - 1, F.lit(3.0)))
    assert one(environment.ks_two_sample(same))["d"] == 0.0


def test_tail_probabilities():
    assert pvalues.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.chi2_p(40, 60) == pytest.approx(0.97818, abs=1e-5)


def test_special_functions(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.0, 3.7, 250.0, 1e6)], "x double")
    for r in df.select("x", special.lgamma(F.col("x")).alias("l"), special.digamma(F.col("x")).alias("d")).collect():
        assert r["l"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-11)
        h = 1e-5 * r["x"]
        assert r["d"] == pytest.approx((math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h), rel=1e-4, abs=1e-4)


def test_quantiles_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([1.0, 7.5, rng.gauss(0, 100)])) for g in "ab" for _ in range(400)]
    rows += [(None, 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in exact_quantiles(df, "v", {"q": 0.3, "m": 0.5}, ["g"]).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert (got[g]["q"], got[g]["m"]) == pytest.approx(tuple(np.quantile(v, [0.3, 0.5])))
    vals = sorted({x for k, x in rows if k == "a" and x is not None})
    run = running_sums(spark.createDataFrame([(x, 1) for x in vals], "v double, n long"), ["v"], {"c": "n"})
    assert [r["c"] for r in run.orderBy("v").collect()] == list(range(1, len(vals) + 1))
    assert exact_quantiles(df.where("false"), "v", {"m": 0.5}).collect()[0]["m"] is None


# -------------------------------------------------------------------- skew


@pytest.mark.parametrize("hot", [None, "x"])
def test_attach_with_hot_and_null_keys(spark, hot):
    rows = [(i, hot if i % 3 == 0 else f"k{i % 2000}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string")
    dim = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = attach(df, dim, ["k"], ["top"], "n", dim.agg(F.sum("n")).scalar())
    got = {r["id"]: r["top"] for r in out.collect()}
    best = {}
    for i, k in rows:
        best[k] = max(best.get(k, -1), i)
    assert got == {i: best[k] for i, k in rows}


def test_hot_rows_do_not_share_one_task(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    dim = rows.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = attach(rows, dim.withColumn("v", F.lit(1)), ["k"], ["v"], "n", dim.agg(F.sum("n")).scalar())
        sizes = [r["c"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 * 0.35


# ----------------------------------------------------------------- geometry


def test_hexagon_is_nearest_centre(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(400)]
    q, r = hex_key("lon", "lat", 0.1)
    df = spark.createDataFrame(rows, "lon double, lat double").select("lon", "lat", q.alias("q"), r.alias("r"))
    x, y = hex_centre("q", "r", 0.1)
    for row in df.select("*", x.alias("x"), y.alias("y")).collect():
        own = math.hypot(row["lon"] - row["x"], row["lat"] - row["y"])
        for dq, dr in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
            cx = (row["q"] + dq + (row["r"] + dr) / 2) * 0.1
            cy = (row["r"] + dr) * 0.1 * 3**0.5 / 2
            assert own <= math.hypot(row["lon"] - cx, row["lat"] - cy) + 1e-12


def test_inside_concave_polygon(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    df = spark.createDataFrame([(2.0, 0.5), (2.0, 2.0), (0.5, 2.0), (5.0, 1.0), (None, 1.0)], "lon double, lat double")
    got = [r[0] for r in polygons.add_inside(df, polygons.as_rings(spark, ring), "hit").select("hit").collect()]
    assert got == [True, False, True, False, False]


def test_hull(spark):
    rng = random.Random(5)
    rows = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)] + [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(300)]
    got = cells.hull_ring(spark.createDataFrame(rows, "lon double, lat double").repartition(4))
    assert set(got) == set(rows[:4])


def _points(n, seed, spread=True):
    rng = random.Random(seed)
    out = [(rng.uniform(-180, 180), rng.uniform(-89, 89)) for _ in range(n // 2)] if spread else []
    out += [(rng.gauss(20, 0.05), rng.gauss(60, 0.05)) for _ in range(n - len(out))]
    return out + ([(179.99, 10.0), (-179.99, 10.0), (0.0, 89.99), (180.0, 89.98)] if spread else [])


def test_neighbours_equal_brute_force(spark):
    pts = _points(150, 7)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, lon_c double, lat_c double")
    got = {(r["a"], r["b"]) for r in nearby.neighbours(df, 15).collect()}
    want = {(i, j) for i, a in enumerate(pts) for j, b in enumerate(pts) if i != j and km(a, b) <= 15}
    assert got == want and len(want) > 10


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_knn_equals_brute_force(spark, metric):
    left, right = _points(40, 11), _points(120, 13)
    dist = km if metric == "haversine" else lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) * 111
    mk = lambda p: spark.createDataFrame([(i, *x) for i, x in enumerate(p)], "id long, lon double, lat double")
    got = {}
    for r in nearby.knn(mk(left), mk(right), 3, metric).collect():
        got.setdefault(r["lid"], {})[r["rank"]] = r["km"]
    for i, a in enumerate(left):
        want = sorted(dist(a, b) for b in right)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == pytest.approx(want, abs=2e-6)


def test_moran_on_complete_graph(spark):
    n = 7
    df = spark.createDataFrame([(i, float(i * i)) for i in range(n)], "id long, v double")
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if i != j], "a long, b long")
    assert one(nearby.morans_i(df, pairs, "v"))["moran_i"] == pytest.approx(-1 / (n - 1))


def test_moran_variance_by_formula(spark):
    # a path of 5 cells
    x = [1.0, 2.0, 4.0, 7.0, 9.0]
    nb = {0: [1], 1: [0, 2], 2: [1, 3], 3: [2, 4], 4: [3]}
    w = np.zeros((5, 5))
    for i, js in nb.items():
        w[i, js] = 1 / len(js)
    z = np.array(x) - np.mean(x)
    n, s0 = 5, w.sum()
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    k = (z**4).mean() / (z**2).mean() ** 2
    e = -1 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / (
        (n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
    df = spark.createDataFrame(list(enumerate(x)), "id long, v double")
    pairs = spark.createDataFrame([(i, j) for i, js in nb.items() for j in js], "a long, b long")
    r = one(nearby.morans_i(df, pairs, "v"))
    assert r["moran_i"] == pytest.approx(n / s0 * (z @ w @ z) / (z @ z))
    assert r["variance"] == pytest.approx(var)


def _far_by_hand(pts, mult=5):
    """(lon, lat, n) -> outlier places by mean distance to the other records."""
    total = sum(n for *_, n in pts)
    d = [round(sum(m * km((x, y), (u, v)) * 1000 for u, v, m in pts) / (total - 1), 3) for x, y, _ in pts]
    q1, q3 = np.quantile([v for v, (*_, n) in zip(d, pts) for _ in range(n)], [0.25, 0.75])
    return {(x, y) for v, (x, y, _) in zip(d, pts) if v > q3 + mult * (q3 - q1)}


def test_outliers_equal_brute_force(spark):
    rng = random.Random(2)
    pts = [(rng.gauss(30, 1), rng.gauss(0, 1), rng.randint(1, 4)) for _ in range(700)]
    pts += [(120.0, 50.0, 1), (-60.0, -20.0, 2)]
    few = [(1.0, 1.0, 1), (99.0, 1.0, 1)]
    rows = [("a", *p) for p in pts] + [("b", *p) for p in few] + [(None, 9.0, 9.0, 30), ("", 1.0, 1.0, 40)]
    df = spark.createDataFrame(rows, "species string, lon double, lat double, n long")
    got = {(r["lon"], r["lat"]) for r in outlier_locations(df).collect()}
    want = _far_by_hand(pts)
    assert got == want and len(want) == 2


def test_outliers_of_binned_species(spark):
    rng = random.Random(4)
    pts = [(rng.uniform(30, 33), rng.uniform(0, 3), 1) for _ in range(300)] + [(120.0, 50.0, 1)]
    df = spark.createDataFrame([("a", *p) for p in pts], "species string, lon double, lat double, n long")
    got = {(r["lon"], r["lat"]) for r in outlier_locations(df, cell_deg=0.5).collect()}
    assert got == {(120.0, 50.0)}


def test_outliers_of_a_species_with_many_places(spark):
    rng = np.random.default_rng(5)
    lon, lat = rng.normal(36, 0.5, 12_000), rng.normal(0, 0.5, 12_000)
    lon[:20], lat[:20] = lon[:20] + 40, lat[:20] + 30
    pdf = pd.DataFrame({"species": "a", "lon": lon, "lat": lat, "n": 1})
    got = {(r["lon"], r["lat"]) for r in outlier_locations(spark.createDataFrame(pdf)).collect()}
    lam, phi = np.radians(lon), np.radians(lat)
    unit = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])
    total = np.concatenate([
        (2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(
            ((unit[:, k : k + 500, None] - unit[:, None, :]) ** 2).sum(axis=0)) / 2))).sum(axis=1)
        for k in range(0, 12_000, 500)
    ])
    mean = np.round(total / 11_999, 3)
    q1, q3 = np.quantile(mean, [0.25, 0.75])
    far = mean > q3 + 5 * (q3 - q1)
    assert far.sum() >= 20 and got == set(zip(lon[far].tolist(), lat[far].tolist()))


def test_distance_to_many_cities(spark):
    towns = spark.createDataFrame([(f"t{k}", -180 + 360 * k / 20_000, 0.0) for k in range(20_000)], "city string, lon double, lat double")
    cells_ = spark.createDataFrame([(0, 36.0, 0.0), (1, 99.99, 0.5)], "id long, lon_c double, lat_c double")
    raster = spark.createDataFrame([("elevation", 0, 0, 1.0)], RASTER_SCHEMA)
    out = design.covariates(cells_, raster, RasterGrid(0.0, 1.0, 1.0), towns, bands=("elevation",))
    near = {r["id"]: r["dist_to_city_km"] for r in out.collect()}
    assert near[0] < 1e-5
    assert abs(near[1] - 55.6) < 0.1


def test_equal_values_are_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(100_000).select(F.lit(1).cast("long").alias("v"), F.col("id").cast("string").alias("name"))
        sliced = running._by_range(df, ["v", "name"]).groupBy("_slice").count().collect()
        out = running_sums(df, ["v", "name"], {"c": "v"})
        assert len(sliced) > 1 and max(r["count"] for r in sliced) < 60_000
        assert [r["c"] for r in out.orderBy("name").select("c").collect()] == list(range(1, 100_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ------------------------------------------------------------------- curves


def test_accumulation_ends_at_all_species(spark):
    rng = random.Random(8)
    inc = spark.createDataFrame(
        list({(rng.randint(0, 30), 0, f"s{int(rng.expovariate(0.1))}") for _ in range(300)}),
        "cell_x long, cell_y long, species string",
    )
    n, sites = inc.select("species").distinct().count(), inc.select("cell_x").distinct().count()
    curve = accumulation.accumulation(inc, ["cell_x", "cell_y"], "species", 20).orderBy("sites").collect()
    assert [r["sites"] for r in curve] == list(range(1, sites + 1))
    assert curve[-1]["richness"] == n and curve[-1]["sd"] == 0
    assert all(a["richness"] <= b["richness"] for a, b in zip(curve, curve[1:]))
    exact = {r["sites"]: r["richness"] for r in accumulation.accumulation_exact(inc, ["cell_x", "cell_y"], "species").collect()}
    assert exact[sites] == pytest.approx(n)
    assert all(abs(exact[r["sites"]] - r["richness"]) < 8 for r in curve)


def test_rarefaction_at_n_is_observed(spark):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate((9, 4, 3, 2, 2, 1, 1, 1))], "species string, n_records long")
    rows = accumulation.rarefaction(df, "species", endpoint=46).collect()
    at_n = [r for r in rows if r["method"] == "observed"]
    assert len(at_n) == 1 and at_n[0]["m"] == 23 and at_n[0]["richness"] == 8
    assert at_n[0]["chao1"] == pytest.approx(8 + 22 / 23 * 9 / 4)
    assert max(r["richness"] for r in rows) <= at_n[0]["chao1"]
    assert one_of(rows, 1)["richness"] == pytest.approx(1)


def one_of(rows, m):
    return next(r for r in rows if r["m"] == m)


# ------------------------------------------------------------------- models


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 2))
    mu = np.exp(1 + 0.5 * x[:, 0] - 0.3 * x[:, 1])
    y = rng.negative_binomial(2.0, 2.0 / (2.0 + mu))
    g = np.where(np.arange(1500) % 3 == 0, "a", "b")
    rows = [(i, float(a), float(b), int(c), str(k)) for i, ((a, b), c, k) in enumerate(zip(x, y, g))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, n_records long, g string").cache()


def test_negbin_recovers_and_solves_score(counts):
    m = glm.fit_negbin(counts, terms=("x1", "x2"))
    assert m.coef == pytest.approx((0.5, -0.3), abs=0.1) and m.theta == pytest.approx(2, rel=0.25)
    assert m.notes["gradient"] < 1e-6


def test_poisson_engines_agree(counts):
    a = glm.fit_poisson(counts, terms=("x1", "x2"))
    b = glm.fit_groups(counts.withColumn("k", F.lit("k")), "k", ["k"], terms=("x1", "x2"), family="poisson")["k"]
    assert a.coef == pytest.approx(b.coef, abs=1e-8) and a.se == pytest.approx(b.se, rel=1e-5)
    assert a.loglik == pytest.approx(b.loglik)


def test_grouped_fit_equals_single_fits(counts):
    both = glm.fit_by_group(counts, "g", terms=("x1", "x2"))
    for g in ("a", "b"):
        alone = glm.fit_negbin(counts.where(F.col("g") == g), terms=("x1", "x2"))
        assert both[g].coef == pytest.approx(alone.coef, abs=1e-7) and both[g].theta == pytest.approx(alone.theta, rel=1e-5)


def test_singular_design_is_reported(counts):
    with pytest.raises(glm.NotConverged):
        glm.fit_negbin(counts.withColumn("x3", F.col("x1")), terms=("x1", "x3"))


def test_quantile_residuals_are_uniform(counts):
    m = glm.fit_negbin(counts, terms=("x1", "x2"))
    assert one(glm.uniformity(glm.quantile_residuals(counts, m)))["p_value"] > 0.01


# -------------------------------------------------------------------- flags


def test_strategies_are_nested(spark, sf_dir):
    from obsweave.columns import STRATEGIES
    from obsweave.operators.flags import passes
    from obsweave.queries.base import flagged, occurrences

    df = flagged(spark, sf_dir)
    assert df.count() == occurrences(spark, sf_dir).count()
    lo, mid, hi = (passes(STRATEGIES[s]) for s in ("minimal", "moderate", "strict"))
    assert df.where((hi & ~mid) | (mid & ~lo)).count() == 0
    assert all(df.where(F.col(c).isNull()).count() == 0 for c in ("flag_duplicate", "flag_coord_urban", "flag_any_coord_issue"))


def test_cells_hold_all_located_records(spark, sf_dir):
    from obsweave.queries.base import occurrences

    df = occurrences(spark, sf_dir)
    grid = cells.grid_metrics(df, box=cells.bounding_box(df))
    want = df.where("lon is not null and lat is not null and species is not null").count()
    assert grid.agg(F.sum("n_records")).collect()[0][0] == want


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from obsweave.queries.base import occurrences

    df = occurrences(spark, sf_dir)
    res = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(taxonomic.gini(taxonomic.rarity(df.repartition(n)), "n_records").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1]


def test_dedupe_cuts_groups_before_the_shuffle(spark, sf_dir):
    from obsweave.operators.cleaning import dedupe
    from obsweave.queries.base import occurrences

    plan = dedupe(occurrences(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
