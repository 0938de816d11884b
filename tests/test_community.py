"""Coverage inversion, exact redraws and the sparse community matrix against brute force."""

from __future__ import annotations

import collections
import math
from fractions import Fraction

import numpy as np
import pytest

from obsweave.operators import accumulation as A
from obsweave.operators import taxonomic as X

COUNTS = (9, 40, 3, 2, 2, 1, 1, 1, 7, 15, 4)


def table(spark, counts):
    return spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(counts)], "species string, n_records long")


def exact(counts, m):
    """Coverage and richness of m of n individuals, by whole binomials."""
    n = sum(counts)
    gone = sum(Fraction(x * math.comb(n - x, m), n * math.comb(n - 1, m)) for x in counts if m <= n - 1)
    return float(1 - gone), float(sum(1 - Fraction(math.comb(n - x, m), math.comb(n, m)) for x in counts))


def test_whole_sizes_come_back(spark):
    """The coverage of a whole m, by exact fractions, leads back to that m and its richness."""
    n = sum(COUNTS)
    sizes = [1, 2, 5, 17, 40, 80, n - 1]
    want = {exact(COUNTS, m)[0]: m for m in sizes}
    rows = A.richness_at_coverage(table(spark, COUNTS), "species", list(want)).collect()
    assert len(rows) == len(sizes)
    for r in rows:
        m = want[r["target"]]
        assert r["m"] == pytest.approx(m, abs=1e-5) and r["method"] == "rarefaction"
        assert r["coverage"] == pytest.approx(r["target"], abs=1e-9)
        assert r["richness"] == pytest.approx(exact(COUNTS, m)[1], abs=1e-5)


def test_targets_are_met_on_every_branch(spark):
    n, f1, f2 = sum(COUNTS), 3, 2
    a = (n - 1) * f1 / ((n - 1) * f1 + 2 * f2)
    full = 1 - f1 / n * a
    targets = [1e-6, 0.03, 0.3, 0.77, 0.9, 1 - f1 / n, (1 - f1 / n + full) / 2, full, 0.99, 0.999999, 1.0, 0.3]
    rows = A.richness_at_coverage(table(spark, [*COUNTS, 0]), "species", targets).collect()
    assert [r["target"] for r in rows] == sorted(set(targets))
    assert [r["method"] for r in rows][-4:] == ["observed", "extrapolation", "extrapolation", None]
    for r in rows[:-1]:
        assert abs(r["coverage"] - r["target"]) < 1e-9
    assert rows[-1]["m"] is None and rows[-1]["richness"] is None
    assert rows[-4]["m"] == pytest.approx(n) and rows[-4]["richness"] == pytest.approx(len(COUNTS))
    m, s = [r["m"] for r in rows[:-1]], [r["richness"] for r in rows[:-1]]
    assert m == sorted(m) and s == sorted(s)
    # extrapolated size and richness agree with the forward estimate at whole sizes
    forward = A.rarefaction(table(spark, COUNTS), "species", endpoint=400.0).where("method = 'extrapolation'").collect()
    some = [r for r in forward if r["coverage"] < 0.9999][:3]
    back = A.richness_at_coverage(table(spark, COUNTS), "species", [r["coverage"] for r in some]).collect()
    assert [(x["m"], x["richness"]) for x in back] == [(pytest.approx(r["m"], abs=1e-6), pytest.approx(r["richness"], abs=1e-6)) for r in some]


def test_large_samples_keep_their_digits(spark):
    """A sample of 10^12: log-gammas of that size differ by more than the answer."""
    big = table(spark, [10**12, 5 * 10**11, *[1] * 50, *[2] * 20])
    for r in A.richness_at_coverage(big, "species", [0.4, 0.6, 1 - 1e-10]).collect():
        assert abs(r["coverage"] - r["target"]) < 1e-9
        # expected by independence, which holds at this size
        m, n = r["m"], 1.5e12 + 90
        p = (10**12 / n, 5 * 10**11 / n)
        s = sum(1 - math.exp(m * math.log1p(-q)) for q in p) + 50 * m / n + 20 * (1 - (1 - m / n) ** 2)
        assert r["richness"] == pytest.approx(s, abs=1e-5)


def test_coverage_of_little(spark):
    assert A.richness_at_coverage(table(spark, []), "species", [0.5]).count() == 0
    one = A.richness_at_coverage(table(spark, [1]), "species", [0.5, 1.0]).collect()
    assert [(r["m"], r["richness"]) for r in one] == [(0.5, 0.5), (1.0, 1.0)]
    none_single = A.richness_at_coverage(table(spark, [4, 4]), "species", [0.5, 1.0]).collect()
    assert none_single[1]["richness"] == pytest.approx(2) and abs(none_single[1]["coverage"] - 1) < 1e-9
    with pytest.raises(ValueError):
        A.richness_at_coverage(table(spark, [1]), "species", [0.0])


def test_draws_have_exact_totals_and_shares(spark, monkeypatch):
    monkeypatch.setattr(A, "_LEAF", 8)  # many leaves and nodes
    monkeypatch.setattr(A, "_FAN", 4)
    rng = np.random.default_rng(1)
    w = [float(v) for v in rng.pareto(1.0, 300)]
    rows = [(i, v) for i, v in enumerate(w)] + [(300, 0.0), (301, None), (302, -1.0)]
    df = spark.createDataFrame(rows, "k long, w double")
    got = A.multinomial_draws(df, "k", "w", 5000, 40, seed=9).collect()
    totals, per = collections.Counter(), collections.Counter()
    for r in got:
        assert r["x"] > 0
        totals[r["rep"]] += r["x"]
        per[r["k"]] += r["x"]
    assert totals == {rep: 5000 for rep in range(1, 41)} and max(per) < 300
    share = np.array(w) / sum(w)
    seen = np.array([per[i] for i in range(300)])
    expected = share * 5000 * 40
    z = (seen - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    big = expected > 20
    assert np.abs(z[big]).max() < 5 and 0.6 < z[big].std() < 1.4
    again = A.multinomial_draws(df.repartition(7), "k", "w", 5000, 40, seed=9).collect()
    assert {(r["rep"], r["k"], r["x"]) for r in again} == {(r["rep"], r["k"], r["x"]) for r in got}
    assert A.multinomial_draws(df.where("w < 0"), "k", "w", 10, 3).count() == 0


def test_limits_hold_the_curve(spark):
    rows = A.rarefaction(table(spark, COUNTS), "species", endpoint=200.0, boots=30).collect()
    for r in rows:
        assert r["lower"] <= r["richness"] <= r["upper"]
    at_one = min(rows, key=lambda r: r["m"])
    assert at_one["m"] == 1 and at_one["se"] == pytest.approx(0, abs=1e-6)  # a sample of one holds one species
    assert A.rarefaction(table(spark, []), "species", boots=2, endpoint=5.0).count() == 0


def test_sparse_rows_hold_the_matrix(spark):
    rng = np.random.default_rng(2)
    truth = collections.Counter()
    for _ in range(3000):  # "hot" stands in every site
        truth[(int(rng.integers(30)), int(rng.integers(3)), str(rng.choice(["hot", *[f"n{i:02d}" for i in range(40)]])))] += 1
    rows = [(*k, v) for k, v in truth.items()]
    df = spark.createDataFrame([*rows, (0, 0, None, 5), (99, 0, None, 1), (None, 0, "n01", 2), (None, 0, "n01", 3)],
                               "cell_x int, cell_y int, species string, n long")
    matrix, names = X.community_rows(df, ["cell_x", "cell_y"], "species", block=7)
    order = {r["species"]: r["number"] for r in names.collect()}
    assert [order[k] for k in sorted(order)] == list(range(41))
    back, word = {}, {v: k for k, v in order.items()}
    for r in matrix.collect():
        assert r["numbers"] == sorted(r["numbers"]) and {i // 7 for i in r["numbers"]} == {r["block"]}
        back |= {(r["cell_x"], r["cell_y"], word[i]): n for i, n in zip(r["numbers"], r["counts"], strict=True)}
    assert back == {**truth, (None, 0, "n01"): 5}
    wide = X.dense_slice(matrix, names, ["cell_x", "cell_y"], "species", ["n01", "hot", "gone", "n01"])
    assert wide.columns == ["cell_x", "cell_y", "n01", "hot", "gone"]
    got = {(r["cell_x"], r["cell_y"]): (r["n01"], r["hot"], r["gone"]) for r in wide.collect()}
    sites = {k[:2] for k in truth} | {(None, 0)}
    assert got == {s: (back.get((*s, "n01"), 0), back.get((*s, "hot"), 0), 0) for s in sites}
    assert X.dense_slice(matrix, names, ["cell_x", "cell_y"], "species", ["gone"]).where("gone <> 0").count() == 0
    empty, no_names = X.community_rows(df.limit(0), ["cell_x", "cell_y"], "species")
    assert empty.count() == 0 and no_names.count() == 0
