"""Trend and small-sample tests against enumeration and all pairs."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.functions import pvalues
from obsweave.operators import environment, temporal, trend


def all_pairs(x):
    return int(sum(np.sign(np.asarray(x)[j] - np.asarray(x)[:j]).sum() for j in range(len(x))))


def test_score_counts_all_pairs():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.choice([rng.randrange(5), rng.random(), -1e300]) for _ in range(rng.randrange(60))]
        assert trend.kendall_score(np.array(x)) == all_pairs(x)


def groups(rng):
    """Short and long groups, ties, one value only, a value that holds half of a group, null group."""
    out = {"a": [rng.random() for _ in range(700)], "b": [rng.randrange(4) for _ in range(500)], None: [rng.random() for _ in range(300)],
           "c": [7] * 200, "d": [rng.choice([3.5, rng.random() * 7]) for _ in range(600)], "e": [1, 2, 3], "f": [5],
           "g": sorted(rng.random() for _ in range(400)), "h": [-x for x in range(300)]}
    return out


@pytest.mark.parametrize("block", [trend.BLOCK, 64, 7])
def test_trend_of_long_groups(spark, block):
    found = groups(random.Random(4))
    rows = [(k, i, float(v)) for k, x in found.items() for i, v in enumerate(x)] + [("a", 9999, None), ("a", None, 1.0), ("f", 3, float("nan"))]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, y int, v double").repartition(5)
    got = {r["k"]: r for r in temporal.mann_kendall(df, "v", "y", ["k"], block=block).collect()}
    assert got.keys() == found.keys()
    for k, x in found.items():
        t = [x.count(v) for v in set(x)]
        n = len(x)
        assert (got[k]["n"], got[k]["s_stat"]) == (n, all_pairs(x))
        assert got[k]["var_s"] == pytest.approx((n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in t)) / 18)
    one = temporal.mann_kendall(df.where("k = 'd'"), "v", "y", block=block).first()
    assert one["s_stat"] == all_pairs(found["d"])
    none = temporal.mann_kendall(df.where("false"), "v", "y", block=block).first()
    assert (none["n"], none["s_stat"], none["p_value"]) == (0, 0, None)


def test_a_million_entries_in_one_group(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("y"), F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double").alias("v"))
    x = (np.arange(n, dtype=np.int64) * 7919) % 10_007
    expected = 0
    # blocks of equal length hold each value once, so pairs across blocks cancel
    for at in range(0, n, 10_007):
        expected += trend.kendall_score(x[at : at + 10_007])
    last = x[n - n % 10_007 :]
    full = n // 10_007
    expected += full * int((2 * last - 10_006).sum())
    got = temporal.mann_kendall(df, "v", "y").first()
    assert (got["n"], got["s_stat"]) == (n, expected)


def test_exact_distribution_of_the_score():
    for n in range(2, 8):
        scores = [all_pairs(p) for p in itertools.permutations(range(n))]
        for s in set(scores):
            assert pvalues.kendall_p(s, n) == pytest.approx(sum(abs(x) >= abs(s) for x in scores) / math.factorial(n))


def test_short_series_get_the_exact_value(spark):
    df = spark.createDataFrame([(y, float(v)) for y, v in enumerate([1, 3, 2, 4, 5, 6])], "y int, v double")
    r = temporal.mann_kendall(df, "v", "y").first()
    assert r["s_stat"] == 13 and r["p_value"] == pytest.approx(2 * 6 / 720)
    assert temporal.mann_kendall(df, "v", "y", exact_up_to=0).first()["p_value"] == pytest.approx(math.erfc(12 / math.sqrt(r["var_s"]) / 2**0.5))


def distance(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


def test_exact_two_sample_p_equals_enumeration():
    rng = random.Random(6)
    for m in range(1, 7):
        for n in range(1, 7):
            pooled = sorted(rng.randrange(rng.choice([3, 50])) for _ in range(m + n))
            whole = []
            for chosen in itertools.combinations(range(m + n), m):
                a = [pooled[i] for i in chosen]
                b = [pooled[i] for i in range(m + n) if i not in chosen]
                whole.append((distance(a, b), a, b))
            d, a, b = rng.choice(whole)
            values = sorted(set(pooled))
            p = pvalues.kolmogorov_exact_p(d, [a.count(v) for v in values], [b.count(v) for v in values])
            assert p == pytest.approx(sum(x[0] >= d - 1e-9 for x in whole) / len(whole), abs=1e-12)


def test_two_sample_test_uses_it_for_few_pairs(spark):
    rng = random.Random(3)
    a, b = [rng.randrange(9) for _ in range(8)], [rng.randrange(4, 14) for _ in range(8)]
    rows = [("v", "Sampled", float(x)) for x in a] + [("v", "Available", float(x)) for x in b]
    rows += [("w", "Sampled", float(x)) for x in range(300)] + [("w", "Available", float(x) + 0.5) for x in range(300)]
    df = spark.createDataFrame(rows, "variable string, type string, value double")
    got = {r["variable"]: r for r in environment.ks_two_sample(df, exact_pairs=10_000).collect()}
    pooled = [*a, *b]
    whole = [distance([pooled[i] for i in c], [pooled[i] for i in range(16) if i not in c]) for c in itertools.combinations(range(16), 8)]
    assert got["v"]["p_value"] == pytest.approx(sum(x >= got["v"]["d"] - 1e-9 for x in whole) / len(whole))
    assert got["w"]["p_value"] == 1.0
