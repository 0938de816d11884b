"""Tail probabilities for result rows; Spark has no erf or gamma function."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # power series of the lower part
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    # Lentz continued fraction of the upper part
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_p(statistic: float, df: float) -> float:
    return gamma_q(df / 2, statistic / 2) if df > 0 else float("nan")


def kolmogorov_p(d: float, m: float, n: float) -> float:
    """Asymptotic two-sample p-value."""
    lam = d * math.sqrt(m * n / (m + n))
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


@functools.lru_cache(maxsize=64)
def _inversions(n: int) -> tuple[int, ...]:
    """Permutations of n entries by their number of inversions."""
    counts = [1]
    for k in range(2, n + 1):
        counts = [sum(counts[max(0, i - k + 1) : i + 1]) for i in range(len(counts) + k - 1)]
    return tuple(counts)


def kendall_p(score: float, n: float) -> float:
    """Exact two-sided p of a Kendall score of n entries without ties."""
    n = int(n)
    falling = (n * (n - 1) // 2 - abs(int(score))) // 2
    return min(1.0, 2 * sum(_inversions(n)[: falling + 1]) / math.factorial(n))


def kolmogorov_exact_p(d: float, first: list[int], second: list[int]) -> float:
    """Exact two-sample p given the counts of both sides at each pooled value.

    Orders of the pooled sample are lattice paths; those that never stand ``d`` or
    more apart at the end of a tie are counted, one tie at a time.
    """
    m, n = sum(first), sum(second)
    if not m or not n:
        return float("nan")
    far = round(d * m * n)  # distances are whole numbers of 1 / (m n)
    ways, seen = {0: 1}, 0
    for a, b in zip(first, second):
        seen += a + b
        size = a + b
        new: dict[int, int] = {}
        for i, w in ways.items():
            for take in range(max(0, size - (n - (seen - size - i))), min(size, m - i) + 1):
                x = i + take
                if abs(x * n - (seen - x) * m) < far:
                    new[x] = new.get(x, 0) + w * math.comb(size, take)
        ways = new
    return 1 - ways.get(m, 0) / math.comb(m + n, m)


def add_p_values(df: DataFrame, name: str, fn, args: list[str]) -> DataFrame:
    """Adds ``fn(*args)`` to a table of test results (one row per test)."""

    def rows(*series: pd.Series) -> pd.Series:
        return pd.Series(
            [
                fn(*v) if all(x is not None and not math.isnan(x) for x in v) else None
                for v in zip(*series, strict=True)
            ],
            dtype="float64",
        )

    if len(args) == 1:
        def call(a: pd.Series) -> pd.Series:
            return rows(a)
    elif len(args) == 2:
        def call(a: pd.Series, b: pd.Series) -> pd.Series:
            return rows(a, b)
    else:
        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return rows(a, b, c)

    udf = F.pandas_udf(call, "double")
    value = udf(*[F.col(a).cast("double") for a in args])
    return df.withColumn(name, F.when(~F.isnan(value), value))
