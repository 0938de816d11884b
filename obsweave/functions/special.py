"""Log-gamma, digamma and log-binomial as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0: Stirling's series at x + 8, shifted back."""
    y = x + _SHIFT
    prod = x
    for i in range(1, _SHIFT):
        prod = prod * (x + i)
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(prod)


def digamma(x: Column) -> Column:
    """Derivative of ``lgamma`` for x > 0, by the same shift and series."""
    y = x + _SHIFT
    back = 1.0 / x
    for i in range(1, _SHIFT):
        back = back + 1.0 / (x + i)
    inv2 = 1.0 / (y * y)
    return (
        F.ln(y) - 0.5 / y
        - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240)))
        - back
    )


def trigamma(x: Column) -> Column:
    """Second derivative of ``lgamma`` for x > 0."""
    y = x + _SHIFT
    back = 1.0 / (x * x)
    for i in range(1, _SHIFT):
        back = back + 1.0 / ((x + i) * (x + i))
    inv = 1.0 / y
    inv2 = inv * inv
    return inv + 0.5 * inv2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 / 42)) + back


def ln_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
