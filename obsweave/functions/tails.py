"""Distribution functions of counts on whole arrays, and uniform numbers by counter."""

from __future__ import annotations

import math

import numpy as np

_TINY, _CLOSE = 1e-300, 1e-15


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0: Stirling's series at x + 8, shifted back."""
    y = x + 8.0
    prod = np.ones_like(y)
    for i in range(8):
        prod = prod * (x + i)
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(prod)


def _fraction(step, n: int) -> np.ndarray:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) per element; ``step(i, on)`` gives a and b of those still moving."""
    out = np.empty(n)
    on = np.arange(n)
    _, b = step(0, on)
    f = np.where(b == 0, _TINY, b)
    c, d, i = f.copy(), np.zeros(n), 0
    while len(on):
        i += 1
        a, b = step(i, on)
        d = b + a * d
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        f = f * c * d
        moving = (np.abs(c * d - 1.0) > _CLOSE) & (i < 200_000)
        out[on[~moving]] = f[~moving]
        on, f, c, d = on[moving], f[moving], c[moving], d[moving]
    return out


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function for a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    low = (x > 0) & (x < a + 1)
    if low.any():  # series for the lower one
        a_, x_ = a[low], x[low]
        term = 1.0 / a_
        total, k, on = term.copy(), 0, np.ones(len(a_), bool)
        while on.any():
            k += 1
            term = np.where(on, term * x_ / (a_ + k), 0.0)
            total += term
            on = term > total * 1e-17
        out[low] = 1.0 - total * np.exp(a_ * np.log(x_) - x_ - lgamma(a_))
    high = x >= a + 1
    if high.any():
        a_, x_ = a[high], x[high]

        def step(i: int, on: np.ndarray):
            return -i * (i - a_[on]), x_[on] + 2 * i + 1 - a_[on]

        out[high] = np.exp(a_ * np.log(x_) - x_ - lgamma(a_)) / _fraction(step, len(a_))
    return np.clip(out, 0.0, 1.0)


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for a, b > 0 and 0 <= x <= 1."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    out = np.zeros(a.shape)
    some = z > 0
    p_, q_, z_ = p[some], q[some], z[some]

    def step(i: int, on: np.ndarray):
        pi, qi, zi, m = p_[on], q_[on], z_[on], i // 2
        if not i:
            return np.zeros(len(on)), np.ones(len(on))
        if i % 2:
            a_ = -(pi + m) * (pi + qi + m) * zi / ((pi + 2 * m) * (pi + 2 * m + 1))
        else:
            a_ = m * (qi - m) * zi / ((pi + 2 * m - 1) * (pi + 2 * m))
        return a_, np.ones(len(on))

    front = np.exp(p_ * np.log(z_) + q_ * np.log1p(-z_) + lgamma(p_ + q_) - lgamma(p_) - lgamma(q_)) / p_
    out[some] = front / _fraction(step, len(p_))
    return np.clip(np.where(turn, 1.0 - out, out), 0.0, 1.0)


def count_cdf(family: str, k: np.ndarray, mean: np.ndarray, theta: float | None = None) -> np.ndarray:
    """P(Y <= k) for whole k; negative k gives 0. ``binomial`` is one trial."""
    out, on = np.zeros(len(k)), np.asarray(k) >= 0
    k, mean = np.asarray(k, float)[on], np.asarray(mean, float)[on]
    if family == "negbin":
        out[on] = beta_lower(np.full(len(k), theta), k + 1, theta / (theta + mean))
    elif family == "binomial":
        out[on] = np.where(k >= 1, 1.0, 1.0 - mean)
    else:
        out[on] = gamma_upper(k + 1, mean)
    return out


# The increment and the two multipliers of the splitmix64 generator.
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


def uniforms(keys: np.ndarray, n: int) -> np.ndarray:
    """``n`` numbers inside (0, 1) per 64-bit key: number j of a key is a function of both alone."""
    start = _mix(np.asarray(keys).astype(np.int64).view(np.uint64))
    z = _mix(start[:, None] + (np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN)[None, :])
    return ((z >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
