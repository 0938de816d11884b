"""Non-linear effects from spline and radial basis columns, under a ridge penalty that cross-validation chooses."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.models.glm import Fitted, NotConverged, _pass, fit_groups
from obsweave.plans.session import cut


def basis(df: DataFrame, terms: Sequence[str], k: int, surface: int,
          lon: str = "lon_c", lat: str = "lat_c") -> dict[str, Column]:
    """Basis columns: x and truncated cubes at k - 2 quantile knots, plus Gaussian bumps."""
    probs = [i / (k - 1) for i in range(1, k - 1)]
    out: dict[str, Column] = {}
    names = list(terms) + ([lon, lat] if surface else [])
    cuts = df.approxQuantile(names, probs if not surface else sorted({*probs, 0.1, 0.3, 0.5, 0.7, 0.9}), 0.001)
    every = probs if not surface else sorted({*probs, 0.1, 0.3, 0.5, 0.7, 0.9})
    for t, knots in zip(names[: len(terms)], cuts):
        out[f"{t}__1"] = F.col(t)
        for i, p in enumerate(probs):
            d = F.col(t) - float(knots[every.index(p)])
            out[f"{t}__k{i + 1}"] = F.when(d > 0, d * d * d).otherwise(0.0)
    if surface:
        xs, ys = ([c[every.index(p)] for p in (0.1, 0.3, 0.5, 0.7, 0.9)] for c in cuts[-2:])
        ys = ys[:4]
        scale = max((max(xs) - min(xs)) / 4, (max(ys) - min(ys)) / 3, 1e-6)
        for i, cx in enumerate(xs):
            for j, cy in enumerate(ys):
                dx, dy = (F.col(lon) - float(cx)) / scale, (F.col(lat) - float(cy)) / scale
                out[f"s_xy__{i}{j}"] = F.exp(-(dx * dx + dy * dy) / 2)
    return out


#: Penalties looked at, and how closely the chosen one is found (factor).
PENALTIES = tuple(10.0 ** (e / 4) for e in range(-40, 17))
_FACTOR = 1.02


def penalty_path(xwx: np.ndarray, xwz: np.ndarray, zwz: float, n: float, penalties: Sequence[float]) -> np.ndarray:
    """(effective parameters, weighted residual sum, generalised cross-validation score) per penalty.

    ``xwx``, ``xwz`` and ``zwz`` are cross-products of the columns (the intercept first) and
    the working response. The penalty shrinks all but the intercept, relative to each
    column's own weight; in these units one eigen-decomposition serves every penalty.
    """
    own = np.sqrt(np.diag(xwx)[1:])
    mean = xwx[0, 1:] / xwx[0, 0]
    centred = xwx[1:, 1:] - np.outer(mean, xwx[0, 1:])
    values, vectors = np.linalg.eigh(centred / np.outer(own, own))
    values = np.maximum(values, 0.0)
    g = vectors.T @ ((xwz[1:] - mean * xwz[0]) / own)
    total = zwz - xwz[0] ** 2 / xwx[0, 0]
    out = []
    for lam in penalties:
        d = values + lam
        edf = 1 + (values / d).sum()
        rss = max(total - (g * g * (values + 2 * lam) / (d * d)).sum(), 0.0)
        out.append((edf, rss, n * rss / (n - edf) ** 2 if n > edf else math.inf))
    return np.array(out)


def best_penalty(xwx: np.ndarray, xwz: np.ndarray, zwz: float, n: float) -> float:
    """The penalty of least score: the best of ``PENALTIES``, narrowed down between its neighbours."""
    score = penalty_path(xwx, xwz, zwz, n, PENALTIES)[:, 2]
    i = int(np.argmin(score))
    low, high = PENALTIES[max(i - 1, 0)], PENALTIES[min(i + 1, len(PENALTIES) - 1)]
    best = PENALTIES[i]
    while high / low > _FACTOR:
        grid = np.geomspace(low, high, 9)
        k = int(np.argmin(penalty_path(xwx, xwz, zwz, n, grid)[:, 2]))
        low, best, high = grid[max(k - 1, 0)], float(grid[k]), grid[min(k + 1, 8)]
    return best


def cross_products(df: DataFrame, model: Fitted) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'WX, X'Wz, z'Wz and the rows of the working model at a fit: two passes, sums only."""
    p = len(model.terms) + 1
    data = df.select(F.lit(0).alias("_g"), F.col(model.response).cast("double").alias("_y"),
                     *[F.col(t).cast("double").alias(f"_x{i}") for i, t in enumerate(model.terms, 1)])
    state = {0: {"b": np.array([model.intercept, *model.coef]), "theta": model.theta or 1.0}}
    sums = _pass(data, state, model.family, p)[0]
    eta = F.least(F.greatest(model.eta(), F.lit(-30.0)), F.lit(30.0))
    mu, y = F.exp(eta), F.col(model.response).cast("double")
    weight = mu / (1 + mu / model.theta) if model.family == "negbin" else mu
    z = eta + (y - mu) / mu
    zwz = df.agg(F.sum(weight * z * z)).first()[0]
    return sums[: p * p].reshape(p, p), sums[p * p : p * p + p], zwz, sums[p * p + p + 2]


def fit_smooth(
    df: DataFrame, y: str = "n_records",
    terms: Sequence[str] = ("elevation_scaled", "temperature_scaled", "precipitation_scaled", "dist_to_city_scaled"),
    k: int = 5, surface: int = 20, ridge: float | None = None,
) -> Fitted:
    """Smooth effects: negative binomial, else Poisson, else Poisson with three-point bases.

    Without ``ridge`` the penalty is chosen by generalised cross-validation: the score of all
    penalties comes from one set of cross-products, and fit and choice take turns until
    the penalty stays (at most six turns). ``notes`` hold the penalty (``ridge``) and the
    effective number of parameters (``edf``).
    """
    for family, size in (("negbin", k), ("poisson", k), ("poisson", 3)):
        cols = basis(df, terms, size, surface)
        data = cut(df.select(F.lit(0).alias("_all"), F.col(y).cast("double").alias("_n"),
                             *[c.alias(n) for n, c in cols.items()]), "basis")
        lam, res = 1e-3 if ridge is None else ridge, None
        for _ in range(6):
            new = fit_groups(data, "_all", [0], "_n", tuple(cols), family, 1e-8, 100, ridge=lam).get(0)
            if not isinstance(new, Fitted):
                # counts no more spread than Poisson ones once the curve fits: the next family. Otherwise
                # a penalty too weak to settle leaves the fit before it
                res = new if family == "negbin" or res is None else res
                break
            res = new
            sums = cross_products(data, res)
            res.notes |= {"ridge": lam, "edf": float(penalty_path(*sums, [lam])[0, 0]), "k": size}
            wanted = lam if ridge is not None else best_penalty(*sums)
            if max(wanted, lam) <= min(wanted, lam) * _FACTOR:
                break
            lam = wanted
        if isinstance(res, Fitted):
            res.response, res.model_type = y, res.model_type + " smooth"
            return res
    raise res or NotConverged("no rows")


def smooth_columns(df: DataFrame, terms: Sequence[str], k: int = 5, surface: int = 20) -> DataFrame:
    """Adds the basis columns a smooth model refers to."""
    return df.withColumns(basis(df, terms, k, surface))
