"""Count and presence models fitted by distributed aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.functions.special import lgamma
from obsweave.functions.tails import count_cdf, uniforms
from obsweave.models.design import PREDICTORS
from obsweave.plans.session import cut


class NotConverged(RuntimeError):
    """A fit did not settle, or its normal equations are singular."""


@dataclass
class Fitted:
    """A fitted model: result-sized numbers only."""

    family: str
    terms: tuple[str, ...]
    intercept: float
    coef: tuple[float, ...]
    se: tuple[float, ...]  # intercept first
    n: int
    loglik: float
    theta: float | None = None
    model_type: str = ""
    response: str = "n_records"
    notes: dict = field(default_factory=dict)

    @property
    def n_params(self) -> int:
        return len(self.terms) + 1 + (self.theta is not None)

    def eta(self) -> Column:
        out = F.lit(float(self.intercept))
        for b, t in zip(self.coef, self.terms, strict=True):
            out = out + F.lit(float(b)) * F.col(t)
        return out

    def mean(self) -> Column:
        """Predicted response."""
        if self.family == "binomial":
            return 1 / (1 + F.exp(-self.eta()))
        return F.exp(self.eta())


def _loglik(family: str, y: Column, mu: Column, theta: float | Column | None = None) -> Column:
    if family == "binomial":
        return F.when(y > 0, F.ln(mu)).otherwise(F.ln(1 - mu))
    if family == "poisson":
        return y * F.ln(mu) - mu - lgamma(y + 1)
    t = F.lit(theta) if isinstance(theta, float) else theta
    return (
        lgamma(y + t) - lgamma(t) - lgamma(y + 1) + t * F.ln(t) + y * F.ln(mu) - (t + y) * F.ln(t + mu)
    )


def _with_glr(df: DataFrame, y: str, terms: Sequence[str], family: str, link: str,
              tol: float, max_iter: int) -> Fitted:
    data = VectorAssembler(inputCols=list(terms), outputCol="features").transform(
        df.select(*terms, F.col(y).cast("double").alias("label"))
    )
    model = GeneralizedLinearRegression(
        family=family, link=link, regParam=0.0, tol=tol, maxIter=max_iter
    ).fit(data)
    s = model.summary
    errors = list(s.coefficientStandardErrors)  # the intercept comes last
    out = Fitted(
        family, tuple(terms), float(model.intercept), tuple(float(c) for c in model.coefficients),
        (errors[-1], *errors[:-1]), int(s.numInstances), float("nan"),
        model_type={"poisson": "Poisson", "binomial": "Binomial"}[family], response=y,
    )
    out.loglik = df.agg(F.sum(_loglik(family, F.col(y).cast("double"), out.mean()))).first()[0]
    return out


def fit_poisson(df: DataFrame, y: str = "n_records", terms: Sequence[str] = PREDICTORS,
                tol: float = 1e-10, max_iter: int = 200) -> Fitted:
    return _with_glr(df, y, terms, "poisson", "log", tol, max_iter)


def fit_logit(df: DataFrame, y: str = "presence", terms: Sequence[str] = PREDICTORS,
              tol: float = 1e-10, max_iter: int = 200) -> Fitted:
    return _with_glr(df, y, terms, "binomial", "logit", tol, max_iter)


def overdispersion(df: DataFrame, model: Fitted) -> DataFrame:
    """Pearson chi-square over residual degrees of freedom; above 2 calls for NB."""
    y, mu = F.col(model.response).cast("double"), model.mean()
    p = len(model.terms) + 1
    return df.agg(
        (F.sum((y - mu) * (y - mu) / mu) / (F.count("*") - p)).alias("ratio"),
        F.avg(y).alias("mean"), F.var_samp(y).alias("variance"),
        F.count_if(y == 0).alias("zeros"),
    ).withColumn("overdispersed", F.col("ratio") > 2)


# ------------------------------------------------- grouped negative binomial


def _digamma(x: np.ndarray) -> np.ndarray:
    back = sum(1 / (x + i) for i in range(8))
    y = x + 8
    i2 = 1 / (y * y)
    return np.log(y) - 0.5 / y - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240))) - back


def _trigamma(x: np.ndarray) -> np.ndarray:
    back = sum(1 / (x + i) ** 2 for i in range(8))
    i = 1 / (x + 8)
    return i + i * i / 2 + i**3 * (1 / 6 - i * i * (1 / 30 - i * i / 42)) + back


def _block(x: np.ndarray, y: np.ndarray, b: np.ndarray, t: float, family: str) -> np.ndarray:
    """Sums of one block of rows: X'WX, X'Wz, theta score and information, n, sum y, sum w."""
    eta = np.clip(x @ b, -30, 30)
    mu = np.exp(eta)
    w = mu / (1 + mu / t) if family == "negbin" else mu
    z = eta + (y - mu) / mu
    score = info = 0.0
    if family == "negbin":
        a, mt, th = y + t, mu + t, np.array([t])
        score = (_digamma(a) - _digamma(th) + math.log(t) + 1 - np.log(mt) - a / mt).sum()
        info = (_trigamma(th) - _trigamma(a) - 1 / t + 2 / mt - a / (mt * mt)).sum()
    xw = x * w[:, None]
    return np.concatenate([(xw.T @ x).ravel(), xw.T @ z, [score, info, len(y), y.sum(), w.sum()]])


def _pass(data: DataFrame, state: dict, family: str, p: int) -> dict:
    """One pass over (_g, _y, _x0...): each task sums its rows, only sums are shuffled."""
    coefs = {g: (np.asarray(s["b"], float), float(s["theta"])) for g, s in state.items()}
    names = [f"_x{i}" for i in range(1, p)]
    schema = T.StructType(
        [T.StructField("_g", data.schema["_g"].dataType), T.StructField("v", T.ArrayType(T.DoubleType()))]
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                if g not in coefs:
                    continue
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
                v = _block(x, part["_y"].to_numpy(float), *coefs[g], family)
                held[g] = held[g] + v if g in held else v
        yield pd.DataFrame({"_g": list(held), "v": list(held.values())})

    parts = data.mapInPandas(sums, schema).select("_g", F.posexplode("v").alias("i", "v"))
    out: dict = {}
    for r in parts.groupBy("_g", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["_g"], np.zeros(p * p + p + 5))[r["i"]] = r["v"]
    return out


def _final_loglik(data: DataFrame, models: dict) -> dict:
    """Log-likelihood per group at the final estimates."""
    rows = [(g, float(m.theta or 0.0), m.intercept, *m.coef) for g, m in models.items()]
    p = len(rows[0]) - 2
    fields = ["_t", *[f"_b{i}" for i in range(p)]]
    schema = T.StructType(
        [T.StructField("_k", data.schema["_g"].dataType)] + [T.StructField(n, T.DoubleType()) for n in fields]
    )
    # one row per fitted group
    d = data.join(F.broadcast(data.sparkSession.createDataFrame(rows, schema)), F.col("_g") == F.col("_k"))
    eta = F.col("_b0")
    for i in range(1, p):
        eta = eta + F.col(f"_x{i}") * F.col(f"_b{i}")
    family = next(iter(models.values())).family
    ll = _loglik(family, F.col("_y"), F.col("_mu"), F.col("_t"))
    d = d.select("_g", "_y", "_t", F.exp(F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))).alias("_mu"))
    return dict(d.groupBy("_g").agg(F.sum(ll).alias("ll")).collect())


def fit_groups(
    df: DataFrame, group: str, groups: Sequence, y: str = "n_records",
    terms: Sequence[str] = PREDICTORS, family: str = "negbin",
    tol: float = 1e-10, max_iter: int = 200, init_theta: float | None = None, ridge: float = 0.0,
) -> dict:
    """One model per group, all groups in the same passes.

    In a pass every task adds up X'WX, X'Wz and the theta score of its own rows;
    only these sums, a few dozen numbers per group, are shuffled and reach the
    driver, so a dominant group costs no more than its rows.  Coefficients and
    theta take their Newton steps together; their information is block-diagonal.
    ``ridge`` shrinks all but the intercept, relative to each column's own weight.
    Values are a Fitted or the NotConverged that stopped the group.
    """
    p = len(terms) + 1
    data = cut(
        df.where(F.col(group).isin(list(groups))).select(
            F.col(group).alias("_g"), F.col(y).cast("double").alias("_y"),
            *[F.col(t).cast("double").alias(f"_x{i}") for i, t in enumerate(terms, 1)],
        ),
        "model",
    )
    active, out = {}, {}
    for r in data.groupBy("_g").agg(F.avg("_y").alias("m"), F.var_samp("_y").alias("v")).collect():
        m, v = max(r["m"], 1e-8), r["v"] or 0.0
        theta = init_theta or (m * m / (v - m) if v > m else 10.0)
        b = np.zeros(p)
        b[0] = math.log(m)
        active[r["_g"]] = {"b": b, "theta": min(max(theta, 1e-3), 1e6), "done": False, "passes": 0}
    close = math.sqrt(tol)
    for _ in range(max_iter):
        if not active:
            break
        res = _pass(data, active, family, p)
        for g, s in list(active.items()):
            v = res[g]
            m, rhs = v[: p * p].reshape(p, p), v[p * p : p * p + p]
            score, info, n, sum_y, sum_w = v[p * p + p :]
            if ridge:
                m = m + ridge * np.diag([0.0, *np.diag(m)[1:]])
            try:
                b = np.linalg.solve(m, rhs)
                cov = np.linalg.inv(m)
            except np.linalg.LinAlgError:
                b = np.full(p, np.nan)
            if not np.isfinite(b).all() or (np.diag(cov) <= 0).any():
                out[g] = NotConverged(f"{g}: singular or diverging normal equations")
                del active[g]
                continue
            if s["done"]:
                out[g] = Fitted(
                    family, tuple(terms), float(s["b"][0]), tuple(map(float, s["b"][1:])),
                    tuple(map(float, np.sqrt(np.diag(cov)))), int(n), math.nan,
                    theta=float(s["theta"]) if family == "negbin" else None,
                    model_type="Negative Binomial" if family == "negbin" else "Poisson", response=y,
                    notes={
                        "passes": s["passes"],
                        "gradient": float(np.abs(rhs - m @ s["b"]).max() / max(sum_y, 1.0)),
                    },
                )
                del active[g]
                continue
            step = b - s["b"]
            # steps are judged in units of the linear predictor
            size = float((np.abs(step) * np.sqrt(np.diag(m) / max(sum_w, 1e-300))).max())
            if size > 5:
                step *= 5 / size
            t = s["theta"]
            if family == "negbin":
                move = score / info if info > 0 else score * t
                t = min(max(t + move, t / 4), t * 4)
                if t > 1e7:
                    out[g] = NotConverged(f"{g}: theta grows without bound")
                    del active[g]
                    continue
            settled = size < close and abs(t - s["theta"]) < close * max(t, 1)
            s.update(b=s["b"] + step, theta=t, done=settled, passes=s["passes"] + 1)
    for g in active:
        out[g] = NotConverged(f"{g}: no convergence in {max_iter} passes")
    good = {g: m for g, m in out.items() if isinstance(m, Fitted)}
    if good:
        for g, ll in _final_loglik(data, good).items():
            out[g].loglik = ll
    return out


def fit_negbin(
    df: DataFrame, y: str = "n_records", terms: Sequence[str] = PREDICTORS,
    tol: float = 1e-10, max_iter: int = 200, init_theta: float | None = None, ridge: float = 0.0,
) -> Fitted:
    """Negative binomial model with log link and maximum-likelihood theta."""
    one = df.withColumn("_all", F.lit(0))
    res = fit_groups(one, "_all", [0], y, terms, "negbin", tol, max_iter, init_theta, ridge).get(0)
    if isinstance(res, Fitted):
        return res
    raise res or NotConverged("no rows")


def moment_theta(df: DataFrame, y: str = "n_records") -> float:
    r = df.agg(F.var_samp(y), F.avg(y)).first()
    ratio = r[0] / r[1]
    return max(0.1, min(10.0, 1 / (ratio - 1) if ratio > 1 else 0.5))


def fit_ladder(df: DataFrame, y: str = "n_records", terms: Sequence[str] = PREDICTORS) -> Fitted:
    """Poisson when dispersion allows it, else the first negative binomial rung that converges."""
    pois = fit_poisson(df, y, terms)
    if overdispersion(df, pois).first()["ratio"] <= 2:
        return pois
    rungs = (
        ("full", lambda: fit_negbin(df, y, terms, 1e-10, 200)),
        ("relaxed", lambda: fit_negbin(df, y, terms, 1e-8, 500, 1.0)),
        ("four predictors", lambda: fit_negbin(df, y, terms[:4], 1e-10, 300)),
        ("three predictors", lambda: fit_negbin(df, y, terms[:3], 1e-10, 200)),
        ("moment theta", lambda: fit_negbin(df, y, terms, 1e-8, 500, moment_theta(df, y))),
        ("smooth", lambda: _smooth_rung(df, y, terms[:4])),
    )
    for name, fit in rungs:
        try:
            out = fit()
        except NotConverged:
            continue
        out.notes["rung"] = name
        return out
    pois.model_type = "Poisson (fallback)"
    pois.notes["rung"] = "poisson"
    return pois


def _smooth_rung(df: DataFrame, y: str, terms: Sequence[str]) -> Fitted:
    from obsweave.models.smooth import fit_smooth

    out = fit_smooth(df, y, terms, k=4, surface=0)
    out.model_type = "Negative Binomial smooth"
    return out


def fit_by_group(
    df: DataFrame, group: str, y: str = "n_records", top: int = 5, min_n: int = 30,
    terms: Sequence[str] = PREDICTORS, among: DataFrame | None = None,
) -> dict[str, Fitted]:
    """Models of the most frequent groups: NB full, then NB with three terms, then Poisson."""
    ranked = (among if among is not None else df).groupBy(group).agg(
        (F.count("*") if among is not None else F.sum(y)).alias("n")
    )
    order = [r[group] for r in ranked.orderBy(F.desc("n"), F.asc_nulls_last(group)).limit(top).collect()]
    sizes = dict(df.where(F.col(group).isin([g for g in order if g is not None])).groupBy(group).count().collect())
    todo = [g for g in order if sizes.get(g, 0) >= min_n]
    out: dict[str, Fitted] = {}
    for spec, family in ((terms, "negbin"), (terms[:3], "negbin"), (terms, "poisson")):
        left = [g for g in todo if g not in out]
        if not left:
            break
        res = fit_groups(df.where(F.col(group).isin(left)), group, left, y, spec, family)
        out |= {g: m for g, m in res.items() if isinstance(m, Fitted)}
    return out


# ------------------------------------------------------------- diagnostics


#: Cells whose draws are held at a time.
_CELLS = 4096


def quantile_residuals(df: DataFrame, model: Fitted, n: int = 250, seed: int = 123, key: str = "id") -> DataFrame:
    """Randomised quantile residuals from n simulated responses per cell.

    Draw j of a cell is the response whose distribution function first reaches a uniform
    number that seed, cell and j alone decide, so results do not depend on partitioning.
    It lies below the observed count where that number is at most the function one step
    before the count: two evaluations per cell stand for n inversions. A NULL response or
    mean gives NULL; equal keys share their draws.
    """
    theta, family = model.theta, model.family

    @F.pandas_udf(T.DoubleType())
    def draw(mu: pd.Series, y: pd.Series, s: pd.Series) -> pd.Series:
        out = np.full(len(mu), np.nan)
        known = np.flatnonzero(mu.notna().to_numpy() & y.notna().to_numpy())
        mean, seen, keys = (v.to_numpy()[known] for v in (mu, y, s))
        before, upto = (count_cdf(family, k, mean, theta) for k in (np.ceil(seen) - 1, np.floor(seen)))
        for at in range(0, len(known), _CELLS):
            part = slice(at, at + _CELLS)
            u = uniforms(keys[part], n + 1)
            low, high = ((u[:, :n] <= c[part, None]).mean(axis=1) for c in (before, upto))
            out[known[part]] = low + u[:, n] * (high - low)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    y = F.col(model.response).cast("double")
    return df.select(key, draw(model.mean(), y, F.xxhash64(F.lit(seed), F.col(key))).alias("u"))


def uniformity(residuals: DataFrame, value: str = "u") -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance of residuals from the uniform law."""
    from obsweave.functions.pvalues import add_p_values
    from obsweave.plans.running import running_sums

    hist = residuals.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    run = running_sums(hist, ["_v"], {"_c": "_n"})
    total = hist.agg(F.sum("_n")).scalar()
    run = run.withColumn("_t", total)
    gap = F.greatest(
        F.col("_c") / F.col("_t") - F.col("_v"), F.col("_v") - (F.col("_c") - F.col("_n")) / F.col("_t")
    )
    out = run.agg(F.first("_t").alias("n"), F.max(gap).alias("d"))
    return add_p_values(out, "p_value", _one_sample_p, ["d", "n"])


def _one_sample_p(d: float, n: float) -> float:
    from obsweave.functions.pvalues import kolmogorov_p

    return kolmogorov_p(d, n, 1e300)


def null_loglik(df: DataFrame, model: Fitted) -> float:
    """Log-likelihood of the intercept-only model (same theta for NB)."""
    y = F.col(model.response).cast("double")
    mean = df.agg(F.avg(y)).scalar()
    return df.withColumn("_m", mean).agg(F.sum(_loglik(model.family, y, F.col("_m"), model.theta))).first()[0]


def performance(df: DataFrame, model: Fitted) -> DataFrame:
    """AIC, BIC, two pseudo-R2 and RMSE in one row."""
    y, n, k = F.col(model.response).cast("double"), model.n, model.n_params
    ll0 = null_loglik(df, model)
    cox = 1 - math.exp(2 * (ll0 - model.loglik) / n)
    top = 1 - math.exp(2 * ll0 / n)
    err = y - model.mean()
    return df.agg(
        F.lit(model.model_type).alias("model"),
        F.lit(-2 * model.loglik + 2 * k).alias("aic"),
        F.lit(-2 * model.loglik + k * math.log(n)).alias("bic"),
        F.lit(1 - model.loglik / ll0).alias("r2_mcfadden"),
        F.lit(cox / top if top else None).cast("double").alias("r2_nagelkerke"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    )


def tidy(spark: SparkSession, models: dict[str, Fitted], z: float = 1.959964, alpha: float = 0.05) -> DataFrame:
    """Coefficients with Wald limits, one row per model and term."""
    rows = []
    for name, m in models.items():
        for term, est, se in zip(("(Intercept)", *m.terms), (m.intercept, *m.coef), m.se, strict=True):
            stat = est / se
            p = math.erfc(abs(stat) / math.sqrt(2))
            rows.append(
                (name, term, float(est), float(se), float(stat), p, est - z * se, est + z * se, p < alpha,
                 "Positive" if est > 0 else "Negative", m.model_type)
            )
    return spark.createDataFrame(
        rows,
        "model string, term string, estimate double, std_error double, statistic double, p_value double,"
        " conf_low double, conf_high double, significant boolean, effect_direction string, model_type string",
    )


def information_criteria(spark: SparkSession, models: dict[str, Fitted]) -> DataFrame:
    """AIC and BIC with differences and Akaike weights."""
    aic = {k: -2 * m.loglik + 2 * m.n_params for k, m in models.items()}
    best = min(aic.values())
    w = {k: math.exp(-(v - best) / 2) for k, v in aic.items()}
    rows = [
        (k, m.n_params, float(m.loglik), float(aic[k]), float(-2 * m.loglik + m.n_params * math.log(m.n)),
         float(aic[k] - best), float(w[k] / sum(w.values())))
        for k, m in models.items()
    ]
    return spark.createDataFrame(
        rows, "model string, n_params int, loglik double, aic double, bic double, delta_aic double, weight double"
    )
