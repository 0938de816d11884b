"""Queries and SQL twins for the models of sampling effort."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.models import design as D
from obsweave.models import glm as M
from obsweave.models import report as R
from obsweave.models.smooth import fit_smooth, smooth_columns
from obsweave.operators import cells as C
from obsweave.plans.session import cut
from obsweave.queries.base import clean, haversine_sql, r
from obsweave.queries.spatial import BOX, BOUNDARY, CLEAN, GRID, GRID_SQL, bands_sql, raster
from obsweave.queries.temporal import rnd
from obsweave.sources.reference import CITIES, cities

QUERIES, ORACLE = {}, {}


def query(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def grid(s, d):
    cells = C.hex_cells(s, BOX, 0.1, BOUNDARY)
    return C.zero_fill(cells, C.cell_metrics(clean(s, d)), ["cell_q", "cell_r"])


def covariates(s, d):
    return D.covariates(grid(s, d), raster(s), GRID, cities(s))


def design(s, d):
    return D.design_matrix(grid(s, d), raster(s), GRID, cities(s)).withColumn(
        "id", F.col("cell_q") * 100_000 + F.col("cell_r"))


_city = "least(" + ", ".join(
    haversine_sql("lon_c", "lat_c", f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)") + " / 1000" for _, x, y in CITIES) + ")"
COV = GRID_SQL + f""",
cv AS (SELECT *, {bands_sql('lon_c', 'lat_c')}, {_city} AS dist_to_city_km, abs(lat_c) AS dist_from_equator,
  abs(lon_c - 40.5) * 111.0 AS dist_from_coast_km FROM gr)"""
_zs = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {D.scaled_name(c)}" for c in D.SCALED)
DES = COV + f""",
ds AS (SELECT * FROM (SELECT *, {_zs}, CAST(n_records > 0 AS INT) AS presence FROM cv)
  WHERE elevation IS NOT NULL AND temperature IS NOT NULL AND precipitation IS NOT NULL)"""
_cov = ["elevation", "temperature", "precipitation", "dist_to_city_km", "dist_from_equator", "dist_from_coast_km"]
query("covariates", lambda s, d: rnd(covariates(s, d).select("cell_q", "cell_r", "n_records", *_cov)),
      f"WITH {COV} SELECT cell_q, cell_r, n_records, {', '.join(f'{r(c)} AS {c}' for c in _cov)} FROM cv")
query("design_matrix", lambda s, d: rnd(design(s, d).select("cell_q", "cell_r", "presence", *D.PREDICTORS)),
      f"WITH {DES} SELECT cell_q, cell_r, presence, {', '.join(f'{r(c)} AS {c}' for c in D.PREDICTORS)} FROM ds")
query("range_report", lambda s, d: rnd(D.range_report(design(s, d), ("elevation", "temperature", "precipitation", "dist_to_city_km"))),
      f"WITH {DES} " + " UNION ALL ".join(
          f"SELECT count(*) AS n, '{c}' AS variable, {r(f'min({c})')} AS lo, {r(f'max({c})')} AS hi FROM ds"
          for c in ("elevation", "temperature", "precipitation", "dist_to_city_km")))

#: A given model, so that predictions and reports have an SQL twin.
GIVEN = M.Fitted("negbin", D.PREDICTORS, 1.5, (0.3, -0.2, 0.1, -0.5, 0.05, -0.001), (0.1,) * 7, 1, -1.0, theta=1.0)
LOGIT = M.Fitted("binomial", D.PREDICTORS, -1.0, (0.2, -0.1, 0.1, -0.4, 0.02, -0.001), (0.1,) * 7, 1, -1.0)


def _eta(m):
    return " + ".join([str(m.intercept), *[f"({b}) * {t}" for b, t in zip(m.coef, m.terms)]])


PRED = DES + f""",
p0 AS (SELECT *, exp({_eta(GIVEN)}) AS predicted_count, 1 / (1 + exp(-({_eta(LOGIT)}))) AS predicted_presence FROM ds),
p1 AS (SELECT *, n_records - predicted_count AS residual_count FROM p0),
p2 AS (SELECT *, residual_count / stddev_samp(residual_count) OVER () AS residual_std FROM p1),
pr AS (SELECT *, residual_std < -1 AS under_sampled, residual_std > 1 AS over_sampled FROM p2),
qq AS (SELECT quantile_cont(predicted_count, 0.25) AS q1, quantile_cont(predicted_count, 0.75) AS q3 FROM pr),
ol AS (SELECT pr.*, CASE WHEN predicted_count < q1 - 1.5 * (q3 - q1) THEN 'low' WHEN predicted_count > q3 + 1.5 * (q3 - q1)
  THEN 'high' ELSE 'normal' END AS outlier_type FROM pr, qq)"""


def pred(s, d):
    return R.predict_residuals(cut(design(s, d), "design"), GIVEN, LOGIT)


_pc = ["predicted_count", "predicted_presence", "residual_count", "residual_std"]
query("predict_residuals", lambda s, d: rnd(pred(s, d).select("cell_q", "cell_r", *_pc, "under_sampled", "over_sampled")),
      f"WITH {PRED} SELECT cell_q, cell_r, {', '.join(f'{r(c)} AS {c}' for c in _pc)}, under_sampled, over_sampled FROM pr")
query("undersampled_profile", lambda s, d: rnd(R.undersampled_profile(R.predict_residuals(cut(design(s, d), "design"), GIVEN, None, 1.0))),
      f"WITH {PRED} SELECT count(*) AS n_cells, {r('avg(elevation)')} AS mean_elevation, {r('avg(temperature)')} AS mean_temp,"
      f" {r('avg(precipitation)')} AS mean_precip, {r('avg(dist_to_city_km)')} AS mean_dist_city FROM pr WHERE residual_std < -1")
query("join_predictions", lambda s, d: rnd(R.join_predictions(grid(s, d), pred(s, d), ["cell_q", "cell_r"])
                                           .select("cell_q", "cell_r", "n_species", "predicted_count", "residual_count", "residual_std")),
      f"WITH {PRED} SELECT gr.cell_q, gr.cell_r, gr.n_species, {', '.join(f'{r(c)} AS {c}' for c in ('predicted_count', 'residual_count', 'residual_std'))}"
      " FROM gr LEFT JOIN pr ON gr.cell_q = pr.cell_q AND gr.cell_r = pr.cell_r WHERE residual_std IS NOT NULL")
query("iqr_outliers", lambda s, d: rnd(R.outlier_counts(R.iqr_outliers(cut(pred(s, d), "pred")))),
      f"WITH {PRED} SELECT count(*) AS n_total, count(*) FILTER (WHERE outlier_type <> 'normal') AS n_outliers,"
      f" {r(chr(99) + 'ount(*) FILTER (WHERE outlier_type <> ' + repr('normal') + ') * 100.0 / count(*)')} AS pct_outliers,"
      " count(*) FILTER (WHERE outlier_type = 'low') AS n_low, count(*) FILTER (WHERE outlier_type = 'high') AS n_high FROM ol")
_rs = lambda tag, where: f"""(SELECT unnest(['n_cells', 'mean_residual', 'sd_residual', 'min_std_residual', 'max_std_residual', 'range_std_residual']) AS statistic,
  unnest([CAST(n AS DOUBLE), m, sd, lo / sd, hi / sd, (hi - lo) / sd]) AS {tag} FROM
  (SELECT count(*) AS n, avg(residual_count) AS m, stddev_samp(residual_count) AS sd, min(residual_count) AS lo, max(residual_count) AS hi
   FROM ol WHERE {where}))"""  # noqa: E731
query("residual_comparison", lambda s, d: R.residual_comparison(R.iqr_outliers(cut(pred(s, d), "pred"))),
      f"""WITH {PRED} SELECT statistic, round(original, 2) AS original, round(filtered, 2) AS filtered
      FROM {_rs('original', 'true')} JOIN {_rs('filtered', "outlier_type = 'normal'")} USING (statistic)""")


# ------------------------------------------------------------- fitted models


def fitted(s, d):
    data = cut(design(s, d), "design")
    return data, {"poisson": M.fit_poisson(data), "negbin": M.fit_negbin(data), "presence": M.fit_logit(data)}


query("model_coefficients", lambda s, d: rnd(M.tidy(s, fitted(s, d)[1])))
query("coefficient_report", lambda s, d: R.coefficient_report(M.tidy(s, fitted(s, d)[1])))
query("information_criteria", lambda s, d: rnd(M.information_criteria(s, fitted(s, d)[1])))
query("predictor_availability", lambda s, d: R.predictor_availability(s, M.tidy(s, fitted(s, d)[1])))


def _overdispersion(s, d):
    data = cut(design(s, d), "design")
    return rnd(M.overdispersion(data, M.fit_poisson(data)))


def _ladder(s, d):
    data = cut(design(s, d), "design")
    m = M.fit_ladder(data)
    return M.tidy(s, {m.notes.get("rung", "poisson"): m})


def _performance(s, d):
    data = cut(design(s, d), "design")
    return rnd(M.performance(data, M.fit_negbin(data)))


def _residuals(s, d):
    data = cut(design(s, d), "design")
    return rnd(M.uniformity(M.quantile_residuals(data, M.fit_negbin(data))))


def _smooth(s, d):
    data = cut(design(s, d).where("n_records > 0"), "design")
    m = fit_smooth(data)
    terms = ("elevation_scaled", "temperature_scaled", "precipitation_scaled", "dist_to_city_scaled")
    out = smooth_columns(data, terms).withColumn("fitted", m.mean())
    return rnd(out.select("cell_q", "cell_r", "n_records", "fitted"))


def _curve(s, d):
    data = cut(design(s, d), "design")
    return rnd(R.effect_curve(data, M.fit_negbin(data), "elevation_scaled"))


def _by_class(s, d):
    data = design(s, d).select("cell_q", "cell_r", *D.PREDICTORS)
    per = C.with_cell(clean(s, d).where("class is not null")).groupBy("cell_q", "cell_r", "class").agg(
        F.count("*").alias("n_records"))
    both = cut(per.join(data, ["cell_q", "cell_r"]), "class_cells")
    return rnd(M.tidy(s, M.fit_by_group(both, "class")))


query("overdispersion", _overdispersion)
query("model_ladder", _ladder)
query("model_performance", _performance)
query("quantile_residuals", _residuals)
query("smooth_effects", _smooth)
query("effect_curve", _curve)
query("class_models", _by_class)
