"""Predictions, residual reports and coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.models.design import PREDICTORS
from obsweave.models.glm import Fitted
from obsweave.operators.tracking import one_row
from obsweave.plans.running import exact_quantiles

# Display names of the predictors.
TERM_NAMES = {
    "elevation": "Elevation", "temperature": "Temperature", "precipitation": "Precipitation",
    "dist_to_city": "Distance to city", "dist_from_equator": "Distance from equator",
    "dist_from_coast_km": "Distance from coast",
}


def predict_residuals(df: DataFrame, count: Fitted, presence: Fitted | None = None, cut: float = 1.0) -> DataFrame:
    """Predicted count and presence, residuals and over- or under-sampled marks."""
    out = df.withColumn("predicted_count", count.mean())
    if presence is not None:
        out = out.withColumn("predicted_presence", presence.mean())
    out = out.withColumn("residual_count", F.col("n_records") - F.col("predicted_count"))
    sd = out.agg(F.stddev_samp("residual_count")).scalar()
    out = out.withColumn("residual_std", F.try_divide(F.col("residual_count"), sd))
    return out.withColumns(
        {
            "under_sampled": F.coalesce(F.col("residual_std") < -cut, F.lit(False)),
            "over_sampled": F.coalesce(F.col("residual_std") > cut, F.lit(False)),
        }
    )


def undersampled_profile(pred: DataFrame) -> DataFrame:
    """Number and mean environment of the under-sampled cells."""
    return pred.where("under_sampled").agg(
        F.count("*").alias("n_cells"),
        F.avg("elevation").alias("mean_elevation"),
        F.avg("temperature").alias("mean_temp"),
        F.avg("precipitation").alias("mean_precip"),
        F.avg("dist_to_city_km").alias("mean_dist_city"),
    )


def join_predictions(grid: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions on the whole grid; cells without a residual are dropped."""
    cols = ["predicted_count", "residual_count", "residual_std"]
    out = grid.join(pred.select(*keys, *cols), list(keys), "left")
    return out.where(F.col("residual_std").isNotNull())


def effect_curve(df: DataFrame, model: Fitted, variable: str, points: int = 50) -> DataFrame:
    """Response over one predictor's range, the others held at their mean."""
    stats = df.agg(
        F.min(variable).alias("_lo"), F.max(variable).alias("_hi"),
        *[F.avg(t).alias(t) for t in model.terms if t != variable],
    )
    out = stats.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = out.withColumn(
        variable, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1)
    )
    return out.select(F.lit(variable).alias("variable"), F.col(variable).alias("value"),
                      model.mean().alias("response"))


def coefficient_report(tidy: DataFrame, names: dict[str, str] = TERM_NAMES, digits: int = 3) -> DataFrame:
    """Readable coefficients: intercept dropped, suffix removed, rounded."""
    mapping = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    base = F.regexp_replace("term", "_scaled$", "")
    return tidy.where(F.col("term") != "(Intercept)").select(
        "model",
        F.coalesce(F.try_element_at(mapping, base), base).alias("predictor"),
        *[F.round(c, digits).alias(c) for c in ("estimate", "conf_low", "conf_high")],
        F.round("p_value", 4).alias("p_value"),
        "significant", "effect_direction",
    )


def iqr_outliers(pred: DataFrame, value: str = "predicted_count", k: float = 1.5) -> DataFrame:
    """Marks values strictly outside quartile -/+ k * IQR."""
    q = exact_quantiles(pred, value, {"q1": 0.25, "q3": 0.75}).select(
        F.struct("q1", "q3").alias("q")
    ).scalar()
    out = pred.where(F.col(value).isNotNull()).withColumn("_q", q)
    spread = F.col("_q.q3") - F.col("_q.q1")
    low, high = F.col(value) < F.col("_q.q1") - k * spread, F.col(value) > F.col("_q.q3") + k * spread
    return out.withColumns(
        {
            "is_outlier": low | high,
            "outlier_type": F.when(low, "low").when(high, "high").otherwise("normal"),
        }
    ).drop("_q")


def outlier_counts(marked: DataFrame) -> DataFrame:
    n = F.count("*")
    return marked.agg(
        n.alias("n_total"), F.count_if("is_outlier").alias("n_outliers"),
        (F.count_if("is_outlier") * 100.0 / n).alias("pct_outliers"),
        F.count_if(F.col("outlier_type") == "low").alias("n_low"),
        F.count_if(F.col("outlier_type") == "high").alias("n_high"),
    )


def residual_comparison(marked: DataFrame) -> DataFrame:
    """Residual statistics before and after dropping outliers; sd is taken anew."""

    def stats(df: DataFrame, tag: str) -> DataFrame:
        v = F.col("residual_count")
        sd = F.stddev_samp(v)
        lo, hi = F.try_divide(F.min(v), sd), F.try_divide(F.max(v), sd)
        return df.agg(
            F.array(F.count("*").cast("double"), F.avg(v), sd, lo, hi, hi - lo).alias(tag)
        )

    both = one_row(stats(marked, "a"), stats(marked.where("not is_outlier"), "b"))
    names = ("n_cells", "mean_residual", "sd_residual", "min_std_residual", "max_std_residual", "range_std_residual")
    return both.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("statistic"), F.round(F.col("a")[i], 2).alias("original"),
                             F.round(F.col("b")[i], 2).alias("filtered"))
                    for i, s in enumerate(names)
                ]
            )
        )
    )


def predictor_availability(spark: SparkSession, tidy: DataFrame, expected: Sequence[str] = PREDICTORS) -> DataFrame:
    """Expected predictors missing from each model and how complete it is."""
    have = tidy.where(F.col("term") != "(Intercept)").groupBy("model").agg(
        F.collect_set("term").alias("have")
    )
    want = F.array(*[F.lit(e) for e in expected])
    missing = F.array_except(want, F.col("have"))
    return have.select(
        "model", F.size("have").alias("n_predictors"), F.size(missing).alias("n_missing"),
        F.array_join(F.array_sort(missing), ",").alias("missing"),
        F.when(F.size(missing) == 0, "complete").when(F.size("have") >= 3, "partial")
        .otherwise("minimal").alias("status"),
    )
