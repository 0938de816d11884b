"""Generic summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.plans.running import exact_quantiles

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def summary_table(
    df: DataFrame, groups: list[str] | None = None, variables: list[str] | None = None
) -> DataFrame:
    """Mean, median and sd per numeric column, named ``{column}_{measure}``.

    Without groups also min and max.  All medians come from one long histogram.
    """
    groups = list(groups or [])
    if variables is None:
        variables = [c for c, t in df.dtypes if t.startswith(_NUMERIC) and c not in groups]
    aggs = []
    for c in variables:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_sd")]
        if not groups:
            aggs += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    base = df.groupBy(*groups).agg(*aggs)
    long = df.select(
        *groups,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_value"))
                    for c in variables
                ]
            )
        ),
    )
    med = exact_quantiles(long, "_value", {"m": 0.5}, [*groups, "_var"])
    wide = med.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(
        *[F.max(F.when(F.col("_var") == c, F.col("m"))).alias(f"{c}_median") for c in variables]
    )
    cond = F.lit(True)
    for g in groups:
        cond = cond & base[g].eqNullSafe(wide[f"_g_{g}"])
    if groups:
        out = base.join(wide, cond, "left")
    else:
        from obsweave.operators.tracking import one_row

        out = one_row(base, wide)
    names = [
        f"{c}_{m}" for c in variables
        for m in (("mean", "median", "sd") if groups else ("mean", "median", "sd", "min", "max"))
    ]
    return out.select(*groups, *names)
