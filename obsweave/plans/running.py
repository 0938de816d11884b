"""Running totals and exact quantiles without a one-task window."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.plans.session import cut

_COARSE = 16  # buckets per level; two levels give 256 buckets


def _by_range(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_slice``, which rises with the whole order."""
    return cut(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ranged")


def _by_quantiles(df: DataFrame, lead: str) -> DataFrame:
    """Adds ``_slice``, the place of ``lead`` between approximate quantiles."""
    probs = [i / _COARSE**2 for i in range(1, _COARSE**2)]
    cuts = df.agg(F.percentile_approx(F.col(lead).cast("double"), probs, 2000)).scalar()
    v = F.col(lead).cast("double")
    # two short scans of the cut points instead of one long one
    out = df.withColumn("_cuts", cuts)
    coarse = F.aggregate(
        F.sequence(F.lit(1), F.lit(_COARSE - 1)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(F.element_at(F.col("_cuts"), i * _COARSE) < v, 1).otherwise(0),
    )
    out = out.withColumn("_coarse", coarse)
    fine = F.size(
        F.filter(F.slice("_cuts", F.col("_coarse") * _COARSE + 1, _COARSE - 1), lambda b: b < v)
    )
    # an empty input has no cut points and no rows
    out = out.withColumn(
        "_slice", F.coalesce(F.col("_coarse") * _COARSE + fine, F.lit(0))
    ).drop("_coarse", "_cuts")
    return out


def running_sums(
    df: DataFrame,
    order: list[str],
    sums: dict[str, str],
    by: list[str] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Adds, per alias, the sum of a column over this row and all before it.

    With ``totals`` also ``<alias>_all``, the sum over the whole group.

    ``order`` is a total order within ``by`` and starts with a number.  Rows are cut
    into slices along it; a window runs inside each slice and the slice totals are
    added on top.  Where the cuts fall changes the balance only, never the result,
    so no task sees a whole group.  With one column, up to 256 slices come from its
    approximate quantiles; it then has to be unique, as in a histogram.  With more,
    rows are dealt by range of the whole order, so equal numbers are split by the
    rest, and written once (eager), because both sums must see the same cuts.
    """
    by = list(by or [])
    out = _by_quantiles(df, order[0]) if len(order) == 1 else _by_range(df, [*by, *order])

    keys = [*by, "_slice"]
    slices = out.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{a}") for a, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    group = Window.partitionBy(*by)
    offsets = slices.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys],
        *[
            F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_o_{a}")
            for a in sums
        ],
        *[F.sum(f"_t_{a}").over(group).alias(f"{a}_all") for a in sums if totals],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = out.select("*", *[F.sum(c).over(inside).alias(f"_l_{a}") for a, c in sums.items()])
    match = functools.reduce(
        operator.and_,
        (
            local[c].eqNullSafe(offsets[f"_k_{c}"]) if c != "_slice"
            else local[c] == offsets[f"_k_{c}"]
            for c in keys
        ),
    )
    return local.join(offsets, match).select(
        *df.columns,
        *[(F.col(f"_l_{a}") + F.col(f"_o_{a}")).alias(a) for a in sums],
        *[f"{a}_all" for a in sums if totals],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    weight: str | None = None,
    ends: bool = False,
) -> DataFrame:
    """Type-7 quantiles (linear between neighbours) of the non-null values.

    Works on the histogram of distinct values and finds the two ranks around each
    quantile by running totals, so memory does not grow with distinct values.
    Returns ``by`` plus one column per alias; with ``ends`` also the two values
    each quantile lies between, as ``<alias>_below`` and ``<alias>_above``.
    """
    by = list(by or [])
    hist = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("_n"))
    )
    ranked = running_sums(hist, ["_v"], {"_upto": "_n"}, by, totals=True)
    ranked = ranked.withColumnRenamed("_upto_all", "_total")
    start = F.col("_upto") - F.col("_n")

    def at(rank):
        return F.max(F.when((start <= rank) & (rank < F.col("_upto")), F.col("_v")))

    aggs = []
    for alias, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("_total") - 1)
        aggs += [
            at(lo).alias(f"_lo_{alias}"),
            at(hi).alias(f"_hi_{alias}"),
            F.max(h - lo).alias(f"_f_{alias}"),
        ]
    res = ranked.groupBy(*by).agg(*aggs)
    return res.select(
        *by,
        *[
            (
                F.col(f"_lo_{a}")
                + F.col(f"_f_{a}") * (F.col(f"_hi_{a}") - F.col(f"_lo_{a}"))
            ).alias(a)
            for a in probs
        ],
        *[F.col(f"_lo_{a}").alias(f"{a}_below") for a in probs if ends],
        *[F.col(f"_hi_{a}").alias(f"{a}_above") for a in probs if ends],
    )
