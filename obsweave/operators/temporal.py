"""Sampling effort over time: yearly series, trend, gaps, seasons, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsweave.columns import Columns
from obsweave.functions.labels import (
    decade, month_name, period_label, period_start, season,
)
from obsweave.functions.pvalues import add_p_values, chi2_p, kendall_p, normal_two_sided
from obsweave.operators.trend import BLOCK, kendall
from obsweave.plans.running import exact_quantiles
from obsweave.plans.session import cut
from obsweave.plans.skew import distinct_counts


def yearly(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records, taxa (NULL counted) and collectors (NULL not counted) per year.

    Taxa and collectors are two narrow aggregates, so records are never repeated
    per distinct column.
    """
    dated = df.where(F.col(cols.year).isNotNull())
    taxa = distinct_counts(
        dated, [cols.year],
        {"n_species": cols.species, "n_genera": cols.genus, "n_families": cols.family}, True,
    )
    people = dated.groupBy(cols.year).agg(
        F.count_distinct(cols.collector).alias("n_collectors")
    )
    return taxa.join(people, cols.year)


def yearly_stats(years: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Spread of the yearly series; one row per calendar year comes in."""
    y = F.col(cols.year)
    n = F.col("n_records")
    return years.agg(
        F.min(y).alias("min_year"),
        F.max(y).alias("max_year"),
        (F.max(y) - F.min(y)).alias("year_range"),
        F.count("*").alias("n_years"),
        F.avg(n).alias("mean_records"),
        F.median(n).alias("median_records"),
        F.stddev_samp(n).alias("sd_records"),
        F.try_divide(F.stddev_samp(n), F.avg(n)).alias("cv_records"),
        F.avg("n_species").alias("mean_species"),
        F.median("n_species").alias("median_species"),
    )


def mann_kendall(
    series: DataFrame, value: str, order: str, by: list[str] | None = None, alpha: float = 0.05,
    exact_up_to: int = 10, block: int = BLOCK,
) -> DataFrame:
    """Trend of a series with one value per step, per group; a group may hold any number of steps.

    Missing values are left out. Ties are corrected; the p-value is the two-sided
    normal one with continuity correction, or comes from the exact distribution of
    the score for series of 3 to ``exact_up_to`` entries (50 at most) without ties. Eager:
    the narrow series is written once.
    """
    by = list(by or [])
    v = F.col(value).cast("double")
    rows = series.where(v.isNotNull() & ~F.isnan(v) & F.col(order).isNotNull())
    rows = cut(rows.select(*by, F.col(order).alias("o"), v.alias("v")), "trend")
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    out = kendall(rows, by, block).withColumns({
        "tau": F.try_divide(F.col("s_stat"), F.sqrt(pairs - F.col("t2")) * F.sqrt(pairs)),
        "var_s": (n * (n - 1) * (2 * n + 5) - F.col("t5")) / 18,
    })
    z = F.try_divide(F.col("s_stat") - F.signum(F.col("s_stat").cast("double")), F.sqrt("var_s"))
    out = out.withColumn("z", F.when(F.col("n") >= 3, z))
    short = (F.col("t2") == 0) & F.col("n").between(3, min(exact_up_to, 50))
    # only rows with a score and a count of their own get the exact value
    out = out.withColumns({"_s": F.when(short, F.col("s_stat")), "_n": F.when(short, F.col("n"))})
    out = add_p_values(add_p_values(out, "p_value", normal_two_sided, ["z"]), "_p", kendall_p, ["_s", "_n"])
    out = out.withColumn("p_value", F.coalesce("_p", "p_value"))
    return out.select(*by, "n", "s_stat", "var_s", "tau", "z", "p_value").withColumn(
        "trend",
        F.when(F.col("p_value").isNull(), F.lit(None).cast("string"))
        .when(F.col("p_value") >= alpha, "No trend")
        .when(F.col("tau") > 0, "Increasing")
        .otherwise("Decreasing"),
    )


def complete_years(years: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Every year from first to last; absent years carry zero."""
    y = cols.year
    bounds = years.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).where("lo is not null")
    every = bounds.select(F.explode(F.sequence("lo", "hi")).alias(y))
    counts = [c for c in years.columns if c.startswith("n_")]
    return every.join(years, y, "left").fillna(0, subset=counts).select(y, *counts)


def missing_years(years: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Years between first and last without any record."""
    return complete_years(years, cols).where("n_records = 0").select(cols.year)


def gap_summary(years: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Years with and without data, the longest gap and the number of gap runs."""
    y = cols.year
    # one row per calendar year: the ordered window holds at most 9999 rows
    gaps = years.select(
        y, (F.lead(y).over(Window.orderBy(y)) - F.col(y) - 1).alias("gap")
    )
    total = F.max(y) - F.min(y) + 1
    return gaps.agg(
        total.cast("long").alias("total_years"),
        F.count("*").alias("years_with_data"),
        (total - F.count("*")).alias("years_without_data"),
        (F.count("*") * 100.0 / total).alias("completeness_pct"),
        F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest_gap"),
        F.count_if(F.col("gap") > 0).alias("n_gap_runs"),
    )


def year_by(df: DataFrame, category: str, cols: Columns = Columns()) -> DataFrame:
    """Records and species per year and category, both present."""
    kept = df.where(F.col(cols.year).isNotNull() & F.col(category).isNotNull())
    return distinct_counts(kept, [cols.year, category], {"n_species": cols.species}, True)


def top_k(df: DataFrame, category: str, k: int = 10) -> DataFrame:
    """The k most frequent categories; NULL competes, ties follow the name."""
    return (
        df.groupBy(category).agg(F.count("*").alias("n_records"))
        .orderBy(F.desc("n_records"), F.asc_nulls_last(category))
        .limit(k)
    )


def within_top_k(df: DataFrame, category: str, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """Rows of the k most frequent categories; k rows are broadcast."""
    top = top_k(among if among is not None else df, category, k)
    top = top.select(F.col(category).alias("_top"))
    return df.join(F.broadcast(top), df[category].eqNullSafe(top["_top"]), "left_semi")


def decades(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records and taxa per decade; 2020 belongs to 2020."""
    kept = df.where(F.col(cols.year).isNotNull()).withColumn("decade", decade(F.col(cols.year)))
    return distinct_counts(
        kept, ["decade"],
        {"n_species": cols.species, "n_genera": cols.genus, "n_families": cols.family}, True,
    )


def monthly(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records and species per month that has data, with name and season."""
    kept = df.where(F.col(cols.month).isNotNull())
    out = distinct_counts(kept, [cols.month], {"n_species": cols.species}, True)
    m = F.col(cols.month)
    return out.withColumns({"month_name": month_name(m), "season": season(m)})


def seasons(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records per season."""
    kept = df.where(F.col(cols.month).isNotNull())
    return kept.groupBy(season(F.col(cols.month)).alias("season")).agg(
        F.count("*").alias("n_records")
    )


def chisq_uniform(counts: DataFrame, value: str = "n_records", alpha: float = 0.05) -> DataFrame:
    """Goodness of fit to equal counts over the categories present."""
    one = counts.agg(
        F.count("*").alias("k"), F.sum(value).alias("s"),
        F.sum(F.col(value).cast("double") * F.col(value)).alias("ss"),
    )
    # sum((o - e)^2 / e) with e = s / k
    e = F.col("s") / F.col("k")
    out = one.select(
        (F.try_divide(F.col("ss"), e) - F.col("s")).alias("chi_squared"),
        (F.col("k") - 1).alias("df"),
    )
    return add_p_values(out, "p_value", chi2_p, ["chi_squared", "df"]).withColumn(
        "significant", F.col("p_value") < alpha
    )


def taxon_years(df: DataFrame, cols: Columns = Columns(), min_n: int = 10) -> DataFrame:
    """First, last, span and completeness of years per species."""
    y = F.col(cols.year)
    per = df.where(y.isNotNull()).groupBy(cols.species, cols.year).agg(F.count("*").alias("n"))
    return (
        per.groupBy(cols.species)
        .agg(
            F.sum("n").alias("n_records"),
            F.min(y).alias("year_first"),
            F.max(y).alias("year_last"),
            (F.max(y) - F.min(y)).alias("temporal_span"),
            F.count("*").alias("n_years"),
            (F.count("*") / (F.max(y) - F.min(y) + 1)).alias("temporal_completeness"),
        )
        .where(F.col("n_records") >= min_n)
    )


def taxon_years_summary(spans: DataFrame) -> DataFrame:
    """Means and medians of spans and completeness over the species kept."""
    from obsweave.operators.tracking import one_row

    base = spans.agg(
        F.count("*").alias("n_species"),
        F.avg("temporal_span").alias("mean_span"),
        F.avg("temporal_completeness").alias("mean_completeness"),
        F.avg("n_years").alias("mean_years"),
        F.max("temporal_span").alias("max_span"),
    )
    return one_row(
        base,
        exact_quantiles(spans, "temporal_span", {"median_span": 0.5}),
        exact_quantiles(spans, "temporal_completeness", {"median_completeness": 0.5}),
    )


def with_period(df: DataFrame, cols: Columns = Columns(), width: int = 10) -> DataFrame:
    """Adds ``period_start`` and ``period``: bins from the data's own first to last break.

    The last bin is closed, so a greatest year of 2020 falls in 2010-2019.
    """
    y = F.col(cols.year)
    hi = df.agg(F.max(y)).scalar()
    lo = df.agg(F.min(y)).scalar()
    last = F.ceil(hi / width) * width
    # a single break (all years equal a multiple of the width) opens one bin
    last = F.greatest(last, F.floor(lo / width) * width + width)
    start = period_start(y, last, width)
    return df.withColumn("period_start", start).withColumn(
        "period", period_label(F.col("period_start"), width)
    )


def period_summary(
    df: DataFrame, cols: Columns = Columns(), ranks: tuple[str, ...] = ("species", "genus", "family")
) -> DataFrame:
    """Records and taxa per period over dated rows; input carries ``period``."""
    names = {"species": "n_species", "genus": "n_genera", "family": "n_families"}
    kept = df.where(F.col("event_day").isNotNull() & F.col("period").isNotNull())
    return distinct_counts(kept, ["period"], {names[r]: cols.ranks[r] for r in ranks}, True)


def temporal_metrics(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Span (both ends counted), years sampled, missing years and CV of yearly counts."""
    per = df.where(F.col(cols.year).isNotNull()).groupBy(cols.year).agg(F.count("*").alias("n"))
    y = F.col(cols.year)
    span = F.max(y) - F.min(y) + 1
    return per.agg(
        F.min(y).alias("min_year"),
        F.max(y).alias("max_year"),
        span.alias("span"),
        F.count("*").alias("n_years_sampled"),
        (F.count("*") / span).alias("completeness"),
        (span - F.count("*")).alias("n_missing_years"),
        F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("cv"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from least to greatest value; the last bin is closed."""
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull())
    lo = kept.agg(F.min(v)).scalar()
    hi = kept.agg(F.max(v)).scalar()
    width = (hi - lo) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(v - lo, width)), F.lit(0)))
    return (
        kept.withColumns({"bin": at.cast("int"), "_lo": lo, "_w": width})
        .groupBy("bin")
        .agg(
            F.count("*").alias("n"),
            (F.first("_lo") + F.col("bin") * F.first("_w")).alias("bin_start"),
        )
    )


def temporal_report(years: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Gaps and spread of the yearly series in one row."""
    from obsweave.operators.tracking import one_row

    gaps = gap_summary(years, cols).select("years_without_data", "completeness_pct")
    stats = yearly_stats(years, cols).select("cv_records", "mean_records", "median_records")
    return one_row(gaps, stats)


