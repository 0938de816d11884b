"""Sequential cleaning: each step drops rows, in a fixed order."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.columns import COORD_FLAGS, UNSUITABLE_BASIS, Columns
from obsweave.operators.flags import (
    FlagRules, add_flags, current_year, flag_high_uncertainty, flag_inappropriate_basis,
    flag_missing_coords, flag_missing_species, parse_date, passes,
)
from obsweave.operators.tracking import one_row
from obsweave.plans.running import exact_quantiles
from obsweave.plans.skew import distinct_count, keep_first
from obsweave.sources.reference import References


def drop_missing_coords(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    return df.where(~flag_missing_coords(cols))


def drop_missing_species(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    return df.where(~flag_missing_species(cols))


def drop_basis(df: DataFrame, cols: Columns = Columns(), values: tuple[str, ...] = UNSUITABLE_BASIS) -> DataFrame:
    """Drops the given kinds; an unknown kind stays."""
    return df.where(~flag_inappropriate_basis(cols, values))


def drop_uncertain(df: DataFrame, cols: Columns = Columns(), max_m: float = 10_000) -> DataFrame:
    """Keeps rows below the limit and rows of unknown uncertainty."""
    return df.where(~flag_high_uncertainty(cols, max_m))


def resolved_year(cols: Columns = Columns()) -> Column:
    """The provider's year; the date text is parsed only where that is absent."""
    y = F.col(cols.year)
    return F.when(y.isNotNull(), y).otherwise(F.year(parse_date(cols.event_date)))


def resolve_year(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    return df.withColumn(cols.year, resolved_year(cols)).withColumn(
        "event_day", parse_date(cols.event_date)
    )


def year_in_range(cols: Columns = Columns(), lo: int = 1950, as_of_year: int | None = None) -> Column:
    return F.coalesce(resolved_year(cols).between(F.lit(lo), current_year(as_of_year)), F.lit(False))


def keep_years(df: DataFrame, cols: Columns = Columns(), lo: int = 1950, as_of_year: int | None = None) -> DataFrame:
    return df.where(year_in_range(cols, lo, as_of_year))


def year_failures(df: DataFrame, cols: Columns = Columns(), lo: int = 1950, as_of_year: int | None = None) -> DataFrame:
    """How many rows the year range drops, by reason."""
    y = resolved_year(cols)
    return df.agg(
        F.count_if(y.isNull()).alias("no_year"),
        F.count_if(y < lo).alias("too_early"),
        F.count_if(y > current_year(as_of_year)).alias("in_future"),
    )


def dedupe(df: DataFrame, cols: Columns = Columns(), keys: list[str] | None = None,
           order_by: list[str] | None = None) -> DataFrame:
    """First record per (species, place, date); NULL keys equal each other.

    The order is total: record id, then every other column.
    """
    src = df if "event_day" in df.columns else df.withColumn("event_day", parse_date(cols.event_date))
    keys = keys or [cols.species, cols.lon, cols.lat, "event_day"]
    order = order_by or [cols.occ_id, *[c for c in df.columns if c != cols.occ_id]]
    return keep_first(src, keys, [F.asc_nulls_last(c) for c in order]).select(*df.columns)


def drop_coord_issues(
    df: DataFrame, cols: Columns = Columns(), refs: References | None = None,
    rules: FlagRules = FlagRules(), tests: tuple[str, ...] = COORD_FLAGS,
) -> DataFrame:
    """Keeps rows on which none of the coordinate tests reports a problem."""
    flagged = add_flags(df, cols, refs, rules, outliers="flag_coord_outliers" in tests)
    return flagged.where(passes(tests)).select(*df.columns)


def step_predicates(cols: Columns = Columns(), as_of_year: int | None = None, max_m: float = 10_000,
                    min_year: int = 1950) -> dict[str, Column]:
    """The row predicates of the cleaning steps in order."""
    return {
        "has_coordinates": ~flag_missing_coords(cols),
        "has_species": ~flag_missing_species(cols),
        "suitable_basis": ~flag_inappropriate_basis(cols),
        "certain_place": ~flag_high_uncertainty(cols, max_m),
        "valid_year": year_in_range(cols, min_year, as_of_year),
    }


def clean(
    df: DataFrame, cols: Columns = Columns(), as_of_year: int | None = None,
    refs: References | None = None, rules: FlagRules | None = None, coord_tests: bool = True,
) -> DataFrame:
    """All steps: row predicates, one record per duplicate key, coordinate tests."""
    keep = functools.reduce(operator.and_, step_predicates(cols, as_of_year).values())
    out = dedupe(df.where(keep), cols)
    if not coord_tests:
        return out
    return drop_coord_issues(out, cols, refs, rules or FlagRules(as_of_year=as_of_year))


def cleaning_waterfall(df: DataFrame, cols: Columns = Columns(), as_of_year: int | None = None) -> DataFrame:
    """Rows left after each step, from one pass; de-duplication has its own aggregate."""
    preds = step_predicates(cols, as_of_year)
    names = ["raw", *preds, "deduplicated"]
    conds = list(preds.values())
    upto = [functools.reduce(operator.and_, conds[: i + 1]) for i in range(len(conds))]
    counts = df.agg(
        F.count("*").alias("c0"), *[F.count_if(c).alias(f"c{i + 1}") for i, c in enumerate(upto)]
    )
    keys = [F.col(cols.species), F.col(cols.lon), F.col(cols.lat), parse_date(cols.event_date).alias("event_day")]
    unique = df.where(upto[-1]).groupBy(*keys).agg(F.lit(1).alias("one")).agg(
        F.count("*").alias(f"c{len(names) - 1}")
    )
    both = one_row(counts, unique)
    rows = [
        F.struct(
            F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"c{i}").alias("records"),
            (F.col(f"c{max(i - 1, 0)}") - F.col(f"c{i}")).alias("removed"),
            F.try_divide(F.col(f"c{i}") * 100.0, F.col("c0")).alias("retained_pct"),
            F.try_divide(F.col(f"c{i}") * 100.0, F.col(f"c{max(i - 1, 0)}")).alias("of_previous_pct"),
        )
        for i, n in enumerate(names)
    ]
    return both.select(F.inline(F.array(*rows)))


def dataset_summary(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records, distinct taxa (NULL counted), year range and median uncertainty."""
    ranks = {"n_species": "species", "n_genera": "genus", "n_families": "family",
             "n_orders": "order", "n_classes": "class", "n_phyla": "phylum"}
    names = [cols.ranks[r] for r in ranks.values()]
    paths = df.groupBy(*names).agg(
        F.count("*").alias("n"), F.min(cols.year).alias("lo"), F.max(cols.year).alias("hi")
    )
    base = paths.agg(
        F.sum("n").alias("n_records"),
        *[distinct_count(cols.ranks[r], True).alias(a) for a, r in ranks.items()],
        F.min("lo").alias("year_min"), F.max("hi").alias("year_max"),
    )
    return one_row(base, exact_quantiles(df, cols.uncertainty, {"median_uncertainty": 0.5}))


def taxon_summary(df: DataFrame, cols: Columns = Columns(), ranks: tuple[str, ...] = ("kingdom", "phylum", "class")) -> DataFrame:
    """Records and species per combination of the ranks, most records first."""
    names = [cols.ranks[r] for r in ranks]
    combos = df.groupBy(*names, cols.species).agg(F.count("*").alias("n"))
    return (
        combos.groupBy(*names)
        .agg(F.sum("n").alias("n_records"), distinct_count(cols.species, True).alias("n_species"))
        .orderBy(F.desc("n_records"), *[F.asc_nulls_last(c) for c in names])
    )


