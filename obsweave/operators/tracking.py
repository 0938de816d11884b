"""Counts, profiles and strategy comparisons over flagged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.columns import COORD_FLAGS, FLAGS, PRESETS, STRATEGIES, Columns
from obsweave.functions.labels import filled
from obsweave.operators.flags import (
    any_flag,
    current_year,
    duplicate_keys,
    parse_date,
    passes,
)
from obsweave.plans.running import exact_quantiles
from obsweave.plans.skew import distinct_count


def percent(n: Column, of: Column) -> Column:
    return F.try_divide(n * 100.0, of)


def long_counts(df: DataFrame, counts: dict[str, Column], name: str, n: str = "n") -> DataFrame:
    """One aggregate over ``df``, then one row per count with the total beside it."""
    keys = list(counts)
    one = df.agg(
        F.count("*").alias("_total"), *[c.alias(f"_c{i}") for i, c in enumerate(counts.values())]
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias(name), F.col(f"_c{i}").cast("long").alias(n))
            for i, k in enumerate(keys)
        ]
    )
    return one.select(F.explode(rows).alias("r"), "_total").select(
        f"r.{name}", f"r.{n}", F.col("_total").alias("total")
    )


def _described(df: DataFrame, name: str) -> DataFrame:
    text = F.create_map(*[F.lit(x) for kv in FLAGS.items() for x in kv])
    return df.withColumn("description", F.element_at(text, F.col(name)))


def flag_tracking(flagged: DataFrame, flags: tuple[str, ...] = tuple(FLAGS)) -> DataFrame:
    """One row per flag: records flagged and their percentage of all raw rows."""
    out = long_counts(flagged, {f: F.count_if(f) for f in flags}, "issue", "records_flagged")
    return _described(out, "issue").select(
        "issue", "description", "records_flagged",
        percent(F.col("records_flagged"), F.col("total")).alias("percent_flagged"),
    )


def coord_issue_table(flagged: DataFrame) -> DataFrame:
    """The seven coordinate tests, most frequent first; ``is_top`` keeps ties."""
    out = long_counts(flagged, {f: F.count_if(f) for f in COORD_FLAGS}, "test", "records_flagged")
    # seven rows: the window holds a fixed-size table
    w = Window.orderBy(F.desc("records_flagged"))
    return (
        _described(out, "test")
        .withColumn("is_top", F.rank().over(w) == 1)
        .select(
            "test", "description", "records_flagged",
            percent(F.col("records_flagged"), F.col("total")).alias("percent_of_original"),
            "is_top",
        )
        .orderBy(F.desc("records_flagged"), "test")
    )


def retention(
    flagged: DataFrame, strategies: dict[str, tuple[str, ...]] = STRATEGIES
) -> DataFrame:
    """Records kept by each strategy, with the original table as first row."""
    counts = {"original": F.count("*")}
    counts |= {s: F.count_if(passes(fs)) for s, fs in strategies.items()}
    return long_counts(flagged, counts, "strategy", "records").select(
        "strategy", "records", percent(F.col("records"), F.col("total")).alias("percent_retained")
    )


def uncertainty_profile(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Distribution of the non-null coordinate uncertainty."""
    u = F.col(cols.uncertainty)
    known = df.where(u.isNotNull())
    stats = known.agg(
        F.count("*").alias("n_with_uncertainty"),
        F.avg(u).alias("mean_uncertainty"),
        F.max(u).alias("max_uncertainty"),
        *[
            F.count_if(u > km * 1000).alias(f"n_gt_{km}km")
            for km in (1, 5, 10, 50)
        ],
    )
    q = exact_quantiles(
        known, cols.uncertainty,
        {"median_uncertainty": 0.5, "q25_uncertainty": 0.25, "q75_uncertainty": 0.75},
    )
    return one_row(stats, q)


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side of one-row results, joined on a constant key."""
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def basis_profile(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records per basis, NULL included, with the share of all records."""
    n = df.groupBy(F.col(cols.basis).alias("basis_of_record")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).scalar()
    return n.withColumn("percent", percent(F.col("n"), total)).orderBy(
        F.desc("n"), F.asc_nulls_last("basis_of_record")
    )


def rank_completeness(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records that carry a name at each of the seven ranks."""
    counts = {rank: F.count_if(filled(F.col(c))) for rank, c in cols.ranks.items()}
    return long_counts(df, counts, "rank", "n_complete").select(
        "rank", "n_complete", percent(F.col("n_complete"), F.col("total")).alias("percent_complete")
    )


def date_issues(dated: DataFrame, cols: Columns = Columns(), as_of_year: int | None = None,
                min_year: int = 1950) -> DataFrame:
    """Counts of date problems; input carries ``event_day`` and the resolved year."""
    y, now = F.col(cols.year), current_year(as_of_year)
    return dated.agg(
        F.count_if(F.col("event_day").isNull()).alias("n_missing_date"),
        F.count_if(y.isNull()).alias("n_missing_year"),
        F.count_if(y > now).alias("n_future_dates"),
        F.count_if(y < min_year).alias("n_pre_min_year"),
        F.count_if(y.between(F.lit(min_year), now)).alias("n_valid_year"),
    )


def duplicate_summary(dated: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Rows in repeated groups, the number of such groups and the share of all rows."""
    groups = dated.groupBy(*duplicate_keys(cols)).agg(F.count("*").alias("n"))
    rows = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return groups.agg(
        rows.alias("n_duplicate_records"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_sets"),
        percent(rows, F.sum("n")).alias("percent_duplicate"),
    )


def quality_summary(flagged: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """One row of totals: strategies, completeness, coordinate and date quality."""
    n = F.count("*")
    return flagged.agg(
        n.alias("n_records"),
        *[F.count_if(passes(fs)).alias(f"n_{s}_clean") for s, fs in STRATEGIES.items()],
        F.count_if(~F.col("flag_missing_coords")).alias("coordinates"),
        *[
            percent(F.count_if(filled(F.col(cols.ranks[k]))), n).alias(f"{k}_id")
            for k in ("species", "genus", "family")
        ],
        percent(F.count_if(~F.col("flag_invalid_date")), n).alias("dates"),
        F.count_if("flag_any_coord_issue").alias("total_coord_flags"),
        percent(F.count_if("flag_any_coord_issue"), n).alias("percent_coord_flags"),
        F.count_if("flag_duplicate").alias("n_duplicate_records"),
        F.count_if("flag_high_uncertainty").alias("n_high_uncertainty"),
    )


def any_flag_count(flagged: DataFrame) -> DataFrame:
    """Rows with at least one flag, and rows outside the moderate strategy."""
    n = F.count("*")
    hit, out = F.count_if(any_flag()), F.count_if(~passes(STRATEGIES["moderate"]))
    return flagged.agg(
        hit.alias("n_any_flag"),
        percent(hit, n).alias("percent_any_flag"),
        out.alias("n_not_moderate"),
        percent(out, n).alias("percent_not_moderate"),
    )


def sensitivity(
    flagged: DataFrame,
    cols: Columns = Columns(),
    strategies: dict[str, tuple[str, ...]] = STRATEGIES,
) -> DataFrame:
    """Records and taxa per strategy.

    Records are first counted per distinct taxonomic path, with one counter per
    strategy; only paths are then repeated per strategy and counted distinct.
    """
    taxa = {"species": cols.species, "families": cols.family, "orders": cols.order,
            "classes": cols.class_}
    x, y = F.floor(F.col(cols.lon) * 10), F.floor(F.col(cols.lat) * 10)
    paths = flagged.groupBy(*taxa.values(), x.alias("_x"), y.alias("_y")).agg(
        F.count("*").alias("_all"),
        *[F.count_if(passes(fs)).alias(f"_n_{s}") for s, fs in strategies.items()],
        *[
            fn(F.when(passes(fs), F.col(cols.year))).alias(f"_{tag}_{s}")
            for s, fs in strategies.items()
            for tag, fn in (("lo", F.min), ("hi", F.max))
        ],
    )
    total = paths.agg(F.sum("_all")).scalar()
    per = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"), F.col(f"_n_{s}").alias("n"),
                F.col(f"_lo_{s}").alias("lo"), F.col(f"_hi_{s}").alias("hi"),
            )
            for s in strategies
        ]
    )
    rows = paths.select(
        *taxa.values(), F.struct("_x", "_y").alias("_cell"),
        F.inline(F.filter(per, lambda p: p["n"] > 0)),
    )
    return rows.groupBy("strategy").agg(
        F.sum("n").alias("records"),
        percent(F.sum("n"), total).alias("retention_pct"),
        *[distinct_count(c, True).alias(a) for a, c in taxa.items()],
        F.count_distinct("_cell").alias("cells"),
        F.min("lo").alias("first_year"),
        F.max("hi").alias("last_year"),
    )


def preset(flagged: DataFrame, name: str) -> DataFrame:
    """Rows an analysis preset or a strategy keeps."""
    return flagged.where(passes({**PRESETS, **STRATEGIES}[name]))


def preset_impact(flagged: DataFrame, name: str) -> DataFrame:
    """Rows before, removed by each flag on its own, and retained."""
    flags = {**PRESETS, **STRATEGIES}[name]
    counts = {"before": F.count("*")}
    counts |= {f: F.count_if(f) for f in flags}
    counts |= {"retained": F.count_if(passes(flags))}
    return long_counts(flagged, counts, "step", "records").select(
        F.lit(name).alias("preset"), "step", "records",
        percent(F.col("records"), F.col("total")).alias("percent"),
    )


def quality_check(
    df: DataFrame, cols: Columns = Columns(), as_of_year: int | None = None
) -> DataFrame:
    """Raw-table check with a score from 0 to 100.

    Records are grouped by the duplicate key first, so the distinct count and all
    other counts come from one shuffle.
    """
    day = parse_date(cols.event_date)
    y, u = F.col(cols.year), F.col(cols.uncertainty)
    keys = df.withColumn("event_day", day).groupBy(*duplicate_keys(cols)).agg(
        F.count("*").alias("n"),
        F.count_if((y < 1700) | (y > current_year(as_of_year))).alias("bad_year"),
        F.count_if(u > 10_000).alias("bad_m"),
    )

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    n = F.sum("n")
    out = keys.agg(
        n.alias("total_records"),
        rows(F.col(cols.lon).isNull() | F.col(cols.lat).isNull()).alias("missing_coords"),
        rows(~filled(F.col(cols.species))).alias("missing_species"),
        rows(F.col("event_day").isNull()).alias("missing_dates"),
        (n - F.count("*")).alias("duplicate_records"),
        F.sum("bad_year").alias("invalid_years"),
        F.sum("bad_m").alias("high_uncertainty"),
    )
    bad = sum(
        (F.col(c) for c in ("missing_species", "missing_dates", "duplicate_records")),
        F.col("missing_coords"),
    )
    return out.withColumn(
        "quality_score", 100 * (1 - F.try_divide(bad, F.col("total_records") * 4))
    )
