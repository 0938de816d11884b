"""Assessments per taxonomic rank, all from one unpivot of counted paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.columns import EARTH_RADIUS_M, Columns
from obsweave.plans.skew import distinct_count


def _by_rank(df: DataFrame, ranks: dict[str, str], keep: list[str]) -> DataFrame:
    """Long form (rank, value, keep...) of a table already counted by path."""
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rank"), F.col(c).alias("value")) for r, c in ranks.items()]
    )
    return df.select(F.inline(pairs), *keep).where("value is not null")


def metric_cell(lon, lat, cell_m: float = 10_000) -> tuple[Column, Column]:
    """Equal-size cell: rows of ``cell_m``, columns shrunk by the row's cosine."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    per_degree = math.pi * EARTH_RADIUS_M / 180 / cell_m
    row = F.floor(y * per_degree)
    mid = (row + 0.5) / per_degree
    return F.floor(x * per_degree * F.cos(F.radians(mid))).cast("long"), row.cast("long")


def assess_records(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records per identifier value and period, for seven ranks and the period itself."""
    ranks = cols.ranks
    base = df.where(F.col("period").isNotNull()).groupBy("period", *ranks.values()).agg(
        F.count("*").alias("n")
    )
    long = _by_rank(base.withColumn("_p", F.col("period")), {**ranks, "period": "_p"}, ["period", "n"])
    return long.groupBy("rank", "value", "period").agg(F.sum("n").alias("n_records"))


def assess_taxa_per_cell(df: DataFrame, cols: Columns = Columns(), cell_m: float = 10_000) -> DataFrame:
    """Distinct taxa per rank and metric cell, with log10(n + 1)."""
    x, y = metric_cell(cols.lon, cols.lat, cell_m)
    base = df.where(F.col(cols.lon).isNotNull() & F.col(cols.lat).isNotNull())
    base = base.select(x.alias("cell_x"), y.alias("cell_y"), *cols.ranks.values()).distinct()
    long = _by_rank(base, cols.ranks, ["cell_x", "cell_y"])
    return long.groupBy("rank", "cell_x", "cell_y").agg(
        F.count_distinct("value").alias("n_taxa")
    ).withColumn("log_taxa", F.log10(F.col("n_taxa") + 1))


def assess_coverage(df: DataFrame, cols: Columns = Columns(), min_coords: int = 5) -> DataFrame:
    """Share of taxa per rank with at least ``min_coords`` distinct coordinates."""
    base = df.where(F.col(cols.lon).isNotNull() & F.col(cols.lat).isNotNull())
    base = base.select(cols.lon, cols.lat, *cols.ranks.values()).distinct()
    taxa = _by_rank(base, cols.ranks, [cols.lon, cols.lat]).groupBy("rank", "value").agg(
        F.count_distinct(F.struct(cols.lon, cols.lat)).alias("n")
    )
    return _share(taxa, F.col("n") >= min_coords, "n_covered")


def assess_record_time(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records per year, for each value of each rank."""
    base = df.where(F.col(cols.year).isNotNull()).groupBy(cols.year, *cols.ranks.values()).agg(
        F.count("*").alias("n")
    )
    return _by_rank(base, cols.ranks, [cols.year, "n"]).groupBy("rank", "value", cols.year).agg(
        F.sum("n").alias("n_records")
    )


def assess_taxa_time(df: DataFrame, cols: Columns = Columns(), min_span: int = 5) -> DataFrame:
    """Share of taxa per rank whose records span at least ``min_span`` years."""
    y = cols.year
    base = df.where(F.col(y).isNotNull()).groupBy(*cols.ranks.values()).agg(
        F.min(y).alias("lo"), F.max(y).alias("hi")
    )
    taxa = _by_rank(base, cols.ranks, ["lo", "hi"]).groupBy("rank", "value").agg(
        (F.max("hi") - F.min("lo")).alias("span")
    )
    return _share(taxa, F.col("span") >= min_span, "n_long")


def assess_identity(
    df: DataFrame, cols: Columns = Columns(), singleton: int = 1, common: int = 100
) -> DataFrame:
    """Singletons, doubletons and common taxa per rank; rows without species are left out."""
    base = df.where(F.col(cols.species).isNotNull()).groupBy(*cols.ranks.values()).agg(
        F.count("*").alias("n")
    )
    taxa = _by_rank(base, cols.ranks, ["n"]).groupBy("rank", "value").agg(F.sum("n").alias("n"))
    return taxa.groupBy("rank").agg(
        F.count("*").alias("n_taxa"),
        F.count_if(F.col("n") <= singleton).alias("n_singletons"),
        F.count_if(F.col("n") == singleton + 1).alias("n_doubletons"),
        F.count_if(F.col("n") >= common).alias("n_common"),
    )


def _share(taxa: DataFrame, cond: Column, name: str) -> DataFrame:
    return taxa.groupBy("rank").agg(
        F.count("*").alias("n_taxa"),
        F.count_if(cond).alias(name),
        (F.count_if(cond) / F.count("*")).alias("share"),
    )


def assessment_matrix(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Which assessments each rank can support: names, places and years present."""
    located = F.col(cols.lon).isNotNull() & F.col(cols.lat).isNotNull()
    aggs = []
    for r, c in cols.ranks.items():
        named = F.col(c).isNotNull()
        aggs += [
            F.count_if(named).alias(f"{r}_n"),
            F.count_if(named & located).alias(f"{r}_s"),
            F.count_if(named & F.col(cols.year).isNotNull()).alias(f"{r}_t"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(r).alias("rank"), (F.col(f"{r}_n") > 0).alias("records"),
                (F.col(f"{r}_s") > 0).alias("spatial"), (F.col(f"{r}_t") > 0).alias("temporal"),
            )
            for r in cols.ranks
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def taxa_per_rank(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Distinct values per rank, NULL counted as one."""
    base = df.select(*cols.ranks.values()).distinct()
    one = base.agg(*[distinct_count(c, True).alias(f"_{r}") for r, c in cols.ranks.items()])
    rows = F.array(
        *[F.struct(F.lit(r).alias("rank"), F.col(f"_{r}").alias("n_taxa")) for r in cols.ranks]
    )
    return one.select(F.inline(rows))
