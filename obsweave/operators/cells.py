"""Grids: cells over an area, record metrics per cell, effort summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.columns import Columns
from obsweave.functions.geo import hex_centre, hex_key, square_key
from obsweave.functions.labels import completeness
from obsweave.operators.polygons import keep_inside
from obsweave.operators.tracking import one_row
from obsweave.plans.running import exact_quantiles
from obsweave.plans.session import cut
from obsweave.plans.skew import distinct_count

Box = tuple[float, float, float, float]


def bounding_box(df: DataFrame, cols: Columns = Columns()) -> Box:
    """(lon min, lat min, lon max, lat max): four numbers on the driver."""
    r = df.agg(F.min(cols.lon), F.min(cols.lat), F.max(cols.lon), F.max(cols.lat)).first()
    return tuple(r)


def hex_cells(spark: SparkSession, box: Box, size: float = 0.1, ring=None) -> DataFrame:
    """All hexagons of the box plus one cell around it; ``ring`` (corner points or a ring table) clips by cell centre."""
    x0, y0, x1, y1 = box[0] - size, box[1] - size, box[2] + size, box[3] + size
    gap = size * 3**0.5 / 2
    rows = spark.range(int(-(-y0 // gap)), int(y1 // gap) + 1).withColumnRenamed("id", "cell_r")
    r = F.col("cell_r")
    q = F.sequence(
        F.ceil(F.lit(x0) / size - r / 2).cast("long"), F.floor(F.lit(x1) / size - r / 2).cast("long")
    )
    out = rows.select(F.explode(q).alias("cell_q"), "cell_r")
    lon, lat = hex_centre("cell_q", "cell_r", size)
    out = out.withColumns({"lon_c": lon, "lat_c": lat})
    return out if ring is None else keep_inside(out, ring, "lon_c", "lat_c")


def with_cell(df: DataFrame, cols: Columns = Columns(), kind: str = "hex", size: float = 0.1) -> DataFrame:
    """Adds the cell key (two longs) and drops rows without coordinates."""
    located = df.where(F.col(cols.lon).isNotNull() & F.col(cols.lat).isNotNull())
    if kind == "hex":
        a, b = hex_key(cols.lon, cols.lat, size)
        return located.withColumns({"cell_q": a, "cell_r": b})
    a, b = square_key(cols.lon, cols.lat, round(1 / size))
    return located.withColumns({"cell_x": a, "cell_y": b})


def cell_keys(kind: str) -> list[str]:
    return ["cell_q", "cell_r"] if kind == "hex" else ["cell_x", "cell_y"]


def cell_metrics(
    df: DataFrame, cols: Columns = Columns(), kind: str = "hex", size: float = 0.1,
    ranks: tuple[str, ...] = ("species", "family"),
) -> DataFrame:
    """Records with a species name and distinct taxa per occupied cell, NULL not counted.

    Taxa are counted per cell first, so a crowded cell reaches no task whole.
    """
    names = {"species": "n_species", "family": "n_families", "order": "n_orders", "class": "n_classes"}
    keys = cell_keys(kind)
    taxa = [cols.ranks[r] for r in ranks]
    combos = with_cell(df, cols, kind, size).groupBy(*keys, *taxa).agg(
        F.count(cols.species).alias("_n")
    )
    return combos.groupBy(*keys).agg(
        F.sum("_n").alias("n_records"),
        *[distinct_count(cols.ranks[r], False).alias(names[r]) for r in ranks],
    )


def zero_fill(cells: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of the grid; empty ones carry 0; adds log10(n + 1)."""
    counts = [c for c in metrics.columns if c.startswith("n_")]
    out = cells.join(metrics, keys, "left").fillna(0, subset=counts)
    return out.withColumn("log_records", F.log10(F.col("n_records") + 1))


def grid_metrics(
    df: DataFrame, cols: Columns = Columns(), size: float = 0.1, ring=None, box: Box | None = None
) -> DataFrame:
    """Zero-filled hexagon grid with records, species, families, orders and median uncertainty."""
    cells = hex_cells(df.sparkSession, box or bounding_box(df, cols), size, ring)
    keys = cell_keys("hex")
    metrics = cell_metrics(df, cols, "hex", size, ("species", "family", "order"))
    out = zero_fill(cells, metrics, keys)
    med = exact_quantiles(
        with_cell(df, cols, "hex", size), cols.uncertainty, {"median_uncertainty": 0.5}, keys
    )
    return out.join(med, keys, "left")


def effort_summary(grid: DataFrame) -> DataFrame:
    """Coverage and spread of effort, over all cells and over sampled cells."""
    n = F.col("n_records")
    scope = F.explode(
        F.when(n > 0, F.array(F.lit("all_cells"), F.lit("sampled_cells"))).otherwise(
            F.array(F.lit("all_cells"))
        )
    ).alias("scope")
    long = cut(grid.select(scope, "n_records", "n_species"), "effort")
    base = long.groupBy("scope").agg(
        F.count("*").alias("total_cells"),
        F.count_if(n > 0).alias("cells_with_data"),
        (F.count_if(n > 0) * 100.0 / F.count("*")).alias("percent_covered"),
        F.avg(n).alias("mean_records"),
        F.stddev_samp(n).alias("sd_records"),
        F.max(n).alias("max_records"),
        F.try_divide(F.stddev_samp(n), F.avg(n)).alias("cv_records"),
        F.avg("n_species").alias("mean_species"),
    )
    a = exact_quantiles(long, "n_records", {"median_records": 0.5}, ["scope"])
    b = exact_quantiles(long, "n_species", {"median_species": 0.5}, ["scope"])
    return base.join(a, "scope").join(b, "scope")


def cell_completeness(
    df: DataFrame, cols: Columns = Columns(), kind: str = "square", size: float = 0.1
) -> DataFrame:
    """Observed over expected (Chao1) species per cell, at most 1."""
    keys = cell_keys(kind)
    sp = with_cell(df, cols, kind, size).where(F.col(cols.species).isNotNull()).groupBy(
        *keys, cols.species
    ).agg(F.count("*").alias("x"))
    out = sp.groupBy(*keys).agg(
        F.sum("x").cast("double").alias("n"),
        F.count("*").alias("observed"),
        F.count_if(F.col("x") == 1).cast("double").alias("f1"),
        F.count_if(F.col("x") == 2).cast("double").alias("f2"),
    )
    return out.select(*keys, "observed", chao1().alias("expected")).withColumn(
        "completeness", completeness(F.col("observed").cast("double"), F.col("expected"))
    )


def chao1() -> Column:
    """Expected richness from the columns observed, n, f1 and f2."""
    n, f1, f2 = F.col("n"), F.col("f1"), F.col("f2")
    return F.col("observed") + (n - 1) / n * F.when(f2 > 0, f1 * f1 / (2 * f2)).otherwise(
        f1 * (f1 - 1) / 2
    )


# -------------------------------------------------------------- convex hull


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise convex hull (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(reversed(pts))


def convex_hull(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Hull of the located records as rows (pos, lon, lat).

    Per latitude only the two outermost longitudes can matter; partitions then
    reduce what is left to their own hulls, and only hull corners meet.
    """
    ends = df.where(F.col(cols.lon).isNotNull() & F.col(cols.lat).isNotNull()).groupBy(
        F.col(cols.lat).alias("lat")
    ).agg(F.min(cols.lon).alias("a"), F.max(cols.lon).alias("b"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, float]] = []
        for b in batches:
            held = _hull(held + list(zip(b.a, b.lat)) + list(zip(b.b, b.lat)))
        yield pd.DataFrame(held, columns=["lon", "lat"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_hull(list(zip(pdf.lon, pdf.lat))), columns=["lon", "lat"])
        out.insert(0, "pos", range(len(out)))
        return out

    corners = ends.mapInPandas(partial, "lon double, lat double")
    return corners.groupBy(F.lit(1).alias("g")).applyInPandas(merge, "pos long, lon double, lat double")


def hull_ring(df: DataFrame, cols: Columns = Columns()) -> list[tuple[float, float]]:
    """The hull as Python corner points, for use as a boundary."""
    return [(r["lon"], r["lat"]) for r in convex_hull(df, cols).orderBy("pos").collect()]
