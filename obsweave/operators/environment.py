"""Raster lookup and comparison of sampled with available environments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.functions.pvalues import add_p_values, kolmogorov_exact_p, kolmogorov_p
from obsweave.operators.polygons import add_inside, as_rings, edges, slab_index
from obsweave.plans.running import exact_quantiles, running_sums
from obsweave.plans.session import cut
from obsweave.sources.raster import read_tiles, window_of
from obsweave.sources.reference import RasterGrid


def with_pixel(points: DataFrame, grid: RasterGrid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds the raster row and column under each point."""
    return points.withColumns(
        {
            "row": F.floor((F.lit(grid.ymax) - F.col(lat)) / grid.pixel).cast("int"),
            "col": F.floor((F.col(lon) - grid.xmin) / grid.pixel).cast("int"),
        }
    )


def raster_lookup(
    points: DataFrame, raster: DataFrame, grid: RasterGrid, bands: list[str],
    lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """One column per band by name; outside or no-data is NULL.

    Meant for cell-sized points; for records, count them per pixel first, as
    ``sampled_environment`` does.
    """
    wide = raster.where(F.col("band").isin(*bands)).groupBy("row", "col").agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]
    )
    return with_pixel(points, grid, lon, lat).join(wide, ["row", "col"], "left").drop("row", "col")


def raster_files_lookup(
    points: DataFrame, path: str, bands: list[str], lon: str = "lon", lat: str = "lat", grid: RasterGrid | None = None,
) -> DataFrame:
    """``raster_lookup`` in a folder of raster tiles; tiles outside the box of the points are not read (eager: the box).

    Points beyond every tile get NULL.
    """
    window = window_of(points, lon, lat)
    raster, grid = read_tiles(points.sparkSession, path, bands if window else [], window, grid)
    return raster_lookup(points, raster, grid, bands, lon, lat)


def sampled_environment(
    records: DataFrame, raster: DataFrame, grid: RasterGrid, bands: list[str],
    lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """Band values under the records with the number ``n`` of records per pixel."""
    located = records.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    per = with_pixel(located, grid, lon, lat).groupBy("row", "col").agg(F.count("*").alias("n"))
    centre = per.select(
        (F.col("col") * grid.pixel + (grid.xmin + grid.pixel / 2)).alias("lon"),
        (F.lit(grid.ymax - grid.pixel / 2) - F.col("row") * grid.pixel).alias("lat"), "n",
    )
    return raster_lookup(centre, raster, grid, bands).select(*bands, "n")


def background_points(spark: SparkSession, ring, n: int = 10_000, seed: int = 123) -> DataFrame:
    """n points spread evenly over a polygon (corner points or a ring table): a low-discrepancy sequence kept inside it.

    The same points come out under any partitioning and in any engine.
    """
    rings = as_rings(spark, ring)
    corner = F.explode("ring").alias("p")
    x0, y0, x1, y1 = rings.select(corner).agg(F.min("p.lon"), F.min("p.lat"), F.max("p.lon"), F.max("p.lat")).first()
    w, h = x1 - x0, y1 - y0
    twice = edges(rings).agg(F.sum((F.col("bx") + F.col("ax")) * (F.col("by") - F.col("ay")))).first()[0]
    area = abs(twice or 0.0) / 2  # only the first guess of the tries depends on it
    tries = math.ceil(n * w * h / area * 1.05) + 200 if area else n
    index = slab_index(rings)
    # Steps of the plane-filling additive sequence.
    a1, a2 = 0.7548776662466927, 0.5698402909980532
    i = F.col("id") + seed
    while True:
        pts = spark.range(1, tries + 1).select(
            "id",
            (F.lit(x0) + F.pmod(0.5 + i * a1, F.lit(1.0)) * w).alias("lon"),
            (F.lit(y0) + F.pmod(0.5 + i * a2, F.lit(1.0)) * h).alias("lat"),
        )
        pts = add_inside(pts, index, "_in").where("_in").drop("_in")
        if pts.limit(n).count() == n:
            return pts.orderBy("id").limit(n)
        if tries > 1000 * (n + 200):
            raise ValueError("the ring holds too little of its bounding box to draw the points")
        tries *= 4


def env_comparison(sampled: DataFrame, available: DataFrame, drop_null: str = "elevation") -> DataFrame:
    """Both sides stacked with a ``type``; only a missing elevation drops a row."""
    one = sampled.withColumn("type", F.lit("Sampled"))
    two = available.withColumn("type", F.lit("Available"))
    return one.unionByName(two).where(F.col(drop_null).isNotNull())


def to_long(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    """Wide to long; NULL values are dropped."""
    return df.unpivot(ids, variables, "variable", "value").where(F.col("value").isNotNull())


@F.pandas_udf(T.DoubleType())
def _exact_ks(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact p of one variable per row."""
    rows = zip(d, a, b, strict=True)
    return pd.Series([kolmogorov_exact_p(x, [int(i) for i in y], [int(i) for i in z]) for x, y, z in rows], dtype="float64")


def ks_two_sample(
    long: DataFrame, value: str = "value", side: str = "type", by: str = "variable",
    first: str = "Sampled", weight: str | None = None, alpha: float = 0.05, exact_pairs: int = 0,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p per variable.

    The p-value is the asymptotic one; variables of at most ``exact_pairs`` pairs (n1 * n2, at most
    10,000) get the exact one, ties included.

    Counts per distinct value come first; the two distribution functions are
    running totals over values, cut into slices so that no task holds a variable.
    """
    n = F.col(weight) if weight else F.lit(1)
    hist = long.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(
        F.sum(F.when(F.col(side) == first, n).otherwise(0)).cast("long").alias("_a"),
        F.sum(F.when(F.col(side) == first, 0).otherwise(n)).cast("long").alias("_b"),
    )
    hist = cut(hist, "values")
    run = running_sums(hist, ["_v"], {"_ca": "_a", "_cb": "_b"}, [by], totals=True)
    gap = F.abs(F.try_divide("_ca", "_ca_all") - F.try_divide("_cb", "_cb_all"))
    out = run.groupBy(by).agg(F.max("_ca_all").alias("n1"), F.max("_cb_all").alias("n2"), F.max(gap).alias("d"))
    out = add_p_values(out, "p_value", kolmogorov_p, ["d", "n1", "n2"])
    if exact_pairs:
        few = run.where(F.col("_ca_all") * F.col("_cb_all") <= min(exact_pairs, 10_000))
        # at most 10,001 values per variable
        ties = few.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_v", "_a", "_b"))).alias("s"))
        exact = out.join(ties, by).select(by, _exact_ks("d", "s._a", "s._b").alias("exact"))
        out = out.join(exact, by, "left").withColumn("p_value", F.coalesce("exact", "p_value")).drop("exact")
    return out.withColumn("significant", F.col("p_value") < alpha)


def kde(
    long: DataFrame, value: str = "value", by: tuple[str, ...] = ("variable", "type"),
    n: int = 512, bins: int = 1024, weight: str | None = None,
) -> DataFrame:
    """Gaussian density at n points per group, bandwidth by the normal-reference rule.

    Values are counted in fine bins first; only bins meet the n points.
    """
    keys = list(by)
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    src = long.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(
        F.sum(w.cast("double")).alias("_w")
    )
    src = cut(src, "values")
    stats = src.groupBy(*keys).agg(
        F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_w").alias("total"),
        F.sum(F.col("_v") * F.col("_w")).alias("s1"),
    )
    q = exact_quantiles(src, "_v", {"q1": 0.25, "q3": 0.75}, keys, weight="_w")
    mean = stats.withColumn("mean", F.col("s1") / F.col("total")).join(q, keys)
    # one row per variable and side
    ss = src.join(F.broadcast(mean.select(*keys, "mean")), keys).groupBy(*keys).agg(
        F.sum(F.col("_w") * F.pow(F.col("_v") - F.col("mean"), 2)).alias("ss")
    )
    sd = F.sqrt(F.try_divide(F.col("ss"), F.col("total") - 1))
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    spread = F.when(iqr > 0, F.least(sd, iqr)).otherwise(F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    par = mean.join(ss, keys).select(
        *keys, "lo", "hi", "total", (0.9 * spread * F.pow("total", -0.2)).alias("bw")
    )
    par = par.withColumn("bw", F.coalesce("bw", F.lit(1.0)))
    step = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    binned = (
        src.join(F.broadcast(par), keys)
        .withColumn("_c", F.col("lo") + (F.least(F.floor((F.col("_v") - F.col("lo")) / step), F.lit(bins - 1)) + 0.5) * step)
        .groupBy(*keys, "_c", "lo", "hi", "total", "bw").agg(F.sum("_w").alias("_w"))
    )
    start, end = F.col("lo") - 3 * F.col("bw"), F.col("hi") + 3 * F.col("bw")
    grid = binned.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "x", start + (end - start) * F.col("i") / (n - 1)
    )
    u = (F.col("x") - F.col("_c")) / F.col("bw")
    kernel = F.exp(-0.5 * u * u) / (F.col("bw") * math.sqrt(2 * math.pi))
    return grid.groupBy(*keys, "x").agg(F.sum(F.col("_w") * kernel / F.col("total")).alias("density"))
