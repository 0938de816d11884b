"""Covariates per cell and their scaling."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.columns import KM_PER_DEGREE
from obsweave.functions.geo import haversine_m
from obsweave.operators.environment import raster_lookup
from obsweave.operators.nearby import nearest_distance
from obsweave.plans.session import cut
from obsweave.sources.reference import RasterGrid

MAX_TOWNS = 1000  # cities that ride along as one array
BANDS = ("elevation", "temperature", "precipitation")
# The model's predictors; the last two are used unscaled.
SCALED = ("elevation", "temperature", "precipitation", "dist_to_city_km")
PREDICTORS = (
    "elevation_scaled", "temperature_scaled", "precipitation_scaled",
    "dist_to_city_scaled", "dist_from_equator", "dist_from_coast_km",
)


def scaled_name(c: str) -> str:
    return c.removesuffix("_km") + "_scaled"


def covariates(
    cells: DataFrame, raster: DataFrame, grid: RasterGrid, cities: DataFrame, coast_lon: float = 40.5,
    bands: tuple[str, ...] = BANDS, lon: str = "lon_c", lat: str = "lat_c",
) -> DataFrame:
    """Raster values and distances to city, equator and coast for each cell.

    A counted short city list rides along as one array, so cells are never multiplied;
    any other is searched by the tree of ``nearest_distance``. Both give the same, unrounded.
    """
    out = raster_lookup(cells, raster, grid, list(bands), lon, lat)
    if cities.count() <= MAX_TOWNS:
        towns = cities.agg(F.collect_list(F.struct("lon", "lat"))).scalar()
        km = F.array_min(
            F.transform("_towns", lambda t: haversine_m(F.col(lon), F.col(lat), t["lon"], t["lat"]) / 1000)
        )
        out = out.withColumn("_towns", towns).withColumn("dist_to_city_km", km).drop("_towns")
    else:
        spots = cells.select(F.col(lon).alias("lon"), F.col(lat).alias("lat")).dropna().distinct()
        spots = cut(spots.withColumn("id", F.struct("lon", "lat")), "spots")
        near = nearest_distance(spots, cities, "haversine", digits=None).select(
            F.col("id.lon").alias("_lon"), F.col("id.lat").alias("_lat"), F.col("nearest_km").alias("dist_to_city_km")
        )
        out = out.join(near, (out[lon] == near["_lon"]) & (out[lat] == near["_lat"]), "left").drop("_lon", "_lat")
    return out.withColumns(
        {
            "dist_from_equator": F.abs(lat),
            "dist_from_coast_km": F.abs(F.col(lon) - coast_lon) * KM_PER_DEGREE,
        }
    )


def zscore(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds ``*_scaled``: mean and sample sd over all rows, one aggregate."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    out = df.withColumn("_st", stats)
    return out.withColumns(
        {
            scaled_name(c): F.try_divide(F.col(c) - F.col(f"_st.m_{c}"), F.col(f"_st.s_{c}"))
            for c in columns
        }
    ).drop("_st")


def finite(columns: tuple[str, ...]) -> Column:
    """No NULL, NaN or infinity in any of the columns."""
    tests = []
    for c in columns:
        v = F.col(c).cast("double")
        tests.append(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return functools.reduce(operator.and_, tests)


def finite_only(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.where(finite(columns))


def range_report(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows kept and the range of each predictor."""
    one = df.agg(
        F.count("*").alias("n"),
        *[f(c).cast("double").alias(f"{t}_{c}") for c in columns for t, f in (("lo", F.min), ("hi", F.max))],
    )
    rows = [
        F.struct(F.lit(c).alias("variable"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"))
        for c in columns
    ]
    return one.select("n", F.inline(F.array(*rows)))


def design_matrix(
    cells: DataFrame, raster: DataFrame, grid: RasterGrid, cities: DataFrame, coast_lon: float = 40.5
) -> DataFrame:
    """Covariates, z-scores and presence; scaling sees all cells, then incomplete ones go."""
    out = zscore(covariates(cells, raster, grid, cities, coast_lon), SCALED)
    out = out.withColumn("presence", (F.col("n_records") > 0).cast("int"))
    return finite_only(out, (*BANDS, "dist_to_city_km", *PREDICTORS))
