"""Small reference tables: places, cities, polygons, rasters, known totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE_SCHEMA = "kind string, name string, lon double, lat double"
RING_SCHEMA = "name string, ring array<struct<lon:double,lat:double>>"
KNOWN_SCHEMA = "`group` string, match_rank string, match_value string, total long"
RASTER_SCHEMA = "band string, row int, col int, value double"

# The provider's headquarters and the five cities of the distance covariate.
HEADQUARTERS = ("hq", "headquarters", 12.58, 55.67)
CITIES = (
    ("Nairobi", 36.8219, -1.2921),
    ("Mombasa", 39.6682, -4.0435),
    ("Kisumu", 34.7617, -0.1022),
    ("Nakuru", 36.0667, -0.3031),
    ("Eldoret", 35.2698, 0.5143),
)


@dataclass
class References:
    """What the coordinate tests compare against; ``None`` switches a test off."""

    places: DataFrame | None = None  # kind in {capital, centroid, hq}
    urban: DataFrame | None = None  # name, ring


@dataclass(frozen=True)
class RasterGrid:
    """Position of a tidy raster: top-left corner and pixel size in degrees."""

    xmin: float
    ymax: float
    pixel: float


def load_reference(spark: SparkSession, name: str, source) -> DataFrame:
    """A reference table from a Parquet path or from in-memory rows."""
    schema = {
        "places": PLACE_SCHEMA, "urban": RING_SCHEMA, "boundary": RING_SCHEMA,
        "cities": "city string, lon double, lat double",
        "known_totals": KNOWN_SCHEMA, "raster": RASTER_SCHEMA,
    }[name]
    if isinstance(source, str):
        return spark.read.schema(schema).parquet(source)
    return spark.createDataFrame(list(source), schema)


def cities(spark: SparkSession) -> DataFrame:
    return load_reference(spark, "cities", CITIES)


def ring_table(spark: SparkSession, rings: dict[str, list]) -> DataFrame:
    """Polygons by name: one ring of corner points each, or a list of rings (parts and holes)."""
    rows = [
        (k, [(float(x), float(y)) for x, y in ring])
        for k, v in rings.items()
        for ring in (v if isinstance(v[0][0], (list, tuple)) else [v])
    ]
    return spark.createDataFrame(rows, RING_SCHEMA)


def _points(corners: Column) -> Column:
    return F.transform(corners, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))


def rings_from_wkt(df: DataFrame, name: str = "name", wkt: str = "wkt") -> DataFrame:
    """(name, ring) rows of POLYGON and MULTIPOLYGON texts: a row per part and per hole.

    Further coordinates of a corner are left out; EMPTY and NULL give no rows.
    """
    ring = F.explode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("corners")
    numbers = F.transform(
        F.split("corners", ","),
        lambda c: F.transform(F.split(F.btrim(c), r"\s+"), lambda v: v.cast("double")),
    )
    return df.select(F.col(name).alias("name"), ring).select("name", _points(numbers).alias("ring"))


def rings_from_geojson(df: DataFrame, name: str = "name", geojson: str = "geojson") -> DataFrame:
    """(name, ring) rows of Polygon and MultiPolygon geometries, or of features that hold one."""
    bare = F.coalesce(F.get_json_object(geojson, "$.geometry"), F.col(geojson))
    shape = df.select(F.col(name).alias("name"), bare.alias("g")).select(
        "name", F.get_json_object("g", "$.type").alias("kind"), F.get_json_object("g", "$.coordinates").alias("c")
    )
    corners = "array<array<double>>"
    one = F.from_json("c", f"array<{corners}>")
    many = F.flatten(F.from_json("c", f"array<array<{corners}>>"))
    rings = F.when(F.col("kind") == "Polygon", one).when(F.col("kind") == "MultiPolygon", many)
    return shape.select("name", F.explode(rings).alias("corners")).select("name", _points(F.col("corners")).alias("ring"))


def raster_extent(raster: DataFrame) -> DataFrame:
    """Rows, columns and no-data pixels per band."""
    return raster.groupBy("band").agg(
        F.max("row").alias("max_row"),
        F.max("col").alias("max_col"),
        F.count_if(F.col("value").isNull()).alias("no_data"),
    )
