"""Point in polygon by a slab index.

Edges are filed by the latitude bands they touch, and each polygon's edges of a band
by the longitude slots they reach over. A record meets only the edges of its own
band and slot and counts crossings to its east; an odd count is inside. All rings of
one name form one polygon, so parts, holes and islands in holes need nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.plans.session import cut
from obsweave.plans.skew import BROADCAST_ROWS, lookup
from obsweave.sources.reference import ring_table


@dataclass(frozen=True)
class SlabIndex:
    """``table`` holds (_band, _slot, _parts); ``small`` says that its edges were counted and may be broadcast."""

    table: DataFrame
    height: float
    width: float
    small: bool


def as_rings(spark: SparkSession, ring) -> DataFrame:
    """A (name, ring) table as it is, or one polygon from Python corner points."""
    return ring if isinstance(ring, DataFrame) else ring_table(spark, {"area": list(ring)})


def edges(rings: DataFrame) -> DataFrame:
    """(name, ax, ay, bx, by) of every edge that a parallel can cross; closes open rings."""
    following = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    pairs = rings.where(F.size("ring") > 2).select(
        "name", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e")
    )
    return pairs.select(
        "name", F.col("e.a.lon").alias("ax"), F.col("e.a.lat").alias("ay"), F.col("e.b.lon").alias("bx"), F.col("e.b.lat").alias("by")
    ).where("ax is not null and bx is not null and ay <> by")


def slab_index(rings: DataFrame) -> SlabIndex:
    """The index of a (name, ring) table.

    Bands are as high as the mean edge and slots as wide as the mean stretch of a
    polygon within a band (weighted by its edges), so the table holds at most about
    four entries per edge, whatever the shapes are. Eager: two small aggregates.
    """
    e = edges(rings)
    n, rise = e.agg(F.count("*"), F.sum(F.abs(F.col("by") - F.col("ay")))).first()
    height = max((rise or 1.0) / max(n, 1), 1e-9)
    band = F.sequence(F.floor(F.least("ay", "by") / height), F.floor(F.greatest("ay", "by") / height))
    pieces = (
        e.withColumn("_band", F.explode(band))
        .groupBy("name", "_band")
        .agg(F.min(F.least("ax", "bx")).alias("west"), F.max(F.greatest("ax", "bx")).alias("east"),
             F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    )
    if n > BROADCAST_ROWS:  # read again below
        pieces = cut(pieces, "slabs")
    size, spread = pieces.agg(F.sum(F.size("edges")), F.sum(F.size("edges") * (F.col("east") - F.col("west")))).first()
    width = max((spread or 1.0) / max(size or 1, 1), 1e-9)
    slot = F.sequence(F.floor(F.col("west") / width), F.floor(F.col("east") / width))
    table = (
        pieces.withColumn("_slot", F.explode(slot))
        .groupBy("_band", "_slot")
        .agg(F.collect_list(F.struct("name", "edges")).alias("_parts"))
    )
    small = n <= BROADCAST_ROWS
    if small:  # a few entries per edge, but the count decides
        filed = table.agg(F.sum(F.aggregate("_parts", F.lit(0), lambda acc, p: acc + F.size(p["edges"])))).first()[0]
        small = (filed or 0) <= 5 * BROADCAST_ROWS
    return SlabIndex(table if small else cut(table, "slab-index"), height, width, small)


def holding(lon: Column, lat: Column, parts: Column) -> Column:
    """Names of the polygons among ``parts`` that hold the point.

    An edge counts when exactly one of its ends lies above the point and the
    crossing lies to the east, so a point on a shared edge has one owner.
    """

    def crosses(e: Column) -> Column:
        return ((e["ay"] > lat) != (e["by"] > lat)) & (
            lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        )

    inside = F.filter(parts, lambda p: F.size(F.filter(p["edges"], crosses)) % 2 == 1)
    return F.transform(inside, lambda p: p["name"])


def with_polygons(df: DataFrame, rings: DataFrame | SlabIndex, out: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``out``, the names of the polygons a row lies in; without a place or a polygon it is empty."""
    index = rings if isinstance(rings, SlabIndex) else slab_index(rings)
    keyed = df.withColumns({
        "_band": F.floor(F.col(lat) / index.height), "_slot": F.floor(F.col(lon) / index.width)
    })
    met = lookup(keyed, index.table, ["_band", "_slot"], ["_parts"], index.small)
    names = F.coalesce(holding(F.col(lon), F.col(lat), F.col("_parts")), F.array().cast("array<string>"))
    return met.withColumn(out, names).drop("_band", "_slot", "_parts")


def add_inside(df: DataFrame, rings: DataFrame | SlabIndex, flag: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``flag``, TRUE inside any polygon and never NULL."""
    out = with_polygons(df, rings, "_names", lon, lat)
    return out.withColumn(flag, F.size("_names") > 0).drop("_names")


def keep_inside(df: DataFrame, ring, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside a polygon given as a table of rings or as corner points."""
    rings = as_rings(df.sparkSession, ring)
    return add_inside(df, rings, "_in", lon, lat).where("_in").drop("_in")
