"""Column expressions for distances and bucket keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsweave.columns import EARTH_RADIUS_M, KM_PER_DEGREE


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    dlat = F.radians((lat2 - lat1) / 2)
    dlon = F.radians((lon2 - lon1) / 2)
    a = F.sin(dlat) * F.sin(dlat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def planar_km(lon1, lat1, lon2, lat2) -> Column:
    """Straight distance in degrees, taken as 111 km each."""
    dx, dy = lon2 - lon1, lat2 - lat1
    return F.sqrt(dx * dx + dy * dy) * F.lit(KM_PER_DEGREE)


def valid_coords(lon, lat) -> Column:
    """Both present, in range and not the null island (0, 0)."""
    lon, lat = _col(lon), _col(lat)
    return F.coalesce(
        lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0)),
        F.lit(False),
    )


def square_key(lon, lat, per_degree: int = 10) -> tuple[Column, Column]:
    """Square cell key as two longs (never a concatenated string)."""
    return (
        F.floor(_col(lon) * per_degree).cast("long"),
        F.floor(_col(lat) * per_degree).cast("long"),
    )


# ---------------------------------------------------------------- hexagons


def hex_key(lon, lat, size: float = 0.1) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon whose opposite edges are ``size`` apart.

    Hexagon centres form two interleaved rectangular lattices (even and odd rows);
    the nearer of the two candidates wins, so a point always has exactly one cell.
    """
    x, y = _col(lon) / size, _col(lat) / (size * 3**0.5 / 2)
    even_r, even_x = 2 * F.floor(y / 2 + 0.5), F.floor(x + 0.5)
    odd_r, odd_x = 2 * F.floor(y / 2) + 1, F.floor(x) + 0.5

    def far(cx: Column, cr: Column) -> Column:
        # squared distance in units of the size; a row step is sqrt(3) / 2 of it
        return (x - cx) * (x - cx) + (y - cr) * (y - cr) * 0.75

    even = far(even_x, even_r) <= far(odd_x, odd_r)
    q = F.when(even, even_x - even_r / 2).otherwise(odd_x - odd_r / 2)
    r = F.when(even, even_r).otherwise(odd_r)
    return F.floor(q + 0.5).cast("long"), r.cast("long")


def hex_centre(q, r, size: float = 0.1) -> tuple[Column, Column]:
    """Longitude and latitude of a hexagon's centre."""
    q, r = _col(q), _col(r)
    return (q + r / 2) * size, r * (size * 3**0.5 / 2)


# ------------------------------------------------- buckets for distance joins


def bucket_degrees(radius_m: float) -> float:
    """Smallest bucket height that a search of ``radius_m`` may use."""
    import math

    return max(math.degrees(radius_m / EARTH_RADIUS_M) * 1.0001, 1e-6)


def _slots(band: Column, degrees: float) -> Column:
    """Number of longitude slots in a latitude band.

    A slot is at least as wide as any pair within ``degrees`` of each other can
    be apart in longitude when both lie in the band or next to it.
    """
    top = F.least(
        F.lit(90.0),
        F.greatest(F.abs(band - 1) * degrees, F.abs(band + 2) * degrees),
    )
    import math

    ratio = F.lit(math.sin(math.radians(degrees / 2))) / F.greatest(
        F.cos(F.radians(top)), F.lit(1e-12)
    )
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio)))
    return F.when(ratio >= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor(F.lit(360.0) / width))
    ).cast("long")


def _slot(lon: Column, slots: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * slots).cast("long"), slots)


def bucket_key(lon, lat, degrees: float) -> tuple[Column, Column]:
    """The (band, slot) bucket a point lies in."""
    lon, lat = _col(lon), _col(lat)
    band = F.floor(lat / degrees).cast("long")
    return band, _slot(lon, _slots(band, degrees))


def bucket_cover(lon, lat, degrees: float) -> Column:
    """Array of the (band, slot) buckets that hold every point within ``degrees``."""
    lon, lat = _col(lon), _col(lat)
    band = F.floor(lat / degrees).cast("long")

    def around(step: Column) -> Column:
        other = band + step
        slots = _slots(other, degrees)
        return F.transform(
            F.sequence(F.lit(-1), F.lit(1)),
            lambda k: F.struct(
                other.alias("band"),
                F.pmod(_slot(lon, slots) + k, slots).alias("slot"),
            ),
        )

    return F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), around))
    )


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
