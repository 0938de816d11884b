"""Quality flags.  Every flag is TRUE for a problem and never NULL; no row is dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.columns import COORD_FLAGS, FLAGS, UNSUITABLE_BASIS, Columns
from obsweave.functions.geo import bucket_cover, bucket_degrees, bucket_key, haversine_m
from obsweave.functions.labels import filled
from obsweave.operators.outliers import outlier_locations
from obsweave.operators.polygons import add_inside
from obsweave.plans.session import cut
from obsweave.plans.skew import attach, is_small, lookup
from obsweave.sources.reference import References


@dataclass(frozen=True)
class FlagRules:
    """Thresholds of the flags; ``as_of_year`` None means the current year."""

    as_of_year: int | None = None
    min_year: int = 1950
    max_m: float = 10_000
    capital_m: float = 10_000
    centroid_m: float = 5_000
    hq_m: float = 1_000
    zero_deg: float = 0.5
    equal_mode: str = "absolute"
    outlier_mult: float = 5
    outlier_min_n: int = 10
    outlier_cell_deg: float | None = None  # bins of all species' places; None compares every place
    bad_basis: tuple[str, ...] = UNSUITABLE_BASIS
    strict_dates: bool = False


# ------------------------------------------------------- row-local flags


def current_year(as_of_year: int | None) -> Column:
    return F.lit(as_of_year) if as_of_year is not None else F.year(F.current_date())


def parse_date(event_date: str | Column, strict: bool = False) -> Column:
    """Date of an ISO text; a time part is ignored unless ``strict``."""
    c = F.col(event_date) if isinstance(event_date, str) else event_date
    text = c if strict else F.substring(c, 1, 10)
    return F.try_to_date(text, "yyyy-MM-dd")


def flag_missing_coords(cols: Columns = Columns()) -> Column:
    return F.col(cols.lon).isNull() | F.col(cols.lat).isNull()


def flag_high_uncertainty(cols: Columns = Columns(), max_m: float = 10_000) -> Column:
    return F.coalesce(F.col(cols.uncertainty) >= max_m, F.lit(False))


def flag_inappropriate_basis(
    cols: Columns = Columns(), values: tuple[str, ...] = UNSUITABLE_BASIS
) -> Column:
    return F.coalesce(F.col(cols.basis).isin(*values), F.lit(False))


def flag_missing_species(cols: Columns = Columns()) -> Column:
    return ~filled(F.col(cols.species))


def flag_invalid_date(
    year: Column, as_of_year: int | None = None, min_year: int = 1950
) -> Column:
    return ~F.coalesce(year.between(F.lit(min_year), current_year(as_of_year)), F.lit(False))


def flag_coord_equal(cols: Columns = Columns(), mode: str = "absolute") -> Column:
    x, y = F.col(cols.lon), F.col(cols.lat)
    same = (x == y) if mode == "identical" else (F.abs(x) == F.abs(y))
    return F.coalesce(same, F.lit(False))


def flag_coord_zeros(cols: Columns = Columns(), degrees: float = 0.5) -> Column:
    x, y = F.col(cols.lon), F.col(cols.lat)
    return F.coalesce(
        (x == 0) | (y == 0) | (F.sqrt(x * x + y * y) <= degrees), F.lit(False)
    )


def with_dates(df: DataFrame, cols: Columns = Columns(), strict: bool = False) -> DataFrame:
    """Adds ``event_day`` and sets year, month and day from it.

    The provider's own parts stay where the text has no date, unless ``strict``,
    which overwrites them with NULL.
    """
    day = parse_date(cols.event_date, strict)
    parts = {cols.year: F.year, cols.month: F.month, cols.day: F.dayofmonth}
    own = df.columns
    out = df.withColumn("event_day", day)
    return out.withColumns(
        {
            c: (
                F.coalesce(fn("event_day"), F.col(c))
                if not strict and c in own
                else fn("event_day")
            )
            for c, fn in parts.items()
        }
    )


# ---------------------------------------------------- place and polygon flags


def place_index(places: DataFrame, radius_m: dict[str, float]) -> tuple[DataFrame, float]:
    """Reference points keyed by the buckets from which they can be in reach.

    One row per bucket, so joining records to it never multiplies them.
    """
    degrees = max(0.5, bucket_degrees(max(radius_m.values())))
    reach = F.lit(None).cast("double")
    for kind, r in radius_m.items():
        reach = F.when(F.col("kind") == kind, F.lit(float(r))).otherwise(reach)
    return (
        places.withColumn("reach", reach)
        .where("reach is not null")
        .withColumn("b", F.explode(bucket_cover("lon", "lat", degrees)))
        .groupBy(F.col("b.band").alias("_pb"), F.col("b.slot").alias("_ps"))
        .agg(F.collect_list(F.struct("kind", "lon", "lat", "reach")).alias("_places")),
        degrees,
    )


def add_place_flags(
    df: DataFrame, places: DataFrame | None, cols: Columns, radius_m: dict[str, float],
    flag_names: dict[str, str],
) -> DataFrame:
    """All "within r of a reference point" flags from one lookup and one pass over its points."""
    if places is None:
        return df.withColumns({f: F.lit(False) for f in flag_names.values()})
    index, degrees = place_index(places, radius_m)
    band, slot = bucket_key(cols.lon, cols.lat, degrees)
    # nine buckets per place at most
    out = lookup(df.withColumns({"_pb": band, "_ps": slot}), index, ["_pb", "_ps"], ["_places"], is_small(places))
    x, y = F.col(cols.lon), F.col(cols.lat)
    near = F.filter("_places", lambda p: haversine_m(x, y, p["lon"], p["lat"]) <= p["reach"])
    out = out.withColumn("_near", F.transform(near, lambda p: p["kind"]))
    flags = {flag: F.coalesce(F.array_contains("_near", kind), F.lit(False)) for kind, flag in flag_names.items()}
    return out.withColumns(flags).drop("_pb", "_ps", "_places", "_near")


def add_inside_flag(
    df: DataFrame, rings: DataFrame | None, flag: str, cols: Columns = Columns()
) -> DataFrame:
    """TRUE inside any polygon; rings of one name are the parts and holes of one polygon."""
    if rings is None:
        return df.withColumn(flag, F.lit(False))
    return add_inside(df, rings, flag, cols.lon, cols.lat)


# ----------------------------------------------------------- key-level flags


def duplicate_keys(cols: Columns = Columns()) -> list[str]:
    return [cols.species, cols.lon, cols.lat, "event_day"]


def key_counts(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Rows per (species, place, day); NULL keys equal each other."""
    return df.groupBy(*duplicate_keys(cols)).agg(F.count("*").alias("duplicate_group_size"))


def add_key_flags(
    df: DataFrame, dated: DataFrame, cols: Columns, rules: FlagRules, outliers: bool = True
) -> DataFrame:
    """Duplicate and outlier flags through one skew-proof lookup.

    ``dated`` is the input before any flag: counting keys needs four columns of it.

    Both are known per (species, place, day).  Only keys that repeat or lie at an
    outlier location are looked up; every other row is unique by definition.
    """
    keys = duplicate_keys(cols)
    counts = cut(key_counts(dated, cols), "keys")
    dim = counts
    if outliers:
        places = [cols.species, cols.lon, cols.lat]
        locations = counts.groupBy(*places).agg(F.sum("duplicate_group_size").alias("n"))
        far = outlier_locations(
            locations, cols,
            mult=rules.outlier_mult, min_n=rules.outlier_min_n,
            cell_deg=rules.outlier_cell_deg,
        ).withColumn("flag_coord_outliers", F.lit(True))
        dim = dim.join(far, places, "left")
    else:
        dim = dim.withColumn("flag_coord_outliers", F.lit(False))
    dim = dim.where((F.col("duplicate_group_size") > 1) | F.col("flag_coord_outliers"))
    total = counts.agg(F.sum("duplicate_group_size")).scalar()
    out = attach(
        df, dim, keys, ["duplicate_group_size", "flag_coord_outliers"],
        weight="duplicate_group_size", total=total,
    )
    return out.withColumns(
        {
            "duplicate_group_size": F.coalesce("duplicate_group_size", F.lit(1)).cast("long"),
            "flag_coord_outliers": F.coalesce("flag_coord_outliers", F.lit(False)),
            "flag_duplicate": F.coalesce(F.col("duplicate_group_size") > 1, F.lit(False)),
        }
    )


def add_local_flags(df: DataFrame, cols: Columns, refs: References, rules: FlagRules) -> DataFrame:
    """Every flag that one row decides alone; also valid on a stream."""
    out = with_dates(df, cols, rules.strict_dates).withColumns(
        {
            "flag_missing_coords": flag_missing_coords(cols),
            "flag_high_uncertainty": flag_high_uncertainty(cols, rules.max_m),
            "flag_inappropriate_basis": flag_inappropriate_basis(cols, rules.bad_basis),
            "flag_missing_species": flag_missing_species(cols),
            "flag_invalid_date": flag_invalid_date(
                F.col(cols.year), rules.as_of_year, rules.min_year
            ),
            "flag_coord_equal": flag_coord_equal(cols, rules.equal_mode),
            "flag_coord_zeros": flag_coord_zeros(cols, rules.zero_deg),
        }
    )
    out = add_place_flags(
        out, refs.places, cols,
        {"capital": rules.capital_m, "centroid": rules.centroid_m, "hq": rules.hq_m},
        {
            "capital": "flag_coord_capitals",
            "centroid": "flag_coord_centroids",
            "hq": "flag_coord_hq",
        },
    )
    return add_inside_flag(out, refs.urban, "flag_coord_urban", cols)


def add_flags(
    df: DataFrame,
    cols: Columns = Columns(),
    refs: References | None = None,
    rules: FlagRules = FlagRules(),
    outliers: bool = True,
) -> DataFrame:
    """The input plus ``event_day``, 14 flags and ``duplicate_group_size``."""
    refs = refs or References()
    keep = [c for c in df.columns]
    out = add_local_flags(df, cols, refs, rules)
    out = add_key_flags(out, with_dates(df, cols, rules.strict_dates), cols, rules, outliers)
    any_issue = F.lit(False)
    for f in COORD_FLAGS:
        any_issue = any_issue | F.col(f)
    out = out.withColumn("flag_any_coord_issue", any_issue)
    return out.select(*keep, "event_day", "duplicate_group_size", *FLAGS)


def any_flag() -> Column:
    """Row carries at least one of the 14 flags."""
    out = F.lit(False)
    for f in FLAGS:
        out = out | F.col(f)
    return out


def passes(flags: tuple[str, ...]) -> Column:
    """None of the given flags is set."""
    out = F.lit(True)
    for f in flags:
        out = out & ~F.col(f)
    return out
