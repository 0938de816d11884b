"""Column expressions that name things: seasons, decades, periods, rarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations and the season each month belongs to.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}

# Rarity class and the largest record count it still covers.
RARITY = (
    ("Singleton (1 record)", 1),
    ("Doubleton (2 records)", 2),
    ("Very rare (3-5 records)", 5),
    ("Rare (6-10 records)", 10),
    ("Uncommon (11-50 records)", 50),
    ("Common (51-100 records)", 100),
    ("Very common (>100 records)", None),
)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))


def season(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), F.lit(name)).otherwise(out)
    return out


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def rarity_class(n: Column) -> Column:
    out = F.when(n <= RARITY[0][1], RARITY[0][0])
    for name, top in RARITY[1:-1]:
        out = out.when(n <= top, name)
    return out.otherwise(RARITY[-1][0])


def rarity_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r[0]) for r in RARITY]), name).cast("int")


def period_start(year: Column, last_break: Column, width: int = 10) -> Column:
    """Start of the bin ``[a, a + width)``; the last bin also holds its right end."""
    return F.least(
        (F.floor(year / width) * width).cast("int"), (last_break - width).cast("int")
    )


def period_label(start: Column, width: int = 10) -> Column:
    return F.concat(
        start.cast("string"), F.lit("-"), (start + (width - 1)).cast("string")
    )


def filled(c: Column) -> Column:
    """Present and not the empty string."""
    return c.isNotNull() & (c != "")


def completeness(observed: Column, expected: Column) -> Column:
    """Observed over expected, at most 1; NULL where nothing is expected."""
    return F.least(F.try_divide(observed, expected), F.lit(1.0))
