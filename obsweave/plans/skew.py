"""Joins and size checks that hold when one key owns a large share of the rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.plans.session import cut

#: A key is hot when it holds more than this share of the rows, so at most
#: 1 / HOT_SHARE keys can be hot whatever the data look like.
HOT_SHARE = 1e-3

#: Rows up to which a caller-supplied reference table is broadcast.
BROADCAST_ROWS = 200_000


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of several keys in which NULL matches NULL (still an equi-join)."""
    return functools.reduce(
        operator.and_, (left[a].eqNullSafe(right[b]) for a, b in keys.items())
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``rows + 1`` rows of a reference table."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Broadcast hint for a side whose size was checked, else a shuffled join."""
    return F.broadcast(df) if small else df


def attach(
    rows: DataFrame,
    dim: DataFrame,
    keys: list[str],
    values: list[str],
    weight: str,
    total: Column,
    spread: list[str] | None = None,
) -> DataFrame:
    """Left join of ``dim`` (one row per key) to record-sized ``rows``.

    ``dim[weight]`` is the number of rows that have the key and ``total`` the
    number of all rows.  Keys above ``HOT_SHARE`` (at most 1000) are looked up
    in a broadcast table; their rows then carry a salt that spreads them evenly
    over the tasks of the shuffled join, which serves all other keys.  Without
    hot keys the broadcast table is empty and this is a plain join.
    """
    k = {c: f"_k_{c}" for c in keys}
    hot = dim.where(F.col(weight) > total * HOT_SHARE).select(
        *[F.col(c).alias(n) for c, n in k.items()],
        *[F.col(v).alias(f"_h_{v}") for v in values],
        F.lit(True).alias("_hot"),
    )
    marked = rows.join(F.broadcast(hot), null_safe(rows, hot, k), "left").drop(*k.values())
    marked = marked.withColumn(
        "_salt",
        F.when(
            F.col("_hot"), 1 + F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(1 << 20))
        ).otherwise(F.lit(0)),
    )
    cold = dim.where(F.col(weight) <= total * HOT_SHARE).select(
        *[F.col(c).alias(n) for c, n in k.items()],
        *[F.col(v).alias(f"_c_{v}") for v in values],
        # always 0, but not a literal: a constant would be folded out of the join key
        F.pmod(F.col(weight), F.lit(1)).cast("long").alias("_cold_salt"),
    )
    out = marked.join(
        cold, null_safe(marked, cold, k) & (marked["_salt"] == cold["_cold_salt"]), "left"
    )
    return out.select(
        *rows.columns,
        *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_c_{v}")).alias(v) for v in values],
    )


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], values: list[str], small: bool) -> DataFrame:
    """Left join of ``dim`` (one row per key) to ``rows``, adding ``values``.

    A side whose size was checked is broadcast. Otherwise the rows are counted per
    key first, so every key with a large share of them is split, NULL and keys
    that ``dim`` does not hold included.
    """
    if small or rows.isStreaming:
        named = dim.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *values)
        match = functools.reduce(operator.and_, (rows[c] == named[f"_k_{c}"] for c in keys))
        return rows.join(broadcast_if(small, named), match, "left").drop(*[f"_k_{c}" for c in keys])
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("_rows")), "key-counts")
    named = dim.select(*[F.col(c).alias(f"_d_{c}") for c in keys], *values)
    match = functools.reduce(operator.and_, (counts[c] == named[f"_d_{c}"] for c in keys))
    known = counts.join(named, match, "left").drop(*[f"_d_{c}" for c in keys])
    return attach(rows, known, keys, values, weight="_rows", total=counts.agg(F.sum("_rows")).scalar())


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in ``order``.

    The rank filter lets Spark cut every map task's groups down to one row before
    the shuffle, so a key with a third of all rows does not reach one task whole.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def distinct_counts(
    df: DataFrame,
    by: list[str],
    distinct: dict[str, str],
    count_null: bool,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Row count ``n_records`` plus one distinct count per column, by group.

    Combinations are counted first (partial aggregates, spread over all keys), so
    the distinct counts run over combinations and not over records.
    ``count_null`` counts NULL as one value.
    """
    sums = sums or {}
    cols = list(dict.fromkeys([*by, *distinct.values()]))
    combos = df.groupBy(*cols).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{a}") for a, c in sums.items()]
    )
    return combos.groupBy(*by).agg(
        F.sum("_n").alias("n_records"),
        *[F.sum(f"_s_{a}").alias(a) for a in sums],
        *[
            distinct_count(c, count_null).alias(a)
            for a, c in distinct.items()
        ],
    )


def distinct_count(c: str, count_null: bool) -> Column:
    out = F.count_distinct(F.col(c))
    if count_null:
        out = out + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))
    return out.cast("long")
