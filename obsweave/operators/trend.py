"""Kendall score of a series by counting inversions, whatever the length of one group's series.

A series that fits one task is merged there. A longer one is cut twice, into
blocks of positions and into slices of values: pairs within a slice and pairs of
different slices within a block are counted inside tasks, all other pairs from
the number of entries per block and slice. The work is n log n plus the square
of the number of blocks.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.plans.running import running_sums
from obsweave.plans.session import cut
from obsweave.plans.skew import attach

BLOCK = 1 << 16  # entries that one task orders at a time


def kendall_score(values: np.ndarray) -> int:
    """Rising minus falling pairs (i < j) of a sequence; equal values count neither way.

    Entries are parted by the bits of their rank from the top: in every part the
    ones before a zero are falling pairs and the zeros before a one rising ones.
    """
    a = np.unique(np.asarray(values, dtype=float), return_inverse=True)[1]
    total, at = 0, np.arange(len(a))
    for bit in reversed(range(int(a.max(initial=0)).bit_length())):
        one, head = (a >> bit) & 1, a >> (bit + 1)
        new = np.concatenate(([True], head[1:] != head[:-1]))
        first = np.maximum.accumulate(np.where(new, at, 0))
        before = np.cumsum(one) - one
        ones = before - before[first]
        total += int(((at - first - ones) * one).sum() - (ones * (1 - one)).sum())
        a = a[np.argsort(a >> bit, kind="stable")]
    return total


@F.pandas_udf(T.LongType())
def _score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in it:
        yield pd.Series([kendall_score(x) for x in series], dtype="int64")


def _same(left: DataFrame, right: DataFrame, by: list[str]):
    return functools.reduce(operator.and_, (left[c].eqNullSafe(right[f"_of_{c}"]) for c in by), F.lit(True))


def _named(df: DataFrame, by: list[str], *others: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_of_{c}") for c in by], *others)


def _in_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The score of each group of ``keys``, taken in one task each."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(*keys).agg(held.alias("s")).select(*keys, _score(F.col("s.v")).alias("score"))


def _long_scores(rows: DataFrame, hist: DataFrame, by: list[str], block: int) -> DataFrame:
    """Score parts (``by``, score) of groups longer than ``block``; several rows per group."""
    placed = running_sums(rows.withColumn("one", F.lit(1).cast("long")), ["o", "v"], {"pos": "one"}, by)
    below = running_sums(hist, ["v"], {"upto": "t"}, by)
    # a value of more than a block is the last one that starts in its stretch, and gets a slice of its own
    heavy = (F.col("t") > block).cast("long")
    below = below.withColumn("slice", 2 * F.floor((F.col("upto") - F.col("t")) / block) + heavy)
    total = hist.agg(F.sum("t")).scalar()
    known = attach(placed, below, [*by, "v"], ["slice"], weight="t", total=total, spread=["pos"])
    known = cut(known.withColumn("blk", F.floor((F.col("pos") - 1) / block)).select(*by, "pos", "v", "slice", "blk"), "series")
    within = _in_order(known.where("slice % 2 = 0"), [*by, "slice"], "pos", "v")
    beside = _in_order(known, [*by, "blk"], "pos", "slice")
    counts = known.groupBy(*by, "blk", "slice").agg(F.count("*").alias("c"))
    span = counts.groupBy(*by).agg(F.max("blk").alias("last"), F.array_sort(F.collect_set("slice")).alias("slices"))
    grid = span.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("blk"), "slices")
    grid = grid.select(*by, "blk", F.explode("slices").alias("slice"))
    named = _named(counts, by, F.col("blk").alias("_blk"), F.col("slice").alias("_slice"), "c")
    match = _same(grid, named, by) & (grid["blk"] == named["_blk"]) & (grid["slice"] == named["_slice"])
    cells = grid.join(named, match, "left").select(*by, "blk", "slice", F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    earlier = Window.partitionBy(*by, "slice").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*by, "blk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    cells = cells.withColumns({
        "less": F.coalesce(F.sum("before").over(lower), F.lit(0)),
        "all": F.sum("before").over(Window.partitionBy(*by, "blk")),
    })
    across = F.col("c") * (2 * F.col("less") + F.col("before") - F.col("all"))
    apart = cells.groupBy(*by).agg(F.sum(across).alias("score"))
    return within.select(*by, "score").unionByName(beside.select(*by, "score")).unionByName(apart)


def kendall(rows: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Per group: n, ``s_stat``, pairs tied in value (``t2``) and the sum t (t - 1) (2 t + 5) over ties (``t5``).

    ``rows`` holds ``by``, ``o`` (order) and ``v`` (double), none of the last two null. It is read
    several times. Entries of equal order are taken by value. Without ``by`` an empty series has n = 0.
    """
    hist = rows.groupBy(*by, "v").agg(F.count("*").alias("t"))
    t = F.col("t").cast("double")
    base = hist.groupBy(*by).agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(t * (t - 1) / 2), F.lit(0.0)).alias("t2"),
        F.coalesce(F.sum(t * (t - 1) * (2 * t + 5)), F.lit(0.0)).alias("t5"),
    )
    large = base.where(F.col("n") > block)
    if not large.limit(1).count():
        scores = _in_order(rows, by, "o", "v")
    else:
        named = _named(large, by)
        if by:
            long_rows, long_hist = (d.join(named, _same(d, named, by), "left_semi") for d in (rows, hist))
            short = rows.join(named, _same(rows, named, by), "left_anti")
            parts = _in_order(short, by, "o", "v").unionByName(_long_scores(long_rows, long_hist, by, block))
        else:
            parts = _long_scores(rows, hist, by, block)
        scores = parts.groupBy(*by).agg(F.sum("score").alias("score"))
    named = _named(scores, by, "score")
    out = base.join(named, _same(base, named, by), "left") if by else base.join(named)  # one row each
    return out.select(*by, "n", F.coalesce("score", F.lit(0)).cast("long").alias("s_stat"), "t2", "t5")
