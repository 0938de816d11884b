"""Per-species spatial outliers by mean distance to the species' other records.

A species with few places is compared place by place. One with many first gets a
lower and an upper bound of every mean from some n^(1/3) groups, the buckets of a
quadtree that is split where weight times bucket area is large; only places that
these bounds leave on both sides of the limit, or of the quartiles the limit is made
of, are looked at again, with smaller buckets nested in the first ones and then
exactly. No place is left to an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.columns import EARTH_RADIUS_M, Columns
from obsweave.functions.labels import filled
from obsweave.plans.running import exact_quantiles, running_sums
from obsweave.plans.session import cut, small_batches
from obsweave.plans.skew import attach

_BLOCK = 512  # points or groups per block; a task compares two blocks at a time
_EXACT = 2048  # places up to which a species is compared place by place
_ROUNDS = ((1 / 3, 8), (2 / 3, 4))  # exponent and factor of the number of groups per round
_CHUNK = 4096  # neighbouring places whose buckets are made in one task
_LEVELS, _SPLITS = 32, 64  # levels of the quadtree, and halvings of the weight times area that a bucket may have
_MM = 0.001  # means are compared in mm


def _unit(lon, lat) -> np.ndarray:
    lam, phi = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])


def _arc(chord: np.ndarray) -> np.ndarray:
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, chord / 2))


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, :, None] - b[:, None, :]) ** 2).sum(axis=0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_sums(
    it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    """Weighted sum of distances from each point of block a to all points of block b."""
    for alon, alat, blon, blat, bw in it:
        out = []
        for x1, y1, x2, y2, w in zip(alon, alat, blon, blat, bw, strict=True):
            out.append(_arc(_chord(_unit(x1, y1), _unit(x2, y2))) @ np.asarray(w, dtype=float))
        yield pd.Series(out)


def group_bounds(points: np.ndarray, centres: np.ndarray, w, spread, radius) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the summed distances from unit vectors to groups of unit vectors.

    A group is its centre of mass, its weight, the weighted sum of squared chords to
    the centre, and a radius that holds it. Arc length is a convex function of the
    end point in space, so the centre gives the lower bound (Jensen). The linear
    term of the expansion around the centre vanishes, so half the largest second
    derivative over the radius times the spread bounds what is above it; close to
    the point or to its antipode the farthest arc is used instead.
    """
    s = _chord(points, centres)
    low = _arc(s) @ w
    near, far = s - radius, np.minimum(s + radius, 2.0)
    open_ = (near > 1e-9) & (far < 1.999)

    def bend(c):
        k = 1 - c * c / 4
        return np.maximum(1 / (c * np.sqrt(k)), c / 4 / k**1.5)

    safe_near, safe_far = np.where(open_, near, 1.0), np.where(open_, far, 1.0)
    curved = _arc(s) * w + 0.5 * EARTH_RADIUS_M * np.maximum(bend(safe_near), bend(safe_far)) * spread
    plain = _arc(far) * w
    return low, np.where(open_, np.minimum(curved, plain), plain).sum(axis=1)


def _arrays(names) -> T.StructType:
    return T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in names])


@F.pandas_udf(_arrays(("lo", "hi")))
def _block_bounds(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """``group_bounds`` for each point of a block against the groups of another, one array per field."""
    for lon, lat, *groups in it:
        lows, highs = [], []
        for x, y, *g in zip(lon, lat, *groups, strict=True):
            low, high = group_bounds(_unit(x, y), np.stack(g[:3]), *g[3:])
            lows.append(low)
            highs.append(high)
        yield pd.DataFrame({"lo": lows, "hi": highs})


def bucket_levels(code: np.ndarray, weight: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per limit (rows) and place (columns, in curve order) the level of its bucket.

    A bucket is the coarsest quadtree cell whose weight times area keeps the limit,
    or that holds one place.
    """
    out = np.full((len(most), len(code)), _LEVELS - 1)
    for level in reversed(range(_LEVELS)):
        prefix = code >> 2 * (_LEVELS - 1 - level)
        cell = np.concatenate(([0], np.cumsum(prefix[1:] != prefix[:-1])))
        heft = np.bincount(cell, weight)[cell] * 4.0**-level
        fits = (heft[None, :] <= most[:, None]) | (np.bincount(cell)[cell] == 1)[None, :]
        out[fits] = np.broadcast_to(level, out.shape)[fits]
    return out


def _starts(code: np.ndarray, level: np.ndarray) -> np.ndarray:
    """TRUE where a bucket starts, along the last axis."""
    prefix = code >> 2 * (_LEVELS - 1 - level)
    new = (prefix[..., 1:] != prefix[..., :-1]) | (level[..., 1:] != level[..., :-1])
    return np.concatenate((np.ones((*new.shape[:-1], 1), bool), new), axis=-1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bucket_counts(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Buckets of a chunk after 0, 1, 2... halvings of the limit."""
    for codes, weights, records in it:
        out = []
        for code, weight, n in zip(codes, weights, records, strict=True):
            order = np.argsort(code, kind="stable")
            code, weight = np.asarray(code)[order], np.asarray(weight, float)[order]
            level = bucket_levels(code, weight, float(n) * 2.0 ** -np.arange(_SPLITS))
            out.append(_starts(code, level).sum(axis=1))
        yield pd.Series(out)


_GROUP = ("cx", "cy", "cz", "w", "spread", "radius")


@F.pandas_udf(_arrays(_GROUP))
def _buckets(
    it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    """The buckets of a chunk as ``group_bounds`` reads them, one array per field."""
    for lons, lats, codes, weights, records, splits in it:
        out = []
        for lon, lat, code, weight, n, split in zip(lons, lats, codes, weights, records, splits, strict=True):
            order = np.argsort(code, kind="stable")
            code, w = np.asarray(code)[order], np.asarray(weight, float)[order]
            v = _unit(np.asarray(lon)[order], np.asarray(lat)[order])
            start = _starts(code, bucket_levels(code, w, np.array([float(n) * 2.0 ** -float(split)])))[0]
            first, group = np.flatnonzero(start), np.cumsum(start) - 1
            heft = np.add.reduceat(w, first)
            centre = np.add.reduceat(v * w, first, axis=1) / heft
            off = ((v - centre[:, group]) ** 2).sum(axis=0)
            # what is added covers rounding
            spread = np.add.reduceat(off * w, first) + heft * 1e-15
            radius = np.sqrt(np.maximum.reduceat(off, first)) + 1e-9
            out.append((*centre, heft, spread, radius))
        yield pd.DataFrame(out, columns=list(_GROUP))


def _spread_bits(v: Column) -> Column:
    """Every bit of a 31-bit number moved to its double place."""
    # Masks of the bit spreading steps.
    steps = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
    for step, mask in steps:
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _curve(lon: Column, lat: Column) -> Column:
    """Place along a curve that keeps neighbours together; its leading bits name quadtree cells."""
    top = F.lit((1 << (_LEVELS - 1)) - 1)
    x = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * top).cast("long")
    y = F.floor(F.least(F.greatest((lat + 90) / 180, F.lit(0.0)), F.lit(1.0)) * top).cast("long")
    return _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1))


def _in_blocks(points: DataFrame, sp: str, fields: list[str]) -> DataFrame:
    """Rows (sp, n_places, p): at most some 512 points of a species each, dealt by hash."""
    counts = points.groupBy(sp).agg(F.count("*").alias("held"))
    counts = counts.withColumn("blocks", F.ceil(F.col("held") / _BLOCK).cast("int"))
    total = counts.agg(F.sum("held")).scalar()
    out = attach(points, counts, [sp], ["blocks"], weight="held", total=total)
    block = F.pmod(F.xxhash64("px", "py"), F.col("blocks")).cast("int")
    return (
        out.groupBy(sp, block.alias("block"))
        .agg(F.first("n_places").alias("n_places"), F.collect_list(F.struct(*fields)).alias("p"))
    )


def _meet(blocks: DataFrame, others: DataFrame, sp: str, n_others: Column) -> DataFrame:
    """Each block next to every block ``q`` of its species; a pair of blocks is a join key of its own."""
    left = blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_others - 1)))
    right = others.select(F.col(sp).alias("_sp"), F.col("chunk").alias("_c"), "q")
    return left.join(right, (F.col(sp) == F.col("_sp")) & (F.col("_chunk") == F.col("_c")))


_POINT = ["px", "py", "w", "m", "n_records", "n_places", "rank"]


def _exact_bounds(points: DataFrame, every: DataFrame, sp: str) -> DataFrame:
    """``lo`` and ``hi`` both the mean distance of each of ``points`` to all records of its species."""
    chunk = F.floor((F.col("rank") - 1) / _BLOCK)
    others = every.groupBy(sp, chunk.alias("chunk")).agg(F.collect_list(F.struct("px", "py", "w")).alias("q"))
    met = _meet(_in_blocks(points, sp, _POINT), others, sp, F.ceil(F.col("n_places") / _BLOCK))
    sums = _block_sums("p.px", "p.py", "q.px", "q.py", F.col("q.w").cast("array<double>"))
    rows = met.select(sp, "p", sums.alias("d")).select(sp, F.explode(F.arrays_zip("p", "d")).alias("z"))
    firsts = [F.first(f"z.p.{c}").alias(c) for c in _POINT if c not in ("px", "py")]
    out = rows.groupBy(sp, F.col("z.p.px").alias("px"), F.col("z.p.py").alias("py")).agg(*firsts, F.sum("z.d").alias("d"))
    mean = F.round(F.col("d") / (F.col("n_records") - 1), 3)
    return out.select(sp, *_POINT, mean.alias("lo"), mean.alias("hi"), F.lit(True).alias("exact"))


def _chunks(every: DataFrame, sp: str) -> DataFrame:
    """Rows of at most ``_CHUNK`` neighbouring places and their bucket counts by number of halvings."""
    chunk = F.floor((F.col("rank") - 1) / _CHUNK)
    out = every.groupBy(sp, chunk.alias("chunk")).agg(
        F.first("n_records").alias("n_records"), F.first("n_places").alias("n_places"),
        F.collect_list(F.struct("px", "py", "code", "w")).alias("p"),
    )
    return cut(out.withColumn("counts", _bucket_counts("p.code", "p.w", "n_records")), "chunks")


def _plan(chunks: DataFrame, sp: str, exponent: float, factor: int) -> DataFrame:
    """Per species the fewest halvings that give enough buckets, and how many these are."""
    per = chunks.select(sp, "n_places", F.posexplode("counts").alias("split", "n"))
    per = per.groupBy(sp, "split").agg(F.first("n_places").alias("n_places"), F.sum("n").alias("groups"))
    enough = F.col("groups") >= factor * F.pow(F.col("n_places").cast("double"), F.lit(exponent))
    pick = F.min(F.when(enough | (F.col("split") == _SPLITS - 1), F.struct("split", "groups"))).alias("pick")
    return per.groupBy(F.col(sp).alias("_of")).agg(pick).select("_of", "pick.split", "pick.groups")


def _grouped_bounds(points: DataFrame, chunks: DataFrame, plan: DataFrame, sp: str) -> DataFrame:
    """Bounds of each of ``points`` from the buckets of its species."""
    named = chunks.join(plan, F.col(sp) == F.col("_of"))
    made = named.select(sp, "groups", _buckets("p.px", "p.py", "p.code", "p.w", "n_records", "split").alias("b"), "chunk")
    zipped = F.arrays_zip(*[F.col(f"b.{c}").alias(c) for c in _GROUP])
    made = made.select(sp, "groups", F.posexplode(zipped).alias("at", "g"), "chunk")
    blocks = F.ceil(F.col("groups") / _BLOCK)
    others = made.groupBy(sp, F.pmod(F.xxhash64("chunk", "at"), blocks).alias("chunk")).agg(F.collect_list("g").alias("q"))
    left = _in_blocks(points, sp, _POINT).join(plan, F.col(sp) == F.col("_of"))
    met = _meet(left, others, sp, blocks)
    rows = met.select(sp, "p", _block_bounds("p.px", "p.py", *[f"q.{c}" for c in _GROUP]).alias("b"))
    rows = rows.select(sp, F.explode(F.arrays_zip("p", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))).alias("z"))
    firsts = [F.first(f"z.p.{c}").alias(c) for c in _POINT if c not in ("px", "py")]
    out = rows.groupBy(sp, F.col("z.p.px").alias("px"), F.col("z.p.py").alias("py")).agg(
        *firsts, F.sum("z.lo").alias("lo"), F.sum("z.hi").alias("hi")
    )
    n = F.col("n_records") - 1
    return out.select(
        sp, *_POINT, (F.col("lo") / n * (1 - 1e-11) - _MM).alias("lo"), (F.col("hi") / n * (1 + 1e-11) + _MM).alias("hi"),
        F.lit(False).alias("exact"),
    )


def _limits(state: DataFrame, sp: str, mult: float) -> DataFrame:
    """Per species the interval of the limit and the zones its two quartiles can lie in."""
    probs = {"q1": 0.25, "q3": 0.75}
    low = exact_quantiles(state, "lo", probs, [sp], "w", ends=True)
    high = exact_quantiles(state, "hi", probs, [sp], "w", ends=True)
    low = low.select(F.col(sp).alias("_sp"), *[F.col(c).alias(f"l_{c}") for c in ("q1", "q3", "q1_below", "q3_below")])
    high = high.select(F.col(sp).alias("_hs"), *[F.col(c).alias(f"h_{c}") for c in ("q1", "q3", "q1_above", "q3_above")])
    both = low.join(high, F.col("_sp") == F.col("_hs"))
    return both.select(
        "_sp", "l_q1_below", "h_q1_above", "l_q3_below", "h_q3_above",
        (F.col("l_q3") + mult * (F.col("l_q3") - F.col("h_q1"))).alias("limit_lo"),
        (F.col("h_q3") + mult * (F.col("h_q3") - F.col("l_q1"))).alias("limit_hi"),
    )


def _far_of_many(points: DataFrame, sp: str, mult: float, pairs: list | None) -> DataFrame:
    """Outlier points (sp, px, py) of species with many places."""
    located = points.withColumns({"code": _curve(F.col("px"), F.col("py")), "one": F.lit(1).cast("long")})
    every = running_sums(located, ["code", "px", "py"], {"rank": "one"}, [sp]).select(sp, *_POINT, "code")
    every = cut(every, "ranked")
    chunks = _chunks(every, sp)
    plans = [cut(_plan(chunks, sp, e, f), "bucket-plan") for e, f in _ROUNDS]

    def note(chosen: DataFrame, plan: DataFrame | None) -> None:
        if pairs is not None:
            met = F.col("n_places") if plan is None else F.col("groups")
            held = chosen if plan is None else chosen.join(plan, F.col(sp) == F.col("_of"))
            pairs.append(held.agg(F.sum(met)).first()[0] or 0)

    steps = [(lambda p, plan=plan: _grouped_bounds(p, chunks, plan, sp), plan) for plan in plans]
    steps.append((lambda p: _exact_bounds(p, every, sp), None))
    note(every, plans[0])
    state = cut(steps[0][0](every), "bounds")
    for evaluate, plan in [*steps[1:], (None, None)]:
        known = state.join(cut(_limits(state, sp, mult), "limits"), F.col(sp) == F.col("_sp"))
        unsure = (F.col("lo") <= F.col("limit_hi")) & (F.col("hi") > F.col("limit_lo"))
        if evaluate is None:
            break
        zone = lambda a, b: (F.col("hi") >= F.col(a)) & (F.col("lo") <= F.col(b))
        again = unsure | zone("l_q1_below", "h_q1_above") | zone("l_q3_below", "h_q3_above")
        undecided = known.where(unsure).select(F.col(sp).alias("_open")).distinct()
        chosen = known.where(again & ~F.col("exact")).join(undecided, F.col(sp) == F.col("_open"), "left_semi")
        chosen = cut(chosen.select(sp, *_POINT), "unsure")
        if not chosen.limit(1).count():
            break
        note(chosen, plan)
        better = evaluate(chosen)
        rest = state.join(chosen, [sp, "px", "py"], "left_anti")
        state = cut(rest.unionByName(better), "bounds")
    # whoever is still on both sides is exact, and so is the limit
    return known.where((F.col("lo") > F.col("limit_hi")) | (F.col("exact") & (F.col("lo") > F.col("limit_lo")) & unsure)).select(
        F.col(sp).alias("_sp"), F.col("px").alias("_px"), F.col("py").alias("_py")
    )


def outlier_locations(
    locations: DataFrame,
    cols: Columns = Columns(),
    mult: float = 5,
    min_n: int = 10,
    cell_deg: float | None = None,
    exact_places: int = _EXACT,
    pairs: list | None = None,
) -> DataFrame:
    """Locations (species, lon, lat) whose mean distance exceeds q75 + mult * IQR.

    ``locations`` holds one row per (species, lon, lat) with its record count
    ``n``.  The result is that of comparing every place with every other; with
    ``cell_deg`` the places of all species are binned to cells of that size first.
    Species of more than ``exact_places`` places go by bounds.  Point pairs are
    never rows: blocks of 512 points meet inside a task and leave sums only, and
    each block of a species is its own join key; a task's Python holds some MB of
    pairs of blocks at a time, however many it meets.  Eager: the narrow intermediate
    tables are written to the shared folder.  ``pairs`` collects the distances
    evaluated in each round of the bounds.
    """
    sp, x, y = cols.species, cols.lon, cols.lat
    loc = locations.where(
        filled(F.col(sp)) & F.col(x).isNotNull() & F.col(y).isNotNull()
    ).select(sp, x, y, "n")
    with small_batches(locations.sparkSession):
        return _outliers_of(loc, cols, mult, min_n, cell_deg, exact_places, pairs)


def _outliers_of(
    loc: DataFrame, cols: Columns, mult: float, min_n: int, cell_deg: float | None, exact_places: int, pairs: list | None
) -> DataFrame:
    """``outlier_locations`` of located records of named species."""
    sp, x, y = cols.species, cols.lon, cols.lat
    loc = cut(loc, "locations")
    species = loc.groupBy(sp).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_locations"))
    total = species.agg(F.sum("n_locations")).scalar()
    species = species.where(F.col("n_records") >= min_n)
    loc = attach(
        loc, species, [sp], ["n_records", "n_locations"],
        weight="n_locations", total=total,
    ).where("n_records is not null")

    def snap(c):
        return F.col(c) if cell_deg is None else (F.floor(F.col(c) / cell_deg) + 0.5) * cell_deg

    loc = cut(loc.withColumns({"px": snap(x), "py": snap(y)}), "points")
    points = loc.groupBy(sp, "px", "py").agg(
        F.sum("n").alias("w"),
        F.count("*").alias("m"),
        F.first("n_records").alias("n_records"),
    )
    places = points.groupBy(sp).agg(F.count("*").alias("n_places"))
    points = attach(points, places, [sp], ["n_places"], weight="n_places", total=places.agg(F.sum("n_places")).scalar())
    points = cut(points, "places")

    few = points.where(F.col("n_places") <= exact_places)
    # ranks only cut a species into blocks here; it has few places
    hashed = F.xxhash64("px", "py")
    few = few.withColumn("rank", F.row_number().over(_by_hash(sp, hashed)))
    means = cut(_exact_bounds(few, few, sp), "means")
    limits = exact_quantiles(means, "lo", {"q1": 0.25, "q3": 0.75}, [sp], "w").withColumnRenamed(sp, "_sp")
    far = means.join(limits, means[sp] == limits["_sp"]).where(
        F.col("lo") > F.col("q3") + mult * (F.col("q3") - F.col("q1"))
    )
    far = far.select(
        F.col(sp).alias("_sp"), F.col("px").alias("_px"), F.col("py").alias("_py")
    )
    many = points.where(F.col("n_places") > exact_places)
    if many.limit(1).count():
        far = far.union(_far_of_many(many, sp, mult, pairs))
    far = cut(far, "far")
    # a flagged point holds less than a quarter of its species' records
    return loc.join(
        far, (loc[sp] == far["_sp"]) & (loc["px"] == far["_px"]) & (loc["py"] == far["_py"]),
        "left_semi",
    ).select(sp, x, y)


def _by_hash(sp: str, hashed: Column):
    from pyspark.sql import Window

    return Window.partitionBy(sp).orderBy(hashed, "px", "py")
