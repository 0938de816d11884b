"""Distance joins: neighbours within a radius, nearest neighbours, Moran's I."""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.columns import EARTH_RADIUS_M, KM_PER_DEGREE
from obsweave.functions.geo import (
    bucket_cover, bucket_degrees, bucket_key, haversine_m, planar_km,
)
from obsweave.functions.pvalues import add_p_values, normal_upper
from obsweave.plans.session import cut
from obsweave.plans.skew import lookup


def neighbours(cells: DataFrame, max_km: float = 15, key: str = "id", lon: str = "lon_c", lat: str = "lat_c") -> DataFrame:
    """Ordered pairs (a, b, km) of distinct cells at most ``max_km`` apart.

    One side is copied to the buckets around it and joined by equality, so the
    work per cell is the grid's own density and no cross join happens.
    """
    deg = bucket_degrees(max_km * 1000)
    band, slot = bucket_key(lon, lat, deg)
    one = cells.select(
        F.col(key).alias("b"), F.col(lon).alias("bx"), F.col(lat).alias("by"),
        band.alias("band"), slot.alias("slot"),
    )
    other = cells.select(
        F.col(key).alias("a"), F.col(lon).alias("ax"), F.col(lat).alias("ay"),
        F.explode(bucket_cover(lon, lat, deg)).alias("k"),
    ).select("a", "ax", "ay", "k.band", "k.slot")
    km = haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / 1000
    return (
        other.join(one, ["band", "slot"])
        .where(F.col("a") != F.col("b"))
        .select("a", "b", km.alias("km"))
        .where(F.col("km") <= max_km)
    )


# ------------------------------------------------------- nearest neighbours

#: Points of a leaf and children of an inner node, at most.
LEAF, FAN = 32, 16
#: Nodes of a level whose child lists are broadcast (some 10 MB); other levels are joined by shuffle.
SMALL_LEVEL = 10_000
#: Bits of each coordinate on the curve that puts points in order.
_BITS = 31


def _curve(x: Column, y: Column) -> Column:
    """Place on a Z-order curve. It only decides how compact the nodes are, not what is found."""

    def spread(share: Column) -> Column:
        v = F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * ((1 << _BITS) - 1)).cast("long")
        for shift, mask in (
            (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
            (2, 0x3333333333333333), (1, 0x5555555555555555),
        ):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread((x + 180) / 360).bitwiseOR(F.shiftleft(spread((y + 90) / 180), 1))


def _finite(*names: str) -> Column:
    """No NULL, NaN or infinity, whose differences from themselves are not 0."""
    return functools.reduce(operator.and_, ((F.col(c) - F.col(c)) == 0 for c in names))


def point_tree(points: DataFrame) -> list[DataFrame]:
    """Levels of a tree over points (rid, x, y), leaves first: node, n, its box and its ``below``.

    Points in the order of a curve are cut into leaves of ``LEAF``, leaves into nodes of ``FAN``
    children, and so on: however dense a place is, no node has more below it. The last
    level has at most ``FAN`` nodes.
    """
    spark = points.sparkSession
    points = points.withColumn("z", _curve(F.col("x"), F.col("y")))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = cut(
        points.repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y", "rid")
        .select("rid", "x", "y", F.spark_partition_id().alias("part"), row.alias("row")),
        "ordered-points",
    )
    sizes = ordered.groupBy("part").agg((F.max("row") + 1).alias("n")).orderBy("part").collect()  # a row per task
    before = list(itertools.accumulate((r["n"] for r in sizes), initial=0))
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part int, start long")
    box = [f(c).alias(n) for n, f, c in (("x0", F.min, "x0"), ("x1", F.max, "x1"), ("y0", F.min, "y0"), ("y1", F.max, "y1"))]
    node = F.floor((F.col("row") + F.col("start")) / LEAF)
    leaves = (
        ordered.join(F.broadcast(starts), "part")
        .withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
        .groupBy(node.alias("node"))
        .agg(F.count("*").alias("n"), *box, F.collect_list(F.struct("rid", "x", "y")).alias("below"))
    )
    levels, nodes = [cut(leaves, "leaves")], -(-before[-1] // LEAF)
    while nodes > FAN:
        child = F.struct("node", "n", "x0", "x1", "y0", "y1")
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.sum("n").alias("n"), *box, F.collect_list(child).alias("below"))
        levels.append(cut(up, "nodes"))
        nodes = -(-nodes // FAN)
    return levels


def knn(
    left: DataFrame,
    right: DataFrame,
    k: int = 1,
    metric: str = "haversine",
    left_key: str = "id",
    right_key: str = "id",
    lon: str = "lon",
    lat: str = "lat",
    exclude_same: bool = False,
    digits: int | None = 6,
) -> DataFrame:
    """The k nearest right points of each left point: (left id, right id, km, rank).

    Right points stand in a tree (``point_tree``) whose nodes have bounding boxes. Going
    down, the triangle inequality gives each node a least and a greatest distance; nodes
    that cannot hold one of the k nearest are dropped before their children are joined.
    Exact for any distribution: leaves are small wherever the points are, and of points at
    one place only as many are filed as an answer can hold. Distances are compared at
    ``digits`` places (None: as they are); ties follow the right id. Points without finite coordinates have no
    neighbours and are nobody's.
    """
    need = k + (1 if exclude_same else 0)

    def dist(x1, y1, x2, y2) -> Column:
        return haversine_m(x1, y1, x2, y2) / 1000 if metric == "haversine" else planar_km(x1, y1, x2, y2)

    per_degree = EARTH_RADIUS_M * 3.141592653589793 / 180 / 1000 if metric == "haversine" else KM_PER_DEGREE
    points = right.select(
        F.col(right_key).alias("rid"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")
    ).where(_finite("x", "y"))
    # the rank filter cuts a place's points down before the shuffle
    first = Window.partitionBy("x", "y").orderBy("rid")
    points = points.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= need).drop("_n")
    levels = point_tree(points)

    def prune(cand: DataFrame) -> DataFrame:
        """Keeps the nodes that may hold one of the nearest points of ``lid``."""
        cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        hx, hy = (F.col("x1") - F.col("x0")) / 2, (F.col("y1") - F.col("y0")) / 2
        reach = F.sqrt(hx * hx + hy * hy) * per_degree + 1e-5
        d = dist(F.col("lx"), F.col("ly"), cx, cy)
        cand = cand.withColumns({"near": d - reach, "far": d + reach})
        upto = Window.partitionBy("lid").orderBy("far").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        cand = cand.withColumn("held", F.sum("n").over(upto))
        limit = F.min(F.when(F.col("held") >= need, F.col("far"))).over(Window.partitionBy("lid"))
        return cand.withColumn("limit", limit).where(
            F.col("limit").isNull() | (F.col("near") <= F.col("limit"))
        ).select("lid", "lx", "ly", "node")

    def descend(cand: DataFrame, level: int) -> DataFrame:
        """What is below the nodes; a node that a large share of the left points asks for is split."""
        small = level >= first_small
        cand = cand if small else cut(cand, "candidates")
        found = lookup(cand, levels[level].select("node", "below"), ["node"], ["below"], small)
        return found.select("lid", "lx", "ly", F.explode("below").alias("b")).select("lid", "lx", "ly", "b.*")

    nodes = [levels[0].count()]
    for _ in levels[1:]:
        nodes.append(-(-nodes[-1] // FAN))
    first_small = next(i for i, n in enumerate([*nodes, 0]) if n <= SMALL_LEVEL)
    roots = levels[-1].agg(F.collect_list(F.struct("node", "n", "x0", "x1", "y0", "y1"))).scalar()  # at most FAN
    cand = left.select(
        F.col(left_key).alias("lid"), F.col(lon).cast("double").alias("lx"), F.col(lat).cast("double").alias("ly")
    ).where(_finite("lx", "ly"))
    cand = prune(cand.withColumn("root", F.explode(roots)).select("lid", "lx", "ly", "root.*"))
    for i in range(len(levels) - 1, 0, -1):
        cand = prune(descend(cand, i))
    met = descend(cand, 0)
    if exclude_same:
        met = met.where(F.col("lid") != F.col("rid"))
    km = dist(F.col("lx"), F.col("ly"), F.col("x"), F.col("y"))
    met = met.select("lid", "rid", (km if digits is None else F.round(km, digits)).alias("km"))
    if k == 1:
        best = met.groupBy("lid").agg(F.min(F.struct("km", "rid")).alias("m"))
        return best.select("lid", "m.rid", "m.km", F.lit(1).alias("rank"))
    w = Window.partitionBy("lid").orderBy("km", "rid")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_distance(left: DataFrame, right: DataFrame, metric: str = "planar", left_key: str = "id",
                     lon: str = "lon", lat: str = "lat", digits: int | None = 6) -> DataFrame:
    """Distance in km from each left point to the nearest right location."""
    spots = right.select(lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).distinct()
    spots = spots.withColumn("rid", F.struct(lon, lat))
    out = knn(left, spots, 1, metric, left_key, "rid", lon, lat, digits=digits)
    return out.select(F.col("lid").alias(left_key), F.col("km").alias("nearest_km"))


# ------------------------------------------------------------------ Moran


def morans_i(cells: DataFrame, pairs: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Global Moran's I with row-standardised weights and randomisation variance.

    ``pairs`` lists ordered neighbours (a, b) and need not be symmetric.  Cells
    without neighbours are left out.  The p-value is one-sided (greater).
    """
    x = cells.select(F.col(key).alias("i"), F.col(value).cast("double").alias("x")).where("x is not null")
    x = cut(x, "values")
    pairs = pairs.select("a", "b").join(x.select(F.col("i").alias("a")), "a", "left_semi")
    pairs = pairs.join(x.select(F.col("i").alias("b"), F.col("x").alias("xb")), "b")
    pairs = cut(pairs.select("a", "b", "xb"), "pairs")
    lag = pairs.groupBy("a").agg(F.count("*").alias("deg"), F.avg("xb").alias("lag"))
    used = cut(x.join(lag, x["i"] == lag["a"]).select("i", "x", "deg", "lag"), "lags")
    mean = used.agg(F.avg("x")).scalar()
    z = F.col("x") - mean
    base = used.agg(
        F.count("*").cast("double").alias("n"),
        F.sum(z * (F.col("lag") - mean)).alias("zwz"),
        F.sum(z * z).alias("z2"),
        F.sum(z * z * z * z).alias("z4"),
    )
    w = pairs.join(used.select(F.col("i").alias("a"), (1.0 / F.col("deg")).alias("w")), "a").select("a", "b", "w")
    both = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    s1 = both.groupBy("a", "b").agg(F.sum("w").alias("w")).agg((F.sum(F.col("w") * F.col("w")) / 2).alias("s1"))
    s2 = both.groupBy("a").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w")).alias("s2"))
    from obsweave.operators.tracking import one_row

    one = one_row(base, s1, s2)
    n, a, b = F.col("n"), F.col("s1"), F.col("s2")
    i = F.try_divide(F.col("zwz"), F.col("z2"))
    e = F.when(n > 1, -1.0 / (n - 1))
    k = F.try_divide(F.col("z4") / n, (F.col("z2") / n) * (F.col("z2") / n))
    n2 = n * n
    var = F.try_divide(
        n * ((n2 - 3 * n + 3) * a - n * b + 3 * n2) - k * ((n2 - n) * a - 2 * n * b + 6 * n2),
        (n - 1) * (n - 2) * (n - 3) * n2,
    ) - e * e
    out = one.select(
        n.cast("long").alias("n"), i.alias("moran_i"), e.alias("expected"),
        F.when((n > 3) & (var > 0), var).alias("variance"),
    )
    out = out.withColumn("z", (F.col("moran_i") - F.col("expected")) / F.sqrt("variance"))
    out = add_p_values(out, "p_value", normal_upper, ["z"])
    return out.withColumn(
        "pattern",
        F.when(F.col("z").isNull(), F.lit(None).cast("string"))
        .when(F.col("z") > 0, "Clustered").otherwise("Dispersed"),
    )
