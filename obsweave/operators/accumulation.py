"""Species accumulation over sites and coverage-based rarefaction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.columns import Columns
from obsweave.functions.special import lgamma, ln_choose
from obsweave.plans.session import cut


def _site_key(seed: int, rep: int, keys: list[str], hash_name: str) -> Column:
    """Position of a site in one random order, the same under any partitioning."""
    if hash_name == "md5":  # 60 bits, also computable outside Spark
        text = F.concat_ws(":", F.lit(seed), F.lit(rep), *[F.col(k) for k in keys])
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.xxhash64(F.lit(seed), F.lit(rep), *keys)


def accumulation(
    incidence: DataFrame,
    sites: list[str],
    species: str,
    reps: int = 100,
    seed: int = 123,
    hash_name: str = "xxhash64",
) -> DataFrame:
    """Mean and sd of species found in the first k sites over random site orders.

    ``incidence`` holds distinct (site, species).  A site's place in order r is its
    hash with r, and a species first appears at the least hash among its sites: one
    aggregate with ``reps`` minima, not ``reps`` copies of the data.  Ranks are
    counted in 64 equal slices of the hash range, so no task sorts a whole order.
    """
    order = list(range(reps))
    key = {r: _site_key(seed, r, sites, hash_name) for r in order}
    bits, shift = ((1 << 60), 54) if hash_name == "md5" else ((1 << 63), 58)
    incidence = cut(incidence.select(*sites, species), "incidence")

    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(r).alias("rep"), F.col(f"_h{r}").alias("h")) for r in order]
        )
        return df.select(F.inline(pairs))

    firsts = incidence.groupBy(species).agg(*[F.min(key[r]).alias(f"_h{r}") for r in order])
    new = long(firsts).groupBy("rep", "h").agg(F.count("*").alias("new"))
    places = incidence.select(*sites).distinct()
    ranks = long(places.select(*[key[r].alias(f"_h{r}") for r in order]))
    both = ranks.select("rep", "h", F.lit(1).alias("site"), F.lit(0).cast("long").alias("new")).unionByName(
        new.select("rep", "h", F.lit(0).alias("site"), "new")
    ).groupBy("rep", "h").agg(F.sum("site").alias("site"), F.sum("new").alias("new"))
    both = both.withColumn("slice", F.shiftright(F.col("h"), shift))
    totals = both.groupBy("rep", "slice").agg(F.sum("site").alias("s"), F.sum("new").alias("n"))
    before = Window.partitionBy("rep").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(
        F.col("rep").alias("_rep"), F.col("slice").alias("_slice"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    inside = Window.partitionBy("rep", "slice").orderBy("h")
    run = both.select(
        "rep", "slice", F.sum("site").over(inside).alias("s"), F.sum("new").over(inside).alias("n")
    )
    curve = run.join(offset, (run["rep"] == offset["_rep"]) & (run["slice"] == offset["_slice"]))
    return curve.groupBy((F.col("s") + F.col("s0")).alias("sites")).agg(
        F.avg(F.col("n") + F.col("n0")).alias("richness"),
        F.stddev_samp(F.col("n") + F.col("n0")).alias("sd"),
    )


def accumulation_exact(incidence: DataFrame, sites: list[str], species: str, ks: list[int] | None = None) -> DataFrame:
    """Expected species among k random sites, for every k or the named ones."""
    incidence = cut(incidence.select(*sites, species), "incidence")
    n_sites = incidence.select(*sites).distinct().agg(F.count("*").cast("double")).scalar()
    hist = (
        incidence.groupBy(species).agg(F.count("*").alias("x"))
        .groupBy("x").agg(F.count("*").alias("f"))
        .withColumn("n", n_sites)
    )
    every = F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))
    at = every if ks is None else F.filter(F.array(*[F.lit(k).cast("long") for k in sorted(set(ks))]), lambda k: k <= F.col("n"))
    grid = hist.withColumn("sites", F.explode(at))
    x, n, k = F.col("x").cast("double"), F.col("n"), F.col("sites").cast("double")
    absent = F.when(
        k <= n - x, F.exp(ln_choose(n - x, k) - ln_choose(n, k))
    ).otherwise(0.0)
    return grid.groupBy("sites").agg(F.sum(F.col("f") * (1 - absent)).alias("richness"))


def accumulation_by_year(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Distinct species seen up to each year."""
    first = df.where(F.col(cols.year).isNotNull() & F.col(cols.species).isNotNull()).groupBy(
        cols.species
    ).agg(F.min(cols.year).alias(cols.year))
    new = first.groupBy(cols.year).agg(F.count("*").alias("new_species"))
    # one row per calendar year
    return new.withColumn("richness", F.sum("new_species").over(Window.orderBy(cols.year)))


# ------------------------------------------------------------- rarefaction


def _estimates(hist: DataFrame, keys: list[str], knots: Column | None) -> DataFrame:
    """Richness and coverage at sample sizes from (count x, species f) per key."""
    x, f = F.col("x").cast("double"), F.col("f").cast("double")
    stats = hist.groupBy(*keys).agg(
        F.sum(x * f).alias("n"), F.sum(f).alias("s_obs"), F.max(x).alias("x_max"),
        F.coalesce(F.sum(F.when(F.col("x") == 1, f)), F.lit(0.0)).alias("f1"),
        F.coalesce(F.sum(F.when(F.col("x") == 2, f)), F.lit(0.0)).alias("f2"),
    )
    n, f1, f2 = F.col("n"), F.col("f1"), F.col("f2")
    f0 = (n - 1) / n * F.when(f2 > 0, f1 * f1 / (2 * f2)).otherwise(f1 * (f1 - 1) / 2)
    num = (n - 1) * F.when(f2 > 0, f1).otherwise(F.greatest(f1 - 1, F.lit(0.0)))
    a = F.coalesce(F.try_divide(num, num + F.when(f2 > 0, 2 * f2).otherwise(2.0)), F.lit(0.0))
    stats = stats.withColumns({"f0": f0, "a": a})
    stats = stats.withColumn("m", F.explode(knots))
    right = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "s_obs", "f1", "f0", "a", "m")
    # knots times replicates: a few thousand rows
    right = F.broadcast(right)
    cond = F.lit(True)
    for k in keys:
        cond = cond & (hist[k] == right[f"_{k}"])
    j = hist.join(right, cond)
    m = F.col("m")
    inner = m < n
    absent = F.when(
        inner & (m <= n - x),
        F.exp(lgamma(n - x + 1) - lgamma(n - x - m + 1) - lgamma(n + 1) + lgamma(n - m + 1)),
    ).otherwise(0.0)
    # coverage deficit of a sample of m < n
    unseen = F.when(
        inner & (m <= n - x),
        x / n * F.exp(lgamma(n - x + 1) - lgamma(n - x - m + 1) - lgamma(n) + lgamma(n - m)),
    ).otherwise(0.0)
    g = j.groupBy(*keys, "m").agg(
        F.sum(f * (1 - absent)).alias("s_in"), F.sum(f * unseen).alias("c_in"),
        *[F.first(c).alias(c) for c in ("n", "s_obs", "f1", "f0", "a")],
    )
    extra = m - n
    grown = F.col("s_obs") + F.when(
        F.col("f0") > 0,
        F.col("f0") * (1 - F.pow(1 - F.col("f1") / (n * F.col("f0") + F.col("f1")), extra)),
    ).otherwise(0.0)
    return g.select(
        *keys, F.col("m").cast("long").alias("m"),
        F.when(m < n, "rarefaction").when(m == n, "observed").otherwise("extrapolation").alias("method"),
        F.when(m < n, F.col("s_in")).otherwise(grown).alias("richness"),
        F.when(m < n, 1 - F.col("c_in"))
        .otherwise(1 - F.col("f1") / n * F.pow(F.col("a"), extra + 1)).alias("coverage"),
        F.col("s_obs").cast("long").alias("s_obs"),
        (F.col("s_obs") + F.col("f0")).alias("chao1"),
    )


def _knots(n: Column, end: Column, knots: int) -> Column:
    """Whole sample sizes from 1 to the endpoint, with n itself when it lies inside."""

    def seq(lo: Column, hi: Column, k: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.floor(lo + (hi - lo) * i / (k - 1)).cast("double"),
        )

    half = knots // 2
    split = F.concat(seq(F.lit(1.0), n - 1, half - 1), F.array(n), seq(n + 1, end, half))
    out = F.when(end <= n, seq(F.lit(1.0), end, knots)).otherwise(split)
    return F.array_distinct(F.filter(out, lambda v: v >= 1))


#: Species per leaf of the splitting tree, and leaves per node above.
_LEAF, _FAN = 4096, 256


def _split(key: tuple[int, ...], n: int, weights: np.ndarray) -> np.ndarray:
    """``n`` individuals dealt by weight, the same for the same key wherever it runs."""
    total = weights.sum()
    if not total:
        return np.zeros(len(weights), np.int64)
    return np.random.default_rng([k & (1 << 63) - 1 for k in key]).multinomial(n, weights / total)


def multinomial_draws(weights: DataFrame, key: str, weight: str, n: int, reps: int, seed: int = 123) -> DataFrame:
    """(rep, key, x): ``reps`` samples of exactly ``n`` individuals, dealt to keys by weight; zeros are left out.

    The individuals are split down a tree: over ranges of keys, then over the leaves of a
    range, then within a leaf, each by the sums of weights below it. A split sees one
    node's children only, so no task holds all keys and every total is exact. Rows of equal
    keys are dealt to one by one; weights that are NULL, negative or 0 draw nothing. Without
    any weight there are no rows.
    """
    own = weights.where(F.col(weight) > 0).select(F.col(key).alias("_key"), F.col(weight).cast("double").alias("_w"))
    count = own.count()
    leaves = max(1, -(-count // (_LEAF // 2)))  # half full on average, hashes vary
    nodes = max(1, -(-leaves // _FAN))
    if nodes > 100_000:
        raise ValueError("more keys than three levels hold")
    leaf = F.pmod(F.xxhash64("_key"), F.lit(leaves)).cast("long")
    own = cut(own.withColumn("_leaf", leaf), "weights")
    sums = own.groupBy("_leaf").agg(F.sum("_w").alias("_w")).withColumn("_node", F.col("_leaf") % nodes)
    # sums of doubles vary with the order of addition in their last digits only; the written ones are used throughout
    sums = cut(sums, "leaf-weights")
    top = sums.groupBy("_node").agg(F.sum("_w").alias("_w")).orderBy("_node").collect()  # a row per node
    share = np.array([r["_w"] for r in top])
    dealt = [(rep, r["_node"], int(x)) for rep in range(1, reps + 1)
             for r, x in zip(top, _split((seed, rep), n, share)) if x]
    spark = weights.sparkSession
    down = spark.createDataFrame(dealt, "rep int, _node long, n long")

    def children(name: str, step: int, out: str):
        def run(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """Replicates of a node (left) dealt to its children (right)."""
            right = right.sort_values([name, "_w"])
            w, names = right["_w"].to_numpy(), right[name].to_numpy()
            made = []
            for rep, total in zip(left["rep"], left["n"], strict=True):
                x = _split((seed, int(rep), step, int(group[0])), int(total), w)
                on = np.flatnonzero(x)
                made.append(pd.DataFrame({"rep": np.int32(rep), out: names[on], "n": x[on]}))
            return pd.concat(made) if made else pd.DataFrame({"rep": [], out: [], "n": []})

        return run

    kind = own.schema["_key"].dataType.simpleString()
    by_leaf = down.groupBy("_node").cogroup(sums.groupBy("_node")).applyInPandas(
        children("_leaf", 1, "_leaf"), "rep int, _leaf long, n long")
    by_key = by_leaf.groupBy("_leaf").cogroup(own.select("_leaf", "_key", "_w").groupBy("_leaf")).applyInPandas(
        children("_key", 2, "_key"), f"rep int, _key {kind}, n long")
    return by_key.select("rep", F.col("_key").alias(key), F.col("n").alias("x"))


def rarefaction(
    counts: DataFrame,
    species: str,
    value: str = "n_records",
    top_n: int | None = None,
    knots: int = 40,
    boots: int = 0,
    endpoint: float | None = None,
    seed: int = 123,
) -> DataFrame:
    """Rarefied and extrapolated richness (q = 0) with sample coverage.

    All species take part unless ``top_n`` names a number of the commonest.
    The endpoint is twice the greatest count.  With ``boots`` the species counts
    are redrawn per replicate from the estimated community, unseen species included:
    exactly n individuals each time. Limits are normal ones from the replicates' sd.
    """
    if top_n is not None:
        counts = counts.orderBy(F.desc(value), F.asc_nulls_last(species)).limit(top_n)
    counts = cut(counts.select(F.col(species), F.col(value).cast("long").alias("x")), "counts")
    hist = counts.groupBy("x").agg(F.count("*").alias("f"))
    end = F.lit(float(endpoint)) if endpoint else F.col("x_max") * 2
    base = _estimates(hist.withColumn("rep", F.lit(0)), ["rep"], _knots(F.col("n"), end, knots))
    base = base.drop("rep")
    if not boots:
        return base
    base = cut(base, "rarefied")
    grid = base.agg(F.array_sort(F.collect_list(F.col("m").cast("double")))).scalar()
    n = counts.agg(F.sum("x").cast("double")).scalar()
    seen = base.where("method = 'observed'").agg(F.max("coverage")).scalar()
    deficit = 1 - F.coalesce(seen, F.lit(1.0))
    # detected species: shrink so that the unseen mass is left over, which the unseen species share
    miss = F.pow(1 - F.col("x") / n, n)
    lam = counts.agg(F.sum(F.col("x") / n * F.pow(1 - F.col("x") / n, n))).scalar()
    mean = F.col("x") * (1 - F.coalesce(F.try_divide(deficit, lam), F.lit(0.0)) * miss)
    own = counts.select(F.xxhash64(species).alias("who"), mean.alias("w"))
    size = counts.agg(F.sum("x")).first()[0] or 0
    lost, hidden = base.agg(
        1 - F.max(F.when(F.col("method") == "observed", F.col("coverage"))), F.max(F.col("chao1") - F.col("s_obs"))).first()
    hidden = math.ceil(hidden or 0)
    unseen = counts.sparkSession.range(hidden).select(
        F.xxhash64(F.lit("unseen"), "id").alias("who"), F.lit((lost or 0.0) * size / max(hidden, 1)).alias("w"))
    drawn = multinomial_draws(own.union(unseen), "who", "w", size, boots, seed)
    boot = drawn.groupBy("rep", "x").agg(F.count("*").alias("f"))
    sims = _estimates(boot, ["rep"], grid)
    sd = sims.groupBy(F.col("m").alias("_m")).agg(
        F.stddev_samp("richness").alias("se"), F.stddev_samp("coverage").alias("se_coverage")
    )
    out = base.join(sd, base["m"] == sd["_m"], "left").drop("_m")
    return out.withColumns(
        {
            "lower": F.col("richness") - 1.959964 * F.col("se"),
            "upper": F.col("richness") + 1.959964 * F.col("se"),
        }
    )


def _log_falling(a: Column, k: Column) -> Column:
    """Log of (a - 1)(a - 2) ... (a - k) for any k < a; differences of two large log-gammas would lose its digits."""
    rest = a - k
    series = (1 / a - 1 / rest) / 12 - (1 / (a * a * a) - 1 / (rest * rest * rest)) / 360
    far = k * F.ln(a) - k - (rest - 0.5) * F.log1p(-k / a) + series
    return F.when(rest >= 32, far).otherwise(lgamma(a) - lgamma(rest))


def _log_ratio(top: Column, base: Column, x: Column, m: Column) -> Column:
    """Log of (top - 1) ... (top - x) over (base - 1) ... (base - x) with top = base - m, by the shorter of two ways."""
    by_x = _log_falling(top, x) - _log_falling(base, x)
    by_m = _log_falling(base - x, m) - _log_falling(base, m)
    return F.when(x <= m, by_x).otherwise(by_m)


def _unseen_share(n: float) -> Column:
    """Expected share of individuals of species of ``x`` records that a sample of real size ``m`` misses."""
    x, m, size = F.col("x").cast("double"), F.col("m"), F.lit(n)
    return F.when(m < size - x + 1, x / size * F.exp(_log_ratio(size - m, size, x - 1, m))).otherwise(0.0)


def _absent(n: float) -> Column:
    """Chance that a species of ``x`` records is not in a sample of real size ``m``."""
    x, m, size = F.col("x").cast("double"), F.col("m"), F.lit(n)
    return F.when(m < size - x + 1, F.exp(_log_ratio(size - m + 1, size + 1, x, m))).otherwise(0.0)


def _at_sizes(hist: DataFrame, what: Column, sizes: list[float]) -> dict[float, float]:
    """Sums of ``what`` over the histogram for a few hundred sample sizes, in one pass."""
    every = hist.withColumn("m", F.explode(F.lit(sizes)))
    return dict(every.groupBy("m").agg(F.sum(F.col("f") * what)).collect())


def richness_at_coverage(
    counts: DataFrame, species: str, targets: Sequence[float], value: str = "n_records", tolerance: float = 1e-10,
) -> DataFrame:
    """Sample size ``m`` (real) at which the expected coverage reaches each target, and the richness there.

    Below the reference sample the coverage rises with m and is inverted by sections: each
    pass evaluates 32 sizes per target over the histogram of counts, until a section's
    coverages differ by ``tolerance`` at most. Between n - 1 and n both curves are straight
    lines to the estimates at n, beyond it the extrapolation has a closed inverse. Targets
    that no sample reaches have NULL. Rows without a positive count do not take part; no
    counts, no rows. Repeated targets give one row.
    """
    targets = sorted({float(t) for t in targets})
    if not targets or targets[0] <= 0 or targets[-1] > 1:
        raise ValueError("targets lie above 0 and at most at 1")
    x = F.col(value).cast("long")
    hist = cut(counts.where(x > 0).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("f")), "histogram")
    f_of = lambda k: F.coalesce(F.sum(F.when(F.col("x") == k, F.col("f"))), F.lit(0))
    n, s_obs, f1, f2 = hist.agg(F.sum(F.col("x") * F.col("f")), F.sum("f"), f_of(1), f_of(2)).first()
    out = "target double, m double, method string, coverage double, richness double"
    if not n:
        return counts.sparkSession.createDataFrame([], out)
    n = float(n)
    f0 = (n - 1) / n * (f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2)
    missed = (n - 1) * (f1 if f2 else max(f1 - 1, 0))
    a = missed / (missed + (2 * f2 if f2 else 2)) if missed else 0.0
    last, full = 1 - f1 / n, 1 - f1 / n * a
    inner = [t for t in targets if t <= last]
    # (low, coverage there, high, coverage there) per target
    box = {t: (0.0, 0.0, n - 1, last) for t in inner}
    points = 32
    while True:
        wide = [t for t, (lo, c_lo, hi, c_hi) in box.items()
                if c_hi - c_lo > tolerance and lo < lo + (hi - lo) / (points + 1) < hi]
        if not wide:
            break
        sizes = {t: [box[t][0] + (box[t][2] - box[t][0]) * i / (points + 1) for i in range(1, points + 1)] for t in wide}
        found = {}
        every = sorted({m for ms in sizes.values() for m in ms})
        for at in range(0, len(every), 512):
            found |= _at_sizes(hist, _unseen_share(n), every[at : at + 512])
        for t, ms in sizes.items():
            for m in ms:
                lo, c_lo, hi, c_hi = box[t]
                c = 1 - found[m]
                if c < t and m > lo:
                    box[t] = (m, c, hi, c_hi)
                elif c >= t and m < hi:
                    box[t] = (lo, c_lo, m, c)
                    break
    reached = {}
    for t, (lo, c_lo, hi, c_hi) in box.items():
        reached[t] = min(hi, lo + (hi - lo) * (t - c_lo) / (c_hi - c_lo)) if c_hi > c_lo else lo
    absent, unseen = {}, {}
    sizes = sorted(set(reached.values()))
    for at in range(0, len(sizes), 512):
        absent |= _at_sizes(hist, _absent(n), sizes[at : at + 512])
        unseen |= _at_sizes(hist, _unseen_share(n), sizes[at : at + 512])
    rows = []
    for t in targets:
        if t in reached:
            rows.append((t, reached[t], "rarefaction", 1 - unseen[reached[t]], s_obs - absent[reached[t]]))
        elif t <= full:
            part = (t - last) / (full - last)
            method = "observed" if part == 1 else "rarefaction"
            rows.append((t, n - 1 + part, method, t, s_obs - f1 / n * (1 - part)))
        elif t < 1 and a > 0:
            more = math.log((1 - t) * n / f1) / math.log(a) - 1
            grown = s_obs + (f0 * -math.expm1(more * math.log1p(-f1 / (n * f0 + f1))) if f0 else 0.0)
            rows.append((t, n + more, "extrapolation", 1 - f1 / n * a ** (more + 1), grown))
        else:
            rows.append((t, None, None, None, None))
    return counts.sparkSession.createDataFrame(rows, out)
