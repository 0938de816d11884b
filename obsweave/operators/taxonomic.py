"""Who is sampled: hierarchy, inequality, diversity, rarity, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.columns import Columns
from obsweave.functions.labels import rarity_class, rarity_order
from obsweave.operators.temporal import within_top_k
from obsweave.operators.tracking import one_row
from obsweave.plans.running import running_sums
from obsweave.plans.session import cut
from obsweave.plans.skew import attach, distinct_count, distinct_counts


def paths(df: DataFrame, cols: Columns = Columns(), extra: list[str] | None = None) -> DataFrame:
    """Records per distinct taxonomic path; later steps work on paths, not records."""
    keys = [*(extra or []), *cols.ranks.values()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def overview(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records and distinct names at seven ranks, NULL not counted."""
    return paths(df, cols).agg(
        F.sum("n").alias("n_records"),
        *[distinct_count(c, False).alias(f"n_{r}") for r, c in cols.ranks.items()],
    )


def hierarchy_summary(
    df: DataFrame, cols: Columns = Columns(), levels: tuple[str, ...] = ("kingdom", "phylum", "class", "order")
) -> DataFrame:
    """Records and distinct lower taxa at each prefix of the hierarchy, in one rollup."""
    names = [cols.ranks[x] for x in levels]
    below = {
        "n_phyla": cols.phylum, "n_classes": cols.class_, "n_orders": cols.order,
        "n_families": cols.family, "n_species": cols.species,
    }
    # rollup replaces its keys by NULL, so distinct counts read copies of them
    src = paths(df, cols).withColumns({f"_d_{a}": F.col(c) for a, c in below.items()})
    out = src.rollup(*names).agg(
        F.grouping_id().alias("_gid"),
        F.sum("n").alias("n_records"),
        *[F.count_distinct(f"_d_{a}").alias(a) for a in below],
    )
    depth = len(names) - F.bit_count("_gid")
    out = out.withColumn("_depth", depth).where("_depth > 0")
    leaf = F.element_at(F.array(*[F.col(c) for c in names]), F.col("_depth").cast("int"))
    return out.where(leaf.isNotNull()).select(
        F.element_at(F.array(*[F.lit(x) for x in levels]), F.col("_depth").cast("int")).alias("level"),
        *names, "n_records",
        *[
            F.when(F.col("_depth") < levels.index(x) + 1, F.col(a)).alias(a)
            if x in levels else F.col(a)
            for a, x in zip(below, ("phylum", "class", "order", "family", "species"), strict=True)
        ],
    )


def class_summary(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records, orders, families and species per named class (with its upper ranks)."""
    kept = paths(df.where(F.col(cols.class_).isNotNull()), cols)
    return kept.groupBy(cols.kingdom, cols.phylum, cols.class_).agg(
        F.sum("n").alias("n_records"),
        distinct_count(cols.order, False).alias("n_orders"),
        distinct_count(cols.family, False).alias("n_families"),
        distinct_count(cols.species, False).alias("n_species"),
    )


def shares(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Share of each category and cumulative share, greatest first."""
    total = df.agg(F.sum(value)).scalar()
    desc = df.withColumn("_o", -F.col(value))
    out = running_sums(desc, ["_o", *names], {"_cum": value})
    return out.withColumns(
        {"share": F.try_divide(F.col(value), total), "cumulative_share": F.try_divide(F.col("_cum"), total)}
    ).drop("_o", "_cum")


def lorenz(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Lorenz curve: cumulative share of items and of the value, least first."""
    one = df.withColumn("_1", F.lit(1).cast("long"))
    n = one.agg(F.count("*")).scalar()
    total = one.agg(F.sum(value)).scalar()
    out = running_sums(one, [value, *names], {"rank": "_1", "_cum": value})
    return out.withColumns(
        {"share_items": F.col("rank") / n, "share_value": F.try_divide(F.col("_cum"), total)}
    ).drop("_1", "_cum")


def gini(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Uncorrected Gini coefficient; zeros stay in.

    Runs on the histogram of values: a value held by m items after r smaller ones
    adds value * (m r + m (m + 1) / 2) to the sum of rank times value.
    """
    by = list(by or [])
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_m"))
    )
    ranked = running_sums(hist, ["_v"], {"_upto": "_m"}, by)
    m, r = F.col("_m"), F.col("_upto") - F.col("_m")
    n, total = F.sum("_m"), F.sum(F.col("_v") * m)
    weighted = F.sum(F.col("_v") * (m * r + m * (m + 1) / 2))
    return ranked.groupBy(*by).agg(
        n.alias("n"), (F.try_divide(2 * weighted, n * total) - (n + 1) / n).alias("gini")
    )


def diversity(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Simpson, Shannon (natural log) and Pielou of counts; Pielou is NULL for one item.

    Written as sums of x, x^2 and x ln x, so one aggregate is enough.
    """
    x = F.col(value).cast("double")
    used = df.where(x > 0)
    t, s2, sl, n = F.sum(x), F.sum(x * x), F.sum(x * F.ln(x)), F.count("*")
    h = F.ln(t) - sl / t
    return used.groupBy(*(by or [])).agg(
        (1 - s2 / (t * t)).alias("simpson"),
        h.alias("shannon"),
        F.when(n > 1, h / F.ln(n)).alias("pielou"),
    )


# Metric keys of the diversity table and what they say.
DIVERSITY_TEXT = {
    "Gini_records": "inequality of records over classes",
    "Gini_species": "inequality of species over classes",
    "Simpson_diversity": "chance that two records differ in class",
    "Shannon_diversity": "entropy of the class distribution",
    "Pielou_evenness": "entropy relative to its maximum",
}


def diversity_metrics(classes: DataFrame) -> DataFrame:
    """The five inequality and diversity measures as a long table."""
    one = one_row(
        gini(classes, "n_records").select(F.col("gini").alias("Gini_records")),
        gini(classes, "n_species").select(F.col("gini").alias("Gini_species")),
        diversity(classes, "n_records").select(
            F.col("simpson").alias("Simpson_diversity"),
            F.col("shannon").alias("Shannon_diversity"),
            F.col("pielou").alias("Pielou_evenness"),
        ),
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(t).alias("interpretation"))
            for k, t in DIVERSITY_TEXT.items()
        ]
    )
    return one.select(F.inline(rows))


def concentration(
    classes: DataFrame, name: str, value: str = "n_records",
    tops: tuple[int, ...] = (3, 5, 10), cuts: tuple[int, ...] = (100, 1000),
) -> DataFrame:
    """Share of the greatest categories and how many reach each record count."""
    v = F.col(value)
    base = classes.agg(
        F.count("*").alias("n_classes"),
        F.sum(value).alias("_total"),
        *[F.count_if(v >= c).alias(f"n_ge_{c}") for c in cuts],
        F.count_if(v < min(cuts)).alias(f"n_lt_{min(cuts)}"),
    )
    order = [F.desc(value), F.asc_nulls_last(name)]
    head = classes.select(name, value).orderBy(*order).limit(max(tops))
    # at most max(tops) rows
    head = head.withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    top = head.agg(
        *[F.sum(F.when(F.col("_k") <= k, v)).alias(f"_top_{k}") for k in tops],
        F.max(F.when(F.col("_k") == 1, F.col(name))).alias("top_name"),
        F.max(F.when(F.col("_k") == 1, v)).alias("_top_1"),
    )
    both = one_row(base, top)
    pct = lambda c: F.try_divide(F.col(c) * 100.0, F.col("_total"))
    return both.select(
        "n_classes", *[f"n_ge_{c}" for c in cuts], f"n_lt_{min(cuts)}",
        *[pct(f"_top_{k}").alias(f"top_{k}_pct") for k in tops],
        "top_name", pct("_top_1").alias("top_name_pct"),
    )


def cell_species(df: DataFrame, cols: Columns = Columns(), per_degree: int = 10) -> DataFrame:
    """Long community table: records per square cell and species."""
    from obsweave.functions.geo import square_key

    x, y = square_key(cols.lon, cols.lat, per_degree)
    return df.groupBy(x.alias("cell_x"), y.alias("cell_y"), cols.species).agg(
        F.count("*").alias("n")
    )


def pivot_counts(long: DataFrame, category: str, categories: list[str]) -> DataFrame:
    """Wide form for display, absent combinations as 0; the columns are given."""
    return (
        long.groupBy("cell_x", "cell_y").pivot(category, categories).agg(F.sum("n"))
        .fillna(0, subset=categories)
    )


def community_rows(
    long: DataFrame, sites: list[str], category: str, value: str = "n", block: int = 65_536,
) -> tuple[DataFrame, DataFrame]:
    """The whole site by category matrix in sparse rows, and the dictionary of its columns.

    A row holds the categories ``block * size`` up to the next block of one site:
    ``numbers``, rising, and their ``counts``. However many categories a site has, no
    row grows beyond a block. The dictionary (``category``, ``number``) numbers the names
    from 0 in their order. ``long`` has one row per site and category; several are added up,
    NULL names are left out, NULL sites are a site. Empty input gives empty tables.
    """
    named = cut(
        long.where(F.col(category).isNotNull()).groupBy(*sites, category).agg(F.sum(value).cast("long").alias("_n")), "community")
    sizes = named.groupBy(category).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_one", F.lit(1))
    numbers = running_sums(sizes, ["_one", category], {"_upto": "_one"}).select(
        category, (F.col("_upto") - 1).cast("long").alias("number"), "_rows")
    numbers = cut(numbers, "dictionary")
    total = named.agg(F.count(F.lit(1)).alias("n")).scalar()
    met = attach(named, numbers, [category], ["number"], "_rows", total)
    entries = F.array_sort(F.collect_list(F.struct("number", "_n")))
    rows = met.groupBy(*sites, F.floor(F.col("number") / block).cast("long").alias("block")).agg(entries.alias("_e"))
    matrix = rows.select(*sites, "block", F.col("_e.number").alias("numbers"), F.col("_e._n").alias("counts"))
    return matrix, numbers.select(category, "number")


def dense_slice(matrix: DataFrame, dictionary: DataFrame, sites: list[str], category: str, names: list[str]) -> DataFrame:
    """A column per name for every site of a sparse matrix, absent combinations as 0; unknown names are all 0.

    Of the matrix only the blocks that hold a name are unfolded; the other rows stand for their sites.
    """
    known = dict(dictionary.where(F.col(category).isin(names)).select(category, "number").collect())  # a row per name
    cell = F.map_from_arrays("numbers", "counts")
    wanted = F.map_filter(cell, lambda k, _: k.isin(list(known.values())))
    rows = matrix.select(*sites, wanted.alias("_c") if known else F.lit(None).alias("_c"))
    columns = [
        F.coalesce(F.max(F.try_element_at("_c", F.lit(known[c]).cast("long"))), F.lit(0).cast("long")).alias(c) if c in known
        else F.lit(0).cast("long").alias(c)
        for c in dict.fromkeys(names)
    ]
    return rows.groupBy(*sites).agg(F.count(F.lit(1)).alias("_rows"), *columns).drop("_rows")


def class_spatial(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Extent and sampling intensity per class; locations are distinct (lon, lat)."""
    x, y = cols.lon, cols.lat
    combos = df.where(F.col(cols.class_).isNotNull()).groupBy(
        cols.class_, cols.species, x, y
    ).agg(F.count("*").alias("n"))
    out = combos.groupBy(cols.class_).agg(
        F.sum("n").alias("n_records"),
        distinct_count(cols.species, True).alias("n_species"),
        F.count_distinct(F.struct(x, y)).alias("n_locations"),
        (F.max(x) - F.min(x)).alias("lon_range"),
        (F.max(y) - F.min(y)).alias("lat_range"),
    )
    return out.withColumns(
        {
            "spatial_extent": F.col("lon_range") * F.col("lat_range"),
            "records_per_location": F.col("n_records") / F.col("n_locations"),
            "species_per_location": F.col("n_species") / F.col("n_locations"),
        }
    )


def rarity(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Record count and rarity class per species."""
    n = df.groupBy(cols.species).agg(F.count("*").alias("n_records"))
    return n.withColumn("rarity_class", rarity_class(F.col("n_records")))


def rarity_summary(species: DataFrame) -> DataFrame:
    """Species and records per rarity class with their shares, rarest first."""
    out = species.groupBy("rarity_class").agg(
        F.count("*").alias("n_species"), F.sum("n_records").alias("total_records")
    )
    w = Window.partitionBy()  # at most seven classes
    return out.select(
        rarity_order(F.col("rarity_class")).alias("class_order"),
        "*",
        (F.col("n_species") / F.sum("n_species").over(w)).alias("prop_species"),
        (F.col("total_records") / F.sum("total_records").over(w)).alias("prop_records"),
    ).orderBy("class_order")


def head_by(df: DataFrame, value: str, names: list[str], n: int) -> DataFrame:
    """First n rows by descending value; ties follow the names, NULL last."""
    return df.orderBy(F.desc(value), *[F.asc_nulls_last(c) for c in names]).limit(n)


def top_taxa(df: DataFrame, cols: Columns = Columns(), n: int = 50) -> DataFrame:
    return head_by(rarity(df, cols), "n_records", [cols.species], n)


def composition(df: DataFrame, category: str, cols: Columns = Columns(), top: int | None = None) -> DataFrame:
    """Records and species per period and category; ``top`` keeps the overall greatest."""
    kept = df.where(F.col("period").isNotNull() & F.col(category).isNotNull())
    out = distinct_counts(kept, ["period", category], {"n_species": cols.species}, True)
    return within_top_k(out, category, top, among=df) if top else out


def composition_share(comp: DataFrame) -> DataFrame:
    """Share of each category within its period."""
    total = F.sum("n_records").over(Window.partitionBy("period"))
    return comp.withColumn("share", F.col("n_records") / total)


def period_diversity(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Records and distinct names at five ranks per period, NULL counted."""
    kept = df.where(F.col("period").isNotNull())
    return distinct_counts(
        kept, ["period"],
        {"n_species": cols.species, "n_genera": cols.genus, "n_families": cols.family,
         "n_orders": cols.order, "n_classes": cols.class_},
        True,
    )


def compare_known(classes: DataFrame, totals: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Observed species against known totals; a group without records counts 0.

    ``totals`` names a rank (class or kingdom) and a value to match for each group.
    """
    ranks = {r: cols.ranks[r] for r in ("kingdom", "phylum", "class")}
    long = classes.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("_rank"), F.col(c).alias("_value"), F.col("n_species").alias("_n"))
                    for r, c in ranks.items()
                ]
            )
        )
    ).groupBy("_rank", "_value").agg(F.sum("_n").alias("_n"))
    out = totals.join(
        long,
        (totals["match_rank"] == long["_rank"]) & (totals["match_value"] == long["_value"]),
        "left",
    )
    seen: Column = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return out.select(
        "group", seen.alias("observed_species"), "total",
        F.try_divide(seen * 100.0, F.col("total")).alias("coverage_percent"),
        (F.col("total") - seen).alias("gap"),
    )
