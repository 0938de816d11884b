"""Queries and SQL twins for taxonomic operators and rank assessments."""

from __future__ import annotations

from obsweave.functions.labels import RARITY
from obsweave.operators import accumulation as A
from obsweave.operators import assess as S
from obsweave.operators import taxonomic as X
from obsweave.operators.flags import with_dates
from obsweave.operators.temporal import with_period
from obsweave.queries.base import CLEAN, COLS, DATED, OCC, RANKS, clean, occurrences, r, with_sql
from obsweave.queries.temporal import nd, rnd, with_period_sql
from obsweave.sources.reference import load_reference

QUERIES, ORACLE = {}, {}


def query(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


dated = lambda s, d: with_dates(occurrences(s, d), COLS)
periods = lambda s, d: with_period(dated(s, d))
PERIODS = DATED + ", " + with_period_sql("dated")

query(
    "overview", lambda s, d: X.overview(occurrences(s, d)),
    with_sql(OCC, "SELECT count(*) AS n_records, " + ", ".join(
        f"count(DISTINCT {c}) AS n_{k}" for k, c in RANKS.items()) + " FROM occ"),
)
_lv = [("kingdom", 1), ("phylum", 2), ("class", 3), ("tax_order", 4)]
_below = [("n_phyla", "phylum", 2), ("n_classes", "class", 3), ("n_orders", "tax_order", 4),
          ("n_families", "family", 9), ("n_species", "species", 9)]
query(
    "hierarchy_summary", lambda s, d: X.hierarchy_summary(occurrences(s, d)),
    with_sql(OCC, " UNION ALL ".join(
        f"SELECT '{ {'tax_order': 'order'}.get(leaf, leaf)}' AS level, "
        + ", ".join(c if i <= k else f"CAST(NULL AS VARCHAR) AS {c}" for c, i in _lv)
        + ", count(*) AS n_records, "
        + ", ".join(f"count(DISTINCT {c}) AS {a}" if k < depth else f"CAST(NULL AS BIGINT) AS {a}"
                    for a, c, depth in _below)
        + f" FROM occ WHERE {leaf} IS NOT NULL GROUP BY " + ", ".join(c for c, i in _lv if i <= k)
        for leaf, k in _lv)),
)
_cs = """cs AS (SELECT kingdom, phylum, class, count(*) AS n_records, count(DISTINCT tax_order) AS n_orders,
  count(DISTINCT family) AS n_families, count(DISTINCT species) AS n_species FROM occ
  WHERE class IS NOT NULL GROUP BY 1, 2, 3)"""
CS = OCC + ", " + _cs
query("class_summary", lambda s, d: X.class_summary(occurrences(s, d)), with_sql(CS, "SELECT * FROM cs"))
_sp = OCC + ", sp AS (SELECT species, count(*) AS n_records FROM occ WHERE species IS NOT NULL GROUP BY 1)"
species = lambda s, d: X.rarity(occurrences(s, d).where("species is not null")).drop("rarity_class")
query(
    "class_shares",
    lambda s, d: rnd(X.shares(X.class_summary(occurrences(s, d)).select("kingdom", "phylum", "class", "n_records"),
                              "n_records", ["class", "kingdom", "phylum"])),
    with_sql(CS, f"""SELECT kingdom, phylum, class, n_records, {r('n_records * 1.0 / sum(n_records) OVER ()')} AS share,
      {r('sum(n_records) OVER (ORDER BY n_records DESC, class, kingdom, phylum ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n_records) OVER ()')}
      AS cumulative_share FROM cs"""),
)
query(
    "lorenz_species",
    lambda s, d: rnd(X.lorenz(species(s, d), "n_records", ["species"])),
    with_sql(_sp, f"""SELECT species, n_records, row_number() OVER w AS rank,
      {r('row_number() OVER w * 1.0 / count(*) OVER ()')} AS share_items,
      {r('sum(n_records) OVER w * 1.0 / sum(n_records) OVER ()')} AS share_value
      FROM sp WINDOW w AS (ORDER BY n_records, species ROWS UNBOUNDED PRECEDING)"""),
)
_gini = lambda v, src, by="": f"""(SELECT {by} count(*) AS n, {r(f'2 * sum(i * {v}) / (count(*) * sum({v})) - (count(*) + 1) * 1.0 / count(*)')} AS gini
  FROM (SELECT {by} {v} * 1.0 AS {v}, row_number() OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''} ORDER BY {v}) AS i FROM {src}) {'GROUP BY 1' if by else ''})"""  # noqa: E731,E501
query(
    "gini_species", lambda s, d: rnd(X.gini(species(s, d), "n_records")),
    with_sql(_sp, "SELECT * FROM " + _gini("n_records", "sp")),
)
_spc = OCC + ", sp AS (SELECT class, species, count(*) AS n_records FROM occ WHERE species IS NOT NULL GROUP BY 1, 2)"
per_class = lambda s, d: occurrences(s, d).where("species is not null").groupBy("class", "species").count().withColumnRenamed("count", "n_records")  # noqa: E731,E501
query(
    "gini_by_class", lambda s, d: rnd(X.gini(per_class(s, d), "n_records", ["class"])),
    with_sql(_spc, "SELECT * FROM " + _gini("n_records", "sp", "class, ")),
)
_div = lambda src, by="": f"""(SELECT {by} {r('1 - sum(p * p)')} AS simpson, {r('-sum(p * ln(p))')} AS shannon,
  {r('CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END')} AS pielou FROM
  (SELECT {by} n_records * 1.0 / sum(n_records) OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''}) AS p FROM {src}) {'GROUP BY 1' if by else ''})"""  # noqa: E731,E501
query(
    "diversity_by_class", lambda s, d: rnd(X.diversity(per_class(s, d), "n_records", ["class"])),
    with_sql(_spc, "SELECT * FROM " + _div("sp", "class, ")),
)
_txt = lambda k: X.DIVERSITY_TEXT[k]
query(
    "diversity_metrics", lambda s, d: rnd(X.diversity_metrics(X.class_summary(occurrences(s, d)))),
    with_sql(CS, " UNION ALL ".join(
        f"SELECT '{k}' AS metric, (SELECT {c} FROM {src}) AS value, '{_txt(k)}' AS interpretation"
        for k, c, src in (
            ("Gini_records", "gini", _gini("n_records", "cs")), ("Gini_species", "gini", _gini("n_species", "cs")),
            ("Simpson_diversity", "simpson", _div("cs")), ("Shannon_diversity", "shannon", _div("cs")),
            ("Pielou_evenness", "pielou", _div("cs"))))),
)
query(
    "concentration", lambda s, d: rnd(X.concentration(
        X.class_summary(occurrences(s, d)).groupBy("class").sum("n_records").withColumnRenamed("sum(n_records)", "n_records"), "class")),
    with_sql(CS + ", c1 AS (SELECT class, CAST(sum(n_records) AS BIGINT) AS n_records FROM cs GROUP BY 1),"
             " ck AS (SELECT *, row_number() OVER (ORDER BY n_records DESC, class) AS k FROM c1)",
             "SELECT count(*) AS n_classes, count(*) FILTER (WHERE n_records >= 100) AS n_ge_100,"
             " count(*) FILTER (WHERE n_records >= 1000) AS n_ge_1000, count(*) FILTER (WHERE n_records < 100) AS n_lt_100, "
             + ", ".join(f"{r(f'sum(n_records) FILTER (WHERE k <= {k}) * 100.0 / sum(n_records)')} AS top_{k}_pct" for k in (3, 5, 10))
             + f", max(class) FILTER (WHERE k = 1) AS top_name, {r('max(n_records) FILTER (WHERE k = 1) * 100.0 / sum(n_records)')}"
             " AS top_name_pct FROM ck"),
)
_cell = "CAST(floor(lon * 10) AS BIGINT) AS cell_x, CAST(floor(lat * 10) AS BIGINT) AS cell_y"
_csp = CLEAN + f", inc AS (SELECT {_cell}, species, count(*) AS n FROM cl GROUP BY ALL)"
query("cell_species", lambda s, d: X.cell_species(clean(s, d)), with_sql(_csp, "SELECT * FROM inc"))
_wide = [f"k_{i}" for i in range(2)]
query(
    "cell_kingdom_wide",
    lambda s, d: X.pivot_counts(
        X.cell_species(clean(s, d).drop("species").withColumnRenamed("kingdom", "species")), "species", _wide),
    with_sql(CLEAN, f"SELECT {_cell}, " + ", ".join(
        f"count(*) FILTER (WHERE kingdom = '{k}') AS {k}" for k in _wide) + " FROM cl GROUP BY 1, 2"),
)
_some = ["sp_1", "sp_7", "sp_r3", "no such species"]
query(
    "cell_species_sparse",
    lambda s, d: X.community_rows(X.cell_species(clean(s, d)), ["cell_x", "cell_y"], "species", block=512)[0].selectExpr(
        "cell_x", "cell_y", "block", "array_join(numbers, ',') AS numbers", "array_join(counts, ',') AS counts"),
    with_sql(_csp + """, nu AS (SELECT species, row_number() OVER (ORDER BY species) - 1 AS number FROM (SELECT DISTINCT species FROM inc WHERE species IS NOT NULL))""",
      """SELECT cell_x, cell_y, number // 512 AS block, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers,
      string_agg(CAST(n AS VARCHAR), ',' ORDER BY number) AS counts FROM inc JOIN nu USING (species) GROUP BY 1, 2, 3"""),
)
query(
    "cell_species_wide",
    lambda s, d: X.dense_slice(*X.community_rows(X.cell_species(clean(s, d)), ["cell_x", "cell_y"], "species", block=512),
                               ["cell_x", "cell_y"], "species", _some),
    with_sql(_csp, "SELECT cell_x, cell_y, " + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE species = '{k}'), 0) AS BIGINT) AS \"{k}\"" for k in _some) + " FROM inc WHERE species IS NOT NULL GROUP BY 1, 2"),
)
query(
    "class_spatial", lambda s, d: rnd(X.class_spatial(occurrences(s, d))),
    with_sql(OCC, f"""SELECT class, n_records, n_species, n_locations, {r('lon_range')} AS lon_range, {r('lat_range')} AS lat_range,
      {r('lon_range * lat_range')} AS spatial_extent, {r('n_records * 1.0 / n_locations')} AS records_per_location,
      {r('n_species * 1.0 / n_locations')} AS species_per_location FROM
      (SELECT class, count(*) AS n_records, {nd('species')} AS n_species, count(DISTINCT (lon, lat)) AS n_locations,
       max(lon) - min(lon) AS lon_range, max(lat) - min(lat) AS lat_range FROM occ WHERE class IS NOT NULL GROUP BY 1)"""),
)
_rc = "CASE " + " ".join(f"WHEN n_records <= {n} THEN '{k}'" for k, n in RARITY[:-1]) + f" ELSE '{RARITY[-1][0]}' END"
_ro = "CASE rarity_class " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, (k, _) in enumerate(RARITY)) + " END"
_rar = OCC + f", rr AS (SELECT species, n_records, {_rc} AS rarity_class FROM (SELECT species, count(*) AS n_records FROM occ GROUP BY 1))"
query("rarity", lambda s, d: X.rarity(occurrences(s, d)), with_sql(_rar, "SELECT * FROM rr"))
query(
    "rarity_summary", lambda s, d: rnd(X.rarity_summary(X.rarity(occurrences(s, d)))),
    with_sql(_rar, f"""SELECT CAST({_ro} AS INT) AS class_order, rarity_class, n_species, total_records,
      {r('n_species * 1.0 / sum(n_species) OVER ()')} AS prop_species,
      {r('total_records * 1.0 / sum(total_records) OVER ()')} AS prop_records FROM
      (SELECT rarity_class, count(*) AS n_species, CAST(sum(n_records) AS BIGINT) AS total_records FROM rr GROUP BY 1)"""),
)
query(
    "top_species", lambda s, d: X.top_taxa(occurrences(s, d)),
    with_sql(_rar, "SELECT * FROM rr ORDER BY n_records DESC, species ASC NULLS LAST LIMIT 50"),
)
query(
    "top_orders", lambda s, d: X.head_by(
        occurrences(s, d).where("tax_order is not null").groupBy("tax_order").count().withColumnRenamed("count", "n_records"),
        "n_records", ["tax_order"], 20),
    with_sql(OCC, """SELECT tax_order, count(*) AS n_records FROM occ WHERE tax_order IS NOT NULL GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 20"""),
)
for _n in (15, 30):
    query(
        f"top_{_n}_classes",
        lambda s, d, n=_n: X.head_by(X.class_summary(occurrences(s, d)), "n_records", ["class", "kingdom", "phylum"], n),
        with_sql(CS, f"SELECT * FROM cs ORDER BY n_records DESC, class, kingdom, phylum LIMIT {_n}"),
    )
_comp = f"""SELECT period, class, count(*) AS n_records, {nd('species')} AS n_species FROM pr
  WHERE period IS NOT NULL AND class IS NOT NULL GROUP BY 1, 2"""
_top10 = "(SELECT class FROM pr GROUP BY 1 ORDER BY count(*) DESC, class ASC NULLS LAST LIMIT 10)"
query("composition", lambda s, d: X.composition(periods(s, d), "class"), with_sql(PERIODS, _comp))
query(
    "composition_top", lambda s, d: X.composition(periods(s, d), "class", top=10),
    with_sql(PERIODS, f"SELECT * FROM ({_comp}) WHERE class IN {_top10}"),
)
query(
    "composition_share", lambda s, d: rnd(X.composition_share(X.composition(periods(s, d), "class", top=10))),
    with_sql(PERIODS, f"""SELECT *, {r('n_records * 1.0 / sum(n_records) OVER (PARTITION BY period)')} AS share
      FROM ({_comp}) WHERE class IN {_top10}"""),
)
query(
    "period_diversity", lambda s, d: X.period_diversity(periods(s, d)),
    with_sql(PERIODS, "SELECT period, count(*) AS n_records, " + ", ".join(
        f"{nd(c)} AS {a}" for a, c in (("n_species", "species"), ("n_genera", "genus"), ("n_families", "family"),
                                      ("n_orders", "tax_order"), ("n_classes", "class")))
        + " FROM pr WHERE period IS NOT NULL GROUP BY 1"),
)
KNOWN = (("birds", "class", "c_0", 1136), ("mammals", "class", "c_1", 390), ("reptiles", "class", "c_77", 200),
         ("plants", "kingdom", "k_1", 7000))
query(
    "compare_known",
    lambda s, d: rnd(X.compare_known(X.class_summary(occurrences(s, d)), load_reference(s, "known_totals", KNOWN))),
    with_sql(CS, " UNION ALL ".join(
        f"""SELECT '{g}' AS "group", CAST(coalesce(sum(n_species), 0) AS BIGINT) AS observed_species, CAST({t} AS BIGINT) AS total,
        {r(f'coalesce(sum(n_species), 0) * 100.0 / {t}')} AS coverage_percent,
        CAST({t} - coalesce(sum(n_species), 0) AS BIGINT) AS gap FROM cs WHERE {k} = '{v}'"""
        for g, k, v, t in KNOWN)),
)

# ----------------------------------------------------------------- curves
inc = lambda s, d: X.cell_species(clean(s, d)).drop("n")
_REPS = 100
query(
    "accumulation_random",
    lambda s, d: rnd(A.accumulation(inc(s, d), ["cell_x", "cell_y"], "species", _REPS, hash_name="md5")),
    with_sql(_csp + f""",
      reps AS (SELECT unnest(range(0, {_REPS})) AS rep),
      st AS (SELECT rep, cell_x, cell_y,
        CAST(concat('0x', substr(md5(concat('123:', CAST(rep AS VARCHAR), ':', CAST(cell_x AS VARCHAR), ':', CAST(cell_y AS VARCHAR))), 1, 15)) AS BIGINT) AS h
        FROM (SELECT DISTINCT cell_x, cell_y FROM inc), reps),
      rk AS (SELECT rep, cell_x, cell_y, row_number() OVER (PARTITION BY rep ORDER BY h) AS k FROM st),
      fs AS (SELECT rep, min(k) AS k FROM inc JOIN rk USING (cell_x, cell_y) GROUP BY rep, species),
      nw AS (SELECT rep, k, count(*) AS n FROM fs GROUP BY 1, 2),
      cu AS (SELECT rk.rep, rk.k, sum(coalesce(n, 0)) OVER (PARTITION BY rk.rep ORDER BY rk.k) AS c FROM rk LEFT JOIN nw ON rk.rep = nw.rep AND rk.k = nw.k)""",
      f"SELECT k AS sites, {r('avg(c)')} AS richness, {r('stddev_samp(c)')} AS sd FROM cu GROUP BY 1"),
)
query(
    "accumulation_fast_hash",
    lambda s, d: rnd(A.accumulation(inc(s, d), ["cell_x", "cell_y"], "species", _REPS)),
)
_lg = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
query(
    "accumulation_exact",
    lambda s, d: rnd(A.accumulation_exact(inc(s, d), ["cell_x", "cell_y"], "species"), 4),
    with_sql(_csp + """, nn AS (SELECT CAST(count(DISTINCT (cell_x, cell_y)) AS DOUBLE) AS n FROM inc),
      hi AS (SELECT x, count(*) AS f FROM (SELECT species, count(*) AS x FROM inc GROUP BY 1) GROUP BY 1),
      ks AS (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM nn)""",
      f"""SELECT k AS sites, {r(f"sum(f * (1 - CASE WHEN k <= n - x THEN exp({_lg.format(n='(n - x)', k='k')} - {_lg.format(n='n', k='k')}) ELSE 0 END))", 4)}
      AS richness FROM hi, nn, ks GROUP BY 1"""),
)
query(
    "accumulation_by_year", lambda s, d: A.accumulation_by_year(clean(s, d)),
    with_sql(CLEAN, """SELECT year, new_species, CAST(sum(new_species) OVER (ORDER BY year) AS BIGINT) AS richness FROM
      (SELECT year, count(*) AS new_species FROM (SELECT species, min(year) AS year FROM cl GROUP BY 1) GROUP BY 1)"""),
)
_counts = lambda s, d: X.rarity(clean(s, d))
query("rarefaction", lambda s, d: rnd(A.rarefaction(_counts(s, d), "species"), 4),
      with_sql(CLEAN + """,
  tx AS (SELECT count(*) AS x FROM cl GROUP BY species),
  hi AS (SELECT CAST(x AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS f FROM tx GROUP BY 1),
  st AS (SELECT sum(x * f) AS n, sum(f) AS s_obs, max(x) * 2 AS e, coalesce(sum(f) FILTER (WHERE x = 1), 0) AS f1,
         coalesce(sum(f) FILTER (WHERE x = 2), 0) AS f2 FROM hi),
  s2 AS (SELECT *, (n - 1) / n * CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END AS f0 FROM st),
  kn AS (SELECT DISTINCT floor(1.0 + (e - 1.0) * i / 39) AS m FROM st, (SELECT unnest(range(0, 40)) AS i))""",
  f"""SELECT CAST(m AS BIGINT) AS m, CASE WHEN m < n THEN 'rarefaction' WHEN m = n THEN 'observed' ELSE 'extrapolation' END AS method,
   {r('sum(f * (1 - CASE WHEN m <= n - x THEN exp(lgamma(n - x + 1) - lgamma(n - x - m + 1) - lgamma(n + 1) + lgamma(n - m + 1)) ELSE 0 END))', 4)} AS richness,
   {r('1 - sum(f * CASE WHEN m <= n - x THEN x / n * exp(lgamma(n - x + 1) - lgamma(n - x - m + 1) - lgamma(n) + lgamma(n - m)) ELSE 0 END)', 4)} AS coverage,
   CAST(any_value(s_obs) AS BIGINT) AS s_obs, {r('any_value(s_obs + f0)', 4)} AS chao1
   FROM hi, s2, kn GROUP BY m, n"""))
query("rarefaction_all_boot", lambda s, d: rnd(A.rarefaction(_counts(s, d), "species", top_n=None, boots=50, endpoint=100_000)))
_TARGETS = (0.1, 0.5, 0.8, 0.9, 0.95, 0.99, 0.999, 0.9999, 0.99999, 0.999999)
_fall = "(lgamma({a}) - lgamma(({a}) - ({k})))"
query(
    "rarefaction_at_coverage",
    lambda s, d: A.richness_at_coverage(_counts(s, d), "species", _TARGETS).selectExpr(
        "target", "round(m, 2) AS m", "method", "round(coverage, 9) AS coverage", "round(richness, 4) AS richness"),
    # halving by recursion; both curves are straight from n - 1 to n
    with_sql(CLEAN + """,
  tx AS (SELECT count(*) AS x FROM cl GROUP BY species),
  hi AS (SELECT CAST(x AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS f FROM tx GROUP BY 1),
  st AS (SELECT *, 1 - f1 / n AS last, 1 - f1 / n * a AS full_ FROM (SELECT *, (n - 1) / n * CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END AS f0,
      CASE WHEN f2 > 0 THEN (n - 1) * f1 / ((n - 1) * f1 + 2 * f2) ELSE (n - 1) * greatest(f1 - 1, 0) / ((n - 1) * greatest(f1 - 1, 0) + 2) END AS a
    FROM (SELECT sum(x * f) AS n, sum(f) AS s_obs, coalesce(sum(f) FILTER (WHERE x = 1), 0) AS f1, coalesce(sum(f) FILTER (WHERE x = 2), 0) AS f2 FROM hi)))""",
  f"""SELECT t AS target, round(m, 2) AS m, method, round(t, 9) AS coverage, round(richness, 4) AS richness FROM (
    WITH RECURSIVE bs AS (
      SELECT CAST(t AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS lo, n - 1 AS hi, 0 AS k FROM st, (SELECT unnest([{', '.join(map(str, _TARGETS))}]) AS t) WHERE t <= last
      UNION ALL
      SELECT t, CASE WHEN c < t THEN mid ELSE lo END, CASE WHEN c < t THEN hi ELSE mid END, k + 1 FROM (
        SELECT t, lo, bs.hi, k, (lo + bs.hi) / 2 AS mid, 1 - sum(f * CASE WHEN (lo + bs.hi) / 2 < n - x + 1
          THEN x / n * exp({_fall.format(a='n - (lo + bs.hi) / 2', k='x - 1')} - {_fall.format(a='n', k='x - 1')}) ELSE 0 END) AS c
        FROM bs, hi, st WHERE k < 64 GROUP BY t, lo, bs.hi, k)),
    rr AS (SELECT t, lo AS m, 'rarefaction' AS method, sum(f * (1 - CASE WHEN lo < n - x + 1
        THEN exp({_fall.format(a='n - lo + 1', k='x')} - {_fall.format(a='n + 1', k='x')}) ELSE 0 END)) AS richness
      FROM bs, hi, st WHERE k = 64 GROUP BY t, lo)
    SELECT * FROM rr UNION ALL
    SELECT t, n - 1 + (t - last) / (full_ - last), CASE WHEN t = full_ THEN 'observed' ELSE 'rarefaction' END,
      s_obs - f1 / n * (1 - (t - last) / (full_ - last)) FROM st, (SELECT unnest([{', '.join(map(str, _TARGETS))}]) :: DOUBLE AS t) WHERE t > last AND t <= full_
    UNION ALL
    SELECT t, n - 1 + ln((1 - t) * n / f1) / ln(a), 'extrapolation',
      s_obs + f0 * (1 - pow(1 - f1 / (n * f0 + f1), ln((1 - t) * n / f1) / ln(a) - 1)) FROM st, (SELECT unnest([{', '.join(map(str, _TARGETS))}]) :: DOUBLE AS t) WHERE t > full_)"""))

# ------------------------------------------------------------ assessments


def _rank_union(cols: str, where: str, src: str, tail: str, period: bool = False) -> str:
    items = list(RANKS.items()) + ([("period", "period")] if period else [])
    return " UNION ALL ".join(
        f"SELECT '{k}' AS rank, {c} AS value, {cols} FROM {src} WHERE {c} IS NOT NULL AND {where} {tail}"
        for k, c in items)


query(
    "assess_records", lambda s, d: S.assess_records(periods(s, d)),
    with_sql(PERIODS, _rank_union("period, count(*) AS n_records", "period IS NOT NULL", "pr", "GROUP BY ALL", True)),
)
_deg = "(pi() * 6371008.8 / 180 / 10000)"
_mc = (f"CAST(floor(lon * {_deg} * cos(radians((floor(lat * {_deg}) + 0.5) / {_deg}))) AS BIGINT) AS cell_x,"
       f" CAST(floor(lat * {_deg}) AS BIGINT) AS cell_y")
_loc = "lon IS NOT NULL AND lat IS NOT NULL"
query(
    "assess_taxa_per_cell", lambda s, d: rnd(S.assess_taxa_per_cell(occurrences(s, d))),
    with_sql(OCC, f"""SELECT rank, cell_x, cell_y, count(DISTINCT value) AS n_taxa, {r('log10(count(DISTINCT value) + 1)')} AS log_taxa
      FROM ({_rank_union(_mc, _loc, 'occ', '')}) GROUP BY 1, 2, 3"""),
)
query(
    "assess_coverage", lambda s, d: rnd(S.assess_coverage(occurrences(s, d))),
    with_sql(OCC, f"""SELECT rank, count(*) AS n_taxa, count(*) FILTER (WHERE n >= 5) AS n_covered,
      {r('count(*) FILTER (WHERE n >= 5) * 1.0 / count(*)')} AS share FROM
      ({_rank_union('count(DISTINCT (lon, lat)) AS n', _loc, 'occ', 'GROUP BY ALL')}) GROUP BY 1"""),
)
query(
    "assess_record_time", lambda s, d: S.assess_record_time(dated(s, d)),
    with_sql(DATED, _rank_union("year, count(*) AS n_records", "year IS NOT NULL", "dated", "GROUP BY ALL")),
)
query(
    "assess_taxa_time", lambda s, d: rnd(S.assess_taxa_time(dated(s, d))),
    with_sql(DATED, f"""SELECT rank, count(*) AS n_taxa, count(*) FILTER (WHERE sp >= 5) AS n_long,
      {r('count(*) FILTER (WHERE sp >= 5) * 1.0 / count(*)')} AS share FROM
      ({_rank_union('max(year) - min(year) AS sp', 'year IS NOT NULL', 'dated', 'GROUP BY ALL')}) GROUP BY 1"""),
)
query(
    "assess_identity", lambda s, d: S.assess_identity(occurrences(s, d)),
    with_sql(OCC, f"""SELECT rank, count(*) AS n_taxa, count(*) FILTER (WHERE n = 1) AS n_singletons,
      count(*) FILTER (WHERE n = 2) AS n_doubletons, count(*) FILTER (WHERE n >= 100) AS n_common FROM
      ({_rank_union('count(*) AS n', 'species IS NOT NULL', 'occ', 'GROUP BY ALL')}) GROUP BY 1"""),
)
query(
    "assessment_matrix", lambda s, d: S.assessment_matrix(dated(s, d)),
    with_sql(DATED, " UNION ALL ".join(
        f"""SELECT '{k}' AS rank, count({c}) > 0 AS records, count({c}) FILTER (WHERE {_loc}) > 0 AS spatial,
        count({c}) FILTER (WHERE year IS NOT NULL) > 0 AS temporal FROM dated""" for k, c in RANKS.items())),
)
query(
    "taxa_per_rank", lambda s, d: S.taxa_per_rank(occurrences(s, d)),
    with_sql(OCC, " UNION ALL ".join(f"SELECT '{k}' AS rank, {nd(c)} AS n_taxa FROM occ" for k, c in RANKS.items())),
)
