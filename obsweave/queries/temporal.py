"""Queries and SQL twins for the temporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.functions.labels import MONTHS, SEASONS
from obsweave.operators import temporal as T
from obsweave.operators.flags import with_dates
from obsweave.queries.base import CLEAN, COLS, DATED, clean, integral_sql, normal_sql, occurrences, r, with_sql

QUERIES, ORACLE = {}, {}


def query(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def rnd(df, digits: int = 6):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def nd(c: str) -> str:
    """Distinct count in which NULL is a value."""
    return f"CAST(count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT)"


dated = lambda s, d: with_dates(occurrences(s, d), COLS)
YEARS = CLEAN + f""",
ys AS (SELECT year, count(*) AS n_records, {nd('species')} AS n_species, {nd('genus')} AS n_genera,
  {nd('family')} AS n_families, count(DISTINCT recorded_by) AS n_collectors FROM cl GROUP BY 1),
span AS (SELECT min(year) AS lo, max(year) AS hi FROM ys),
every AS (SELECT CAST(unnest(range(lo, hi + 1)) AS INT) AS year FROM span),
gaps AS (SELECT year, lead(year) OVER (ORDER BY year) - year - 1 AS gap FROM ys)"""

query("yearly", lambda s, d: T.yearly(clean(s, d)), with_sql(YEARS, "SELECT * FROM ys"))
query(
    "yearly_stats",
    lambda s, d: rnd(T.yearly_stats(T.yearly(clean(s, d)))),
    with_sql(YEARS, f"""SELECT min(year) AS min_year, max(year) AS max_year, max(year) - min(year) AS year_range,
      count(*) AS n_years, {r('avg(n_records)')} AS mean_records, {r('median(n_records)')} AS median_records,
      {r('stddev_samp(n_records)')} AS sd_records, {r('stddev_samp(n_records) / avg(n_records)')} AS cv_records,
      {r('avg(n_species)')} AS mean_species, {r('median(n_species)')} AS median_species FROM ys"""),
)


def _mk_sql(by: str) -> str:
    g, j = (f"{by},", f"a.{by} = b.{by} AND") if by else ("", "")
    src = "kl" if by else "ys"
    key = f"USING ({by})" if by else "ON true"
    return f"""SELECT {g} n, s_stat, {r('s_stat / (sqrt(n * (n - 1) / 2.0 - t2) * sqrt(n * (n - 1) / 2.0))')} AS tau,
      {r('(n * (n - 1) * (2 * n + 5) - t5) / 18.0')} AS var_s FROM
      (SELECT {g} count(*) AS n FROM {src} {'GROUP BY 1' if by else ''}) c
      JOIN (SELECT {f'a.{by},' if by else ''} CAST(sum(sign(b.n_records - a.n_records)) AS BIGINT) AS s_stat
            FROM {src} a JOIN {src} b ON {j} a.year < b.year {'GROUP BY 1' if by else ''}) s {key}
      JOIN (SELECT {g} sum(t * (t - 1) / 2.0) AS t2, CAST(sum(t * (t - 1) * (2 * t + 5)) AS DOUBLE) AS t5 FROM
            (SELECT {g} n_records, count(*) AS t FROM {src} GROUP BY ALL) {'GROUP BY 1' if by else ''}) t {key}"""


query(
    "mann_kendall",
    lambda s, d: rnd(T.mann_kendall(T.yearly(clean(s, d)), "n_records", "year").select("n", "s_stat", "tau", "var_s")),
    with_sql(YEARS, _mk_sql("")),
)
query(
    "mann_kendall_test",
    lambda s, d: rnd(T.mann_kendall(T.yearly(clean(s, d)), "n_records", "year")),
    with_sql(YEARS, f"""SELECT * REPLACE ({r('p_value')} AS p_value, {r('z')} AS z), CASE WHEN p_value >= 0.05 THEN 'No trend' WHEN tau > 0 THEN 'Increasing' ELSE 'Decreasing' END AS trend
      FROM (SELECT *, greatest(0.0, 1 - 2 * {normal_sql('abs(z)')}) AS p_value FROM
        (SELECT *, (s_stat - sign(s_stat)) / sqrt(var_s) AS z FROM ({_mk_sql("")})))"""),
)
query(
    "mann_kendall_by_class",
    lambda s, d: rnd(T.mann_kendall(T.year_by(clean(s, d), "class"), "n_records", "year", ["class"])
                     .select("class", "n", "s_stat", "tau", "var_s")),
    with_sql(YEARS + ", kl AS (SELECT class, year, count(*) AS n_records FROM cl WHERE class IS NOT NULL GROUP BY 1, 2)",
             _mk_sql("class")),
)
query(
    "complete_years",
    lambda s, d: T.complete_years(T.yearly(clean(s, d)).select("year", "n_records", "n_species")),
    with_sql(YEARS, """SELECT year, coalesce(n_records, 0) AS n_records, coalesce(n_species, 0) AS n_species
      FROM every LEFT JOIN ys USING (year)"""),
)
query(
    "missing_years",
    lambda s, d: T.missing_years(T.yearly(clean(s, d))),
    with_sql(YEARS, "SELECT year FROM every WHERE year NOT IN (SELECT year FROM ys)"),
)
_gap = f"""SELECT CAST(max(year) - min(year) + 1 AS BIGINT) AS total_years, count(*) AS years_with_data,
  max(year) - min(year) + 1 - count(*) AS years_without_data,
  {r('count(*) * 100.0 / (max(year) - min(year) + 1)')} AS completeness_pct,
  CAST(coalesce(max(gap), 0) AS BIGINT) AS longest_gap, count(*) FILTER (WHERE gap > 0) AS n_gap_runs FROM gaps"""
query("gap_summary", lambda s, d: rnd(T.gap_summary(T.yearly(clean(s, d)))), with_sql(YEARS, _gap))
query(
    "year_by_class",
    lambda s, d: T.year_by(clean(s, d), "class"),
    with_sql(CLEAN, f"""SELECT year, class, count(*) AS n_records, {nd('species')} AS n_species FROM cl
      WHERE class IS NOT NULL GROUP BY 1, 2"""),
)
_top = "top AS (SELECT class FROM cl GROUP BY 1 ORDER BY count(*) DESC, class ASC NULLS LAST LIMIT 10)"
query(
    "top_classes_by_year",
    lambda s, d: T.within_top_k(T.year_by(clean(s, d), "class"), "class", 10, among=clean(s, d)),
    with_sql(CLEAN + ", " + _top, f"""SELECT year, class, count(*) AS n_records, {nd('species')} AS n_species
      FROM cl WHERE class IS NOT NULL AND class IN (SELECT class FROM top) GROUP BY 1, 2"""),
)
query(
    "decades",
    lambda s, d: T.decades(dated(s, d)),
    with_sql(DATED, f"""SELECT CAST(floor(year / 10.0) * 10 AS INT) AS decade, count(*) AS n_records,
      {nd('species')} AS n_species, {nd('genus')} AS n_genera, {nd('family')} AS n_families
      FROM dated WHERE year IS NOT NULL GROUP BY 1"""),
)
_mn = "CASE month " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(MONTHS)) + " END"
_sn = "CASE " + " ".join(f"WHEN month IN {v} THEN '{k}'" for k, v in SEASONS.items()) + " END"
query(
    "monthly",
    lambda s, d: T.monthly(clean(s, d)),
    with_sql(CLEAN, f"""SELECT month, count(*) AS n_records, {nd('species')} AS n_species, {_mn} AS month_name,
      {_sn} AS season FROM cl WHERE month IS NOT NULL GROUP BY month"""),
)
query(
    "seasons", lambda s, d: T.seasons(clean(s, d)),
    with_sql(CLEAN, f"SELECT {_sn} AS season, count(*) AS n_records FROM cl WHERE month IS NOT NULL GROUP BY 1"),
)
query(
    "chisq_months",
    lambda s, d: rnd(T.chisq_uniform(T.monthly(clean(s, d))).select("chi_squared", "df"), 4),
    with_sql(CLEAN, f"""SELECT {r('sum((n - e) * (n - e) / e)', 4)} AS chi_squared, count(*) - 1 AS df FROM
      (SELECT n, sum(n) OVER () * 1.0 / count(*) OVER () AS e FROM
       (SELECT CAST(count(*) AS DOUBLE) AS n FROM cl WHERE month IS NOT NULL GROUP BY month))"""),
)
# twelve months: eleven degrees of freedom
query(
    "chisq_months_test", lambda s, d: rnd(T.chisq_uniform(T.monthly(clean(s, d))), 4),
    with_sql(CLEAN, f"""SELECT {r('c', 4)} AS chi_squared, df, {r('p', 4)} AS p_value, p < 0.05 AS significant FROM
      (SELECT *, greatest(0.0, 1 - {integral_sql('(pow(x, df / 2.0 - 1) * pow(2.718281828459045, -x) / gamma(df / 2.0))', '(c / 2)', 20000)}) AS p FROM
       (SELECT sum((n - e) * (n - e) / e) AS c, count(*) - 1 AS df FROM
        (SELECT n, sum(n) OVER () * 1.0 / count(*) OVER () AS e FROM
         (SELECT CAST(count(*) AS DOUBLE) AS n FROM cl WHERE month IS NOT NULL GROUP BY month))))"""),
)
_ty = """ty AS (SELECT species, count(*) AS n_records, min(year) AS year_first, max(year) AS year_last,
  max(year) - min(year) AS temporal_span, count(DISTINCT year) AS n_years,
  count(DISTINCT year) * 1.0 / (max(year) - min(year) + 1) AS temporal_completeness
  FROM dated WHERE year IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"""
query(
    "taxon_years", lambda s, d: rnd(T.taxon_years(dated(s, d))),
    with_sql(DATED + ", " + _ty, f"SELECT * REPLACE ({r('temporal_completeness')} AS temporal_completeness) FROM ty"),
)
query(
    "taxon_years_summary",
    lambda s, d: rnd(T.taxon_years_summary(T.taxon_years(dated(s, d)))),
    with_sql(DATED + ", " + _ty, f"""SELECT count(*) AS n_species, {r('avg(temporal_span)')} AS mean_span,
      {r('avg(temporal_completeness)')} AS mean_completeness, {r('avg(n_years)')} AS mean_years,
      max(temporal_span) AS max_span, {r('median(temporal_span)')} AS median_span,
      {r('median(temporal_completeness)')} AS median_completeness FROM ty"""),
)


def period_sql(y: str, lo: str, hi: str) -> str:
    """Label of the 10-year bin of ``y``; the last bin is closed."""
    start = (f"least(CAST(floor({y} / 10.0) * 10 AS INT), CAST(greatest(ceil({hi} / 10.0) * 10, "
             f"floor({lo} / 10.0) * 10 + 10) AS INT) - 10)")
    return f"concat(CAST({start} AS VARCHAR), '-', CAST({start} + 9 AS VARCHAR))"


def with_period_sql(src: str) -> str:
    lab = period_sql("t.year", "b.lo", "b.hi")
    return f"""pr AS (SELECT t.*, CASE WHEN t.year IS NULL THEN NULL ELSE {lab} END AS period
      FROM {src} t, (SELECT min(year) AS lo, max(year) AS hi FROM {src}) b)"""


query(
    "period_summary",
    lambda s, d: T.period_summary(T.with_period(dated(s, d))),
    with_sql(DATED + ", " + with_period_sql("dated"), f"""SELECT period, count(*) AS n_records, {nd('species')} AS n_species,
      {nd('genus')} AS n_genera, {nd('family')} AS n_families FROM pr
      WHERE event_day IS NOT NULL AND period IS NOT NULL GROUP BY 1"""),
)
query(
    "temporal_metrics",
    lambda s, d: rnd(T.temporal_metrics(dated(s, d))),
    with_sql(DATED, f"""SELECT min(year) AS min_year, max(year) AS max_year, max(year) - min(year) + 1 AS span,
      count(*) AS n_years_sampled, {r('count(*) * 1.0 / (max(year) - min(year) + 1)')} AS completeness,
      max(year) - min(year) + 1 - count(*) AS n_missing_years, {r('stddev_samp(n) / avg(n)')} AS cv
      FROM (SELECT year, count(*) AS n FROM dated WHERE year IS NOT NULL GROUP BY 1)"""),
)
query(
    "span_histogram",
    lambda s, d: rnd(T.histogram(T.taxon_years(dated(s, d)), "temporal_span")),
    with_sql(DATED + ", " + _ty, f"""SELECT bin, count(*) AS n, {r('any_value(lo) + bin * any_value(w)')} AS bin_start FROM
      (SELECT CAST(least(49, coalesce(floor((CAST(temporal_span AS DOUBLE) - lo) / nullif(w, 0)), 0)) AS INT) AS bin, lo, w
       FROM ty, (SELECT CAST(min(temporal_span) AS DOUBLE) AS lo, (max(temporal_span) - min(temporal_span)) / 50.0 AS w FROM ty))
      GROUP BY bin"""),
)
query(
    "temporal_report",
    lambda s, d: rnd(T.temporal_report(T.yearly(clean(s, d)))),
    with_sql(YEARS, f"""SELECT g.years_without_data, g.completeness_pct, {r('stddev_samp(n_records) / avg(n_records)')} AS cv_records,
      {r('avg(n_records)')} AS mean_records, {r('median(n_records)')} AS median_records
      FROM ys, ({_gap}) g GROUP BY 1, 2"""),
)
