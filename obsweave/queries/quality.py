"""Queries and SQL twins for flags, tracking and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.columns import COORD_FLAGS, FLAGS, PRESETS, STRATEGIES
from obsweave.functions.geo import valid_coords
from obsweave.operators import tracking as T
from obsweave.operators.flags import with_dates
from obsweave.operators.summary import summary_table
from obsweave.queries.base import (
    AS_OF, COLS, DATED, FLAGGED, OCC, RANKS, flagged, occurrences, passes_sql, r, with_sql,
)


def rounded(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _unpivot_sql(pairs: list[tuple[str, str]], name: str, value: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS {name}, CAST({e} AS BIGINT) AS {value} FROM {source}" for k, e in pairs
    )


QUERIES, ORACLE = {}, {}


def query(name: str, fn, sql: str | None = None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


_FLAG_COLS = ["occ_id", "species", "lon", "lat", "year", "month", "day", "duplicate_group_size", *FLAGS]
query(
    "flags_all_records",
    lambda s, d: flagged(s, d).select(*_FLAG_COLS),
    with_sql(FLAGGED, f"SELECT {', '.join(_FLAG_COLS)} FROM f"),
)

_desc = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in FLAGS.items())


def _tracking_sql(flags, name):
    return (
        _unpivot_sql([(f, f"count(*) FILTER (WHERE {f})") for f in flags], name, "records_flagged", "f")
    )


query(
    "flag_tracking",
    lambda s, d: rounded(T.flag_tracking(flagged(s, d)), "percent_flagged"),
    with_sql(
        FLAGGED,
        f"""SELECT issue, CASE issue {_desc} END AS description, records_flagged,
        {r('records_flagged * 100.0 / (SELECT count(*) FROM f)')} AS percent_flagged
        FROM ({_tracking_sql(FLAGS, 'issue')})""",
    ),
)
query(
    "coord_issue_table",
    lambda s, d: rounded(T.coord_issue_table(flagged(s, d)), "percent_of_original"),
    with_sql(
        FLAGGED,
        f"""SELECT test, CASE test {_desc} END AS description, records_flagged,
        {r('records_flagged * 100.0 / (SELECT count(*) FROM f)')} AS percent_of_original,
        rank() OVER (ORDER BY records_flagged DESC) = 1 AS is_top
        FROM ({_tracking_sql(COORD_FLAGS, 'test')})""",
    ),
)
query(
    "retention",
    lambda s, d: rounded(T.retention(flagged(s, d)), "percent_retained"),
    with_sql(
        FLAGGED,
        f"""SELECT strategy, records, {r('records * 100.0 / (SELECT count(*) FROM f)')} AS percent_retained
        FROM ({_unpivot_sql(
            [('original', 'count(*)')] + [(k, f'count(*) FILTER (WHERE {passes_sql(v)})') for k, v in STRATEGIES.items()],
            'strategy', 'records', 'f')})""",
    ),
)
_u = "uncertainty_m"
query(
    "uncertainty_profile",
    lambda s, d: rounded(
        T.uncertainty_profile(occurrences(s, d)), "mean_uncertainty", "median_uncertainty",
        "q25_uncertainty", "q75_uncertainty", "max_uncertainty",
    ),
    with_sql(
        OCC,
        f"""SELECT count({_u}) AS n_with_uncertainty, {r(f'avg({_u})')} AS mean_uncertainty,
        {r(f'max({_u})')} AS max_uncertainty, {r(f'median({_u})')} AS median_uncertainty,
        {r(f'quantile_cont({_u}, 0.25)')} AS q25_uncertainty, {r(f'quantile_cont({_u}, 0.75)')} AS q75_uncertainty,
        """ + ", ".join(f"count(*) FILTER (WHERE {_u} > {k * 1000}) AS n_gt_{k}km" for k in (1, 5, 10, 50))
        + " FROM occ",
    ),
)
query(
    "basis_profile",
    lambda s, d: rounded(T.basis_profile(occurrences(s, d)), "percent"),
    with_sql(OCC, f"""SELECT basis_of_record, count(*) AS n,
        {r('count(*) * 100.0 / (SELECT count(*) FROM occ)')} AS percent FROM occ GROUP BY 1"""),
)
query(
    "rank_completeness",
    lambda s, d: rounded(T.rank_completeness(occurrences(s, d)), "percent_complete"),
    with_sql(OCC, f"""SELECT rank, n_complete, {r('n_complete * 100.0 / (SELECT count(*) FROM occ)')} AS percent_complete
        FROM ({_unpivot_sql([(k, f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} <> '')") for k, c in RANKS.items()],
                            'rank', 'n_complete', 'occ')})"""),
)


def _dates(strict: bool):
    return lambda s, d: T.date_issues(with_dates(occurrences(s, d), COLS, strict), COLS, AS_OF)


_date_sql = """SELECT count(*) FILTER (WHERE event_day IS NULL) AS n_missing_date,
    count(*) FILTER (WHERE year IS NULL) AS n_missing_year, count(*) FILTER (WHERE year > 2025) AS n_future_dates,
    count(*) FILTER (WHERE year < 1950) AS n_pre_min_year,
    count(*) FILTER (WHERE year BETWEEN 1950 AND 2025) AS n_valid_year FROM """
query("date_issues", _dates(False), with_sql(DATED, _date_sql + "dated"))
query(
    "date_issues_strict", _dates(True),
    with_sql(OCC, _date_sql + """(SELECT event_day, extract(year FROM event_day) AS year FROM
      (SELECT CASE WHEN length(event_date) = 10 THEN try_cast(event_date AS DATE) END AS event_day FROM occ))"""),
)
query(
    "duplicate_summary",
    lambda s, d: rounded(T.duplicate_summary(with_dates(occurrences(s, d), COLS)), "percent_duplicate"),
    with_sql(DATED, f"""SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_duplicate_records,
      count(*) FILTER (WHERE n > 1) AS n_duplicate_sets,
      {r('coalesce(sum(n) FILTER (WHERE n > 1), 0) * 100.0 / sum(n)')} AS percent_duplicate
      FROM (SELECT count(*) AS n FROM dated GROUP BY species, lon, lat, event_day)"""),
)
_fill = lambda c: f"{c} IS NOT NULL AND {c} <> ''"
query(
    "quality_summary",
    lambda s, d: rounded(T.quality_summary(flagged(s, d)), "species_id", "genus_id", "family_id",
                         "dates", "percent_coord_flags"),
    with_sql(
        FLAGGED,
        "SELECT count(*) AS n_records, "
        + ", ".join(f"count(*) FILTER (WHERE {passes_sql(v)}) AS n_{k}_clean" for k, v in STRATEGIES.items())
        + ", count(*) FILTER (WHERE NOT flag_missing_coords) AS coordinates, "
        + ", ".join(
            f"{r(f'count(*) FILTER (WHERE {_fill(k)}) * 100.0 / count(*)')} AS {k}_id"
            for k in ("species", "genus", "family"))
        + f", {r('count(*) FILTER (WHERE NOT flag_invalid_date) * 100.0 / count(*)')} AS dates"
        + ", count(*) FILTER (WHERE flag_any_coord_issue) AS total_coord_flags"
        + f", {r('count(*) FILTER (WHERE flag_any_coord_issue) * 100.0 / count(*)')} AS percent_coord_flags"
        + ", count(*) FILTER (WHERE flag_duplicate) AS n_duplicate_records"
        + ", count(*) FILTER (WHERE flag_high_uncertainty) AS n_high_uncertainty FROM f",
    ),
)
_any = "(" + " OR ".join(FLAGS) + ")"
query(
    "any_flag_count",
    lambda s, d: rounded(T.any_flag_count(flagged(s, d)), "percent_any_flag", "percent_not_moderate"),
    with_sql(FLAGGED, f"""SELECT count(*) FILTER (WHERE {_any}) AS n_any_flag,
      {r(f'count(*) FILTER (WHERE {_any}) * 100.0 / count(*)')} AS percent_any_flag,
      count(*) FILTER (WHERE NOT {passes_sql(STRATEGIES['moderate'])}) AS n_not_moderate,
      {r(f"count(*) FILTER (WHERE NOT {passes_sql(STRATEGIES['moderate'])}) * 100.0 / count(*)")} AS percent_not_moderate
      FROM f"""),
)
_nd = lambda c: f"(count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0))"
query(
    "sensitivity",
    lambda s, d: rounded(T.sensitivity(flagged(s, d)), "retention_pct"),
    with_sql(FLAGGED, " UNION ALL ".join(
        f"""SELECT '{k}' AS strategy, count(*) AS records, {r('count(*) * 100.0 / (SELECT count(*) FROM f)')} AS retention_pct,
        CAST({_nd('species')} AS BIGINT) AS species, CAST({_nd('family')} AS BIGINT) AS families,
        CAST({_nd('tax_order')} AS BIGINT) AS orders, CAST({_nd('class')} AS BIGINT) AS classes,
        count(DISTINCT (CAST(floor(lon * 10) AS BIGINT), CAST(floor(lat * 10) AS BIGINT))) AS cells,
        min(year) AS first_year, max(year) AS last_year FROM f WHERE {passes_sql(v)}"""
        for k, v in STRATEGIES.items())),
)
for _name, _flags in PRESETS.items():
    query(
        f"preset_impact_{_name}",
        lambda s, d, n=_name: rounded(T.preset_impact(flagged(s, d), n), "percent"),
        with_sql(FLAGGED, f"""SELECT '{_name}' AS preset, step, records,
          {r('records * 100.0 / (SELECT count(*) FROM f)')} AS percent FROM ({_unpivot_sql(
            [('before', 'count(*)')] + [(x, f'count(*) FILTER (WHERE {x})') for x in _flags]
            + [('retained', f'count(*) FILTER (WHERE {passes_sql(_flags)})')], 'step', 'records', 'f')})"""),
    )
    query(
        f"preset_{_name}",
        lambda s, d, n=_name: T.preset(flagged(s, d), n).groupBy("basis_of_record").agg(
            F.count("*").alias("n"), F.count_distinct("species").alias("species")),
        with_sql(FLAGGED, f"""SELECT basis_of_record, count(*) AS n, count(DISTINCT species) AS species
          FROM f WHERE {passes_sql(_flags)} GROUP BY 1"""),
    )
query(
    "quality_check",
    lambda s, d: rounded(T.quality_check(occurrences(s, d), COLS, AS_OF), "quality_score"),
    with_sql(
        OCC,
        f"""SELECT *, {r('100 * (1 - (missing_coords + missing_species + missing_dates + duplicate_records) / (total_records * 4.0))')} AS quality_score
        FROM (SELECT count(*) AS total_records,
          count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) AS missing_coords,
          count(*) FILTER (WHERE species IS NULL OR species = '') AS missing_species,
          count(*) FILTER (WHERE day0 IS NULL) AS missing_dates,
          count(*) - count(DISTINCT (species, lon, lat, day0)) AS duplicate_records,
          count(*) FILTER (WHERE year < 1700 OR year > 2025) AS invalid_years,
          count(*) FILTER (WHERE uncertainty_m > 10000) AS high_uncertainty
        FROM (SELECT *, try_cast(substr(event_date, 1, 10) AS DATE) AS day0 FROM occ))""",
    ),
)
query(
    "valid_coords",
    lambda s, d: occurrences(s, d).groupBy(valid_coords("lon", "lat").alias("valid")).agg(
        F.count("*").alias("n")),
    with_sql(OCC, """SELECT coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90
      AND NOT (lon = 0 AND lat = 0), false) AS valid, count(*) AS n FROM occ GROUP BY 1"""),
)

_num = ["lon", "lat", "uncertainty_m", "year"]
query(
    "summary_table",
    lambda s, d: _round_all(summary_table(occurrences(s, d), variables=_num)),
    with_sql(OCC, "SELECT " + ", ".join(
        f"{r(f'avg({c})')} AS {c}_mean, {r(f'median({c})')} AS {c}_median, {r(f'stddev_samp({c})')} AS {c}_sd, "
        f"{r(f'min({c})')} AS {c}_min, {r(f'max({c})')} AS {c}_max" for c in _num) + " FROM occ"),
)
query(
    "summary_table_by_class",
    lambda s, d: _round_all(summary_table(occurrences(s, d), ["class"], _num)),
    with_sql(OCC, "SELECT class, " + ", ".join(
        f"{r(f'avg({c})')} AS {c}_mean, {r(f'median({c})')} AS {c}_median, {r(f'stddev_samp({c})')} AS {c}_sd"
        for c in _num) + " FROM occ GROUP BY 1"),
)


def _round_all(df, digits: int = 6):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
