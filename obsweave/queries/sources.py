"""Queries and SQL twins for reading, scoping, cleaning and stage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsweave.operators import cleaning as K
from obsweave.plans.session import scratch_path
from obsweave.queries.base import (
    AS_OF, COLS, FLAGGED, OCC, OCCURRENCES, RULES, occurrences, r, references, with_sql,
)
from obsweave.queries.temporal import nd, rnd
from obsweave.sources import occurrences as S
from obsweave.sources import stage as G

QUERIES, ORACLE = {}, {}


def query(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


_EXTRA = """SELECT *, CASE WHEN day % 7 = 0 THEN 'UG' ELSE 'KE' END AS country_code,
  CASE WHEN day % 11 = 0 THEN 'ABSENT' ELSE 'PRESENT' END AS occurrence_status,
  day % 13 = 0 AS has_geospatial_issue FROM """
query(
    "scope_filter",
    lambda s, d: S.scope_filter(s.sql(_EXTRA + "{occ}", occ=occurrences(s, d)), "KE").groupBy("year").agg(F.count("*").alias("n")),
    with_sql(OCC, f"""SELECT year, count(*) AS n FROM ({_EXTRA} occ) WHERE country_code = 'KE' AND lon IS NOT NULL
      AND lat IS NOT NULL AND NOT has_geospatial_issue AND occurrence_status = 'PRESENT' AND year >= 1950 GROUP BY 1"""),
)


def _through_tsv(s, d):
    """Writes the records as delimited text and reads them back by the declared schema."""
    from pyspark.sql import types as T

    df = occurrences(s, d)
    path = scratch_path(s, "tsv")
    df.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(path)
    schema = T.StructType([f for n in df.columns for f in S.occurrence_schema(COLS).fields if f.name == n])
    return S.read_occurrences(s, path, "tsv", schema=schema)


_TOT = """SELECT basis_of_record, count(*) AS n, count(species) AS n_species_set, count(lon) AS n_lon, count(event_date) AS n_date,
  CAST(sum(year) AS BIGINT) AS sum_year, round(sum(uncertainty_m), 4) AS sum_m"""
query("read_delimited", lambda s, d: s.sql(_TOT + " FROM {t} GROUP BY basis_of_record", t=_through_tsv(s, d)),
      with_sql(OCC, _TOT.replace("count(species)", "count(*)").replace("count(event_date)", "count(*)")
               .replace("SELECT basis_of_record", "SELECT coalesce(basis_of_record, '') AS basis_of_record") + " FROM occ GROUP BY 1"))


def _through_parquet(s, d):
    path = scratch_path(s, "stage")
    G.materialize(s, lambda: occurrences(s, d), path)
    return S.read_occurrences(s, path)


query("stage_table", lambda s, d: s.sql(_TOT + " FROM {t} GROUP BY basis_of_record", t=_through_parquet(s, d)),
      with_sql(OCC, _TOT + " FROM occ GROUP BY basis_of_record"))


def _csv(s, d):
    path = scratch_path(s, "csv")
    G.write_csv(K.taxon_summary(occurrences(s, d)), path)
    return s.read.option("header", True).schema(
        "kingdom string, phylum string, class string, n_records long, n_species long").csv(path)


_tx = f"SELECT kingdom, phylum, class, count(*) AS n_records, {nd('species')} AS n_species FROM occ GROUP BY 1, 2, 3"
query("csv_export", _csv, with_sql(OCC, _tx))
query("taxon_summary", lambda s, d: K.taxon_summary(occurrences(s, d)), with_sql(OCC, _tx))


def _meta(s, d):
    df = occurrences(s, d)
    counts = df.agg(F.count("*").alias("raw_n"),
                    F.count_if(F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("clean_n"))
    store = scratch_path(s, "runs")
    G.run_metadata(s, counts, ["coords"], "demo", "2025-01-01", store)
    # a second run keeps the first record
    again = G.run_metadata(s, counts.withColumn("clean_n", F.lit(0)), ["none"], "demo", "2025-02-02", store)
    return again.select("source_id", "run_date", "raw_n", "clean_n", F.array_join("steps", ",").alias("steps"))


query("run_metadata", _meta, with_sql(OCC, """SELECT 'demo' AS source_id, '2025-01-01' AS run_date, count(*) AS raw_n,
  count(*) FILTER (WHERE lon IS NOT NULL AND lat IS NOT NULL) AS clean_n, 'coords' AS steps FROM occ"""))
# ------------------------------------------------------------------ cleaning
_day = "try_cast(substr(event_date, 1, 10) AS DATE)"
_yr = f"coalesce(year, extract(year FROM {_day}))"
_P = [
    ("has_coordinates", "lon IS NOT NULL AND lat IS NOT NULL"),
    ("has_species", "species IS NOT NULL AND species <> ''"),
    ("suitable_basis", "NOT coalesce(basis_of_record IN ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN'), false)"),
    ("certain_place", "coalesce(uncertainty_m < 10000, true)"),
    ("valid_year", f"coalesce({_yr} BETWEEN 1950 AND 2025, false)"),
]
_all = " AND ".join(f"({p})" for _, p in _P)
for _name, _fn in (("drop_missing_coords", K.drop_missing_coords), ("drop_missing_species", K.drop_missing_species),
                   ("drop_basis", K.drop_basis), ("drop_uncertain", K.drop_uncertain)):
    _cond = dict(zip(("drop_missing_coords", "drop_missing_species", "drop_basis", "drop_uncertain"), [p for _, p in _P]))[_name]
    query(_name, lambda s, d, f=_fn: s.sql(_TOT + " FROM {t} GROUP BY basis_of_record", t=f(occurrences(s, d))),
          with_sql(OCC, _TOT + f" FROM occ WHERE {_cond} GROUP BY basis_of_record"))
#: Every fifth record loses its year, so that the text must be parsed.
_NOYEAR = "SELECT * REPLACE (CASE WHEN day % 5 = 0 THEN NULL ELSE year END AS year) FROM occ"
_noyear = lambda s, d: occurrences(s, d).withColumn("year", F.when(F.col("day") % 5 != 0, F.col("year")))
query("resolve_year", lambda s, d: K.resolve_year(_noyear(s, d)).groupBy("year").agg(F.count("*").alias("n")),
      with_sql(OCC, f"SELECT CAST(y AS INT) AS year, count(*) AS n FROM (SELECT {_yr} AS y FROM ({_NOYEAR})) GROUP BY 1"))
query("keep_years", lambda s, d: K.keep_years(_noyear(s, d), as_of_year=AS_OF).groupBy("basis_of_record").agg(F.count("*").alias("n")),
      with_sql(OCC, f"SELECT basis_of_record, count(*) AS n FROM ({_NOYEAR}) WHERE {_P[-1][1]} GROUP BY 1"))
query("year_failures", lambda s, d: K.year_failures(_noyear(s, d), as_of_year=AS_OF),
      with_sql(OCC, f"""SELECT count(*) FILTER (WHERE y IS NULL) AS no_year, count(*) FILTER (WHERE y < 1950) AS too_early,
        count(*) FILTER (WHERE y > 2025) AS in_future FROM (SELECT {_yr} AS y FROM ({_NOYEAR}))"""))
_cols = ["occ_id", "species", "genus", "family", "tax_order", "class", "phylum", "kingdom", "lon", "lat", "uncertainty_m",
         "basis_of_record", "event_date", "year", "month", "day", "recorded_by"]
_ord = ", ".join(f"{c} ASC NULLS LAST" for c in _cols)
_first = lambda src: f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY species, lon, lat, {_day} ORDER BY {_ord}) AS rn FROM {src}) WHERE rn = 1)"  # noqa: E731,E501
query("dedupe", lambda s, d: K.dedupe(occurrences(s, d)).select("occ_id", "species", "lon", "lat", "event_date", "recorded_by"),
      with_sql(OCC, f"SELECT occ_id, species, lon, lat, event_date, recorded_by FROM {_first('occ')}"))
query("clean_rows", lambda s, d: K.clean(occurrences(s, d), as_of_year=AS_OF, coord_tests=False).select("occ_id", "species", "lon", "lat", "year"),
      with_sql(OCC, f"SELECT occ_id, species, lon, lat, year FROM {_first(f'(SELECT * FROM occ WHERE {_all})')}"))


def _clean_coords_sql() -> str:
    """The flag query over the cleaned rows instead of the raw ones."""
    inner = f"raw AS ({OCCURRENCES}), occ AS (SELECT * FROM {_first(f'(SELECT * FROM raw WHERE {_all})')})"
    rest = FLAGGED[FLAGGED.index("dated AS ("):]
    return f"WITH {inner}, {rest} SELECT occ_id, species, lon, lat, year FROM f WHERE NOT flag_any_coord_issue"


query("clean_with_coord_tests",
      lambda s, d: K.clean(occurrences(s, d), as_of_year=AS_OF, refs=references(s), rules=RULES).select("occ_id", "species", "lon", "lat", "year"),
      _clean_coords_sql())
query("cleaning_waterfall", lambda s, d: rnd(K.cleaning_waterfall(occurrences(s, d), as_of_year=AS_OF)),
      with_sql(OCC + ", ct AS (SELECT count(*) AS c0, " + ", ".join(
          "count(*) FILTER (WHERE " + " AND ".join(f"({p})" for _, p in _P[: i + 1]) + f") AS c{i + 1}" for i in range(5))
          + f", (SELECT count(*) FROM {_first(f'(SELECT * FROM occ WHERE {_all})')}) AS c6 FROM occ)",
          " UNION ALL ".join(
              f"SELECT {i} AS step_no, '{n}' AS step, c{i} AS records, c{max(i - 1, 0)} - c{i} AS removed,"
              f" {r(f'c{i} * 100.0 / c0')} AS retained_pct, {r(f'c{i} * 100.0 / c{max(i - 1, 0)}')} AS of_previous_pct FROM ct"
              for i, n in enumerate(["raw", *[k for k, _ in _P], "deduplicated"]))))
query("dataset_summary", lambda s, d: rnd(K.dataset_summary(occurrences(s, d))),
      with_sql(OCC, f"""SELECT count(*) AS n_records, {nd('species')} AS n_species, {nd('genus')} AS n_genera, {nd('family')} AS n_families,
        {nd('tax_order')} AS n_orders, {nd('class')} AS n_classes, {nd('phylum')} AS n_phyla, min(year) AS year_min, max(year) AS year_max,
        {r('median(uncertainty_m)')} AS median_uncertainty FROM occ"""))
