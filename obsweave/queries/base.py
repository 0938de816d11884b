"""Occurrence view over the given tables, shared by the queries and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.columns import COORD_FLAGS, FLAGS, STRATEGIES, Columns
from obsweave.operators.flags import FlagRules, add_flags, passes
from obsweave.plans.session import scratch_path, tune
from obsweave.sources.reference import HEADQUARTERS, References, load_reference, ring_table
from obsweave.sources.stage import materialize

COLS = Columns()
AS_OF = 2025
RULES = FlagRules(as_of_year=AS_OF)

#: Occurrence records derived from every row of lineitem; runs in Spark and DuckDB.
OCCURRENCES = """
SELECT
  l_orderkey * 1000000 + l_partkey * 100 + l_suppkey                       AS occ_id,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL
       WHEN l_orderkey % 43 = 0 THEN ''
       WHEN l_orderkey % 37 = 0 THEN concat('sp_r', CAST((l_orderkey * 13 + l_partkey) % 2500 AS VARCHAR(10)))
       ELSE concat('sp_', CAST(k AS VARCHAR(10))) END                      AS species,
  CASE WHEN k % 59 = 0 THEN NULL
       ELSE concat('g_', CAST(k % 400 AS VARCHAR(10))) END                 AS genus,
  concat('f_', CAST(k % 80 AS VARCHAR(10)))                                AS family,
  concat('o_', CAST(k % 20 AS VARCHAR(10)))                                AS tax_order,
  CASE WHEN k % 10 = 9 THEN NULL
       ELSE concat('c_', CAST(k % 10 AS VARCHAR(10))) END                  AS class,
  concat('p_', CAST(k % 5 AS VARCHAR(10)))                                 AS phylum,
  concat('k_', CAST((k % 5) % 2 AS VARCHAR(10)))                           AS kingdom,
  CASE WHEN l_orderkey % 97  = 0 THEN NULL
       WHEN l_orderkey % 211 = 0 THEN CAST(3.5 AS DOUBLE)
       WHEN l_orderkey % 223 = 0 THEN CAST(12.58 AS DOUBLE)
       WHEN l_orderkey % 227 = 0 THEN CAST(0.25 AS DOUBLE)
       WHEN l_orderkey % 17  = 0 THEN CAST(36.82 AS DOUBLE)
       ELSE CAST((l_suppkey * 7919 + l_linenumber * 31) % 800 AS DOUBLE) / 100 + 34 END  AS lon,
  CASE WHEN l_orderkey % 89  = 0 THEN NULL
       WHEN l_orderkey % 211 = 0 THEN CAST(-3.5 AS DOUBLE)
       WHEN l_orderkey % 223 = 0 THEN CAST(55.67 AS DOUBLE)
       WHEN l_orderkey % 227 = 0 THEN CAST(0.125 AS DOUBLE)
       WHEN l_orderkey % 17  = 0 THEN CAST(-1.29 AS DOUBLE)
       ELSE CAST((l_suppkey * 104729 + l_linenumber * 17) % 1000 AS DOUBLE) / 100 - 5 END AS lat,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL
       ELSE CAST((l_partkey * 50) % 15000 AS DOUBLE) END                   AS uncertainty_m,
  CASE WHEN l_orderkey % 61 = 0 THEN 'FOSSIL_SPECIMEN'
       WHEN l_orderkey % 67 = 0 THEN 'LIVING_SPECIMEN'
       WHEN l_returnflag = 'A'  THEN 'HUMAN_OBSERVATION'
       ELSE 'PRESERVED_SPECIMEN' END                                       AS basis_of_record,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL
       WHEN l_orderkey % 7  = 0 THEN concat(ymd, 'T10:00:00')
       ELSE ymd END                                                        AS event_date,
  y AS year, m AS month, dd AS day,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL
       ELSE concat('col_', CAST(l_suppkey % 25 AS VARCHAR(10))) END        AS recorded_by
FROM (
  SELECT *,
    concat(CAST(y AS VARCHAR(4)), '-', CASE WHEN m < 10 THEN '0' ELSE '' END, CAST(m AS VARCHAR(2)),
           '-', CASE WHEN dd < 10 THEN '0' ELSE '' END, CAST(dd AS VARCHAR(2))) AS ymd
  FROM (
    SELECT *,
      CAST((kk * kk - (kk * kk) % 2000) / 2000 AS BIGINT) AS k,
      CAST(CASE WHEN l_orderkey % 90 BETWEEN 20 AND 22 THEN 1971 ELSE 1940 + l_orderkey % 90 END AS INT) AS y,
      CAST(1 + l_orderkey % 12 AS INT) AS m,
      CAST(1 + l_partkey % 28 AS INT)  AS dd
    FROM (SELECT *, l_partkey % 2000 AS kk FROM lineitem) a
  ) b
) c
"""

PLACES = (
    ("capital", "capital", 36.82, -1.29),
    ("centroid", "centroid", 37.9, 0.5),
    HEADQUARTERS,
)
#: Two towns; the first one has a park in it and a suburb apart from it.
URBAN = {
    "urban": [[(36.7, -1.4), (36.95, -1.4), (36.95, -1.2), (36.7, -1.2)],
              [(36.88, -1.38), (36.94, -1.38), (36.94, -1.22), (36.91, -1.3)],
              [(37.1, -1.4), (37.6, -1.1), (37.2, -0.9)]],
    "port": [[(39.5, -4.2), (39.9, -4.1), (39.8, -3.8), (39.55, -3.9)]],
}
BOUNDARY = [(34.0, -5.0), (42.0, -5.0), (42.0, 5.0), (39.0, 5.0), (38.0, 2.0), (37.0, 5.0), (34.0, 5.0)]
#: The same land with a lake, an island in the lake, and an island in the bay.
LAND = [BOUNDARY, [(35.0, -2.0), (36.5, -2.4), (36.2, -0.3), (35.1, -0.5)],
        [(35.5, -1.6), (36.0, -1.5), (35.8, -1.0)], [(37.6, 4.0), (38.3, 3.7), (38.4, 4.8), (37.7, 4.6)]]
RANKS = {"kingdom": "kingdom", "phylum": "phylum", "class": "class", "order": "tax_order",
         "family": "family", "genus": "genus", "species": "species"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw occurrence records."""
    tune(spark)
    return spark.sql(OCCURRENCES.replace("FROM lineitem", "FROM {src}"),
                     src=table(spark, sf_dir, "lineitem"))


def references(spark: SparkSession) -> References:
    return References(
        places=load_reference(spark, "places", PLACES),
        urban=ring_table(spark, URBAN),
    )


_STAGES: dict[tuple[str, str], str] = {}


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged stage table: written once per application, then read by each report."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _STAGES:
        _STAGES[key] = scratch_path(spark, "flagged")
    return materialize(spark, lambda: flag_now(spark, sf_dir), _STAGES[key])


def flag_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_flags(occurrences(spark, sf_dir), COLS, references(spark), RULES)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the moderate strategy's row-local part, input of the analyses."""
    from obsweave.operators.flags import with_dates

    return with_dates(occurrences(spark, sf_dir), COLS).where(
        (F.col("lon").isNotNull() & F.col("lat").isNotNull())
        & F.col("species").isNotNull() & (F.col("species") != "")
        & F.col("year").between(1950, AS_OF)
    )


# ------------------------------------------------------------------ SQL side


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def integral_sql(density: str, upper: str, steps: int = 4000) -> str:
    """Simpson's rule from 0 to ``upper``; ``density`` is written in ``x``. DuckDB has no error function."""
    f = density.replace("x", f"({upper} * k / {steps})")
    weight = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {f})) * {upper} / {3 * steps})"


def normal_sql(z: str) -> str:
    """Probability between 0 and ``z``."""
    return integral_sql("(0.3989422804014327 * pow(2.718281828459045, -0.5 * x * x))", z)


def haversine_sql(x1, y1, x2, y2) -> str:
    return (
        f"(2 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(({y2} - {y1}) / 2)) * sin(radians(({y2} - {y1}) / 2))"
        f" + cos(radians({y1})) * cos(radians({y2})) * sin(radians(({x2} - {x1}) / 2))"
        f" * sin(radians(({x2} - {x1}) / 2))))))"
    )


def inside_sql(rings, x="lon", y="lat") -> str:
    """Parity over every edge of a polygon, given as one ring or as a list of rings."""
    parts = []
    for ring in rings if isinstance(rings[0][0], (list, tuple)) else [rings]:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay == by:
                continue
            parts.append(
                f"(CASE WHEN (({ay} > {y}) <> ({by} > {y})) AND {x} < (CAST({bx} AS DOUBLE) - CAST({ax} AS DOUBLE)) * ({y} - {ay})"
                f" / (CAST({by} AS DOUBLE) - CAST({ay} AS DOUBLE)) + {ax} THEN 1 ELSE 0 END)"
            )
    dbl = " + ".join(parts)
    return f"coalesce(({dbl}) % 2 = 1, false)"


OCC = f"occ AS ({OCCURRENCES})"

DATED = OCC + """,
dated AS (
  SELECT * EXCLUDE (year, month, day),
    CAST(coalesce(extract(year FROM event_day), year) AS INT) AS year,
    CAST(coalesce(extract(month FROM event_day), month) AS INT) AS month,
    CAST(coalesce(extract(day FROM event_day), day) AS INT) AS day
  FROM (SELECT *, try_cast(substr(event_date, 1, 10) AS DATE) AS event_day FROM occ)
)"""

CLEAN = DATED + """,
cl AS (SELECT * FROM dated WHERE lon IS NOT NULL AND lat IS NOT NULL AND species IS NOT NULL
       AND species <> '' AND year BETWEEN 1950 AND 2025)"""


def _near(kind: str, radius: float) -> str:
    return " OR ".join(
        f"{haversine_sql('lon', 'lat', f'CAST({x} AS DOUBLE)', f'CAST({y} AS DOUBLE)')} <= {radius}"
        for k, _, x, y in PLACES
        if k == kind
    )


FLAGGED = DATED + f""",
loc AS (SELECT species, lon, lat, count(*) AS n FROM dated
        WHERE species IS NOT NULL AND species <> '' AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2, 3),
spn AS (SELECT species, sum(n) AS nn FROM loc GROUP BY 1 HAVING sum(n) >= 10),
md AS (SELECT a.species, a.lon, a.lat, any_value(a.n) AS n,
         round(sum(b.n * {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}) / (any_value(s.nn) - 1), 3) AS d
       FROM loc a JOIN spn s ON a.species = s.species JOIN loc b ON a.species = b.species GROUP BY 1, 2, 3),
mdr AS (SELECT md.species, md.d FROM dated t JOIN md USING (species, lon, lat)),
lim AS (SELECT species, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM mdr GROUP BY 1),
far AS (SELECT md.species, md.lon, md.lat FROM md JOIN lim USING (species) WHERE d > q3 + 5 * (q3 - q1)),
f0 AS (
  SELECT t.*,
    count(*) OVER (PARTITION BY t.species, t.lon, t.lat, t.event_day) AS duplicate_group_size,
    (t.lon IS NULL OR t.lat IS NULL) AS flag_missing_coords,
    coalesce(uncertainty_m >= 10000, false) AS flag_high_uncertainty,
    coalesce(basis_of_record IN ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN'), false) AS flag_inappropriate_basis,
    (t.species IS NULL OR t.species = '') AS flag_missing_species,
    NOT coalesce(year BETWEEN 1950 AND 2025, false) AS flag_invalid_date,
    coalesce({_near('capital', 10000).replace('lon', 't.lon').replace('lat', 't.lat')}, false) AS flag_coord_capitals,
    coalesce({_near('centroid', 5000).replace('lon', 't.lon').replace('lat', 't.lat')}, false) AS flag_coord_centroids,
    coalesce(abs(t.lon) = abs(t.lat), false) AS flag_coord_equal,
    coalesce({_near('hq', 1000).replace('lon', 't.lon').replace('lat', 't.lat')}, false) AS flag_coord_hq,
    coalesce(t.lon = 0 OR t.lat = 0 OR sqrt(t.lon * t.lon + t.lat * t.lat) <= 0.5, false) AS flag_coord_zeros,
    ({" OR ".join(inside_sql(town, 't.lon', 't.lat') for town in URBAN.values())}) AS flag_coord_urban,
    far.species IS NOT NULL AS flag_coord_outliers
  FROM dated t LEFT JOIN far ON t.species = far.species AND t.lon = far.lon AND t.lat = far.lat
),
f AS (SELECT *, duplicate_group_size > 1 AS flag_duplicate,
        ({" OR ".join(COORD_FLAGS)}) AS flag_any_coord_issue FROM f0)"""


def passes_sql(flags) -> str:
    return "(" + " AND ".join(f"NOT {x}" for x in flags) + ")"


def with_sql(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


__all__ = ["FLAGS", "STRATEGIES", "passes"]
