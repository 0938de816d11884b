"""Queries and SQL twins for grids, neighbours, rasters and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.operators import cells as C
from obsweave.operators import environment as E
from obsweave.operators import nearby as N
from obsweave.operators.environment import raster_files_lookup, with_pixel
from obsweave.operators.polygons import add_inside, with_polygons
from obsweave.operators.temporal import with_period
from obsweave.plans.session import scratch_path
from obsweave.plans.skew import distinct_counts
from obsweave.queries.base import (
    BOUNDARY, CLEAN, COLS, DATED, LAND, OCC, URBAN, clean, haversine_sql, inside_sql, occurrences, r, with_sql,
)
from obsweave.queries.temporal import nd, rnd, with_period_sql
from obsweave.sources.raster import write_tiles
from obsweave.sources.reference import RasterGrid, ring_table

QUERIES, ORACLE = {}, {}
GRID = RasterGrid(34.0, 5.0, 0.1)
BANDS = {"elevation": (37, 17, 3000), "temperature": (13, 29, 30), "precipitation": (91, 7, 1500)}
BOX = (34.0, -5.0, 42.0, 5.0)


def query(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def raster(spark: SparkSession) -> DataFrame:
    """Tidy raster over the study area: 100 x 80 pixels, three bands."""
    row, col = F.col("id") / 80, F.col("id") % 80
    base = spark.range(8000).select(F.floor(row).cast("int").alias("row"), col.cast("int").alias("col"))
    value = [
        F.struct(
            F.lit(b).alias("band"),
            F.when((F.col("row") + F.col("col")) % 50 != 0, (F.col("row") * p + F.col("col") * q) % m)
            .cast("double").alias("value"),
        )
        for b, (p, q, m) in BANDS.items()
    ]
    return base.select("row", "col", F.inline(F.array(*value))).select("band", "row", "col", "value")


def band_sql(b: str, row: str, col: str) -> str:
    p, q, m = BANDS[b]
    return (f"CASE WHEN {row} BETWEEN 0 AND 99 AND {col} BETWEEN 0 AND 79 AND ({row} + {col}) % 50 <> 0"
            f" THEN CAST(({row} * {p} + {col} * {q}) % {m} AS DOUBLE) END")


ROW, COL = "CAST(floor((5.0 - {y}) / 0.1) AS INT)", "CAST(floor(({x} - 34.0) / 0.1) AS INT)"


def bands_sql(x: str, y: str) -> str:
    return ", ".join(f"{band_sql(b, ROW.format(y=y), COL.format(x=x))} AS {b}" for b in BANDS)


_GAP = "(0.1 * sqrt(3.0) / 2)"


def hex_sql(src: str) -> str:
    """Nearest centre of the two interleaved lattices that make the hexagons."""
    return f"""(SELECT * EXCLUDE (hx, hy, er, ex, orow, ox, ev),
      CAST(floor(CASE WHEN ev THEN ex - er / 2.0 ELSE ox - orow / 2.0 END + 0.5) AS BIGINT) AS cell_q,
      CAST(CASE WHEN ev THEN er ELSE orow END AS BIGINT) AS cell_r FROM
      (SELECT *, (hx - ex) * (hx - ex) + (hy - er) * (hy - er) * 0.75 <= (hx - ox) * (hx - ox) + (hy - orow) * (hy - orow) * 0.75 AS ev FROM
       (SELECT *, 2 * floor(hy / 2 + 0.5) AS er, floor(hx + 0.5) AS ex, 2 * floor(hy / 2) + 1 AS orow, floor(hx) + 0.5 AS ox FROM
        (SELECT *, lon / 0.1 AS hx, lat / {_GAP} AS hy FROM {src} WHERE lon IS NOT NULL AND lat IS NOT NULL))))"""


HEX = f"""hx AS (SELECT q AS cell_q, r AS cell_r, (q + r / 2.0) * 0.1 AS lon_c, r * {_GAP} AS lat_c FROM
  (SELECT r, unnest(range(CAST(ceil(33.9 / 0.1 - r / 2.0) AS BIGINT), CAST(floor(42.1 / 0.1 - r / 2.0) AS BIGINT) + 1)) AS q
   FROM (SELECT unnest(range(CAST(ceil(-5.1 / {_GAP}) AS BIGINT), CAST(floor(5.1 / {_GAP}) AS BIGINT) + 1)) AS r)))"""
_hm = f"""SELECT cell_q, cell_r, count(species) AS n_records, count(DISTINCT species) AS n_species,
  count(DISTINCT family) AS n_families FROM {hex_sql('occ')} GROUP BY 1, 2"""
query("cell_metrics_hex", lambda s, d: C.cell_metrics(occurrences(s, d)), with_sql(OCC, _hm))
query(
    "cell_metrics_square", lambda s, d: C.cell_metrics(occurrences(s, d), kind="square"),
    with_sql(OCC, """SELECT CAST(floor(lon * 10) AS BIGINT) AS cell_x, CAST(floor(lat * 10) AS BIGINT) AS cell_y,
      count(species) AS n_records, count(DISTINCT species) AS n_species, count(DISTINCT family) AS n_families
      FROM occ WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2"""),
)


def grid(s, d):
    """Hexagons of the boundary with record metrics, empty cells included."""
    cells = C.hex_cells(s, BOX, 0.1, BOUNDARY)
    return C.zero_fill(cells, C.cell_metrics(clean(s, d)), ["cell_q", "cell_r"])


GRID_SQL = CLEAN + ", " + HEX + f""",
gr AS (SELECT hx.*, coalesce(n_records, 0) AS n_records, coalesce(n_species, 0) AS n_species,
  coalesce(n_families, 0) AS n_families, log10(coalesce(n_records, 0) + 1) AS log_records
  FROM hx LEFT JOIN ({_hm.replace("'occ'", "'cl'").replace('FROM occ', 'FROM cl')}) m USING (cell_q, cell_r)
  WHERE {inside_sql(BOUNDARY, 'lon_c', 'lat_c')})"""
query(
    "grid_zero_filled", lambda s, d: rnd(grid(s, d)),
    with_sql(GRID_SQL, f"SELECT cell_q, cell_r, {r('lon_c')} AS lon_c, {r('lat_c')} AS lat_c, n_records, n_species, n_families, {r('log_records')} AS log_records FROM gr"),
)
query(
    "grid_metrics", lambda s, d: rnd(C.grid_metrics(occurrences(s, d), box=BOX, ring=BOUNDARY)),
    with_sql(OCC + ", " + HEX, f"""SELECT cell_q, cell_r, {r('lon_c')} AS lon_c, {r('lat_c')} AS lat_c,
      coalesce(n_records, 0) AS n_records, coalesce(n_species, 0) AS n_species, coalesce(n_families, 0) AS n_families,
      coalesce(n_orders, 0) AS n_orders, {r('log10(coalesce(n_records, 0) + 1)')} AS log_records,
      {r('median_uncertainty')} AS median_uncertainty FROM hx LEFT JOIN
      (SELECT cell_q, cell_r, count(species) AS n_records, count(DISTINCT species) AS n_species, count(DISTINCT family) AS n_families,
       count(DISTINCT tax_order) AS n_orders, median(uncertainty_m) AS median_uncertainty FROM {hex_sql('occ')} GROUP BY 1, 2) m
      USING (cell_q, cell_r) WHERE {inside_sql(BOUNDARY, 'lon_c', 'lat_c')}"""),
)
_eff = lambda scope, where: f"""SELECT '{scope}' AS scope, count(*) AS total_cells, count(*) FILTER (WHERE n_records > 0) AS cells_with_data,
  {r('count(*) FILTER (WHERE n_records > 0) * 100.0 / count(*)')} AS percent_covered, {r('avg(n_records)')} AS mean_records,
  {r('stddev_samp(n_records)')} AS sd_records, max(n_records) AS max_records, {r('stddev_samp(n_records) / avg(n_records)')} AS cv_records,
  {r('avg(n_species)')} AS mean_species, {r('median(n_records)')} AS median_records, {r('median(n_species)')} AS median_species
  FROM gr WHERE {where}"""  # noqa: E731
query(
    "effort_summary", lambda s, d: rnd(C.effort_summary(grid(s, d))),
    with_sql(GRID_SQL, _eff("all_cells", "true") + " UNION ALL " + _eff("sampled_cells", "n_records > 0")),
)
query(
    "cell_completeness", lambda s, d: rnd(C.cell_completeness(clean(s, d))),
    with_sql(CLEAN, f"""SELECT cell_x, cell_y, observed, {r('e')} AS expected, {r('least(observed / e, 1.0)')} AS completeness FROM
      (SELECT *, observed + (n - 1) / n * CASE WHEN f2 > 0 THEN f1 * f1 / (2.0 * f2) ELSE f1 * (f1 - 1) / 2.0 END AS e FROM
       (SELECT cell_x, cell_y, CAST(sum(x) AS DOUBLE) AS n, count(*) AS observed, count(*) FILTER (WHERE x = 1) AS f1,
        count(*) FILTER (WHERE x = 2) AS f2 FROM
        (SELECT CAST(floor(lon * 10) AS BIGINT) AS cell_x, CAST(floor(lat * 10) AS BIGINT) AS cell_y, species, count(*) AS x
         FROM cl GROUP BY ALL) GROUP BY 1, 2))"""),
)
query(
    "inside_boundary",
    lambda s, d: add_inside(clean(s, d), ring_table(s, {"land": LAND}), "inside").groupBy("inside")
    .agg(F.count("*").alias("n")),
    with_sql(CLEAN, f"SELECT {inside_sql(LAND)} AS inside, count(*) AS n FROM cl GROUP BY 1"),
)
query(
    "records_by_polygon",
    lambda s, d: with_polygons(clean(s, d), ring_table(s, URBAN | {"land": LAND}), "polygon")
    .select(F.explode_outer("polygon").alias("polygon")).groupBy("polygon").agg(F.count("*").alias("n")),
    with_sql(CLEAN, " UNION ALL ".join(
        f"SELECT '{k}' AS polygon, count(*) AS n FROM cl WHERE {inside_sql(v)} HAVING count(*) > 0" for k, v in (URBAN | {"land": LAND}).items()
    ) + " UNION ALL SELECT NULL, count(*) FROM cl WHERE NOT (" + " OR ".join(inside_sql(v) for v in (URBAN | {"land": LAND}).values())
        + ") HAVING count(*) > 0"),
)
query("convex_hull", lambda s, d: rnd(C.convex_hull(occurrences(s, d))))


def square_cells(s, d):
    """Occupied 0.1 degree cells with an id and their centre."""
    m = C.cell_metrics(clean(s, d), kind="square")
    return m.select(
        (F.col("cell_x") * 100_000 + F.col("cell_y")).alias("id"),
        ((F.col("cell_x") + 0.5) / 10).alias("lon_c"), ((F.col("cell_y") + 0.5) / 10).alias("lat_c"),
        "n_records", "n_species",
    )


CELLS = CLEAN + f""",
sc AS (SELECT cx * 100000 + cy AS id, (cx + 0.5) / 10 AS lon_c, (cy + 0.5) / 10 AS lat_c, n_records, n_species FROM
  (SELECT CAST(floor(lon * 10) AS BIGINT) AS cx, CAST(floor(lat * 10) AS BIGINT) AS cy, count(species) AS n_records,
   count(DISTINCT species) AS n_species FROM cl GROUP BY 1, 2)),
ap AS (SELECT a.id AS a, b.id AS b, {haversine_sql('a.lon_c', 'a.lat_c', 'b.lon_c', 'b.lat_c')} / 1000 AS km,
  a.n_records AS xa, b.n_records AS xb FROM sc a, sc b WHERE a.id <> b.id)"""


def moran_sql(src: str) -> str:
    return f""", w AS (SELECT a, b, xa, xb, 1.0 / count(*) OVER (PARTITION BY a) AS w FROM {src}),
    us AS (SELECT a, any_value(xa) AS x FROM w GROUP BY 1), mm AS (SELECT avg(x) AS m, count(*) AS n FROM us)
    SELECT (SELECT n FROM mm) AS n, {r('sum(w * (xa - m) * (xb - m)) / (SELECT sum((x - m) * (x - m)) FROM us, mm)')} AS moran_i,
    {r('-1.0 / (any_value(n) - 1)')} AS expected FROM w, mm"""


query(
    "neighbours_15km",
    lambda s, d: rnd(N.neighbours(square_cells(s, d))),
    with_sql(CELLS, f"SELECT a, b, {r('km')} AS km FROM ap WHERE km <= 15"),
)


def moran_distance(s, d):
    from obsweave.plans.session import cut

    cells = cut(square_cells(s, d), "cells")
    return N.morans_i(cells, N.neighbours(cells), "n_records")


def moran_knn(s, d):
    from obsweave.plans.session import cut

    cells = cut(square_cells(s, d).withColumnsRenamed({"lon_c": "lon", "lat_c": "lat"}), "cells")
    pairs = N.knn(cells, cells, 8, exclude_same=True).select(F.col("lid").alias("a"), F.col("rid").alias("b"))
    return N.morans_i(cells, pairs, "n_records")


query("morans_i", lambda s, d: rnd(moran_distance(s, d).select("n", "moran_i", "expected")),
      f"WITH {CELLS}{moran_sql('(SELECT * FROM ap WHERE km <= 15)')}")
query("morans_i_test", lambda s, d: rnd(moran_distance(s, d)))
_knn = "(SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) AS k FROM ap)"
query(
    "knn_cells",
    lambda s, d: rnd(N.knn(*[square_cells(s, d).withColumnsRenamed({"lon_c": "lon", "lat_c": "lat"})] * 2, 8, exclude_same=True)),
    with_sql(CELLS, f"SELECT a AS lid, b AS rid, {r('km')} AS km, CAST(k AS INT) AS rank FROM {_knn} WHERE k <= 8"),
)
query("morans_i_knn", lambda s, d: rnd(moran_knn(s, d).select("n", "moran_i", "expected")),
      f"WITH {CELLS}{moran_sql(f'(SELECT * FROM {_knn} WHERE k <= 8)')}")


def _near(metric):
    def run(s, d):
        cells = C.hex_cells(s, BOX, 0.1, BOUNDARY).select(
            (F.col("cell_q") * 100_000 + F.col("cell_r")).alias("id"), F.col("lon_c").alias("lon"), F.col("lat_c").alias("lat"))
        return N.nearest_distance(cells, clean(s, d), metric)
    return run


for _m, _dist in (("planar", "sqrt((lon_c - lon) * (lon_c - lon) + (lat_c - lat) * (lat_c - lat)) * 111.0"),
                  ("haversine", haversine_sql("lon_c", "lat_c", "lon", "lat") + " / 1000")):
    query(
        f"nearest_record_{_m}", _near(_m),
        with_sql(CLEAN + ", " + HEX, f"""SELECT cell_q * 100000 + cell_r AS id, round(min({_dist}), 6) AS nearest_km FROM hx,
          (SELECT DISTINCT lon, lat FROM cl) WHERE {inside_sql(BOUNDARY, 'lon_c', 'lat_c')} GROUP BY 1"""),
    )

query(
    "raster_at_cells",
    lambda s, d: rnd(E.raster_lookup(square_cells(s, d), raster(s), GRID, list(BANDS), "lon_c", "lat_c")),
    with_sql(CELLS, f"SELECT id, {r('lon_c')} AS lon_c, {r('lat_c')} AS lat_c, n_records, n_species, {bands_sql('lon_c', 'lat_c')} FROM sc"),
)


def density_at_cells(s: SparkSession, d: str) -> DataFrame:
    """Records and mean year per pixel, written as raster tiles and looked up under the cells of the boundary's west half."""
    per = with_pixel(clean(s, d).where("lon between 34 and 42 and lat between -5 and 5"), GRID).groupBy("row", "col").agg(
        F.count("*").cast("double").alias("density"), F.avg("year").alias("mean_year"))
    tidy = per.where("row >= 0 and col >= 0").unpivot(["row", "col"], ["density", "mean_year"], "band", "value")
    path = scratch_path(s, "raster")
    write_tiles(tidy.select("band", "row", "col", "value"), GRID, path, 32, "bil")
    west = square_cells(s, d).select("id", "lon_c", "lat_c").where("lon_c < 38")
    return raster_files_lookup(west, path, ["density", "mean_year"], "lon_c", "lat_c", GRID)


query(
    "raster_files_at_cells", lambda s, d: rnd(density_at_cells(s, d)),
    with_sql(CELLS, f"""SELECT id, {r('lon_c')} AS lon_c, {r('lat_c')} AS lat_c, density, {r('mean_year')} AS mean_year FROM sc LEFT JOIN
      (SELECT {ROW.format(y='lat')} AS pr, {COL.format(x='lon')} AS pc, CAST(count(*) AS DOUBLE) AS density, avg(year) AS mean_year
       FROM cl WHERE lon BETWEEN 34 AND 42 AND lat BETWEEN -5 AND 5 GROUP BY 1, 2)
      ON pr = {ROW.format(y='lat_c')} AND pc = {COL.format(x='lon_c')} WHERE lon_c < 38"""),
)
query(
    "sampled_environment",
    lambda s, d: E.sampled_environment(clean(s, d), raster(s), GRID, list(BANDS)).groupBy(*BANDS).agg(F.sum("n").alias("n")),
    with_sql(CLEAN, f"""SELECT elevation, temperature, precipitation, count(*) AS n FROM
      (SELECT {bands_sql('lon', 'lat')} FROM cl) GROUP BY 1, 2, 3"""),
)


def environment(s, d):
    """Environment under the records against 10,000 points of the boundary."""
    bg = E.background_points(s, BOUNDARY)
    avail = E.raster_lookup(bg, raster(s), GRID, list(BANDS)).select(*BANDS, F.lit(1).cast("long").alias("n"))
    return E.env_comparison(E.sampled_environment(clean(s, d), raster(s), GRID, list(BANDS)), avail)


def long_environment(s, d):
    return E.to_long(environment(s, d), ["type", "n"], list(BANDS))


_bx = "(i + 123)"
ENV = CLEAN + f""",
bg AS (SELECT * FROM (SELECT i, 34.0 + ((0.5 + {_bx} * CAST(0.7548776662466927 AS DOUBLE)) % 1.0) * 8.0 AS lon,
  -5.0 + ((0.5 + {_bx} * CAST(0.5698402909980532 AS DOUBLE)) % 1.0) * 10.0 AS lat FROM (SELECT unnest(range(1, 20001)) AS i))
  WHERE {inside_sql(BOUNDARY)} ORDER BY i LIMIT 10000),
en AS (SELECT 'Sampled' AS type, {bands_sql('lon', 'lat')} FROM cl UNION ALL SELECT 'Available' AS type, {bands_sql('lon', 'lat')} FROM bg),
el AS (SELECT type, variable, value FROM (SELECT * FROM en WHERE elevation IS NOT NULL) UNPIVOT (value FOR variable IN (elevation, temperature, precipitation)))"""
query(
    "env_comparison",
    lambda s, d: rnd(environment(s, d).groupBy("type").agg(
        F.sum("n").alias("n"), *[(F.sum(F.col(b) * F.col("n")) / F.sum("n")).alias(f"mean_{b}") for b in BANDS])),
    with_sql(ENV, "SELECT type, count(*) AS n, " + ", ".join(f"{r(f'avg({b})')} AS mean_{b}" for b in BANDS)
             + " FROM en WHERE elevation IS NOT NULL GROUP BY 1"),
)
query(
    "env_long",
    lambda s, d: long_environment(s, d).groupBy("variable", "type").agg(
        F.sum("n").alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi")),
    with_sql(ENV, "SELECT variable, type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM el GROUP BY 1, 2"),
)
query(
    "ks_environment",
    lambda s, d: rnd(E.ks_two_sample(long_environment(s, d), weight="n").select("variable", "n1", "n2", "d")),
    with_sql(ENV, f"""SELECT variable, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r('max(abs(c1 / n1 - c2 / n2))')} AS d FROM
      (SELECT variable, value, sum(sum(CASE WHEN type = 'Sampled' THEN 1.0 ELSE 0 END)) OVER w AS c1,
       sum(sum(CASE WHEN type = 'Sampled' THEN 0 ELSE 1.0 END)) OVER w AS c2 FROM el GROUP BY 1, 2
       WINDOW w AS (PARTITION BY variable ORDER BY value)) JOIN
      (SELECT variable, count(*) FILTER (WHERE type = 'Sampled') AS n1, count(*) FILTER (WHERE type <> 'Sampled') AS n2 FROM el GROUP BY 1)
      USING (variable) GROUP BY 1, 2, 3"""),
)
_lam = "(d * sqrt(CAST(n1 AS DOUBLE) * n2 / (n1 + n2)))"
query(
    "ks_environment_test",
    lambda s, d: rnd(E.ks_two_sample(long_environment(s, d), weight="n")),
    with_sql(ENV, f"""SELECT variable, n1, n2, {r('d')} AS d, {r('p')} AS p_value, p < 0.05 AS significant FROM
      (SELECT *, CASE WHEN {_lam} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
         lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * {_lam} * {_lam}))))) END AS p FROM
       (SELECT variable, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, max(abs(c1 / n1 - c2 / n2)) AS d FROM
        (SELECT variable, value, sum(sum(CASE WHEN type = 'Sampled' THEN 1.0 ELSE 0 END)) OVER w AS c1,
          sum(sum(CASE WHEN type = 'Sampled' THEN 0 ELSE 1.0 END)) OVER w AS c2 FROM el GROUP BY 1, 2
          WINDOW w AS (PARTITION BY variable ORDER BY value)) JOIN
        (SELECT variable, count(*) FILTER (WHERE type = 'Sampled') AS n1, count(*) FILTER (WHERE type <> 'Sampled') AS n2 FROM el GROUP BY 1)
        USING (variable) GROUP BY 1, 2, 3))"""),
)
query("kde_environment", lambda s, d: rnd(E.kde(long_environment(s, d), weight="n")))
query(
    "by_period",
    lambda s, d: distinct_counts(with_period(_dated(s, d)), ["period"], {"n_species": "species"}, True),
    with_sql(DATED + ", " + with_period_sql("dated"), f"SELECT period, count(*) AS n_records, {nd('species')} AS n_species FROM pr GROUP BY 1"),
)


def _dated(s, d):
    from obsweave.operators.flags import with_dates

    return with_dates(occurrences(s, d), COLS)
