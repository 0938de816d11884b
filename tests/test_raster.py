"""Raster files: round trips, windows, headers of other writers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsweave.operators.environment import raster_files_lookup, raster_lookup
from obsweave.sources.raster import RasterSource, grid_of, placed, read_tiles, tiles, window_of, write_tiles
from obsweave.sources.reference import RASTER_SCHEMA, RasterGrid

GRID = RasterGrid(10.0, 20.0, 0.5)


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(3)
    rows = [(b, r, c, None if (r + c) % 7 == 0 else float(v))
            for b, scale in (("elevation", 1000.0), ("rain", 1e-7))
            for (r, c), v in zip(((r, c) for r in range(37) for c in range(23)), rng.normal(size=37 * 23) * scale)]
    return spark.createDataFrame(rows, RASTER_SCHEMA).cache()


def known(df):
    return {(x["band"], x["row"], x["col"], x["value"]) for x in df.collect() if x["value"] is not None}


@pytest.mark.parametrize("kind", ["asc", "bil"])
def test_round_trip(spark, pixels, tmp_path, kind):
    path = str(tmp_path / kind)
    assert write_tiles(pixels, GRID, path, 10, kind) == 2 * 4 * 3
    back, grid = read_tiles(spark, "file://" + path)
    assert (grid.xmin, grid.ymax, grid.pixel) == (10.0, 20.0, 0.5)
    assert known(back) == known(pixels) and back.count() == 2 * 37 * 23
    assert back.rdd.getNumPartitions() == 24
    # written again over the same files, nothing doubles
    assert write_tiles(pixels, GRID, path, 10, kind) == 24 and known(read_tiles(spark, path)[0]) == known(pixels)


@pytest.mark.parametrize("kind", ["asc", "bil"])
def test_window_and_bands_skip_tiles(spark, pixels, tmp_path, kind):
    path = str(tmp_path / kind)
    write_tiles(pixels, GRID, path, 10, kind)
    window = (15.1, 9.0, 16.9, 11.2)  # columns 10 to 13, rows 17 to 22
    found, _ = read_tiles(spark, path, ["rain"], window)
    assert found.rdd.getNumPartitions() == 2
    inside = pixels.where("band = 'rain' and col between 10 and 13 and row between 17 and 22")
    assert known(found) == known(inside) and found.count() == 4 * 6
    assert read_tiles(spark, path, ["rain"], (50.0, 50.0, 51.0, 51.0))[0].count() == 0
    assert read_tiles(spark, path, [])[0].count() == 0
    assert read_tiles(spark, path, ["nothing"])[0].count() == 0


def test_lookup_equals_the_table(spark, pixels, tmp_path):
    path = str(tmp_path / "t")
    write_tiles(pixels, GRID, path, 8, "bil")
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(9, 16, 300), rng.uniform(3, 21, 300)))]
    pts = spark.createDataFrame([*rows, (300, 10.0, 20.0), (301, None, 5.0), (302, 16.0, 12.0)], "id int, lon double, lat double")
    bands = ["elevation", "rain"]
    got = raster_files_lookup(pts, path, bands).orderBy("id").collect()
    assert got == raster_lookup(pts, pixels, GRID, bands).orderBy("id").collect()
    nowhere = raster_files_lookup(pts.where("id = 301"), path, bands).collect()
    assert [(x["elevation"], x["rain"]) for x in nowhere] == [(None, None)] and window_of(pts.where("id = 301")) is None


def test_headers_of_other_writers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.asc").write_text(
        "NCOLS 3\nNROWS 2\nXLLCENTER 0.5\nYLLCENTER 0.5\nCELLSIZE 1\nNODATA_VALUE -1\n1 2\n3 4 -1\n 6\n")  # lines broken anywhere
    (tmp_path / "b").mkdir()
    np.array([[1, 2, 3, 0], [4, 5, 255, 0]], ">u2").tofile(tmp_path / "b" / "y.bil")  # two bytes of padding a row
    (tmp_path / "b" / "y.hdr").write_text(
        "BYTEORDER M\nLAYOUT BIL\nNROWS 2\nNCOLS 3\nNBANDS 1\nNBITS 16\nTOTALROWBYTES 8\nULXMAP 0.5\nULYMAP 1.5\nXDIM 1\nYDIM 1\nNODATA 255\n")
    df, grid = read_tiles(spark, str(tmp_path))
    assert (grid.xmin, grid.ymax, grid.pixel) == (0.0, 2.0, 1.0)
    assert [tuple(x) for x in df.orderBy("band", "row", "col").collect()] == [
        ("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 0, 2, 3.0), ("a", 1, 0, 4.0), ("a", 1, 1, None), ("a", 1, 2, 6.0),
        ("b", 0, 0, 1.0), ("b", 0, 1, 2.0), ("b", 0, 2, 3.0), ("b", 1, 0, 4.0), ("b", 1, 1, 5.0), ("b", 1, 2, None)]


def test_large_flat_tiles_are_cut_and_strange_ones_refused(tmp_path):
    (tmp_path / "a").mkdir()
    np.zeros((2, 2)).tofile(tmp_path / "a" / "y.bil")
    head = "NROWS {n}\nNCOLS 8192\nNBITS 64\nPIXELTYPE FLOAT\nULXMAP 0.5\nULYMAP {y}\nXDIM {p}\nYDIM {p}\n"
    (tmp_path / "a" / "y.hdr").write_text(head.format(n=10_000, y=9999.5, p=1))
    one = tiles(str(tmp_path))
    parts = placed(one, grid_of(one), None)
    assert [(t.first, t.last) for t in parts] == [(a, min(a + 2048, 10_000)) for a in range(0, 10_000, 2048)]
    with pytest.raises(ValueError, match="grid"):
        placed(one, RasterGrid(0.3, 10_000.0, 1.0), None)
    (tmp_path / "a" / "z.bil").write_bytes(b"")
    (tmp_path / "a" / "z.hdr").write_text(head.format(n=1, y=1, p=2))
    with pytest.raises(ValueError, match="pixel size"):
        grid_of(tiles(str(tmp_path)))
    with pytest.raises(ValueError, match="no tiles"):
        grid_of([])


def test_band_filters_reach_the_source(spark, pixels, tmp_path):
    path = str(tmp_path / "t")
    write_tiles(pixels, GRID, path, 10)
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("raster_tiles").option("path", path).option("pushdown", "true").load().where(F.col("band") == "rain")
        assert df.rdd.getNumPartitions() == 12 and known(df) == known(pixels.where("band = 'rain'"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_and_refused_rows(spark, pixels, tmp_path):
    assert write_tiles(pixels.limit(0), GRID, str(tmp_path / "e")) == 0
    with pytest.raises(Exception, match="count from 0"):
        write_tiles(spark.createDataFrame([("a", -1, 0, 1.0)], RASTER_SCHEMA), GRID, str(tmp_path / "f"))
    twice = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 0, 3.0), ("a", 0, 0, 2.0)], RASTER_SCHEMA)
    write_tiles(twice, GRID, str(tmp_path / "g"))
    assert [x["value"] for x in read_tiles(spark, str(tmp_path / "g"))[0].collect()] == [3.0]
