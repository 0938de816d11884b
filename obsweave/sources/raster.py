"""Raster files as tables: text grids (.asc) and flat binary tiles (.bil with .hdr).

A folder holds one folder per band and any number of tiles in each. Every tile is a
partition of its own (large flat tiles several), tiles outside the wanted window or
bands are never opened beyond their header, and of the others only the rows inside
the window are decoded.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from obsweave.sources.reference import RASTER_SCHEMA, RasterGrid

NO_DATA = -9999.0
#: Bytes read for a header, and pixels decoded at a time.
_HEAD, _BLOCK = 4096, 1 << 20
#: Pixels of a flat tile per partition.
_SPLIT = 1 << 24
# Sample types of flat tiles by (pixel type, bits).
_KINDS = {
    ("FLOAT", 32): "f4", ("FLOAT", 64): "f8", ("SIGNEDINT", 8): "i1", ("SIGNEDINT", 16): "i2",
    ("SIGNEDINT", 32): "i4", ("UNSIGNEDINT", 8): "u1", ("UNSIGNEDINT", 16): "u2", ("UNSIGNEDINT", 32): "u4",
}


@dataclass(frozen=True)
class Tile(InputPartition):
    """Rows ``first`` to ``last`` (last one left out) of a file that lies at a place of the whole grid."""

    path: str
    band: str
    west: float
    north: float
    pixel: float
    rows: int
    cols: int
    no_data: float | None
    kind: str | None = None  # sample type of a flat tile
    stride: int = 0  # bytes of its rows
    lines: int = 0  # header lines of a text grid
    row0: int = 0
    col0: int = 0
    first: int = 0
    last: int = 0
    left: int = 0
    right: int = 0


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _pairs(head: str) -> tuple[dict[str, str], int]:
    """Keyword lines at the beginning of a text, and how many they are."""
    found, n = {}, 0
    for line in head.splitlines():
        parts = line.split()
        if len(parts) != 2 or not parts[0][0].isalpha():
            break
        found[parts[0].lower()] = parts[1]
        n += 1
    return found, n


def _text_tile(path: str, band: str, head: str) -> Tile:
    h, n = _pairs(head)
    pixel, rows, cols = float(h["cellsize"]), int(h["nrows"]), int(h["ncols"])
    west = float(h["xllcorner"]) if "xllcorner" in h else float(h["xllcenter"]) - pixel / 2
    south = float(h["yllcorner"]) if "yllcorner" in h else float(h["yllcenter"]) - pixel / 2
    no_data = float(h.get("nodata_value", NO_DATA))
    return Tile(path, band, west, south + rows * pixel, pixel, rows, cols, no_data, lines=n)


def _flat_tile(path: str, band: str, head: str) -> Tile:
    h = {k: v for k, v in (line.lower().split()[:2] for line in head.splitlines() if len(line.split()) > 1)}
    if h.get("nbands", "1") != "1":
        raise ValueError(f"{path}: one band per file is read")
    if float(h["xdim"]) != float(h["ydim"]):
        raise ValueError(f"{path}: pixels have to be square")
    pixel, rows, cols, bits = float(h["xdim"]), int(h["nrows"]), int(h["ncols"]), int(h.get("nbits", 8))
    kind = _KINDS[(h.get("pixeltype", "unsignedint").upper(), bits)]
    order = ">" if h.get("byteorder", "i") == "m" else "<"
    no_data = float(h["nodata"]) if "nodata" in h else None
    stride = int(h.get("totalrowbytes", cols * bits // 8))
    # the header names the centre of the first pixel
    return Tile(path, band, float(h["ulxmap"]) - pixel / 2, float(h["ulymap"]) + pixel / 2, pixel, rows, cols,
                no_data, kind=order + kind, stride=stride)


def tiles(path: str, bands: list[str] | None = None) -> list[Tile]:
    """All tiles below ``path``: one small read per file, of its header only."""
    fs, root = _files(path)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        stem, ext = os.path.splitext(info.path)
        band = os.path.basename(os.path.dirname(info.path)).removeprefix("band=")
        if info.is_file and ext.lower() in (".asc", ".bil") and (bands is None or band in bands):
            found.append((info.path, stem, ext.lower(), band))

    def head(item: tuple[str, str, str, str]) -> Tile:
        file, stem, ext, band = item
        with fs.open_input_file(file if ext == ".asc" else stem + ".hdr") as f:
            text = f.read(_HEAD).decode("ascii", "replace")
        return (_text_tile if ext == ".asc" else _flat_tile)(file, band, text)

    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(head, found), key=lambda t: (t.band, -t.north, t.west, t.path))


def grid_of(found: list[Tile]) -> RasterGrid:
    """The grid that all tiles are parts of."""
    if not found:
        raise ValueError("no tiles")
    pixel = found[0].pixel
    if any(abs(t.pixel - pixel) > 1e-9 * pixel for t in found):
        raise ValueError("tiles differ in pixel size")
    return RasterGrid(min(t.west for t in found), max(t.north for t in found), pixel)


def placed(found: list[Tile], grid: RasterGrid, window: tuple[float, float, float, float] | None) -> list[Tile]:
    """Partitions for the tiles that reach into ``window`` (west, south, east, north), cut to it."""
    out = []
    for t in found:
        row, col = (grid.ymax - t.north) / grid.pixel, (t.west - grid.xmin) / grid.pixel
        row0, col0 = round(row), round(col)
        if max(abs(row - row0), abs(col - col0)) > 1e-3:
            raise ValueError(f"{t.path}: does not lie on the grid")
        top, bottom, left, right = 0, t.rows, 0, t.cols
        if window:
            # the pixel of a place is counted from the grid's corner, as lookups count it
            west, south, east, north = window
            left = max(0, math.floor((west - grid.xmin) / grid.pixel) - col0)
            right = min(t.cols, math.floor((east - grid.xmin) / grid.pixel) + 1 - col0)
            top = max(0, math.floor((grid.ymax - north) / grid.pixel) - row0)
            bottom = min(t.rows, math.floor((grid.ymax - south) / grid.pixel) + 1 - row0)
        if top >= bottom or left >= right:
            continue
        step = max(1, _SPLIT // t.cols) if t.kind else bottom - top  # text has to be read from its beginning
        for a in range(top, bottom, step):
            out.append(replace(t, row0=row0, col0=col0, first=a, last=min(a + step, bottom), left=left, right=right))
    return out


def _blocks(t: Tile, fs: pafs.FileSystem) -> Iterator[tuple[int, np.ndarray]]:
    """(row, values) blocks of a tile's rows, cut to its columns."""
    path = t.path
    step = max(1, _BLOCK // t.cols)
    if t.kind:
        size = int(t.kind[-1])
        with fs.open_input_file(path) as f:
            for a in range(t.first, t.last, step):
                b = min(a + step, t.last)
                raw = np.frombuffer(f.read_at((b - a) * t.stride, a * t.stride), np.uint8).reshape(b - a, t.stride)
                flat = np.ascontiguousarray(raw[:, : t.cols * size]).view(t.kind)
                yield a, flat[:, t.left : t.right].astype(np.float64)
        return
    # values follow one another; writers may break lines anywhere
    todo, held, row = t.last * t.cols, [], 0
    with fs.open_input_stream(path) as f:
        rest, lines = b"", t.lines
        while row < t.last:
            chunk = f.read(_BLOCK)
            rest += chunk
            while lines and b"\n" in rest:
                rest, lines = rest.split(b"\n", 1)[1], lines - 1
            if lines and chunk:
                continue
            # the last word may go on in the next chunk
            at = len(rest) if not chunk else max(rest.rfind(b" "), rest.rfind(b"\n"), rest.rfind(b"\t")) + 1
            held += rest[:at].split()
            rest = rest[at:]
            n = min(len(held) // t.cols, t.last - row)
            if n:
                values = np.array(held[: n * t.cols], dtype="S").astype(np.float64).reshape(n, t.cols)
                skip = max(0, t.first - row)
                if skip < n:
                    yield row + skip, values[skip:, t.left : t.right]
                held, row = held[n * t.cols :], row + n
            elif not chunk:
                raise ValueError(f"{t.path}: ends after {row * t.cols + len(held)} of {todo} values")


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bands = options["bands"].split("\n") if options.get("bands") else None
        box = options.get("window")
        self.window = tuple(float(v) for v in box.split(",")) if box else None
        at = options.get("grid")
        self.grid = RasterGrid(*(float(v) for v in at.split(","))) if at else None

    def partitions(self) -> list[Tile]:
        # without a grid given, all bands together fix it
        found = tiles(self.path, self.bands if self.grid else None)
        grid = self.grid or grid_of(found)
        return placed([t for t in found if self.bands is None or t.band in self.bands], grid, self.window)

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        t = partition
        if t is None:  # nothing to read
            return
        for row, values in _blocks(t, _files(self.path)[0]):
            n, m = values.shape
            none = np.isnan(values)
            if t.no_data is not None:
                none |= values == t.no_data
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t.band] * (n * m)) if n * m < 1 << 12 else pa.DictionaryArray.from_arrays(
                        pa.array(np.zeros(n * m, np.int32)), pa.array([t.band])).cast(pa.string()),
                    pa.array(np.repeat(np.arange(row, row + n, dtype=np.int32) + t.row0, m)),
                    pa.array(np.tile(np.arange(t.left, t.right, dtype=np.int32) + t.col0, n)),
                    pa.array(values.ravel(), mask=none.ravel()),
                ],
                ["band", "row", "col", "value"],
            )


class FilteredReader(RasterReader):
    """A reader for sessions with ``spark.sql.python.filterPushdown.enabled``; Spark refuses it in others."""

    def pushFilters(self, filters):
        """Bands asked for by name leave the other folders unread; Spark checks every filter again."""
        for f in filters:
            wanted = f.value if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
            if wanted is not None and f.attribute == ("band",):
                self.bands = [b for b in wanted if self.bands is None or b in self.bands]
            yield f


class RasterSource(DataSource):
    """``spark.read.format("raster_tiles")`` with options ``path``, ``bands`` (a line each), ``window``, ``grid``
    and ``pushdown`` (``true``: filters on the band reach the files, if the session allows that)."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return RASTER_SCHEMA

    def reader(self, schema) -> RasterReader:
        options = dict(self.options)
        return (FilteredReader if options.get("pushdown") == "true" else RasterReader)(options)


def read_tiles(
    spark: SparkSession, path: str, bands: list[str] | None = None,
    window: tuple[float, float, float, float] | None = None, grid: RasterGrid | None = None,
) -> tuple[DataFrame, RasterGrid]:
    """(band, row, col, value) of the tiles below ``path`` and the grid that rows and columns count in.

    ``bands`` and ``window`` (west, south, east, north) say what is read at all; pixels
    that a place inside the window falls in are all there. No-data is NULL. An empty
    ``bands`` list reads nothing.
    """
    grid = grid or grid_of(tiles(path))
    if bands is not None and not bands:
        return spark.createDataFrame([], RASTER_SCHEMA), grid
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("raster_tiles").option("path", path)
    reader = reader.option("grid", f"{grid.xmin!r},{grid.ymax!r},{grid.pixel!r}")
    if bands is not None:
        reader = reader.option("bands", "\n".join(bands))
    if window:
        reader = reader.option("window", ",".join(repr(float(v)) for v in window))
    return reader.load(), grid


def window_of(points: DataFrame, lon: str = "lon", lat: str = "lat") -> tuple[float, float, float, float] | None:
    """The box that holds all points that have a place; None without any."""
    there = points.where(f"{lon} is not null and {lat} is not null and not isnan({lon}) and not isnan({lat})")
    box = there.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    return None if box[0] is None else tuple(float(v) for v in box)


def write_tiles(raster: DataFrame, grid: RasterGrid, path: str, tile: int = 256, kind: str = "asc") -> int:
    """Write (band, row, col, value) as tiles of at most ``tile`` x ``tile`` pixels; the number of tiles.

    ``kind`` is ``asc`` or ``bil`` (64-bit floats). Absent pixels of a tile and NULL become
    no-data; of a pixel given more than once the greatest value stands. Tiles are complete
    files or absent, however often a task is tried. Rows or columns below 0 are refused.
    """
    if kind not in ("asc", "bil"):
        raise ValueError(kind)

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, r, c = key[0], int(key[1]), int(key[2])
        values = np.full((tile, tile), NO_DATA)
        # rising values: the last one written to a pixel is the greatest
        known = pdf[pdf["value"].notna()].sort_values("value", kind="stable")
        values[known["row"] - r * tile, known["col"] - c * tile] = known["value"]
        height, width = int(pdf["row"].max()) - r * tile + 1, int(pdf["col"].max()) - c * tile + 1
        values = values[:height, :width]
        west, north = grid.xmin + c * tile * grid.pixel, grid.ymax - r * tile * grid.pixel
        fs, root = _files(path)
        stem = f"{root}/band={band}/{r}_{c}"
        fs.create_dir(os.path.dirname(stem), recursive=True)
        if kind == "asc":
            head = (f"ncols {width}\nnrows {height}\nxllcorner {west!r}\nyllcorner {north - height * grid.pixel!r}\n"
                    f"cellsize {grid.pixel!r}\nNODATA_value {NO_DATA!r}\n")  # fmt: skip
            parts = {".asc": (head + "".join(" ".join(map(repr, row)) + "\n" for row in values.tolist())).encode()}
        else:
            half = grid.pixel / 2
            head = (f"BYTEORDER I\nLAYOUT BIL\nNROWS {height}\nNCOLS {width}\nNBANDS 1\nNBITS 64\nPIXELTYPE FLOAT\n"
                    f"ULXMAP {west + half!r}\nULYMAP {north - half!r}\nXDIM {grid.pixel!r}\nYDIM {grid.pixel!r}\nNODATA {NO_DATA!r}\n")  # fmt: skip
            # a tile counts by its .bil, which therefore comes last
            parts = {".hdr": head.encode(), ".bil": values.astype("<f8").tobytes()}
        for ext, data in parts.items():
            own = f"{stem}{ext}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(data)
            fs.move(own, stem + ext)
        return pd.DataFrame({"tiles": [1]})

    checked = raster.withColumn("row", F.when((F.col("row") >= 0) & (F.col("col") >= 0), F.col("row")).otherwise(
        F.raise_error("rows and columns count from 0").cast("int")))
    parts = checked.groupBy("band", F.expr(f"row div {tile}").cast("int").alias("r"), F.expr(f"col div {tile}").cast("int").alias("c"))
    return parts.applyInPandas(save, "tiles long").agg(F.coalesce(F.sum("tiles"), F.lit(0))).first()[0]
