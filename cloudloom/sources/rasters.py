"""Grids as ESRI ASCII files and GeoTIFF, north row first. A grid is a table of cells (row, col, z), row 0 in the south."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_read, open_write

NODATA = -9999.0
# Sizes of TIFF field types, and the tags read and written.
_SIZE = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


def ascii_grid(values: np.ndarray, x0: float, y0: float, size: float, nodata: float = NODATA) -> str:
    """Text of a grid whose first array row is the southern one."""
    head = [f"ncols         {values.shape[1]}", f"nrows         {values.shape[0]}", f"xllcorner     {x0:.6f}", f"yllcorner     {y0:.6f}", f"cellsize      {size:.6f}", f"NODATA_value  {nodata:.1f}"]
    filled = np.where(np.isnan(values), nodata, values)[::-1]
    return "\n".join(head + [" ".join(f"{v:.3f}" for v in row) for row in filled]) + "\n"


def parse_ascii_grid(text: str) -> tuple[np.ndarray, float, float, float]:
    """(values with the southern row first, x0, y0, size); missing values are NaN."""
    lines = text.split("\n")
    head = dict(line.split()[:2] for line in lines[:6])
    head = {k.lower(): float(v) for k, v in head.items()}
    values = np.array([float(v) for line in lines[6:] for v in line.split()]).reshape(int(head["nrows"]), int(head["ncols"]))[::-1]
    return np.where(values == head.get("nodata_value", NODATA), np.nan, values), head["xllcorner"], head["yllcorner"], head["cellsize"]


def geotiff(values: np.ndarray, x0: float, y0: float, size: float, kind: str = "u1", epsg: int | None = None) -> bytes:
    """One band in one strip, northern row first. u1: rounded to 0 to 255 with 0 for missing cells; f4 or f8: as they are, missing ones the no-data value."""
    if kind == "u1":
        data, missing = np.where(np.isnan(values), 0, np.clip(np.round(np.nan_to_num(values)), 0, 255)).astype("u1"), "0"
    else:
        data, missing = np.where(np.isnan(values), NODATA, values).astype("<" + kind), f"{NODATA:g}"
    data = np.ascontiguousarray(data[::-1])
    raw, (rows, columns) = data.tobytes(), data.shape
    tags = [
        (WIDTH, 4, [columns]), (HEIGHT, 4, [rows]), (BITS, 3, [data.itemsize * 8]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, [0]), (SAMPLES, 3, [1]),
        (STRIP_ROWS, 4, [rows]), (STRIP_BYTES, 4, [len(raw)]), (282, 5, [1, 1]), (283, 5, [1, 1]), (296, 3, [1]), (SAMPLE_FORMAT, 3, [1 if kind == "u1" else 3]),
        (PIXEL_SCALE, 12, [size, size, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, x0, y0 + rows * size, 0.0]),
    ]
    if epsg:
        tags.append((GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg]))
    tags.append((GDAL_NODATA, 2, missing))
    end = 8 + 2 + 12 * len(tags) + 4
    entries, tail = b"", b""
    for tag, t, value in tags:
        body = value.encode() + b"\0" if t == 2 else struct.pack(f"<{len(value)}{'I' if t == 5 else _SIZE[t][0]}", *value)
        count = len(body) if t == 2 else len(value) // (2 if t == 5 else 1)
        if len(body) > 4:
            slot, tail = struct.pack("<I", end + len(tail)), tail + body + b"\0" * (len(body) % 2)
        else:
            slot = body.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, t, count) + (b"STRP" if tag == STRIPS else slot)
    entries = entries.replace(b"STRP", struct.pack("<I", end + len(tail)))
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + tail + raw


def parse_geotiff(raw: bytes) -> dict:
    """values (southern row first, NaN for missing), x0, y0, size, epsg, nodata of an uncompressed single band in strips or tiles."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, t, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if t not in _SIZE:
            continue
        code, width = _SIZE[t]
        where = at + 10 + 12 * i
        if count * width > 4:
            where = struct.unpack_from(order + "I", raw, where)[0]
        if t == 2:
            tags[tag] = raw[where : where + count].split(b"\0")[0].decode("ascii", "replace")
        else:
            tags[tag] = list(struct.unpack_from(order + code * count, raw, where))
    if tags.get(COMPRESSION, [1])[0] != 1:
        raise ValueError("compressed TIFF files can't be read")
    if tags.get(SAMPLES, [1])[0] != 1:
        raise ValueError("more than one band")
    rows, columns = tags[HEIGHT][0], tags[WIDTH][0]
    form, bits = tags.get(SAMPLE_FORMAT, [1])[0], tags[BITS][0]
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    if TILES in tags:
        tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        across = -(-columns // tw)
        values = np.zeros((-(-rows // th) * th, across * tw), dtype=kind)
        for i, where in enumerate(tags[TILES]):
            r, c = i // across * th, i % across * tw
            values[r : r + th, c : c + tw] = np.frombuffer(raw, kind, tw * th, where).reshape(th, tw)
        values = values[:rows, :columns]
    else:
        data = b"".join(raw[o : o + n] for o, n in zip(tags[STRIPS], tags[STRIP_BYTES]))
        values = np.frombuffer(data, kind, rows * columns).reshape(rows, columns)
    values = values.astype(np.float64)[::-1]
    missing = tags.get(GDAL_NODATA)
    if missing not in (None, ""):
        values = np.where(values == float(missing), np.nan, values)
    scale, tie = tags.get(PIXEL_SCALE, [1.0, 1.0]), tags.get(TIE_POINT, [0.0] * 6)
    size = abs(scale[0])
    epsg = None
    keys = tags.get(GEO_KEYS, [])
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (3072, 2048) and keys[i + 1] == 0 and (epsg is None or keys[i] == 3072):
            epsg = keys[i + 3]
    y1 = tie[4] + tie[1] * abs(scale[1])
    return {"values": values, "x0": tie[3] - tie[0] * size, "y0": y1 - rows * abs(scale[1]), "size": size, "epsg": epsg, "nodata": missing}


def cells_of(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """Cells of one raster that fits the driver, as a water surface of a project does."""
    r, c = np.nonzero(~np.isnan(values))
    return spark.createDataFrame(pa.table({"row": pa.array(r, pa.int64()), "col": pa.array(c, pa.int64()), "z": pa.array(values[r, c])}))


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Cells with a value, and the georeference."""
    with open_read(path) as f:
        found = parse_geotiff(f.read())
    return cells_of(spark, found.pop("values")), found


def write_rasters(cells: DataFrame, folder: str, size: float, tile_cells: int = 500, form: str = "asc", epsg: int | None = None, kind: str = "f4") -> DataFrame:
    """Cells (row, col, z) of one grid over everything as files of ``tile_cells`` squared cells each; (path, rows, cols) of what was written.

    All files share the grid, so they meet without seams. A file is written by the task that has its cells.
    """
    if form not in ("asc", "tif"):
        raise ValueError("form is asc or tif")
    dealt = cells.withColumns({"tr": F.floor(F.col("row") / tile_cells).cast("long"), "tc": F.floor(F.col("col") / tile_cells).cast("long")})

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table["tr"][0].as_py(), table["tc"][0].as_py()
        r, c = table["row"].to_numpy(), table["col"].to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        values = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)
        values[r - r0, c - c0] = table["z"].to_numpy(zero_copy_only=False)
        path = f"{folder.rstrip('/')}/raster_{tr}_{tc}.{form}"
        args = (values, c0 * size, r0 * size, size)
        with open_write(path) as f:  # the same bytes when a task is run again
            f.write(ascii_grid(*args).encode() if form == "asc" else geotiff(*args, kind=kind, epsg=epsg))
        return pa.table({"path": [path], "rows": pa.array([values.shape[0]], pa.int64()), "cols": pa.array([values.shape[1]], pa.int64())})

    return dealt.groupBy("tr", "tc").applyInArrow(run, "path string, rows long, cols long")


def check_config(size: float, form: str = "asc") -> None:
    """Raise for settings no raster can have."""
    if not size > 0:
        raise ValueError("the cell size must be above 0")
    if form not in ("asc", "tif"):
        raise ValueError(f"unknown form {form!r}")
