"""LAS files as a Spark data source: ``spark.read.format("las").load(folder)`` and ``df.write.format("las").save(folder)``.

Reading: headers give one partition for each million points of a file, of compressed files as many whole chunks (option ``chunk``: so many points at most); beyond
some hundred partitions those of few points are read several by a task. Files whose box misses the option
``bbox`` (min_x,min_y,max_x,max_y) are never opened again. ``read_las`` reads headers in a Spark job, once, and hands the table on; a bare
``spark.read`` reads them in threads. Files with a bad header are skipped with a warning, and so are compressed ones of formats 6 to 10.
Formats 0 to 3 and 6 to 8 are read with all attributes, 4, 5, 9 and 10 without their wave packets; extra dimensions are columns.

Writing: one file for each value of ``tile`` in a task, so deal rows by tile first (``write_tiles`` does); files get their names only when the job commits.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..lineage import shared_folder
from . import laz
from .files import listed, move, open_read, open_write, remove

# The layout of headers and point records.
_HEAD = struct.Struct("<4sHH16sBB32s32sHHHIIBHI5I3d3d6d")
_SHORT = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("kind", "u1"), ("rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_LONG = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("kind", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_TIME, _RGB, _NIR = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
_WAVE = [("wave", "V29")]
FORMATS = {
    0: _SHORT, 1: _SHORT + _TIME, 2: _SHORT + _RGB, 3: _SHORT + _TIME + _RGB, 4: _SHORT + _TIME + _WAVE, 5: _SHORT + _TIME + _RGB + _WAVE,
    6: _LONG, 7: _LONG + _RGB, 8: _LONG + _RGB + _NIR, 9: _LONG + _WAVE, 10: _LONG + _RGB + _NIR + _WAVE,
}
_EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
_ANGLE_STEP, _CRS_RECORD, _EXTRA_RECORD = 0.006, 2112, 4
CHUNK = 1_000_000

COLUMNS = {
    "x": "double", "y": "double", "z": "double", "classification": "int", "intensity": "int", "return_number": "int", "number_of_returns": "int", "point_source_id": "int",
    "gps_time": "double", "scan_angle_rank": "int", "scan_angle": "double", "scan_direction_flag": "int", "edge_of_flight_line": "int", "user_data": "int", "red": "int", "green": "int",
    "blue": "int", "key_point": "int", "synthetic": "int", "withheld": "int", "overlap": "int",
}
# What a file lacks: one return, no class, nothing else.
_DEFAULTS = {"return_number": 1, "number_of_returns": 1}
_ARROW = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


@dataclass
class Header:
    path: str
    version: tuple[int, int] = (1, 4)
    point_format: int = 6
    record_length: int = 30
    n_points: int = 0
    offset_to_points: int = 375
    scales: tuple = (0.001, 0.001, 0.001)
    offsets: tuple = (0.0, 0.0, 0.0)
    low: tuple = (0.0, 0.0, 0.0)
    high: tuple = (0.0, 0.0, 0.0)
    system_id: str = ""
    software: str = ""
    file_source_id: int = 0
    wkt: str = ""
    descriptions: list = field(default_factory=list)
    extra: list = field(default_factory=list)  # (name, dtype, scale, offset)
    coding: laz.Coding | None = None  # of a compressed file
    size: int = 0

    def dtype(self) -> np.dtype:
        names = FORMATS[self.point_format] + [(f"+{name}", kind) for name, kind, _, _ in self.extra]
        gap = self.record_length - np.dtype(names).itemsize
        if gap < 0:
            raise ValueError(f"{self.path}: records of {self.record_length} bytes are too short")
        return np.dtype(names + ([("rest", f"V{gap}")] if gap else []))


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("ascii", "replace").strip()


def read_header(path: str) -> Header:
    """Header and records before the points; raises ValueError for anything else than a readable LAS file."""
    with open_read(path) as f:
        raw = f.read(375)
        if len(raw) < 227 or raw[:4] != b"LASF":
            raise ValueError(f"{path}: not a LAS file")
        v = _HEAD.unpack(raw[: _HEAD.size])
        major, minor, size, at, records, kind, length = v[4], v[5], v[10], v[11], v[12], v[13], v[14]
        if kind & 0x40 or (kind & 0x3F) not in FORMATS:
            raise ValueError(f"{path}: unknown point format {kind}")
        n = v[15]
        if (major, minor) >= (1, 4) and size >= 375:
            n = struct.unpack_from("<Q", raw, 247)[0] or n
        box = v[27:33]
        out = Header(path, (major, minor), kind & 0x3F, length, n, at, tuple(v[21:24]), tuple(v[24:27]), (box[1], box[3], box[5]), (box[0], box[2], box[4]), _text(v[6]), _text(v[7]), v[1])
        f.seek(size)
        for _ in range(records):
            head = f.read(54)
            if len(head) < 54:
                break
            user, number, many = _text(head[2:18]), *struct.unpack_from("<HH", head, 18)
            out.descriptions.append(_text(head[22:54]))
            body = f.read(many)
            if user == "LASF_Projection" and number == _CRS_RECORD:
                out.wkt = body.split(b"\0", 1)[0].decode("ascii", "replace")
            elif user == laz.RECORD_USER and number == laz.RECORD_NUMBER and kind & 0x80:
                out.coding = laz.read_coding(body)
            elif user == "LASF_Spec" and number == _EXTRA_RECORD:
                for i in range(0, len(body) - 191, 192):
                    r = body[i : i + 192]
                    if r[2] in _EXTRA:
                        scale = struct.unpack_from("<d", r, 112)[0] if r[3] & 8 else 1.0
                        shift = struct.unpack_from("<d", r, 136)[0] if r[3] & 16 else 0.0
                        out.extra.append((_text(r[4:36]), _EXTRA[r[2]], scale, shift))
        out.dtype()
        if kind & 0x80:
            if out.coding is None or sum(size for _, size in out.coding.items) != length:
                raise ValueError(f"{path}: compressed, but how is not said")
            f.seek(0, os.SEEK_END)
            out.size = f.tell()
        return out


def safe_attribute(points: np.ndarray, name: str, default: int = 0) -> np.ndarray:
    """A field of point records, or a constant if the format lacks it."""
    return points[name] if name in points.dtype.names else np.full(len(points), default)


def decode(points: np.ndarray, h: Header) -> dict[str, np.ndarray]:
    """Columns of point records."""
    get = lambda name, default=0: safe_attribute(points, name, default)
    out = {c: points[c.upper()] * h.scales[i] + h.offsets[i] for i, c in enumerate("xyz")}
    bits, kind = points["bits"], points["kind"]
    if h.point_format >= 6:
        flags = points["flags"]
        out |= {"return_number": bits & 15, "number_of_returns": bits >> 4, "classification": kind, "scan_angle": points["angle"] * _ANGLE_STEP, "scan_angle_rank": np.round(points["angle"] * _ANGLE_STEP)}
        out |= {"synthetic": flags & 1, "key_point": (flags >> 1) & 1, "withheld": (flags >> 2) & 1, "overlap": (flags >> 3) & 1, "scan_direction_flag": (flags >> 6) & 1, "edge_of_flight_line": flags >> 7}
    else:
        out |= {"return_number": bits & 7, "number_of_returns": (bits >> 3) & 7, "scan_direction_flag": (bits >> 6) & 1, "edge_of_flight_line": bits >> 7}
        out |= {"classification": kind & 31, "synthetic": (kind >> 5) & 1, "key_point": (kind >> 6) & 1, "withheld": kind >> 7, "overlap": (kind & 31) == 12, "scan_angle_rank": points["rank"], "scan_angle": points["rank"].astype(float)}
    out |= {c: get(c) for c in ("intensity", "point_source_id", "gps_time", "user_data", "red", "green", "blue")}
    for name, _, scale, shift in h.extra:
        out[name] = points[f"+{name}"] * scale + shift if (scale, shift) != (1.0, 0.0) else points[f"+{name}"]
    return out


def _spark_kind(kind: str, scaled: bool) -> str:
    return "double" if scaled or kind in ("<f4", "<f8") else "bigint" if kind in ("<u4", "<u8", "<i8") else "int"


def _try_header(path: str) -> tuple[str, str | None, str | None]:
    """(path, header as JSON or None, what is wrong or None)."""
    try:
        return path, json.dumps(asdict(read_header(path))), None
    except (ValueError, OSError, struct.error) as e:
        return path, None, str(e)


def _from_json(text: str) -> Header:
    h = Header(**json.loads(text))
    h.coding = laz.Coding(h.coding["chunk_size"], [tuple(i) for i in h.coding["items"]]) if h.coding else None
    h.version, h.scales, h.offsets, h.low, h.high = (tuple(v) for v in (h.version, h.scales, h.offsets, h.low, h.high))
    h.extra = [tuple(e) for e in h.extra]
    return h


def _sorted_out(tried: list[tuple]) -> tuple[list[Header], list[str]]:
    for _, _, wrong in tried:
        if wrong:
            warnings.warn(f"skipped: {wrong}", stacklevel=3)
    return [_from_json(h) for _, h, _ in tried if h], [p for p, h, _ in tried if not h]


def headers(path: str, table: str | None = None, threads: int = 16) -> tuple[list[Header], list[str]]:
    """Readable headers of a folder in order, and the files skipped. table: where scan_headers() put them."""
    if table:
        with open_read(table) as f:
            return [_from_json(line) for line in f.read().decode().splitlines()], []
    with ThreadPoolExecutor(threads) as pool:
        return _sorted_out(list(pool.map(_try_header, listed(path, ("*.las", "*.laz")))))


def scan_headers(spark: SparkSession, path: str, files_a_task: int = 64) -> tuple[list[Header], list[str]]:
    """headers(), read by a Spark job over the listing; a row a file comes back."""
    paths = listed(path, ("*.las", "*.laz"))
    if len(paths) <= files_a_task:
        return headers(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with ThreadPoolExecutor(8) as pool:
                rows = list(pool.map(_try_header, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "header", "wrong"])

    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(-(-len(paths) // files_a_task))
    return _sorted_out(sorted(map(tuple, listing.mapInArrow(read, "path string, header string, wrong string").collect())))


@dataclass
class Chunk(InputPartition):
    header: Header
    first: int
    n: int
    pieces: list = field(default_factory=list)  # (place, bytes, points) of whole chunks of a compressed file


@dataclass
class Several(InputPartition):
    parts: list


def _together(parts: list[Chunk], most: int = 256) -> list[InputPartition]:
    """Parts that follow one another as one partition, where there are so many that tasks would do little else than begin: about ``most`` then, none of many more than CHUNK points."""
    if len(parts) <= most:
        return parts
    aim = min(CHUNK, -(-sum(p.n for p in parts) // most))
    out: list[Several] = []
    held = aim
    for p in parts:
        if held >= aim:
            out.append(Several([]))
            held = 0
        out[-1].parts.append(p)
        held += p.n
    return out


def _compressed_parts(h: Header, most: int) -> list[Chunk]:
    """Whole chunks in file order, so many together that they have at most so many points, one at least."""
    with open_read(h.path) as f:

        def read_at(place: int, many: int) -> bytes:
            f.seek(place)
            return f.read(many)

        table = laz.chunk_table(read_at, h.offset_to_points, h.size, h.coding, h.n_points)
    out: list[Chunk] = []
    at = 0
    for piece in table:
        if not out or out[-1].n + piece[2] > most:
            out.append(Chunk(h, at, 0, []))
        out[-1].pieces.append(piece)
        out[-1].n += piece[2]
        at += piece[2]
    return out


class LasReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Chunk]:
        found, _ = headers(self.options["path"], self.options.get("headers"))
        box = self.options.get("bbox")
        if box:
            x0, y0, x1, y1 = map(float, box.split(","))
            found = [h for h in found if h.high[0] >= x0 and h.low[0] <= x1 and h.high[1] >= y0 and h.low[1] <= y1]
        chunk = int(self.options.get("chunk", CHUNK))
        packed = [h for h in found if h.coding and h.n_points]
        with ThreadPoolExecutor(16) as pool:
            pieces = dict(zip([h.path for h in packed], pool.map(lambda h: _compressed_parts(h, chunk), packed)))
        out: list[Chunk] = []
        for h in found:
            out += pieces[h.path] if h.path in pieces else [Chunk(h, i, min(chunk, h.n_points - i)) for i in range(0, h.n_points, chunk)]
        return _together(out) or [Chunk(Header(""), 0, 0)]

    def read(self, part: InputPartition):
        for own in part.parts if isinstance(part, Several) else [part]:
            yield from self._read(own)

    def _read(self, part: Chunk):
        h = part.header
        if not part.n:
            return
        if not h.coding:
            with open_read(h.path) as f:
                f.seek(h.offset_to_points + part.first * h.record_length)
                raw = f.read(part.n * h.record_length)
            yield from self._batches(h, part.first, np.frombuffer(raw, dtype=h.dtype(), count=len(raw) // h.record_length))
        first = part.first
        for place, size, n in part.pieces:
            with open_read(h.path) as f:
                f.seek(place)
                raw = f.read(size)
            yield from self._batches(h, first, laz.records(raw, n, h.coding, h.dtype()))
            first += n

    def _batches(self, h: Header, first: int, points: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(points), 50_000):
            own = decode(points[lo : lo + 50_000], h)
            n = len(own["x"])
            columns = []
            for f_ in self.schema.fields:
                kind = _ARROW[f_.dataType.simpleString()]
                if f_.name == "file":
                    columns.append(pa.array([os.path.basename(h.path)] * n, kind))
                elif f_.name == "point_idx":
                    columns.append(pa.array(np.arange(first + lo, first + lo + n), kind))
                elif f_.name in own:
                    columns.append(pa.array(own[f_.name].astype(kind.to_pandas_dtype())))
                elif f_.name in COLUMNS:
                    columns.append(pa.array(np.full(n, _DEFAULTS.get(f_.name, 0)).astype(kind.to_pandas_dtype())))
                else:
                    columns.append(pa.nulls(n, kind))  # an extra dimension of other files
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    files: list


class LasWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.options = schema.names, options
        if "tile" not in self.names:
            raise ValueError("rows need a column tile")
        if not overwrite and listed(options["path"], ("*.las", "*.laz")):
            raise ValueError(f"{options['path']} has files already")
        self.old = listed(options["path"], ("*.las", "*.laz")) if overwrite else []

    def write(self, batches) -> Written:
        """One file a tile under a temporary name. Rows of a tile follow one another, so one is open at a time."""
        out, tile, held = [], None, []

        def close():
            if held:
                ending = "laz" if self.options.get("compress", "false").lower() == "true" else "las"
                name = self.options.get("name", f"tile_{{}}.{ending}").format(tile)
                made = f"{self.options['path'].rstrip('/')}/.{name}.{uuid.uuid4().hex}"
                write_file(made, pa.Table.from_batches(held), self.options)
                out.append((made, f"{self.options['path'].rstrip('/')}/{name}"))
                held.clear()

        for batch in batches:
            tiles = batch.column(self.names.index("tile")).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            for lo, hi in zip(cut, cut[1:]):
                if hi > lo:
                    if tiles[lo] != tile:
                        close()
                        tile = tiles[lo]
                    held.append(batch.slice(lo, hi - lo))
        close()
        return Written(out)

    def commit(self, messages) -> None:
        made = [f for m in messages if m is not None for f in m.files]
        targets = [t for _, t in made]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise RuntimeError("a tile came from two tasks: deal rows by tile before writing")
        for source, target in made:
            move(source, target)
        for path in set(self.old) - set(targets):
            remove(path)

    def abort(self, messages) -> None:
        for m in messages:
            for source, _ in m.files if m is not None else ():
                remove(source)


def write_file(path: str, table: pa.Table, options: dict | None = None) -> None:
    """One LAS file, version 1.4 by default format 6, or 7 with colours; other numeric columns become extra dimensions.

    compress: chunks of the pointwise coder, for formats 0 to 3, which are then the default.
    """
    o = options or {}
    get = lambda c, default=0: np.nan_to_num(table[c].to_numpy().astype(np.float64), nan=default) if c in table.column_names else np.full(table.num_rows, default)
    packed = str(o.get("compress", "false")).lower() == "true"
    kind = int(o.get("point_format", (3 if packed else 7) if {"red", "green", "blue"} <= set(table.column_names) and (get("red").any() or get("green").any() or get("blue").any()) else 1 if packed else 6))
    if kind not in FORMATS or kind in (4, 5, 9, 10):
        raise ValueError(f"point format {kind} can't be written")
    scale = tuple(map(float, str(o.get("scale", "0.001,0.001,0.001")).split(",")))
    xyz = [get(c) for c in "xyz"]
    shift = tuple(float(np.floor(v.min())) if len(v) else 0.0 for v in xyz)
    skip = {*COLUMNS, "tile", "file", "point_idx"}
    extra = [(c, table.schema.field(c).type) for c in table.column_names if c not in skip and (pa.types.is_integer(table.schema.field(c).type) or pa.types.is_floating(table.schema.field(c).type))]
    codes = {np.dtype(v).newbyteorder("="): k for k, v in _EXTRA.items()}
    dims = [(c, codes[np.dtype(t.to_pandas_dtype()).newbyteorder("=")]) for c, t in extra]
    h = Header(path, point_format=kind, scales=scale, offsets=shift, extra=[(c, _EXTRA[k], 1.0, 0.0) for c, k in dims])
    h.record_length = np.dtype(FORMATS[kind]).itemsize + sum(np.dtype(_EXTRA[k]).itemsize for _, k in dims)
    p = np.zeros(table.num_rows, dtype=h.dtype())
    for i, c in enumerate("XYZ"):
        p[c] = np.round((xyz[i] - shift[i]) / scale[i])
    whole = lambda c, default=0: get(c, default).astype(np.int64)
    p["intensity"], p["user_data"], p["point_source_id"] = whole("intensity"), whole("user_data"), whole("point_source_id")
    returns, many = whole("return_number", 1), whole("number_of_returns", 1)
    if kind >= 6:
        p["bits"] = np.clip(returns, 0, 15) | (np.clip(many, 0, 15) << 4)
        p["flags"] = whole("synthetic") | (whole("key_point") << 1) | (whole("withheld") << 2) | (whole("overlap") << 3) | (whole("scan_direction_flag") << 6) | (whole("edge_of_flight_line") << 7)
        p["kind"] = whole("classification")
        angle = get("scan_angle") if "scan_angle" in table.column_names else get("scan_angle_rank")
        p["angle"] = np.round(angle / _ANGLE_STEP)
    else:
        p["bits"] = np.clip(returns, 0, 7) | (np.clip(many, 0, 7) << 3) | (whole("scan_direction_flag") << 6) | (whole("edge_of_flight_line") << 7)
        p["kind"] = (whole("classification") & 31) | (whole("synthetic") << 5) | (whole("key_point") << 6) | (whole("withheld") << 7)
        p["rank"] = np.round(get("scan_angle_rank") if "scan_angle_rank" in table.column_names else get("scan_angle"))
    for c in ("gps_time", "red", "green", "blue"):
        if c in p.dtype.names:
            p[c] = get(c)
    for c, _ in dims:
        p[f"+{c}"] = table[c].fill_null(0).to_numpy()
    records = []
    wkt = o.get("wkt", "")
    if wkt:
        records.append((b"LASF_Projection", _CRS_RECORD, wkt.encode("ascii", "replace") + b"\0"))
    if dims:
        body = b"".join(struct.pack("<2xBB32s156x", k, 0, c.encode("ascii", "replace")[:32]) for c, k in dims)
        records.append((b"LASF_Spec", _EXTRA_RECORD, body))
    coding = laz.coding_of(kind, h.record_length - np.dtype(FORMATS[kind]).itemsize, int(o.get("chunk", 50_000))) if packed else None
    if coding:
        records.append((laz.RECORD_USER.encode(), laz.RECORD_NUMBER, laz.coding_record(coding)))
    blob = b"".join(struct.pack("<2x16sHH32x", user, number, len(body)) + body for user, number, body in records)
    n = len(p)
    by_return = np.bincount(np.clip(returns, 1, 15), minlength=16)[1:16] if n else np.zeros(15, dtype=np.int64)
    legacy = n if kind < 6 and n < 1 << 32 else 0
    back = [p[c] * scale[i] + shift[i] for i, c in enumerate("XYZ")]
    box = [v for b in back for v in ((float(b.max()), float(b.min())) if n else (0.0, 0.0))]
    head = _HEAD.pack(
        b"LASF", 0, 16 if wkt else 0, b"", 1, 4, str(o.get("system_id", "")).encode()[:32], str(o.get("software", "")).encode()[:32], 1, 2000, 375, 375 + len(blob), len(records), kind | (0x80 if packed else 0), h.record_length, legacy,
        *(by_return[:5].tolist() if legacy else [0] * 5), *scale, *shift, *box,
    )
    with open_write(path) as f:
        f.write(head + struct.pack("<QQIQ15Q", 0, 0, 0, n, *by_return.tolist()) + blob + (laz.write_points(p.tobytes(), h.record_length, coding, 375 + len(blob)) if coding else p.tobytes()))


class LasSource(DataSource):
    """Options: path, bbox, chunk, headers (see scan_headers); for writing also name, point_format, compress, scale, wkt, system_id, software."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        """All known columns, and the extra dimensions of any file."""
        names = dict(COLUMNS)
        for h in headers(self.options["path"], self.options.get("headers"))[0]:
            for name, kind, scale, shift in h.extra:
                own = _spark_kind(kind, (scale, shift) != (1.0, 0.0))
                names[name] = own if names.get(name, own) == own else "double"
        return ", ".join(f"`{k}` {v}" for k, v in names.items()) + ", file string, point_idx bigint"

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(schema, dict(self.options), overwrite)


def read_las(spark: SparkSession, path: str, **options) -> DataFrame:
    """Points of a folder; its headers are read by one Spark job and handed on."""
    spark.dataSource.register(LasSource)
    return _read_with(spark, path, scan_headers(spark, path)[0], **options)


def _read_with(spark: SparkSession, path: str, found: list[Header], **options) -> DataFrame:
    table = f"{shared_folder(spark).rstrip('/')}/cloudloom/headers-{uuid.uuid4().hex}.json"
    with open_write(table) as f:
        f.write("\n".join(json.dumps(asdict(h)) for h in found).encode())
    return spark.read.format("las").options(**options | {"headers": table}).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, from headers alone: box, count, format, writer and reference system."""
    rows = [
        (os.path.basename(h.path), h.n_points, *h.low, *h.high, f"{h.version[0]}.{h.version[1]}", h.point_format, h.system_id, h.software, h.file_source_id, h.wkt, h.descriptions, [e[0] for e in h.extra])
        for h in scan_headers(spark, path)[0]
    ]
    schema = "file string, n_points long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, version string, point_format int, system_id string, software string, file_source_id int, wkt string, descriptions array<string>, extra array<string>"
    return spark.createDataFrame(rows, schema)


def crs_by_file(spark: SparkSession, path: str) -> dict[str, str]:
    """The reference system of each file that has one."""
    return {os.path.basename(h.path): h.wkt for h in scan_headers(spark, path)[0] if h.wkt}


def template(path: str) -> dict:
    """What new files take over from the first readable one, and the extra dimensions of all."""
    found, _ = headers(path)
    if not found:
        raise ValueError(f"no readable file in {path}")
    first = found[0]
    extra = {name: kind for h in found for name, kind, _, _ in h.extra}
    return {"version": first.version, "point_format": first.point_format, "scale": ",".join(map(str, first.scales)), "wkt": first.wkt, "extra": dict(sorted(extra.items()))}


def write_tiles(points: DataFrame, path: str, mode: str = "append", **options) -> None:
    """One file for each tile; rows are dealt by tile once."""
    points.sparkSession.dataSource.register(LasSource)
    points.repartition("tile").sortWithinPartitions("tile").write.format("las").mode(mode).options(**options).save(path)


def write_split(points: DataFrame, path: str, keep: str = "keep", **options) -> None:
    """Kept points to the tile files, dropped ones to noise files in a folder beside them."""
    from ..operators.selection import split_by_mask

    clean, noise = split_by_mask(points, keep)
    write_tiles(clean, path, mode="overwrite", **options)
    write_tiles(noise, f"{path.rstrip('/')}/noise", mode="overwrite", **options | {"name": "{}_noise.las"})


def import_folder(spark: SparkSession, path: str, target: int = 1_500_000, size: float | None = None, overlap: float = 0.0, least: int = 0) -> DataFrame:
    """Points of all strips of a folder with the tile each belongs to, over one grid made from the headers; tiles of fewer than ``least`` points go."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from ..operators.tiling import TileGrid, auto_tile_size

    readable, _ = scan_headers(spark, path)
    found = [h for h in readable if h.n_points]
    if not found:
        raise ValueError(f"no points in {path}")
    x0, y0 = min(h.low[0] for h in found), min(h.low[1] for h in found)
    x1, y1 = max(h.high[0] for h in found), max(h.high[1] for h in found)
    edge = size or auto_tile_size(sum(h.n_points for h in found), (x1 - x0) * (y1 - y0), target)
    spark.dataSource.register(LasSource)
    points = _read_with(spark, path, readable).withColumn("tile", TileGrid(x0, y0, x1, y1, edge, overlap).index())
    if least > 1:
        points = points.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("tile"))).where(F.col("_n") >= least).drop("_n")
    return points
