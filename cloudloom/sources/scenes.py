"""Training scenes: folders of .npy arrays, binary scans with labels, PLY and text clouds. One row a point.

Files are listed on the driver and read where the rows are made, a file a row of the listing; nothing is unpickled.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_read

# The arrays of a scene and their kinds.
ASSETS = {"coord": ("<f4", 3), "color": ("<f4", 3), "normal": ("<f4", 3), "strength": ("<f4", 1), "segment": ("<i4", 1), "instance": ("<i4", 1)}


def resolve_split(root: str, split: str | Iterable[str]) -> list[str]:
    """Scene folders of a split: a name of a folder, several of them, a JSON list of paths, or a pattern."""
    names, out = [split] if isinstance(split, str) else list(split), []
    for name in names:
        path = os.path.join(root, name)
        if name.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                out += [os.path.join(root, p) for p in json.load(f)]
        elif os.path.isdir(path):
            out += [os.path.join(path, p) for p in sorted(os.listdir(path)) if os.path.isdir(os.path.join(path, p))]
        else:
            folder, pattern = os.path.split(path)
            out += [os.path.join(folder, p) for p in sorted(os.listdir(folder)) if fnmatch.fnmatch(p, pattern)] if os.path.isdir(folder) else []
    return out


def _listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, scene): a task for every few files."""
    rows = [(p, os.path.basename(p.rstrip("/"))) for p in paths]
    return spark.createDataFrame(rows, "path string, scene string").repartition(max(1, min(len(rows), 10_000)), "path")


def _load(path: str) -> np.ndarray | None:
    try:
        with open_read(path) as f:
            return np.lib.format.read_array(f, allow_pickle=False)
    except FileNotFoundError:
        return None


def read_scenes(spark: SparkSession, root: str, split: str | Iterable[str], batch: int = 100_000) -> DataFrame:
    """(scene, i, x, y, z, color, normal, strength, segment, instance); without a segment or an instance they are -1, other missing arrays null."""

    def run(batches):
        for listed in batches:
            for path, scene in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist()):
                own = {k: _load(f"{path}/{k}.npy") for k in ASSETS}
                if own["coord"] is None:
                    raise FileNotFoundError(f"{path}/coord.npy")
                n = len(own["coord"])
                flat = {k: None if v is None else np.asarray(v).astype(ASSETS[k][0]).reshape(n, -1) for k, v in own.items()}
                for lo in range(0, n, batch):
                    cut = {k: None if v is None else v[lo : lo + batch] for k, v in flat.items()}
                    m = len(cut["coord"])
                    vector = lambda k: pa.nulls(m, pa.list_(pa.float32())) if cut[k] is None else pa.array(list(cut[k]), pa.list_(pa.float32()))
                    single = lambda k, kind, other: pa.array(np.full(m, other) if cut[k] is None else cut[k][:, 0], kind) if other is not None or cut[k] is not None else pa.nulls(m, kind)
                    columns = [pa.array([scene] * m), pa.array(np.arange(lo, lo + m))] + [pa.array(np.ascontiguousarray(cut["coord"][:, i]), pa.float32()) for i in range(3)]
                    columns += [vector("color"), vector("normal"), single("strength", pa.float32(), None), single("segment", pa.int32(), -1), single("instance", pa.int32(), -1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["scene", "i", "x", "y", "z", "color", "normal", "strength", "segment", "instance"])

    schema = "scene string, i long, x float, y float, z float, color array<float>, normal array<float>, strength float, segment int, instance int"
    return _listing(spark, resolve_split(root, split)).mapInArrow(run, schema)


def read_scans(spark: SparkSession, scans: list[str], labels: list[str] | None = None, mapping: dict[int, int] | None = None, fields: int = 4, ignore: int = -1) -> DataFrame:
    """(scene, i, x, y, z, strength, segment) of binary scans of 32-bit floats, ``fields`` a point, with labels of 32 bits whose low half is the class;
    mapping gives the class learned, others are ignored."""
    of = dict(zip(scans, labels or [None] * len(scans)))

    def run(batches):
        for listed in batches:
            for path, scene in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist()):
                with open_read(path) as f:
                    p = np.frombuffer(f.read(), "<f4").reshape(-1, fields)
                segment = np.full(len(p), ignore, dtype=np.int32)
                if of[path]:
                    with open_read(of[path]) as f:
                        raw = np.frombuffer(f.read(), "<i4") & 0xFFFF
                    names, back = np.unique(raw, return_inverse=True)
                    segment = np.array([(mapping or {int(v): int(v) for v in names}).get(int(v), ignore) for v in names], dtype=np.int32)[back]
                columns = [pa.array([scene] * len(p)), pa.array(np.arange(len(p)))] + [pa.array(np.ascontiguousarray(p[:, i])) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(segment)], names=["scene", "i", "x", "y", "z", "strength", "segment"])

    return _listing(spark, list(of)).mapInArrow(run, "scene string, i long, x float, y float, z float, strength float, segment int")


def read_scan_infos(spark: SparkSession, info: str, root: str, fields: int = 5) -> DataFrame:
    """Scans named in a JSON list of infos ({lidar_path, gt_segment_path}); pickled lists are refused, for they could run code."""
    if not info.endswith(".json"):
        raise ValueError("infos must be JSON; turn a pickled list into one where it is trusted")
    with open_read(info) as f:
        rows = json.loads(f.read())
    scans = [os.path.join(root, r["lidar_path"]) for r in rows]
    labels = [os.path.join(root, r["gt_segment_path"]) for r in rows] if rows and all("gt_segment_path" in r for r in rows) else None
    return read_scans(spark, scans, labels, fields=fields)


_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_ply(raw: bytes, element: str | None = None) -> np.ndarray:
    """Records of one element (by default the first) of a PLY file, binary or text, without list properties before it."""
    head, _, _ = raw.partition(b"end_header")
    at = raw.index(b"\n", len(head)) + 1
    lines = head.decode("ascii", "replace").splitlines()
    form = next(line.split()[1] for line in lines if line.startswith("format"))
    elements: list[tuple[str, int, list]] = []
    for line in lines:
        words = line.split()
        if words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], None if words[1] == "list" else _PLY[words[1]]))
    mark = ">" if form == "binary_big_endian" else "<"
    text = raw[at:].split() if form == "ascii" else None
    for name, n, properties in elements:
        if any(t is None for _, t in properties):
            raise ValueError("list properties can't be read")
        kind = np.dtype([(p, mark + t) for p, t in properties])
        wanted = element in (None, name)
        if text is not None:
            if wanted:
                flat = np.array(text[: n * len(properties)], dtype=np.float64).reshape(n, -1)
                out = np.zeros(n, dtype=kind)
                for k, (p, _) in enumerate(properties):
                    out[p] = flat[:, k]
                return out
            text = text[n * len(properties) :]
        elif wanted:
            return np.frombuffer(raw, kind, n, at)
        else:
            at += n * kind.itemsize
    raise ValueError(f"no element {element!r}")


def read_ply(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("x", "y", "z", "intensity", "sem_class")) -> DataFrame:
    """(scene, i, columns as double) of PLY files."""

    def run(batches):
        for listed in batches:
            for path, scene in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist()):
                with open_read(path) as f:
                    p = parse_ply(f.read())
                values = [pa.array(p[c].astype(np.float64)) if c in p.dtype.names else pa.nulls(len(p), pa.float64()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([scene] * len(p)), pa.array(np.arange(len(p))), *values], names=["scene", "i", *columns])

    return _listing(spark, paths).mapInArrow(run, "scene string, i long, " + ", ".join(f"`{c}` double" for c in columns))


def read_text_clouds(spark: SparkSession, path: str, names: tuple[str, ...], separator: str = ",") -> DataFrame:
    """(scene, names as double) of text clouds with one point a line, separated by commas or blanks; lines that don't parse are left out."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("scene"), F.trim("value").alias("line"))
    f = F.split("line", r"\s+" if separator in (" ", r"\s+") else F.lit("\\Q" + separator + "\\E"))
    own = lines.where("line <> ''").select("scene", f.alias("f"))
    return own.select("scene", *[F.trim(F.try_element_at("f", F.lit(i + 1))).try_cast("double").alias(n) for i, n in enumerate(names)]).dropna()
