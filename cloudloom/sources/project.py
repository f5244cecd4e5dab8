"""Project folders: metadata as JSON, and the catalogue as Parquet tables that only grow."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import settle
from ..operators import catalog

# The folders of a project, and its tables.
FOLDERS = ("tiles", "dtm", "backups", "exports")
TABLES = {
    "tiles": "id string, version long, filename string, min_x double, min_y double, max_x double, max_y double, point_count long, flight_line int, scanner string, sensor_type string, crs_epsg int, crs_wkt string, status string, qc_status string, qc_comment string, filter_params string, classification_model string, deleted boolean",
    "edits": "id long, tile string, points array<long>, old array<int>, new int, deleted boolean",
    "times": "tile string, step string, duration double, points long, params string, batch string, moment timestamp",
}


class Project:
    """A project folder that is open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        path = os.path.join(self.root, "project.json")
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        if not os.path.isfile(path):
            raise ValueError(f"{self.root} has no project.json")
        with open(path, encoding="utf-8") as f:
            self.metadata = json.load(f)
        for key in ("name", "version"):
            if key not in self.metadata:
                raise ValueError(f"project.json lacks {key!r}")

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str = "Untitled Project", overwrite: bool = False, now: datetime | None = None, **settings) -> Project:
        """A new folder; an existing one goes only with ``overwrite``, and only if it is a project."""
        if os.path.exists(root):
            if not overwrite:
                raise FileExistsError(root)
            if os.listdir(root) and not os.path.isfile(os.path.join(root, "project.json")):
                raise ValueError(f"{root} is not a project")
            shutil.rmtree(root)
        for folder in FOLDERS:
            os.makedirs(os.path.join(root, folder))
        stamp = (now or datetime.now(timezone.utc)).isoformat()
        with open(os.path.join(root, "project.json"), "w", encoding="utf-8") as f:
            json.dump({"name": name, "version": 1, "created": stamp, "last_opened": stamp, "tile_size_m": 200.0, "tile_overlap_m": 10.0} | settings, f, indent=2)
        return cls(spark, root)

    def save(self) -> None:
        """Metadata, put in place in one step."""
        path = os.path.join(self.root, "project.json")
        made = f"{path}.{uuid.uuid4().hex}"
        with open(made, "w", encoding="utf-8") as f:
            json.dump(self.metadata, f, indent=2)
        os.replace(made, path)

    def _path(self, table: str) -> str:
        return os.path.join(self.root, "catalog", table)

    def table(self, name: str) -> DataFrame:
        """All events of a table; columns that older files lack are null."""
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        if not os.path.isdir(self._path(name)):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self._path(name))

    def append(self, name: str, rows: DataFrame, one_file: bool = True) -> None:
        empty = self.spark.createDataFrame([], TABLES[name])
        unknown = set(rows.columns) - set(empty.columns)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        whole = empty.unionByName(rows, allowMissingColumns=True)
        whole = whole.select(*[F.col(c).cast(t).alias(c) for c, t in empty.dtypes])
        (whole.coalesce(1) if one_file else whole).write.mode("append").parquet(self._path(name))

    def tiles(self, status: str | None = None) -> DataFrame:
        """The present state of each tile: of each field the newest value."""
        fields = [c for c in self.table("tiles").columns if c not in ("id", "version")]
        now = catalog.current_state(self.table("tiles"), "id", ("version",), fields).where("coalesce(deleted, false) = false").drop("deleted")
        return now if status is None else now.where(F.col("status") == status)

    def _next(self) -> int:
        row = self.table("tiles").agg(F.max("version")).first()
        return (row[0] or 0) + 1

    def add_tiles(self, rows: DataFrame) -> None:
        """Insert or replace tiles: fields not given are those of a new tile."""
        version = self._next()
        self.append("tiles", rows.withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(False)}))

    def update(self, tile: str | list[str], **fields) -> None:
        """Set some fields of tiles: status, counts, parameters, reference system or quality marks."""
        ids = [tile] if isinstance(tile, str) else list(tile)
        version = self._next()
        rows = self.spark.createDataFrame([(i,) for i in ids], "id string")
        self.append("tiles", rows.withColumns({"version": F.lit(version).cast("long"), **{k: F.lit(v) for k, v in fields.items()}}))

    def delete_tile(self, tile: str) -> None:
        """A tile and its edits go; its processing times stay."""
        self.update(tile, deleted=True)
        edits = self.table("edits").where((F.col("tile") == tile) & F.coalesce(~F.col("deleted"), F.lit(True)))
        self.append("edits", edits.select("id", "tile", F.lit(True).alias("deleted")).distinct())

    def edits(self, tile: str | None = None, newest: int | None = None) -> DataFrame:
        """Commands that were not cleared; one of very many points has several rows."""
        gone = self.table("edits").where("deleted").select(F.col("id").alias("g"))
        own = self.table("edits").where("coalesce(deleted, false) = false").join(gone, F.col("id") == F.col("g"), "left_anti")
        own = own if tile is None else own.where(F.col("tile") == tile)
        return own if newest is None else own.join(own.select("id").distinct().orderBy(F.desc("id")).limit(newest), "id", "left_semi").orderBy(F.desc("id"))

    def log_edit(self, tile: str, points: list[int], old: list[int], new: int) -> int:
        """Append a classify command, mark the tile as edited, and give the command's number."""
        row = self.table("edits").agg(F.max("id")).first()
        number = (row[0] or 0) + 1
        self.append("edits", self.spark.createDataFrame([(number, tile, points, old, new)], "id long, tile string, points array<long>, old array<int>, new int"))
        self.update(tile, status="EDITED")
        return number

    def log_changes(self, tile: str, changes: DataFrame, most: int = 1 << 16) -> list[int]:
        """log_edit for points in a table (point, old, new): a command for each new class, in their order; the commands' numbers. most: points a row aims at."""
        changes = settle(changes.select("point", "old", "new"))
        held = {r["new"]: r["count"] for r in changes.groupBy("new").count().collect()}  # as many rows as classes
        row = self.table("edits").agg(F.max("id")).first()
        numbered = [((row[0] or 0) + i, v, -(-held[v] // most)) for i, v in enumerate(sorted(held, key=lambda v: (v is not None, v)), 1)]
        if not numbered:
            return []
        commands = self.spark.createDataFrame(numbered, "id long, _new int, parts int")
        dealt = changes.join(F.broadcast(commands), F.col("new").eqNullSafe(F.col("_new"))).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")))
        rows = dealt.groupBy("id", "new", "part").agg(F.sort_array(F.collect_list(F.struct("point", "old"))).alias("p"))
        self.append("edits", rows.select("id", F.lit(tile).alias("tile"), F.col("p.point").alias("points"), F.col("p.old").alias("old"), "new"), one_file=False)
        self.update(tile, status="EDITED")
        return [n for n, _, _ in numbered]

    def record_time(self, tile: str, step: str, duration: float, points: int, batch: str | None = None, moment: datetime | None = None, params: str | None = None) -> None:
        at = moment or datetime.now(timezone.utc)
        self.append("times", self.spark.createDataFrame([(tile, step, float(duration), points, params, batch, at)], "tile string, step string, duration double, points long, params string, batch string, moment timestamp"))

    def validate(self) -> list[str]:
        """What is wrong with the folder."""
        return [f"missing folder {f}" for f in FOLDERS if not os.path.isdir(os.path.join(self.root, f))]


class Editor:
    """An editing session on one tile: selections by condition, classes assigned to them, undo and redo.

    The base points never change; the state is the log laid over them. Undone commands are logged turned round. Points stay in tables:
    the stacks hold numbers of commands, whose points are in the log.
    """

    def __init__(self, project: Project, tile: str, points: DataFrame, most: int = 200):
        self.project, self.tile, self.base, self.most = project, tile, settle(points.where(F.col("tile") == tile)), most
        self.undo_stack: list[int] = []
        self.redo_stack: list[int] = []
        self.selected: DataFrame | None = None

    def points(self) -> DataFrame:
        edits = catalog.flatten_edits(self.project.edits(self.tile))
        last = catalog.last_edit_wins(edits).withColumnRenamed("point", "pid")
        return catalog.reclassify(self.base, last)

    def _logged(self, number: int) -> DataFrame:
        """(point, old, new) of a command."""
        own = self.project.table("edits").where((F.col("id") == number) & ~F.coalesce("deleted", F.lit(False)))
        return catalog.flatten_edits(own).select("point", F.col("old_class").alias("old"), F.col("new_class").alias("new"))

    def select(self, condition) -> int:
        """Select points by a condition; their number."""
        self.selected = settle(self.points().where(condition).select("pid"))
        return self.selected.count()

    def assign(self, new: int) -> int | None:
        if self.selected is None or self.selected.isEmpty():
            return None
        own = self.points().join(self.selected, "pid", "left_semi")
        number, = self.project.log_changes(self.tile, own.select(F.col("pid").alias("point"), F.col("classification").alias("old"), F.lit(new).alias("new")))
        self.undo_stack = [*self.undo_stack, number][-self.most :]
        self.redo_stack.clear()
        return number

    def can_undo(self) -> bool:
        return bool(self.undo_stack)

    def can_redo(self) -> bool:
        return bool(self.redo_stack)

    def undo(self) -> bool:
        """The last command's points get their classes back, one logged command for each class."""
        if not self.undo_stack:
            return False
        number = self.undo_stack.pop()
        self.project.log_changes(self.tile, self._logged(number).select("point", F.col("new").alias("old"), F.col("old").alias("new")))
        self.redo_stack.append(number)
        return True

    def redo(self) -> bool:
        if not self.redo_stack:
            return False
        number = self.redo_stack.pop()
        self.project.log_changes(self.tile, self._logged(number))
        self.undo_stack.append(number)
        return True
