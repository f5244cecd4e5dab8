"""The tile catalogue, its edits and logs: tables that only grow; the state is the newest event of each key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Status and quality codes in their order, and class names.
STATUSES = ("IMPORTED", "FILTERED", "CLASSIFIED", "EDITED", "NOISE", "ERROR")
QC_STATUSES = ("QC_PASSED", "IN_REVIEW", "NEEDS_REWORK")
CLASS_NAMES = {
    0: "Created, Never Classified", 1: "Unclassified", 2: "Ground", 3: "Low Vegetation", 4: "Medium Vegetation", 5: "High Vegetation",
    6: "Building", 7: "Low Point (Noise)", 8: "Model Key/Reserved", 9: "Water", 10: "Rail", 11: "Road Surface", 12: "Overlap/Reserved",
    13: "Wire – Guard (Shield)", 14: "Wire – Conductor (Phase)", 15: "Transmission Tower", 16: "Wire-Structure Connector", 17: "Bridge Deck", 18: "High Noise",
}
# Scanner names in file names, and names of bathymetric systems and dimensions.
SCANNERS = (
    r"vq\d{3,4}(?:-[a-z])?[a-z]?", r"vux-\d+(?:-[a-z])?[a-z]?", r"vq-\d+(?:-[a-z])?[a-z]?", r"minivux-\d+(?:-[a-z])?[a-z]?", r"als\d+",
    r"pegasus.*?\d+", r"orion.*?\w\d+", r"gemini.*?\w\d+", r"alta\s*x\d+", r"galaxy.*?\w\d+", r"ri.*?copl\d+",
)
BATHY_SYSTEMS = ("chiroptera", "hawkeye", "dragoneye", "czmil", "shoals", "lads", "eaarl", "coastal", "aquarius")
BATHY_WORDS = ("green laser", "bathy", "hydrographic", "532 nm", "532nm", "water surface", "cwlaser")
BATHY_DIMENSIONS = ("water_depth", "water surface", "bottom_return", "bathy_depth", "sea_floor", "subsea_depth", "subsea_surface")


def class_name(code: Column, names: dict[int, str] | None = None) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in (names or CLASS_NAMES).items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, code), F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def insert_or_replace(tiles: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """tiles with the rows of new, which replace those of the same key; columns that a side lacks are null."""
    return tiles.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def current_state(events: DataFrame, key: str = "id", version: Iterable[str] = ("version",), fields: Iterable[str] = ("status",)) -> DataFrame:
    """Of each key the newest value that is not null, field by field: updates of single fields overlay one another."""
    order = F.struct(*version)
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "id", cascade: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """tables without the keys that go; cascade names the tables and the column by which they follow."""
    out = dict(tables)
    for name, column in (cascade or {}).items():
        ids = gone.select(F.col(key).alias(column)).distinct()
        out[name] = tables[name].join(ids, column, "left_anti")
    return out


def flatten_edits(history: DataFrame) -> DataFrame:
    """(edit, tile, point, old_class, new_class) of classify commands (id, tile, points, old, new)."""
    pairs = F.explode(F.arrays_zip(F.col("points").alias("point"), F.col("old").alias("old_class")))
    return history.select(F.col("id").alias("edit"), "tile", pairs.alias("p"), F.col("new").alias("new_class")).select("edit", "tile", "p.point", "p.old_class", "new_class")


def last_edit_wins(edits: DataFrame, key: Iterable[str] = ("point",), order: Iterable[str] = ("edit",), value: str = "new_class") -> DataFrame:
    """Of each point the value of its last edit."""
    return edits.groupBy(*key).agg(F.max(F.struct(*order, value))[value].alias(value))


def undone(edits: DataFrame, steps: int, edit: str = "edit") -> DataFrame:
    """The edits that remain after undoing the last commands."""
    last = edits.select(edit).distinct().orderBy(F.desc(edit)).limit(steps)
    return edits.join(last, edit, "left_anti")


def undo_commands(edits: DataFrame, steps: int, edit: str = "edit") -> DataFrame:
    """The last commands turned round, as new commands: numbers go on, classes are swapped."""
    top = edits.agg(F.max(edit).alias("_top"))
    last = edits.select(edit).distinct().orderBy(F.desc(edit)).limit(steps)
    order = Window.orderBy(F.desc(edit))
    numbered = last.withColumn("_n", F.row_number().over(order))  # as many rows as steps
    back = edits.join(F.broadcast(numbered), edit).crossJoin(F.broadcast(top))
    return back.select((F.col("_top") + F.col("_n")).alias(edit), "tile", "point", F.col("new_class").alias("old_class"), F.col("old_class").alias("new_class"))


def reclassify(points: DataFrame, edits: DataFrame, key: Iterable[str] = ("pid",)) -> DataFrame:
    """points with the class of their last edit (key columns, new_class), and the class before as a backup."""
    last = edits.select(*[F.col(k).alias("_" + k) for k in key], F.col("new_class").alias("_new"))
    on = [F.col(k) == F.col("_" + k) for k in key]
    return points.join(last, on, "left").select(
        *[c for c in points.columns if c != "classification"], F.coalesce("_new", "classification").cast("int").alias("classification"), F.col("classification").alias("backup"),
    )


def timing_filter(log: DataFrame, tiles: Iterable[int] | None = None, step: str | None = None, batch: int | None = None, since: object | None = None) -> DataFrame:
    """Rows of a timing log that meet all bounds given."""
    out = log
    if tiles is not None:
        out = out.where(F.col("tile_id").isin(*tiles))
    if step is not None:
        out = out.where(F.col("step") == step)
    if batch is not None:
        out = out.where(F.col("batch") == batch)
    if since is not None:
        out = out.where(F.col("moment") >= F.lit(since))
    return out


def timing_table(log: DataFrame, by: str) -> DataFrame:
    """Count, total, mean, deviation and extremes of each key; a missing key has a name."""
    key = F.coalesce(F.col(by).cast("string"), F.lit("(unknown)")).alias("key")
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"),
        F.coalesce(F.stddev_samp("duration"), F.lit(0.0)).alias("std"), F.min("duration").alias("least"), F.max("duration").alias("most"),
    )


def duration_text(seconds: Column) -> Column:
    """Seconds as a reader wants them: milliseconds, seconds, minutes or hours."""
    whole = lambda c: F.floor(c).cast("long")
    minutes = whole((seconds % 3600) / 60)
    return (
        F.when(seconds < 0.001, "0.00 s")
        .when(seconds < 1, F.format_string("%.0f ms", F.bround(seconds * 1000, 0)))
        .when(seconds < 60, F.format_string("%.2f s", F.bround(seconds, 2)))
        .when(seconds < 3600, F.format_string("%dm %.1fs", minutes, F.bround(seconds % 60, 1)))
        .otherwise(F.format_string("%dh %dm %.0fs", whole(seconds / 3600), minutes, F.bround(seconds % 60, 0)))
    )


def number_text(n: Column) -> Column:
    """With thousands separators, and two places unless it is whole."""
    return F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(F.format_number(n, 2))


def by_count(points: DataFrame, key: str, value: str) -> DataFrame:
    """Of each key its values, the most frequent first (the smaller at ties); empty names are left out."""
    n = points.where((F.col(value).isNotNull()) & (F.col(value).cast("string") != "")).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))))
    return n.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias("ranked"))


def status_groups(tiles: DataFrame, statuses: Iterable[str] = STATUSES) -> DataFrame:
    """(place, status, n, ids) for each known status in its fixed order; tiles of another status are left out."""
    order = tiles.sparkSession.createDataFrame(list(enumerate(statuses)), "place int, status string")
    own = tiles.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    return F.broadcast(order).join(own, "status", "left").select("place", "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def box_density(boxes: DataFrame) -> DataFrame:
    """Points by area over all boxes; where boxes overlap the area counts twice."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return boxes.agg((F.sum("n") / F.sum(area)).alias("density"))


def sensor_of_line(points: DataFrame, table: dict[int, int], unknown: int = 0) -> DataFrame:
    """points with the sensor of their flight line."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return points.withColumn("sensor", F.coalesce(F.try_element_at(pairs, F.col("line")), F.lit(unknown)))


def line_summary(points: DataFrame) -> DataFrame:
    """Of each tile one text: its flight lines in order with the sensor's name."""
    label = F.when(F.col("sensor") == 1, "topo").when(F.col("sensor") == 2, "bathy").otherwise("unknown")
    own = points.select("tile", "line", label.alias("label")).distinct()
    named = F.transform(F.array_sort(F.collect_list(F.struct("line", "label"))), lambda s: F.concat(s["line"].cast("string"), F.lit(" ("), s["label"], F.lit(")")))
    return own.groupBy("tile").agg(F.array_join(named, ", ").alias("summary"))


_SCANNER = "(?i)(?:^|[^a-zA-Z0-9])(" + "|".join(SCANNERS) + ")(?:[^a-zA-Z0-9]|$)"


def scanner_of(stem: Column, parent: Column | None = None) -> Column:
    """The scanner named in a file's stem, else in its folder, in lower case; empty if none is."""
    own = F.lower(F.regexp_extract(stem, _SCANNER, 1))
    return own if parent is None else F.when(own != "", own).otherwise(F.lower(F.regexp_extract(parent, _SCANNER, 1)))


def sensor_name(scanner: Column) -> Column:
    """bathy for green lasers and known systems, topo for other known scanners, else empty."""
    low = F.lower(F.trim(scanner))
    green = low.rlike(r"vq-?\d{3,4}-?g\b") | low.rlike("|".join(BATHY_SYSTEMS))
    return F.when(green, "bathy").when(low.rlike(_SCANNER), "topo").otherwise("")


def content_sensor(descriptions: Column, dimensions: Column) -> Column:
    """bathy if record descriptions or names of extra dimensions (arrays) tell of a green laser, else empty."""
    said = F.exists(descriptions, lambda t: F.lower(t).rlike(r"vq\d{3,4}-?g\b") | F.lower(t).rlike("|".join(BATHY_WORDS)))
    has = F.arrays_overlap(F.transform(dimensions, F.lower), F.array(*map(F.lit, BATHY_DIMENSIONS)))
    return F.when(F.coalesce(said, F.lit(False)) | F.coalesce(has, F.lit(False)), "bathy").otherwise("")


def epsg_code(text: Column) -> Column:
    """The number after EPSG: or a bare number; null without one."""
    return F.regexp_extract(text, r"(?i)^\s*(?:epsg\s*:\s*)?(\d+)\s*$", 1).try_cast("int")


def search_names(table: DataFrame, words: str, limit: int = 20) -> DataFrame:
    """Rows of a (code, name) table whose name or code holds the words, in order of code."""
    hit = F.lower("name").contains(words.lower()) | F.col("code").cast("string").contains(words)
    return table.where(hit).orderBy("code").limit(limit)
