"""Filters, selections, samples and masks over points. A mask is a boolean column; a filter drops rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Class codes and sensor codes that the filters name.
GROUND, UNASSIGNED, LOW_NOISE = 2, 1, 7
UNKNOWN_SENSOR, TOPO, BATHY = 0, 1, 2


def apply_mask(points: DataFrame, mask: str = "keep") -> DataFrame:
    """The rows of a mask, with all columns and extra dimensions, without the mask."""
    return points.where(F.col(mask)).drop(mask)


def split_by_mask(points: DataFrame, mask: str = "keep") -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows; a null mask drops."""
    flag = F.coalesce(F.col(mask), F.lit(False))
    return points.where(flag).drop(mask), points.where(~flag).drop(mask)


def class_filter(points: DataFrame, classes: Iterable[int]) -> DataFrame:
    return points.where(F.col("classification").isin(*classes))


def hide_lines(points: DataFrame, hidden: Iterable[int]) -> DataFrame:
    """Points of the flight lines that are shown."""
    hidden = list(hidden)
    return points.where(~F.col("line").isin(*hidden)) if hidden else points


def ground_or_all(points: DataFrame, ground_class: int = GROUND, fallback: bool = True) -> DataFrame:
    """Ground points; of a tile without any all points, or none without ``fallback``."""
    is_ground = F.col("classification") == ground_class
    if not fallback:
        return points.where(is_ground)
    marked = points.withColumn("_any", F.max(is_ground).over(Window.partitionBy("tile")))
    return marked.where(is_ground | ~F.col("_any")).drop("_any")


def drop_single_water_returns(points: DataFrame) -> DataFrame:
    """Bathymetric points stay only if their pulse had several returns."""
    return points.where(~((F.col("sensor") == BATHY) & (F.col("nr") <= 1)))


def keep_other_sensors(keep: Column, bathy: int = BATHY) -> Column:
    """A bathymetric step's mask: points of other sensors are kept whatever it says."""
    return keep | (F.col("sensor") != bathy)


def keep_topo(keep: Column, topo: int = TOPO) -> Column:
    """The river crop's mask: topographic points are kept, those of an unknown sensor are not."""
    return keep | (F.col("sensor") == topo)


def boxes_meet(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y) that touch a closed box."""
    return boxes.where((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1))


def in_rectangle(d0: float, d1: float, z0: float, z1: float) -> Column:
    """Mask of profile points in a closed box of distance and height, corners in any order."""
    return F.col("along").between(min(d0, d1), max(d0, d1)) & F.col("z").between(min(z0, z1), max(z0, z1))


def in_brush(d: float, z: float, radius: float) -> Column:
    return F.sqrt((F.col("along") - d) ** 2 + (F.col("z") - z) ** 2) <= radius


def in_rect_brush(d: float, z: float, half_width: float, half_height: float) -> Column:
    return F.col("along").between(d - half_width, d + half_width) & F.col("z").between(z - half_height, z + half_height)


def _line_height(d1: float, z1: float, d2: float, z2: float) -> Column:
    return F.lit(z1) + (F.col("along") - d1) * ((z2 - z1) / (d2 - d1))


def below_line(profile: DataFrame, d1: float, z1: float, d2: float, z2: float) -> DataFrame:
    """Profile points strictly below a line; below a vertical one are those before it."""
    if abs(d2 - d1) < 1e-9:
        return profile.where(F.col("along") < d1)
    return profile.where(F.col("z") < _line_height(d1, z1, d2, z2))


def beside_segment(profile: DataFrame, d1: float, z1: float, d2: float, z2: float, side: str) -> DataFrame:
    """Points above or below a line, between the ends of the segment only."""
    if side not in ("above", "below"):
        raise ValueError("side is above or below")
    within = profile.where(F.col("along").between(min(d1, d2), max(d1, d2)))
    if abs(d2 - d1) < 1e-9:
        return within.where(F.lit(side == "above"))
    h = _line_height(d1, z1, d2, z2)
    return within.where(F.col("z") > h if side == "above" else F.col("z") < h)


def intensity_floor(points: DataFrame, least: float) -> DataFrame:
    """Points whose intensity is at least a share of the largest."""
    top = points.agg(F.max("intensity").alias("_top"))
    return points.crossJoin(F.broadcast(top)).where(F.col("intensity") / (F.col("_top") + 1e-6) >= least).drop("_top")


def floor_filter(points: DataFrame, buffer: float, height: str = "hag") -> DataFrame:
    """Points no deeper under the ground than a buffer."""
    return points.where(F.col(height) >= -buffer)


def clip_to_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Coordinates moved into a box; no row is dropped."""
    return points.withColumns({c: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.col(c))) for c, a, b in zip("xyz", low, high)})


def drop_segments(points: DataFrame, segments: Iterable[int] = (0, 1), column: str = "classification") -> DataFrame:
    return points.where(~F.col(column).isin(*segments))


def prune_by_plane(points: DataFrame, a: float, b: float, c: float, band: float = 100.0) -> DataFrame:
    """Points whose height differs from a plane z = a x + b y + c by less than a band."""
    off = F.col("z") - (F.col("x") * a + F.col("y") * b + c)
    return points.where((off > -band) & (off < band))


def anchor_band(points: DataFrame, cells: DataFrame, size: float, below: float = 1.5, above: float = 2.5) -> DataFrame:
    """Points strictly within a band about their cell's anchor height (row, col, z)."""
    own = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("z").alias("_a"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    near = points.join(own, (at("y") == F.col("_r")) & (at("x") == F.col("_c")))
    return near.where((F.col("z") > F.col("_a") - below) & (F.col("z") < F.col("_a") + above)).drop("_r", "_c", "_a")


def source_mask(source: int) -> Column:
    """Which points ground classification may change: -1 all, -2 unassigned and ground, else one class."""
    c = F.col("classification")
    return F.lit(True) if source == -1 else c.isin(UNASSIGNED, GROUND) if source == -2 else c == source


def apply_ground(points: DataFrame, ground: str = "ground", source: int = -1) -> DataFrame:
    """Ground points get the ground class, others the unassigned one, within the source; the rest stays as it is."""
    new = F.when(F.col(ground), GROUND).otherwise(UNASSIGNED)
    return points.withColumn("classification", F.when(source_mask(source), new).otherwise(F.col("classification")).cast("int"))


def shape_fields(points: DataFrame, keep: Iterable[str] | None = None, copy: dict[str, str] | None = None, update: dict[str, object] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """Copies of columns, constants, new names and a choice of columns, in that order."""
    out = points
    if copy:
        out = out.withColumns({new: F.col(old) for old, new in copy.items()})
    if update:
        out = out.withColumns({name: F.lit(value) for name, value in update.items()})
    if rename:
        out = out.withColumnsRenamed(rename)
    return out.select(*keep) if keep is not None else out


def take_index(points: DataFrame, index: DataFrame, column: str = "pid") -> DataFrame:
    """Rows whose number is in an index table."""
    return points.join(index.select(F.col(index.columns[0]).alias("_i")).distinct(), F.col(column) == F.col("_i"), "left_semi")


def drop_index(points: DataFrame, index: DataFrame, column: str = "pid") -> DataFrame:
    return points.join(index.select(F.col(index.columns[0]).alias("_i")).distinct(), F.col(column) == F.col("_i"), "left_anti")


def stride_sample(points: DataFrame, step: int, chunk: int = 1_000_000, number: str = "pid", first: int = 1) -> DataFrame:
    """Every step-th row of each chunk of rows, as a reader that starts anew with each chunk takes them."""
    at = F.pmod(F.col(number) - first, F.lit(chunk))
    return points.where(F.pmod(at, F.lit(max(1, step))) == 0)


def budget_stride(points: DataFrame, budget: int, number: str = "pid", first: int = 1) -> DataFrame:
    """Every k-th row so that about ``budget`` stay; all rows if there are no more."""
    n = points.agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), (F.col("_n") / budget).cast("long"))
    return points.crossJoin(F.broadcast(n)).where((F.col("_n") <= budget) | (F.pmod(F.col(number) - first, step) == 0)).drop("_n")


def nearest_to(points: DataFrame, x: float, y: float, most: int, z: float | None = None) -> DataFrame:
    """The ``most`` rows nearest to a centre, smaller ids first at ties: a preview cluster or a sphere crop."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 + ((F.col("z") - z) ** 2 if z is not None else 0.0)
    return points.withColumn("d2", d2).orderBy("d2", "pid").limit(most)


def preview_cluster(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The rows nearest to one row that the seed picks, in XY."""
    centre = points.select("x", "y", F.xxhash64(F.lit(seed), "pid").alias("h"), "pid").orderBy("h", "pid").limit(1).select(F.col("x").alias("_cx"), F.col("y").alias("_cy"))
    d2 = (F.col("x") - F.col("_cx")) ** 2 + (F.col("y") - F.col("_cy")) ** 2
    return points.crossJoin(F.broadcast(centre)).withColumn("d2", d2).drop("_cx", "_cy").orderBy("d2", "pid").limit(most)


def central_crop(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """All rows if there are at most ``most``; else those of a central window that should hold a tenth more, cut to ``most`` by hash."""
    box = points.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))])
    ratio = F.sqrt(F.lit(most * 1.1) / F.col("_n"))
    inside = lambda c: F.abs(F.col(c) - (F.col(f"_lo{c}") + F.col(f"_hi{c}")) / 2) < (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * ratio / 2
    own = points.crossJoin(F.broadcast(box)).where((F.col("_n") <= most) | (inside("x") & inside("y")))
    return own.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(most).select(*points.columns)


def shuffled(points: DataFrame, seed: int, key: str = "pid") -> DataFrame:
    """All rows in an order that the seed fixes."""
    return points.orderBy(F.xxhash64(F.lit(seed), key), key)


def pick_profile(profile: DataFrame, d: float, z: float, brush: float) -> DataFrame:
    """The profile point nearest to a click; none beyond three brushes."""
    d2 = (F.col("along") - d) ** 2 + (F.col("z") - z) ** 2
    return profile.withColumn("dist", F.sqrt(d2)).where(F.col("dist") <= 3 * brush).orderBy("dist", "pid").limit(1)


def pick_screen(points: DataFrame, sx: float, sy: float, reach: float = 20.0) -> DataFrame:
    """Of projected points (screen_x, screen_y, depth) the one nearest to a click, within some pixels."""
    px = F.sqrt((F.col("screen_x") - sx) ** 2 + (F.col("screen_y") - sy) ** 2)
    return points.withColumn("pixels", px).where(F.col("pixels") <= reach).orderBy("pixels", "pid").limit(1)


def latest(log: DataFrame, n: int, order: Iterable[str] = ("id",), by: Iterable[str] = ()) -> DataFrame:
    """The newest n rows, or of each group: a bounded history or undo stack."""
    keys = [F.desc(c) for c in order]
    if not by:
        return log.orderBy(*keys).limit(n)
    own = Window.partitionBy(*by).orderBy(*keys)
    return log.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r")


def remap(points: DataFrame, table: dict[int, int], other: int, column: str = "classification", to: str = "mapped") -> DataFrame:
    """Codes through a table; codes it lacks become ``other``."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return points.withColumn(to, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(other)))


def union_all(parts: Iterable[DataFrame], number: str | None = None) -> DataFrame:
    """Rows of all parts by column name, missing columns null; with the part's number if a name for it is given."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn(number, F.lit(i)) if number else part
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def common_names(names: Column, allowed: Iterable[str]) -> Column:
    """Of a list of dimension names those that are allowed, sorted."""
    return F.array_sort(F.array_intersect(names, F.array(*[F.lit(a) for a in allowed])))
