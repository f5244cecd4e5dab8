"""Transforms of scenes for training: shifts, turns, jitters, colours and crops, by scene.

Each is a function of a table (scene, pid, x, y, z, and optionally red, green, blue and nx, ny, nz) and a seed. A scene's draws follow from the seed
and the scene, a point's from the seed, the scene and the point, so reruns agree however the rows are dealt. ``compose`` chains them by name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRANSFORMS: dict[str, Callable] = {}
COLORS, NORMALS = ("red", "green", "blue"), ("nx", "ny", "nz")


def transform(f):
    TRANSFORMS[f.__name__] = f
    return f


def compose(steps: list[dict], points: DataFrame) -> DataFrame:
    """Transforms in a row: {"type": name, parameters}."""
    for s in steps:
        if s.get("type") not in TRANSFORMS:
            raise ValueError(f"unknown transform {s.get('type')!r}; known: {', '.join(sorted(TRANSFORMS))}")
        points = TRANSFORMS[s["type"]](points, **{k: v for k, v in s.items() if k != "type"})
    return points


def _draw(seed: int, *keys) -> Column:
    """Uniform in [0, 1) from a seed and some columns or literals."""
    parts = [F.col(k) if isinstance(k, str) else F.lit(k) for k in keys]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / float(1 << 53)


def _between(low: float, high: float, draw: Column) -> Column:
    return F.lit(float(low)) + draw * float(high - low)


def _normal(seed: int, *keys) -> Column:
    """Standard normal, from two uniform draws."""
    return F.sqrt(-2.0 * F.ln(1.0 - _draw(seed, *keys, 1))) * F.cos(2 * math.pi * _draw(seed, *keys, 2))


def _has(points: DataFrame, names: tuple) -> bool:
    return set(names) <= set(points.columns)


def _of_scene(points: DataFrame, **aggregates: Column) -> DataFrame:
    """points with aggregates of their scene as columns _name."""
    sums = points.groupBy(F.col("scene").alias("_scene")).agg(*[a.alias("_" + n) for n, a in aggregates.items()])
    return points.join(F.broadcast(sums), F.col("scene") == F.col("_scene")).drop("_scene")


def _plain(points: DataFrame) -> DataFrame:
    return points.drop(*[c for c in points.columns if c.startswith("_")])


@transform
def normalize_color(points):
    return points.withColumns({c: F.col(c) / 255.0 for c in COLORS}) if _has(points, COLORS) else points


@transform
def normalize_coord(points):
    """Centred on the mean, the farthest point at distance 1."""
    own = _of_scene(points, **{"m" + c: F.avg(c) for c in "xyz"})
    own = own.withColumns({c: F.col(c) - F.col("_m" + c) for c in "xyz"})
    own = _of_scene(own, far=F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)))
    return _plain(own.withColumns({c: F.col(c) / F.col("_far") for c in "xyz"}))


@transform
def positive_shift(points):
    own = _of_scene(points, **{"m" + c: F.min(c) for c in "xyz"})
    return _plain(own.withColumns({c: F.col(c) - F.col("_m" + c) for c in "xyz"}))


@transform
def center_shift(points, apply_z: bool = True):
    """The middle of the box in x and y and, with apply_z, the floor go to 0."""
    own = _of_scene(points, x=(F.min("x") + F.max("x")) / 2, y=(F.min("y") + F.max("y")) / 2, z=F.min("z") if apply_z else F.lit(0.0))
    return _plain(own.withColumns({c: F.col(c) - F.col("_" + c) for c in "xyz"}))


@transform
def random_shift(points, shift=((-0.2, 0.2), (-0.2, 0.2), (0, 0)), seed: int = 0):
    return points.withColumns({c: F.col(c) + _between(*s, _draw(seed, "scene", i)) for i, (c, s) in enumerate(zip("xyz", shift))})


@transform
def random_dropout(points, ratio: float = 0.2, chance: float = 0.5, seed: int = 0):
    """Of a scene that is drawn, the share with the least hashes goes."""
    own = points.withColumn("_r", F.row_number().over(Window.partitionBy("scene").orderBy(F.xxhash64(F.lit(seed), "scene", "pid"), "pid")))
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("scene")))
    return _plain(own.where((_draw(seed, "scene", 7) >= chance) | (F.col("_r") <= F.floor(F.col("_n") * (1 - ratio)))))


def _turn(points: DataFrame, angle: Column, axis: str, center, applies: Column) -> DataFrame:
    if axis not in "xyz":
        raise ValueError(f"unknown axis {axis!r}")
    own = _of_scene(points, **{"c" + c: (F.min(c) + F.max(c)) / 2 for c in "xyz"}) if center is None else points.withColumns({"_c" + c: F.lit(float(v)) for c, v in zip("xyz", center)})
    own = own.withColumns({"_cos": F.when(applies, F.cos(angle)).otherwise(1.0), "_sin": F.when(applies, F.sin(angle)).otherwise(0.0)})
    # About an axis the two others turn, in the order in which they follow it.
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    u, v = F.col(a) - F.col("_c" + a), F.col(b) - F.col("_c" + b)
    new = {a: u * F.col("_cos") - v * F.col("_sin") + F.col("_c" + a), b: u * F.col("_sin") + v * F.col("_cos") + F.col("_c" + b)}
    if _has(points, NORMALS):
        new |= {"n" + a: F.col("n" + a) * F.col("_cos") - F.col("n" + b) * F.col("_sin"), "n" + b: F.col("n" + a) * F.col("_sin") + F.col("n" + b) * F.col("_cos")}
    return _plain(own.withColumns(new))


@transform
def random_rotate(points, angle=(-1.0, 1.0), axis: str = "z", center=None, p: float = 0.5, seed: int = 0):
    """angle: bounds in half turns."""
    return _turn(points, _between(*angle, _draw(seed, "scene", 1)) * math.pi, axis, center, _draw(seed, "scene", 2) <= p)


@transform
def random_rotate_target(points, angle=(0.5, 1.0, 1.5), axis: str = "z", center=None, p: float = 0.75, seed: int = 0):
    """One of some angles in half turns."""
    pick = F.element_at(F.array(*[F.lit(float(a)) for a in angle]), (F.floor(_draw(seed, "scene", 1) * len(angle)) + 1).cast("int"))
    return _turn(points, pick * math.pi, axis, center, _draw(seed, "scene", 2) <= p)


@transform
def random_scale(points, scale=(0.95, 1.05), anisotropic: bool = False, seed: int = 0):
    return points.withColumns({c: F.col(c) * _between(*scale, _draw(seed, "scene", i if anisotropic else 0)) for i, c in enumerate("xyz")})


@transform
def random_flip(points, p: float = 0.5, seed: int = 0):
    """x, and apart from it y, change sign."""
    out = points
    for i, c in enumerate("xy"):
        sign = F.when(_draw(seed, "scene", i) < p, -1.0).otherwise(1.0)
        out = out.withColumns({n: F.col(n) * sign for n in (c, "n" + c) if n in points.columns})
    return out


@transform
def random_jitter(points, sigma: float = 0.01, clip: float = 0.05, seed: int = 0):
    if clip <= 0:
        raise ValueError("clip must be above 0")
    move = lambda i: F.greatest(F.lit(-clip), F.least(F.lit(clip), _normal(seed, "scene", "pid", i) * sigma))
    return points.withColumns({c: F.col(c) + move(i) for i, c in enumerate("xyz")})


@transform
def clip_gaussian_jitter(points, scalar: float = 0.02, store: bool = False, seed: int = 0):
    """Normal moves about 0, cut at 1.96 deviations and scaled."""
    move = lambda i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _normal(seed, "scene", "pid", i) / 1.96)) * scalar
    out = points.withColumns({f"_j{c}": move(i) for i, c in enumerate("xyz")})
    out = out.withColumns({c: F.col(c) + F.col(f"_j{c}") for c in "xyz"})
    return _plain(out.withColumn("jitter", F.array("_jx", "_jy", "_jz")) if store else out)


def _limited(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))


@transform
def auto_contrast(points, p: float = 0.2, blend: float | None = None, seed: int = 0):
    """Colours spread over the whole range, blended with what they were."""
    own = _of_scene(points, **{k + c: f(c) for c in COLORS for k, f in (("lo", F.min), ("hi", F.max))})
    share = F.lit(float(blend)) if blend is not None else _draw(seed, "scene", 1)
    gap = {c: F.col("_hi" + c) - F.col("_lo" + c) for c in COLORS}
    applies = (_draw(seed, "scene", 2) < p) & (F.greatest(*gap.values()) > 0)
    spread = lambda c: (F.col(c) - F.col("_lo" + c)) * F.when(gap[c] > 0, 255.0 / gap[c]).otherwise(1.0)
    return _plain(own.withColumns({c: F.when(applies, F.col(c) * (1 - share) + spread(c) * share).otherwise(F.col(c)) for c in COLORS}))


@transform
def color_translation(points, p: float = 0.95, ratio: float = 0.05, seed: int = 0):
    move = lambda i: (_draw(seed, "scene", i) - 0.5) * 255 * 2 * ratio
    return points.withColumns({c: F.when(_draw(seed, "scene", 9) < p, _limited(F.col(c) + move(i))).otherwise(F.col(c)) for i, c in enumerate(COLORS)})


@transform
def color_jitter(points, p: float = 0.95, std: float = 0.005, seed: int = 0):
    move = lambda i: _normal(seed, "scene", "pid", i) * std * 255
    return points.withColumns({c: F.when(_draw(seed, "scene", 9) < p, _limited(F.col(c) + move(i))).otherwise(F.col(c)) for i, c in enumerate(COLORS)})


def _gray() -> Column:
    return F.col("red") * 0.2989 + F.col("green") * 0.587 + F.col("blue") * 0.114


@transform
def gray_scale(points, p: float = 1.0, seed: int = 0):
    own = points.withColumn("_g", _gray())
    return _plain(own.withColumns({c: F.when(_draw(seed, "scene", 3) < p, F.col("_g")).otherwise(F.col(c)) for c in COLORS}))


@transform
def brightness(points, low: float = 0.8, high: float = 1.2, seed: int = 0):
    return points.withColumns({c: _limited(F.col(c) * _between(low, high, _draw(seed, "scene", 4))) for c in COLORS})


@transform
def contrast(points, low: float = 0.8, high: float = 1.2, seed: int = 0):
    """Colours moved from or towards the scene's mean grey."""
    own = _of_scene(points, gray=F.avg(_gray()))
    k = _between(low, high, _draw(seed, "scene", 5))
    return _plain(own.withColumns({c: _limited(F.col(c) * k + F.col("_gray") * (1 - k)) for c in COLORS}))


@transform
def saturation(points, low: float = 0.8, high: float = 1.2, seed: int = 0):
    """Colours moved from or towards their own grey."""
    own = points.withColumns({"_g": _gray(), "_k": _between(low, high, _draw(seed, "scene", 6))})
    return _plain(own.withColumns({c: _limited(F.col(c) * F.col("_k") + F.col("_g") * (1 - F.col("_k"))) for c in COLORS}))


@transform
def hue_saturation(points, hue: float = 0.5, saturate: float = 0.2, seed: int = 0):
    """Hue turned and saturation scaled by draws of the scene, by way of hue, saturation and value."""
    r, g, b = (F.col(c) / 255.0 for c in COLORS)
    own = points.withColumns({"_v": F.greatest(r, g, b), "_d": F.greatest(r, g, b) - F.least(r, g, b)})
    d = F.when(F.col("_d") > 0, F.col("_d"))
    h = F.when(F.col("_v") == r, (g - b) / d).when(F.col("_v") == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    turn, more = (_draw(seed, "scene", 1) - 0.5) * 2 * hue, 1 + (_draw(seed, "scene", 2) - 0.5) * 2 * saturate
    own = own.withColumns({"_h": F.pmod(F.coalesce(h / 6, F.lit(0.0)) + turn + 1, F.lit(1.0)), "_s": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("_v") > 0, F.col("_d") / F.col("_v")).otherwise(0.0) * more))})

    def channel(n: float) -> Column:
        k = F.pmod(F.lit(float(n)) + F.col("_h") * 6, F.lit(6.0))
        return (F.col("_v") - F.col("_v") * F.col("_s") * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255

    return _plain(own.withColumns({c: _limited(channel(n)) for c, n in zip(COLORS, (5, 3, 1))}))


def _drop(points: DataFrame, names: tuple, ratio: float, chance: float, seed: int) -> DataFrame:
    if not _has(points, names):
        return points
    own = points.withColumn("_r", F.row_number().over(Window.partitionBy("scene").orderBy(F.xxhash64(F.lit(seed), "scene", "pid"), "pid")))
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("scene")))
    gone = (_draw(seed, "scene", 8) < chance) & (F.col("_r") <= F.floor(F.col("_n") * ratio))
    return _plain(own.withColumns({c: F.when(gone, 0.0).otherwise(F.col(c)) for c in names}))


@transform
def drop_color(points, ratio: float = 0.2, chance: float = 0.5, seed: int = 0):
    return _drop(points, COLORS, ratio, chance, seed)


@transform
def drop_normal(points, ratio: float = 0.2, chance: float = 0.5, seed: int = 0):
    return _drop(points, NORMALS, ratio, chance, seed)


@transform
def elastic_distortion(points, granularity: float = 0.2, magnitude: float = 0.4, seed: int = 0):
    """Points moved by a smooth field: normal draws at grid nodes, averaged with their neighbours, between nodes linear.

    Nodes' draws follow from their place, so the field needs no table.
    """
    own = points.withColumns({"_g" + c: F.floor(F.col(c) / granularity).cast("long") for c in "xyz"})

    def node(axis: int, i: int, j: int, k: int) -> Column:
        """The mean draw of a node and its six neighbours."""
        at = lambda a, b, c: _hash_normal(seed, axis, F.col("_gx") + a, F.col("_gy") + b, F.col("_gz") + c)
        near = [(i, j, k), (i + 1, j, k), (i - 1, j, k), (i, j + 1, k), (i, j - 1, k), (i, j, k + 1), (i, j, k - 1)]
        return sum(at(*n) for n in near) / 7.0

    w = {c: F.col(c) / granularity - F.col("_g" + c) for c in "xyz"}
    part = lambda c, on: w[c] if on else 1.0 - w[c]

    def field(axis: int) -> Column:
        return sum(part("x", i) * part("y", j) * part("z", k) * node(axis, i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1))

    return _plain(own.withColumns({c: F.col(c) + field(a) * magnitude for a, c in enumerate("xyz")}))


def _hash_normal(seed: int, axis: int, x: Column, y: Column, z: Column) -> Column:
    """Nearly normal: the sum of four parts of one hash, centred and scaled."""
    h = F.xxhash64(F.lit(seed), F.lit(axis), F.col("scene"), x, y, z)
    parts = sum(F.shiftright(h, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4))
    return (parts / 65536.0 - 2.0) * math.sqrt(3.0)


@transform
def grid_sample(points, size: float = 0.05, mode: str = "train", fragment: int = 0, seed: int = 0):
    """One point of each voxel: by hash in training, the fragment-th (in a circle) in a test. Cells gx, gy, gz count from the scene's least cell."""
    if mode not in ("train", "test"):
        raise ValueError(f"unknown mode {mode!r}")
    own = points.withColumns({"g" + c: F.floor(F.col(c) / size).cast("long") for c in "xyz"})
    own = _of_scene(own, **{"m" + c: F.min("g" + c) for c in "xyz"})
    own = own.withColumns({"g" + c: F.col("g" + c) - F.col("_m" + c) for c in "xyz"})
    voxel = Window.partitionBy("scene", "gx", "gy", "gz")
    order = voxel.orderBy(F.xxhash64(F.lit(seed), "scene", "pid"), "pid") if mode == "train" else voxel.orderBy("pid")
    own = own.withColumns({"_r": F.row_number().over(order) - 1, "_k": F.count(F.lit(1)).over(voxel)})
    return _plain(own.where(F.col("_r") == (0 if mode == "train" else F.lit(fragment) % F.col("_k"))))


@transform
def sphere_crop(points, most: int = 80_000, seed: int = 0):
    """Of each scene the rows nearest to one that the seed picks."""
    own = _of_scene(points, at=F.min_by(F.struct("x", "y", "z"), F.struct(F.xxhash64(F.lit(seed), "scene", "pid"), "pid")))
    d2 = sum((F.col(c) - F.col("_at")[c]) ** 2 for c in "xyz")
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy("scene").orderBy(d2, "pid")))
    return _plain(own.where(F.col("_r") <= most))


def chunks(points: DataFrame, size: float, stride: float, least: int, voxel: float | None = None) -> DataFrame:
    """points once for each square chunk (cx, cy) that holds them, chunks of fewer than ``least`` points left out; with a voxel one point of each."""
    own = grid_sample(points, voxel).drop("gx", "gy", "gz") if voxel else points
    own = _of_scene(own, lx=F.min("x"), ly=F.min("y"))
    reach = F.array(*[F.lit(i) for i in range(math.ceil(size / stride))])
    spread = own.withColumn("_i", F.explode(reach)).withColumn("_j", F.explode(reach))
    place = lambda c, i: (F.floor((F.col(c) - F.col("_l" + c)) / stride) - F.col(i)).cast("long")
    spread = spread.withColumns({"cx": place("x", "_i"), "cy": place("y", "_j")})
    inside = (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("x") - F.col("_lx") < F.col("cx") * stride + size) & (F.col("y") - F.col("_ly") < F.col("cy") * stride + size)
    spread = spread.where(inside).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("scene", "cx", "cy")))
    return _plain(spread.where(F.col("_n") >= least))


def segment_graph(vertices: DataFrame, edges: DataFrame, threshold: float = 0.01, least: int = 20) -> DataFrame:
    """(scene, v, segment): edges (scene, a, b, w) in rising order join segments that differ no more inside than the edge is heavy, plus threshold by size;
    then small segments join a neighbour. Each step depends on those before, so a scene is one task."""
    import pyarrow as pa

    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        names = np.sort(own["v"].to_numpy())
        a, b = np.searchsorted(names, links["a"].to_numpy()), np.searchsorted(names, links["b"].to_numpy())
        w = links["w"].to_numpy()
        root, size, allow = list(range(len(names))), [1] * len(names), [threshold] * len(names)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def join(i: int, j: int) -> int:
            low, high = min(i, j), max(i, j)
            root[high] = low
            size[low] += size[high]
            return low

        order = np.lexsort((b, a, w)).tolist()
        for k in order:
            i, j = find(int(a[k])), find(int(b[k]))
            if i != j and w[k] <= allow[i] and w[k] <= allow[j]:
                i = join(i, j)
                allow[i] = float(w[k]) + threshold / size[i]
        for k in order:
            i, j = find(int(a[k])), find(int(b[k]))
            if i != j and (size[i] < least or size[j] < least):
                join(i, j)
        scene = own["scene"].slice(0, 1).to_pylist() * len(names)
        return pa.table({"scene": pa.array(scene, own.schema.field("scene").type), "v": pa.array(names), "segment": pa.array(names[[find(i) for i in range(len(names))]])})

    kind = vertices.schema["scene"].dataType.simpleString()
    return vertices.select("scene", "v").groupBy("scene").cogroup(edges.select("scene", "a", "b", "w").groupBy("scene")).applyInArrow(run, f"scene {kind}, v long, segment long")


def rotary(features: Column, position: Column, base: float = 100.0, scale: float = 1.0) -> Column:
    """Pairs of places i and i + n/2 of a vector turned by the position over base ** (2 i / n)."""
    n = F.size(features)
    half = (n / 2).cast("int")

    def turned(v: Column, i: Column) -> Column:
        k = F.pmod(i, half)
        angle = position * scale / F.pow(F.lit(base), 2.0 * k / n)
        other = F.get(features, F.when(i < half, i + half).otherwise(i - half))
        return v * F.cos(angle) + F.when(i < half, -other).otherwise(other) * F.sin(angle)

    return F.transform(features, turned)
