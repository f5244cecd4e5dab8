"""Control points, shifts and transforms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..balls import ball_tasks, blocks, finite, places
from ..cells import cell, radius_join
from ..functions import projections
from ..functions.projections import Crs, from_epsg, from_wkt
from ..lineage import kept, settle
from ..quantiles import percentile, percentiles


def gcp_dz(gcp: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Of each control point the median, deviation and number of heights within the radius in XY, and dz."""
    dims = ("x", "y")
    own = settle(finite(gcp.select("name", *dims, "z"), dims).groupBy("name", "z", *dims).agg(F.count(F.lit(1)).alias("times")))
    spots = settle(finite(points.select(*dims, "z"), dims).groupBy(*dims, "z").agg(F.count(F.lit(1)).alias("n")))

    def run(asked: pa.Table, near: pa.Table) -> pa.Table:
        heights, many, rows = near["z"].to_numpy(zero_copy_only=False).astype(np.float64), near["n"].to_numpy(), []
        known = near["z"].is_valid().to_numpy()
        for i, j, d2 in blocks(places(asked, dims), places(near, dims), radius):
            for one, row in zip(i.tolist(), d2 <= float(radius) * float(radius)):
                sel = j[row]
                if not len(sel):
                    continue
                n, z, w = int(many[sel].sum()), heights[sel][known[sel]], many[sel][known[sel]]
                middle = std = None
                if len(z):
                    order = np.argsort(z, kind="stable")
                    upto, total = np.cumsum(w[order]), int(w.sum())
                    at = [float(z[order[np.searchsorted(upto, r, "right")]]) for r in ((total - 1) // 2, total // 2)]
                    middle = at[0] if at[0] == at[1] else at[0] * 0.5 + at[1] * 0.5
                    mean = float((z * w).sum() / total)
                    std = float(np.sqrt((w * (z - mean) ** 2).sum() / total))
                rows.append((one, middle, std, n))
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({"_x": asked["x"].take(at), "_y": asked["y"].take(at), "mid": pa.array([r[1] for r in rows], pa.float64()), "std": pa.array([r[2] for r in rows], pa.float64()), "n": pa.array([r[3] for r in rows], pa.int64())})

    # Each place once, however many control points are there. A name in one place gets what its place has, as often as it is there.
    numbered = settle(own.groupBy("name", "z").agg(F.count(F.lit(1)).alias("spots"), F.sum("times").alias("times"), F.first("x").alias("x"), F.first("y").alias("y")).withColumn("id", F.monotonically_increasing_id()))
    single = numbered.where("spots = 1")
    seen = settle(ball_tasks(single.select(*dims).distinct(), spots, radius, dims, run, "_x double, _y double, mid double, std double, n long"))
    out = single.join(seen, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select("name", "z", "mid", "std", (F.col("n") * F.col("times")).alias("n"))
    several = numbered.where("spots > 1")
    if not several.isEmpty():
        mine = own.withColumnsRenamed({"name": "_name", "z": "_z"})
        mine = mine.join(several.select("id", "name", F.col("z").alias("gz")), F.col("_name").eqNullSafe(F.col("name")) & F.col("_z").eqNullSafe(F.col("gz"))).select("id", "times", *dims)
        pairs = radius_join(mine.select(*dims).distinct(), spots, radius, dims).select(F.col("x").alias("px"), F.col("y").alias("py"), "n_z", "n_n")
        met = mine.join(pairs, (F.col("x") == F.col("px")) & (F.col("y") == F.col("py"))).withColumn("w", F.col("times") * F.col("n_n"))
        heights = met.groupBy("id", "n_z").agg(F.sum("w").alias("w"))
        means = heights.where("n_z is not null").groupBy("id").agg((F.sum(F.col("n_z") * F.col("w")) / F.sum("w")).alias("mean"))
        off = F.col("n_z") - F.col("mean")
        stats = heights.join(means, "id", "left").groupBy("id").agg(
            F.expr("percentile(n_z, 0.5, w)").alias("mid"), F.sqrt(F.sum(F.col("w") * off * off) / F.sum(F.when(F.col("n_z").isNotNull(), F.col("w")))).alias("std"), F.sum("w").alias("n")
        )
        out = out.unionByName(several.select("id", "name", "z").join(stats, "id").select("name", "z", "mid", "std", "n"))
    return out.withColumn("dz", F.col("z") - F.col("mid"))


def gcp_summary(dz: DataFrame) -> DataFrame:
    """Median, mean, deviation, RMS and largest dz; the shift to apply is the median."""
    return dz.agg(
        F.expr("percentile(dz, 0.5)").alias("median"), F.avg("dz").alias("mean"), F.stddev_pop("dz").alias("std"),
        F.sqrt(F.avg(F.col("dz") * F.col("dz"))).alias("rms"), F.max(F.abs("dz")).alias("most"),
        F.count_if(F.abs("dz") > 5).alias("over_5"), F.count_if(F.abs("dz") > 20).alias("over_20"),
    )


def vertical_shift(source: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """Median of (mean height of the target's cell - source height) over source points whose cell has target points."""
    mean = target.groupBy(cell("y", size).alias("r"), cell("x", size).alias("c")).agg(F.avg("z").alias("tz"))
    pairs = source.withColumns({"sr": cell("y", size), "sc": cell("x", size)}).join(mean, (F.col("sr") == F.col("r")) & (F.col("sc") == F.col("c")))
    with kept(pairs.select((F.col("tz") - F.col("z")).alias("dz"))) as shifts:
        middle, n = percentile(shifts, "dz", 0.5), shifts.count()
    return source.sparkSession.range(1).select(F.lit(middle).cast("double").alias("shift"), F.lit(n).cast("long").alias("n"))


def affine(points: DataFrame, m: list[list[float]]) -> DataFrame:
    """x, y, z by the rows of a 3 x 4 or 4 x 4 matrix."""
    move = lambda r: F.col("x") * r[0] + F.col("y") * r[1] + F.col("z") * r[2] + r[3]
    return points.withColumns({"x": move(m[0]), "y": move(m[1]), "z": move(m[2])})


def estimate_helmert(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift from (sx, sy, sz) to (tx, ty, tz); one pass of sums, then a 3 x 3 SVD."""
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m_" + c) for c in s + t],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a in s for b in t],
        *[F.var_pop(c).alias("v_" + c) for c in s + t],
    ).first()
    if sums["n"] < 3:
        raise ValueError("three pairs are needed")
    cov = np.array([[sums[f"{a}_{b}"] for b in t] for a in s])
    u, _, vt = np.linalg.svd(cov)
    d = np.diag([1.0, 1.0, float(np.sign(np.linalg.det(vt.T @ u.T)))])
    rotation = vt.T @ d @ u.T
    scale = math.sqrt(sum(sums["v_" + c] for c in t) / sum(sums["v_" + c] for c in s))
    shift = np.array([sums["m_" + c] for c in t]) - scale * rotation @ np.array([sums["m_" + c] for c in s])
    return scale, rotation, shift


def shift(points: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def apply_helmert(pairs: DataFrame, found: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """pairs (sx, sy, sz) with mx, my, mz: scale, rotation and shift applied."""
    scale, r, t = found
    row = lambda i: sum(F.col("s" + c) * float(scale * r[i, j]) for j, c in enumerate("xyz")) + float(t[i])
    return pairs.withColumns({"mx": row(0), "my": row(1), "mz": row(2)})


def estimate_affine(pairs: DataFrame) -> np.ndarray:
    """3 x 4 matrix from (sx, sy, sz) to (tx, ty, tz) by least squares: sums of products in one pass, solved about their means."""
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m_" + c) for c in s + t],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a in s for b in s + t],
    ).first()
    if sums["n"] < 4:
        raise ValueError("four pairs are needed")
    left = np.array([[sums[f"{a}_{b}"] for b in s] for a in s])
    right = np.array([[sums[f"{a}_{b}"] for b in t] for a in s])
    m = np.linalg.lstsq(left, right, rcond=None)[0].T
    shift_ = np.array([sums["m_" + c] for c in t]) - m @ np.array([sums["m_" + c] for c in s])
    return np.column_stack((m, shift_))


def residuals(pairs: DataFrame, moved: DataFrame, key: str = "pid") -> DataFrame:
    """(key, residual): how far each moved source lies from its target."""
    off = sum((F.col("m" + c) - F.col("t" + c)) * (F.col("m" + c) - F.col("t" + c)) for c in "xyz")
    return moved.select(key, F.sqrt(off).alias("residual"))


def residual_stats(rows: DataFrame) -> DataFrame:
    """One row rmse, p68, p95, p99, most."""
    e = F.col("residual")
    with kept(rows.select("residual")) as own:
        held = dict(zip(("p68", "p95", "p99"), percentiles(own, "residual", (0.68, 0.95, 0.99))))
        rmse, most = own.agg(F.sqrt(F.avg(e * e)), F.max(e)).first()
    return rows.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in {"rmse": rmse, **held, "most": most}.items()])


def roof_summary(shifts: DataFrame) -> DataFrame:
    """Mean shift along each axis, and median and mean of its length."""
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    own = shifts.where("dx is not null").withColumn("length", length)
    return own.agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.avg("dz").alias("dz"), F.expr("percentile(length, 0.5)").alias("median"), F.avg("length").alias("mean"))


def roof_shifts(corners: DataFrame, points: DataFrame, radius: float, residual: float = 0.3, tries: int = 200, seed: int = 0) -> DataFrame:
    """(surface, dx, dy, dz, offset, n): what moves the points near a roof onto it, along the normal of their own plane, which a seeded consensus finds.

    corners (surface, x, y, z), at least three a surface. With fewer than three points near, the shift is null.
    """
    dims = ("x", "y")
    kind = corners.schema["surface"].dataType.simpleString()
    own = corners.select("surface", "x", "y", "z")
    middle = settle(own.groupBy("surface").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("corners"), F.collect_list(F.struct("x", "y", "z")).alias("v")).where("corners >= 3"))
    spots = settle(finite(points.select(*dims, "z"), dims).groupBy(*dims, "z").agg(F.count(F.lit(1)).alias("many")))

    def run(asked: pa.Table, near: pa.Table) -> pa.Table:
        """Of each centre its points' plane: normal, mean, and medians along the normal and of heights."""
        b, many = places(near, ("x", "y", "z")), near["many"].to_numpy()
        out = {k: [] for k in ("at", "n", "normal", "mean", "along", "height")}
        for i, j, d2 in blocks(places(asked, dims), b[:, :2], radius):
            for one, row in zip(i.tolist(), d2 <= float(radius) * float(radius)):
                sel = j[row]
                if not len(sel):
                    continue
                sel = sel[np.lexsort(b[sel].T)]
                p, w = b[sel], many[sel]
                n = int(w.sum())
                normal = _plane_normal(p, w, residual, tries, seed) if n >= 3 else None
                mean = w @ p / n
                out["at"].append(one)
                out["n"].append(n)
                out["normal"].append(None if normal is None else normal.tolist())
                out["mean"].append(mean.tolist())
                out["along"].append(None if normal is None else float(np.median(np.repeat((p - mean) @ normal, w))))
                out["height"].append(float(np.median(np.repeat(p[:, 2], w))))
        at, three = pa.array(out.pop("at"), pa.int64()), pa.list_(pa.float64())
        kinds = {"n": pa.int64(), "normal": three, "mean": three, "along": pa.float64(), "height": pa.float64()}
        return pa.table({"_x": asked["x"].take(at), "_y": asked["y"].take(at)} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    # Surfaces about one centre share its plane.
    centres = finite(middle.select(F.col("cx").alias("x"), F.col("cy").alias("y")), dims).distinct()
    planes = settle(ball_tasks(centres, spots, radius, dims, run, "_x double, _y double, n long, normal array<double>, mean array<double>, along double, height double", aim=1 << 12))

    def move(batches):
        for batch in batches:
            t = batch.to_pydict()
            out = {"surface": batch.column("surface"), "dx": [], "dy": [], "dz": [], "offset": [], "n": []}
            for v, n, normal, mean, along, height in zip(t["v"], t["n"], t["normal"], t["mean"], t["along"], t["height"]):
                v, moved, offset = np.array([[c["x"], c["y"], c["z"]] for c in v], dtype=np.float64), [None] * 3, None
                if normal is not None:
                    offset = float(np.median((v - np.array(mean)) @ np.array(normal)) - along)
                    moved = (-offset * np.array(normal)).tolist()
                elif n is not None and n >= 3:
                    offset = float(v[:, 2].mean() - height)
                    moved = [0.0, 0.0, offset]
                for k, x in zip(("dx", "dy", "dz", "offset", "n"), (*moved, offset, n or 0)):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([out["surface"], *[pa.array(out[k], pa.float64()) for k in ("dx", "dy", "dz", "offset")], pa.array(out["n"], pa.int64())], names=list(out))

    met = middle.join(planes, (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")), "left").select("surface", "v", "n", "normal", "mean", "along", "height")
    return met.mapInArrow(move, f"surface {kind}, dx double, dy double, dz double, offset double, n long")


def _plane_normal(p: np.ndarray, many: np.ndarray, residual: float, tries: int, seed: int) -> np.ndarray | None:
    """The upright normal of the plane that most points agree with, each row of p being so many points."""
    rng, best, most, upto = np.random.default_rng(seed), None, 0, np.cumsum(many)
    for _ in range(tries):
        a, b, c = p[np.searchsorted(upto, rng.choice(int(upto[-1]), 3, replace=False), "right")]
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal)
        if size > 1e-10:
            near = np.abs((p - a) @ normal / size) < residual
            if (n := int(many[near].sum())) > most:
                best, most = near, n
    if best is None or most < 3:
        return None
    own = p[best] - many[best] @ p[best] / most
    # Without the square matrix of all points, which is not needed.
    normal = np.linalg.svd(own * np.sqrt(many[best])[:, None], full_matrices=len(own) < 3)[2][2]
    return normal if normal[2] >= 0 else -normal  # one of two signs, so that reruns agree


def icp(source: DataFrame, target: DataFrame, rounds: int = 30, reach: float = 1.0, neighbours: int = 12, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """4 x 4 matrix and RMS of a point-to-plane alignment of source to target.

    Normals are those of the target. Each round is one nearest-neighbour join and one pass of sums (a 6 x 6 system); only these come to the driver.
    """
    from ..cells import knn_join
    from ..lineage import settle

    normals = settle(_normals(target, neighbours))
    m, before = np.eye(4), None
    for _ in range(rounds):
        moved = affine(source.select("pid", "x", "y", "z"), m.tolist())
        near = knn_join(moved, normals, 1, dims=("x", "y", "z"), self_join=False).where(F.sqrt("d2") <= reach)
        j = {"a": "y * n_nz - z * n_ny", "b": "z * n_nx - x * n_nz", "c": "x * n_ny - y * n_nx", "d": "n_nx", "e": "n_ny", "f": "n_nz"}
        own = near.selectExpr(*[f"{v} as {k}" for k, v in j.items()], "(n_x - x) * n_nx + (n_y - y) * n_ny + (n_z - z) * n_nz as r")
        names = list(j)
        sums = own.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"),
            *[F.sum(F.col(p) * F.col(q)).alias(p + q) for i, p in enumerate(names) for q in names[i:]], *[F.sum(F.col(p) * F.col("r")).alias(p + "r") for p in names],
        ).first()
        if sums["n"] < 6:
            raise ValueError("too few points are within reach")
        left = np.array([[sums[min(p, q) + max(p, q)] for q in names] for p in names])
        step = np.linalg.lstsq(left, np.array([sums[p + "r"] for p in names]), rcond=None)[0]
        a, b, c = step[:3]
        turn = np.array([[1, -c, b], [c, 1, -a], [-b, a, 1]])
        u, _, vt = np.linalg.svd(turn)
        move = np.eye(4)
        move[:3, :3], move[:3, 3] = u @ vt, step[3:]
        m = move @ m
        rms = math.sqrt(sums["rr"] / sums["n"])
        if before is not None and abs(before - rms) < tolerance:
            break
        before = rms
    return m, rms


def _normals(points: DataFrame, k: int) -> DataFrame:
    """points (pid, x, y, z) with nx, ny, nz, the upright normal of the k nearest points and the point itself."""
    import pyarrow as pa

    from .ground import PAIRS, covariances

    small = points.select("pid", "x", "y", "z")
    at = {c: lambda rows, i, near, j, c=c: rows[c].to_numpy() for c in "xyz"}
    sums = covariances(small, k, more=at).select("pid", "x", "y", "z", *[a + b for a, b in PAIRS])

    def solve(batches):
        for batch in batches:
            c = np.zeros((batch.num_rows, 3, 3))
            for i, (a, b) in enumerate(PAIRS):
                v = np.nan_to_num(batch.column(4 + i).to_numpy(zero_copy_only=False).astype(np.float64))
                c[:, "xyz".index(a), "xyz".index(b)] = c[:, "xyz".index(b), "xyz".index(a)] = v
            n = np.linalg.eigh(c)[1][:, :, 0] if batch.num_rows else np.zeros((0, 3))
            n = np.where(n[:, 2:] < 0, -n, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(np.ascontiguousarray(n[:, i])) for i in range(3)]], names=["pid", "x", "y", "z", "nx", "ny", "nz"])

    return sums.mapInArrow(solve, "pid long, x double, y double, z double, nx double, ny double, nz double")


def system(of: int | str) -> Crs:
    """A reference system by its code or its well-known text."""
    return from_epsg(of) if isinstance(of, int) else from_wkt(of)


def transform(points: DataFrame, source: int | str, target: int | str) -> DataFrame:
    """x, y (and z, between datums) from one system to another; 4326 is longitude and latitude."""
    return points if source == target else projections.transform(points, system(source), system(target))


def transform_or_keep(points: DataFrame, source: int | str, target: int | str) -> tuple[DataFrame, str | None]:
    """Transformed points, or the points as they are with a warning if a system isn't known."""
    try:
        return transform(points, source, target), None
    except ValueError as e:
        return points, str(e)
