"""Training transforms over the adapter's points; a scene is a tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import points
from ..operators import transforms as t
from ..operators import views
from .registry import query
from .registry import rounded as _r

SCENES = "sc AS (SELECT tile AS scene, pid, x, y, z, CAST(intensity % 256 AS DOUBLE) AS red, CAST(pid % 256 AS DOUBLE) AS green, CAST((pid * 7) % 256 AS DOUBLE) AS blue FROM pts)"


def scenes(spark, d):
    return points(spark, d).select(F.col("tile").alias("scene"), "pid", "x", "y", "z", (F.col("intensity") % 256).cast("double").alias("red"), (F.col("pid") % 256).cast("double").alias("green"), (F.col("pid") * 7 % 256).cast("double").alias("blue"))


@query(f"-- ctes {SCENES} SELECT pid, round(red / 255, 6) AS red FROM sc")
def normalize_color(spark, d):
    return t.normalize_color(scenes(spark, d)).select("pid", _r("red"))


@query(f"-- ctes {SCENES}, c AS (SELECT pid, scene, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM sc WINDOW w AS (PARTITION BY scene)) SELECT pid, round(x / max(sqrt(x*x + y*y + z*z)) OVER (PARTITION BY scene), 6) AS x, round(z / max(sqrt(x*x + y*y + z*z)) OVER (PARTITION BY scene), 6) AS z FROM c")
def normalize_coord(spark, d):
    return t.normalize_coord(scenes(spark, d)).select("pid", _r("x"), _r("z"))


@query(f"-- ctes {SCENES} SELECT pid, round(x - min(x) OVER w, 6) AS x, round(z - min(z) OVER w, 6) AS z FROM sc WINDOW w AS (PARTITION BY scene)")
def positive_shift(spark, d):
    return t.positive_shift(scenes(spark, d)).select("pid", _r("x"), _r("z"))


@query(f"-- ctes {SCENES} SELECT pid, round(x - (min(x) OVER w + max(x) OVER w) / 2, 6) AS x, round(z - min(z) OVER w, 6) AS z FROM sc WINDOW w AS (PARTITION BY scene)")
def center_shift(spark, d):
    return t.center_shift(scenes(spark, d)).select("pid", _r("x"), _r("z"))


@query(f"-- ctes {SCENES}, c AS (SELECT *, (min(x) OVER w + max(x) OVER w) / 2 AS cx, (min(y) OVER w + max(y) OVER w) / 2 AS cy FROM sc WINDOW w AS (PARTITION BY scene)) SELECT pid, round((x - cx) * cos(pi() / 2) - (y - cy) * sin(pi() / 2) + cx, 6) AS x, round((x - cx) * sin(pi() / 2) + (y - cy) * cos(pi() / 2) + cy, 6) AS y FROM c")
def rotate_quarter(spark, d):
    """A turn of which only one angle can be drawn."""
    return t.random_rotate_target(scenes(spark, d), (0.5,), p=1.0).select("pid", _r("x"), _r("y"))


@query(f"-- ctes {SCENES} SELECT pid, round(x * 1.5, 6) AS x, round(-y * 1.5, 6) AS y FROM sc")
def scale_flip(spark, d):
    flipped = t.random_flip(t.random_scale(scenes(spark, d), (1.5, 1.5)), p=1.0)
    return flipped.select("pid", F.round(-F.col("x"), 6).alias("x"), _r("y"))


@query(f"-- ctes {SCENES}, c AS (SELECT *, min(red) OVER w AS lo, max(red) OVER w AS hi FROM sc WINDOW w AS (PARTITION BY scene)) SELECT pid, round(red * 0.5 + (red - lo) * CASE WHEN hi > lo THEN 255 / (hi - lo) ELSE 1 END * 0.5, 6) AS red FROM c")
def auto_contrast(spark, d):
    return t.auto_contrast(scenes(spark, d), p=1.0, blend=0.5).select("pid", _r("red"))


@query(f"-- ctes {SCENES} SELECT pid, round(red * 0.2989 + green * 0.587 + blue * 0.114, 6) AS red FROM sc")
def gray_scale(spark, d):
    return t.gray_scale(scenes(spark, d), p=2.0).select("pid", _r("red"))


@query(f"-- ctes {SCENES}, g AS (SELECT scene, pid, floor(x / 40) AS gx, floor(y / 40) AS gy, floor(z / 40) AS gz FROM sc), r AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY scene, gx, gy, gz) AS k, CAST(gx - min(gx) OVER (PARTITION BY scene) AS BIGINT) AS cx FROM g WINDOW w AS (PARTITION BY scene, gx, gy, gz ORDER BY pid)) SELECT pid, cx AS gx FROM r WHERE r = 2 % k")
def grid_sample_test(spark, d):
    return t.grid_sample(scenes(spark, d), 40.0, "test", 2).select("pid", "gx")


@query(f"-- ctes {SCENES}, c AS (SELECT pid, scene, x - min(x) OVER w AS u, y - min(y) OVER w AS v FROM sc WINDOW w AS (PARTITION BY scene)), k AS (SELECT pid, scene, CAST(floor(u / 50) - i AS BIGINT) AS cx, CAST(floor(v / 50) - j AS BIGINT) AS cy FROM c, range(2) a(i), range(2) b(j)), n AS (SELECT scene, cx, cy, count(*) AS n FROM k WHERE cx >= 0 AND cy >= 0 GROUP BY 1, 2, 3) SELECT scene, cx, cy, n FROM n WHERE n >= 30")
def scene_chunks(spark, d):
    return t.chunks(scenes(spark, d), 100.0, 50.0, 30).groupBy("scene", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query()
def random_transforms(spark, d):
    """Every transform with draws, by seed; tests check their bounds and that reruns agree."""
    steps = [
        {"type": "random_shift"}, {"type": "random_dropout", "chance": 1.0}, {"type": "random_rotate", "p": 1.0}, {"type": "random_scale", "anisotropic": True}, {"type": "random_flip"}, {"type": "random_jitter"},
        {"type": "clip_gaussian_jitter"}, {"type": "color_translation"}, {"type": "color_jitter"}, {"type": "brightness"}, {"type": "contrast"}, {"type": "saturation"}, {"type": "hue_saturation"}, {"type": "drop_color"},
        {"type": "elastic_distortion", "granularity": 50.0}, {"type": "sphere_crop", "most": 100},
    ]
    return t.compose(steps, scenes(spark, d)).select("scene", "pid", _r("x"), _r("red"))


@query()
def segment_graph(spark, d):
    """A graph of neighbours in space, weighted by height differences."""
    from ..cells import knn_join

    p = points(spark, d).select("pid", "x", "y", "z", "tile")
    near = knn_join(p.select("pid", "x", "y", "z", "tile"), p, 4, by="tile")
    edges = near.select(F.col("tile").alias("scene"), F.col("pid").alias("a"), F.col("n_pid").alias("b"), F.abs(F.col("z") - F.col("n_z")).alias("w"))
    return t.segment_graph(p.select(F.col("tile").alias("scene"), F.col("pid").alias("v")), edges, 40.0, 5)


@query("SELECT pid, round(a * cos(x) - c * sin(x), 6) AS f0, round(b * cos(x / 10) - d * sin(x / 10), 6) AS f1, round(c * cos(x) + a * sin(x), 6) AS f2, round(d * cos(x / 10) + b * sin(x / 10), 6) AS f3 FROM (SELECT pid, x, z AS a, y AS b, pid % 5 AS c, pid % 3 AS d FROM pts)")
def rotary_features(spark, d):
    v = F.array(F.col("z"), F.col("y"), (F.col("pid") % 5).cast("double"), (F.col("pid") % 3).cast("double"))
    out = points(spark, d).select("pid", t.rotary(v, F.col("x")).alias("v"))
    return out.select("pid", *[F.round(F.col("v")[i], 6).alias(f"f{i}") for i in range(4)])


# Centres and shares by arithmetic in place of hashes, so that SQL can follow; view 0 and 1 are global, 2 and 3 local.
_DRAW, _SHARE = "(pid * 7919 + v * 104729) % 10007", "((scene * 31 + v * 17) % 11) / 11.0E0"
_CENTRE = "SELECT scene, v, arg_min(x, ({d}, pid)) AS cx, arg_min(y, ({d}, pid)) AS cy, arg_min(z, ({d}, pid)) AS cz FROM {t} GROUP BY 1, 2"
_NEAREST = "SELECT * FROM (SELECT p.scene, c.v, p.pid, p.x, p.y, p.z, row_number() OVER (PARTITION BY p.scene, c.v ORDER BY (p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy) + (p.z - cz) * (p.z - cz), p.pid) AS place, size FROM sc p JOIN {c} c ON c.scene = p.scene JOIN sz ON sz.scene = p.scene AND sz.v = c.v) WHERE place <= size"
VIEWS = f"""{SCENES}, b AS (SELECT scene, count(*) AS n, min(z) AS z0, max(z) AS z1 FROM sc GROUP BY 1), s1 AS (SELECT scene, n, v, CASE WHEN v < 2 THEN 0.3E0 ELSE 0.1E0 END AS lo, CASE WHEN v < 2 THEN 0.8E0 ELSE 0.3E0 END AS hi FROM b, range(4) r(v)),
 sz AS (SELECT scene, v, CASE WHEN floor((lo + (hi - lo) * {_SHARE}) * least(n, 60)) > 0 THEN floor((lo + (hi - lo) * {_SHARE}) * least(n, 60)) ELSE least(n, greatest(10, floor(hi * least(n, 60)))) END AS size FROM s1),
 mz AS (SELECT sc.*, 0 AS v FROM sc JOIN b USING (scene) WHERE z BETWEEN z0 + (z1 - z0) * 0.25E0 AND z0 + (z1 - z0) * 0.75E0), mc AS ({_CENTRE.format(d=_DRAW, t="mz")}), mv AS ({_NEAREST.format(c="mc")}),
 oz AS (SELECT mv.scene, r.v, pid, x, y, z FROM mv, range(1, 4) r(v)), oc AS ({_CENTRE.format(d=_DRAW, t="oz")}), vw AS (SELECT scene, v, pid, place FROM mv UNION ALL SELECT scene, v, pid, place FROM ({_NEAREST.format(c="oc")}))"""


def views_of(spark, d):
    draw = F.expr(_DRAW.replace("v *", "view *"))
    share = F.expr(_SHARE.replace("v *", "view *").replace("11.0E0", "11.0D"))
    return views.multi_views(scenes(spark, d), 2, (0.3, 0.8), 2, (0.1, 0.3), most=60, heights=(0.25, 0.75), draw=draw, share=share)


@query(f"-- ctes {VIEWS} SELECT scene, CAST(v AS INTEGER) AS view, pid, place FROM vw")
def multi_views(spark, d):
    """Four crops of each scene about drawn centres."""
    return views_of(spark, d).select("scene", "view", "pid", "place")


@query(f"-- ctes {VIEWS} SELECT a.scene, a.pid, CAST(a.v AS INTEGER) AS a, CAST(b.v AS INTEGER) AS b, a.place AS place_a, b.place AS place_b FROM vw a JOIN vw b ON a.scene = b.scene AND a.pid = b.pid AND a.v < b.v")
def view_matches(spark, d):
    """Points that two crops share, and their places in both."""
    return views.matches(views_of(spark, d))


@query(f"-- ctes {SCENES}, v AS (SELECT scene, pid, (red / 127.5 - 1) AS red, x - min(x) OVER (PARTITION BY scene) AS x FROM sc) SELECT view, scene, pid, round(x, 6) AS x FROM v, (VALUES (1), (2)) w(view)")
def contrastive_views(spark, d):
    """Two views of every scene; without draws in the transforms both are the same."""
    steps = [{"type": "positive_shift"}]
    return views.contrastive_views(scenes(spark, d), steps).select("view", "scene", "pid", _r("x"))
