"""Losses, votes, scores and instance operators over the adapter's points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapter import points, read
from ..functions import arrays
from ..operators import evaluation
from ..ranges import running
from .registry import query
from .registry import rounded as _r

# Five logits a point, exact in binary, and a target class.
LOGITS = "lg AS (SELECT pid, c, ((pid * (c + 3)) % 17) / 4.0E0 AS l, pid % 5 AS target, tile FROM pts, range(5) r(c))"
SOFT = LOGITS + ", sm AS (SELECT *, exp(l - max(l) OVER w) / sum(exp(l - m)) OVER w AS p, l - m - ln(sum(exp(l - m)) OVER w) AS lp FROM (SELECT *, max(l) OVER (PARTITION BY pid) AS m FROM lg) WINDOW w AS (PARTITION BY pid))"


def logits(spark, d):
    return points(spark, d).select("pid", "tile", F.expr("transform(sequence(0, 4), c -> ((pid * (c + 3)) % 17) / 4.0D)").alias("logits"), (F.col("pid") % 5).alias("target"))


GUESS = "g AS (SELECT classification AS truth, CASE WHEN pid % 10 = 0 THEN CASE classification WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 ELSE 1 END ELSE classification END AS guess, pid, tile FROM pts)"
CONF = GUESS + ", conf AS (SELECT c AS class, count(*) FILTER (truth = c AND guess = c) AS inter, count(*) FILTER (truth = c OR guess = c) AS uni, count(*) FILTER (truth = c) AS target FROM (SELECT unnest([1, 2, 5, 6, 7, 9]) AS c) LEFT JOIN g ON truth = c OR guess = c GROUP BY 1)"


def guesses(spark, d):
    nxt = F.create_map(*[F.lit(v) for kv in {1: 2, 2: 5, 5: 6, 6: 7, 7: 1}.items() for v in kv])
    guess = F.when(F.col("pid") % 10 == 0, F.element_at(nxt, F.col("classification"))).otherwise(F.col("classification"))
    return points(spark, d).select(F.col("classification").alias("truth"), guess.alias("guess"), "pid", "tile")


@query(f"-- ctes {CONF} SELECT class, inter, uni, target FROM conf")
def confusion(spark, d):
    from ..operators import basic

    return basic.confusion(guesses(spark, d), (1, 2, 5, 6, 7, 9))


@query(f"-- ctes {CONF} SELECT round(avg(inter / (uni + 1e-10)), 6) AS miou, round(avg(inter / (target + 1e-10)), 6) AS macc, round(sum(inter) / (sum(target) + 1e-10), 6) AS allacc FROM conf")
def mean_iou(spark, d):
    from ..operators import basic

    return evaluation.mean_scores(basic.confusion(guesses(spark, d), (1, 2, 5, 6, 7, 9))).select(_r("miou"), _r("macc"), _r("allacc"))


PARTS = "parts AS (SELECT * FROM (VALUES (0, 1), (0, 2), (0, 9), (1, 5), (1, 6), (2, 2), (2, 5), (2, 7)) v(category, part))"


@query(f"""-- ctes {GUESS}, {PARTS}, s AS (SELECT tile AS sample, tile % 3 AS category, truth, guess FROM g),
 i AS (SELECT sample, s.category, part, count(*) FILTER (truth = part AND guess = part) AS n, count(*) FILTER (truth = part OR guess = part) AS u FROM s JOIN parts USING (category) GROUP BY 1, 2, 3),
 m AS (SELECT sample, category, avg(CASE WHEN u = 0 THEN 1.0 ELSE n / (u + 1e-10) END) AS iou FROM i GROUP BY 1, 2), c AS (SELECT category, sum(iou) AS t, count(*) AS n FROM m GROUP BY 1)
 SELECT round(sum(t) / (sum(n) + 1e-10), 6) AS instance_miou, round(avg(t / (n + 1e-10)), 6) AS category_miou FROM c""")
def part_scores(spark, d):
    own = guesses(spark, d).withColumnRenamed("tile", "sample").withColumn("category", F.col("sample") % 3)
    parts = spark.createDataFrame([(0, 1), (0, 2), (0, 9), (1, 5), (1, 6), (2, 2), (2, 5), (2, 7)], "category int, part int")
    return evaluation.part_scores(own, parts)[1].select(_r("instance_miou"), _r("category_miou"))


@query(f"-- ctes {SOFT} SELECT round(avg(-lp), 6) AS ce FROM sm WHERE c = target")
def cross_entropy(spark, d):
    return logits(spark, d).agg(F.round(F.avg(evaluation.cross_entropy(F.col("logits"), F.col("target"))), 6).alias("ce"))


@query(f"-- ctes {SOFT}, s AS (SELECT pid, -sum(lp * CASE WHEN c = target THEN 0.9E0 ELSE 0.1E0 / 4 END) AS l FROM sm GROUP BY 1) SELECT round(avg(l), 6) AS ce FROM s")
def smooth_cross_entropy(spark, d):
    return logits(spark, d).agg(F.round(F.avg(evaluation.smooth_cross_entropy(F.col("logits"), F.col("target"), 5)), 6).alias("ce"))


BCE = "greatest({0}, 0.0) - {0} * {1} + ln(1 + exp(-abs({0})))"


@query(f"-- ctes b AS (SELECT (pid % 33 - 16) / 4.0E0 AS l, CAST(pid % 2 AS DOUBLE) AS t FROM pts), e AS (SELECT *, {BCE.format('l', 't')} AS bce FROM b) SELECT round(avg((0.25E0 * t + 0.75E0 * (1 - t)) * (1 - exp(-bce))**2 * bce), 6) AS focal FROM e")
def binary_focal(spark, d):
    l, t = F.expr("(pid % 33 - 16) / 4.0D"), F.expr("double(pid % 2)")
    return points(spark, d).agg(F.round(F.avg(evaluation.binary_focal(l, t, alpha=0.25)), 6).alias("focal"))


@query(f"-- ctes {LOGITS}, t AS (SELECT l, CASE WHEN c = target THEN 1.0E0 ELSE 0.0E0 END AS t, 1 / (1 + exp(-l)) AS p FROM lg), e AS (SELECT *, {BCE.format('l', 't')} AS bce, (1 - p) * t + p * (1 - t) AS off FROM t) SELECT round(avg(bce * 0.5E0 * off**2), 6) AS focal FROM e")
def focal(spark, d):
    return logits(spark, d).agg(F.round(F.avg(evaluation.focal(F.col("logits"), F.col("target"))), 6).alias("focal"))


@query(f"-- ctes {SOFT}, k AS (SELECT c, sum(p * (c = target)::INT) * 2 + 1 AS num, sum(p * p + (c = target)::INT) + 1 AS den FROM sm GROUP BY 1) SELECT round(sum(1 - num / den) / 5, 6) AS dice FROM k")
def dice(spark, d):
    return evaluation.dice(logits(spark, d), 5).select(_r("dice"))


LOVASZ = "j AS (SELECT *, 1 - (sum(fg) OVER (PARTITION BY {k}) - sum(fg) OVER o) / (sum(fg) OVER (PARTITION BY {k}) + sum(1 - fg) OVER o) AS jac FROM e WINDOW o AS (PARTITION BY {k} ORDER BY err DESC, id ROWS UNBOUNDED PRECEDING)), r AS (SELECT *, jac - coalesce(lag(jac) OVER (PARTITION BY {k} ORDER BY err DESC, id), 0) AS grad FROM j)"


@query(f"-- ctes {SOFT}, e AS (SELECT pid AS id, c, (c = target)::DOUBLE AS fg, round(abs((c = target)::INT - p), 12) AS err FROM sm), " + LOVASZ.format(k="c") + ", s AS (SELECT c, sum(err * grad) AS l FROM r GROUP BY 1) SELECT round(avg(l), 5) AS lovasz FROM s")
def lovasz_softmax(spark, d):
    return evaluation.lovasz_softmax(logits(spark, d).withColumnRenamed("pid", "id")).select(_r("lovasz", 5))


@query("-- ctes e AS (SELECT pid AS id, tile, (pid % 3 = 0)::DOUBLE AS fg, 1 - ((pid % 33 - 16) / 4.0E0) * ((pid % 3 = 0)::INT * 2 - 1) AS err FROM pts), " + LOVASZ.format(k="tile") + ", s AS (SELECT tile, sum(greatest(err, 0) * grad) AS l FROM r GROUP BY 1) SELECT round(avg(l), 5) AS lovasz FROM s")
def lovasz_hinge(spark, d):
    rows = points(spark, d).select(F.col("pid").alias("id"), F.col("tile").alias("image"), F.expr("(pid % 33 - 16) / 4.0D").alias("logit"), F.expr("double(int(pid % 3 = 0))").alias("fg"))
    return evaluation.lovasz_hinge(rows).select(_r("lovasz", 5))


@query(f"-- ctes {SOFT} SELECT pid, c, round(p, 6) AS p FROM sm")
def softmax(spark, d):
    return logits(spark, d).select("pid", F.posexplode(arrays.softmax(F.col("logits"))).alias("c", "p")).select("pid", "c", _r("p"))


@query(f"-- ctes {LOGITS} SELECT pid, CAST(arg_min(c, (-l, c)) AS INTEGER) AS label, string_agg(CAST(c AS VARCHAR), ',' ORDER BY l DESC, c) FILTER (r <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY l DESC, c) AS r FROM lg) GROUP BY 1")
def top_classes(spark, d):
    top = F.array_join(arrays.top(F.col("logits"), 3).cast("array<string>"), ",")
    return logits(spark, d).select("pid", arrays.argmax(F.col("logits")).alias("label"), top.alias("top"))


@query(f"-- ctes {SOFT}, v AS (SELECT pid // 7 AS id, c, sum(p) AS p FROM sm GROUP BY 1, 2) SELECT id, c, round(p, 6) AS p FROM v")
def fragment_votes(spark, d):
    """Class probabilities of test fragments or views added up for each point."""
    own = logits(spark, d).withColumn("id", F.expr("pid div 7"))
    return evaluation.vote(own, key="id").select("id", F.posexplode("votes").alias("c", "p")).select("id", "c", _r("p"))


@query("SELECT l_suppkey AS run, round(avg(l_extendedprice), 4) AS metric FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice) DESC, run LIMIT 1", pts=False)
def best_run(spark, d):
    """The best of repeated evaluations."""
    runs = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.avg("l_extendedprice").alias("metric"))
    return evaluation.best_run(runs, "metric").select("run", _r("metric", 4))


# Masks: 40 of them over points in squares that overlap.
MASKS = "mk AS (SELECT CAST(m AS BIGINT) AS mask, m % 3 AS label, ((m * 37) % 41) / 64.0E0 AS score, (m * 61) % 800 AS mx, (m * 97) % 800 AS my FROM range(40) r(m)), mem AS (SELECT mask, pid AS point FROM mk JOIN pts ON x BETWEEN mx AND mx + 260 AND y BETWEEN my AND my + 260)"


def masks(spark, d):
    mk = spark.range(40).select(F.col("id").alias("mask"), (F.col("id") % 3).alias("label"), ((F.col("id") * 37) % 41 / 64.0).alias("score"), ((F.col("id") * 61) % 800).alias("mx"), ((F.col("id") * 97) % 800).alias("my"))
    inside = F.col("x").between(F.col("mx"), F.col("mx") + 260) & F.col("y").between(F.col("my"), F.col("my") + 260)
    return mk, F.broadcast(mk).join(points(spark, d), inside).select("mask", F.col("pid").alias("point"))


def _nms_sql(ratio: str) -> str:
    return f"""-- ctes {MASKS}, pl AS (SELECT *, row_number() OVER (ORDER BY score DESC, mask) AS place FROM mk), ar AS (SELECT mask, count(*) AS area FROM mem GROUP BY 1),
 it AS (SELECT a.mask AS i, b.mask AS j, count(*) AS n FROM mem a JOIN mem b USING (point) JOIN pl p ON p.mask = a.mask JOIN pl q ON q.mask = b.mask WHERE p.label = q.label AND p.place < q.place GROUP BY 1, 2),
 io AS (SELECT i, j, n / (x.area + y.area - n) AS iou FROM it JOIN ar x ON x.mask = i JOIN ar y ON y.mask = j), cp AS (SELECT j AS m, max(iou) AS comp FROM io GROUP BY 1),
 dc AS (SELECT j, min({ratio}) AS d FROM io LEFT JOIN (SELECT m, comp FROM cp) ON m = i GROUP BY 1)
 SELECT mask, label, round(score * least(1, coalesce(d, 1)), 6) AS score FROM mk LEFT JOIN dc ON j = mask"""


@query(_nms_sql("exp(-2.0 * iou * iou) / exp(-2.0 * coalesce(comp, 0) * coalesce(comp, 0))"))
def matrix_nms(spark, d):
    mk, members = masks(spark, d)
    return evaluation.matrix_nms(members, mk).select("mask", "label", _r("score"))


@query(_nms_sql("(1 - iou) / (1 - coalesce(comp, 0))"))
def matrix_nms_linear(spark, d):
    mk, members = masks(spark, d)
    return evaluation.matrix_nms(members, mk, "linear").select("mask", "label", _r("score"))


# Instances: cells of 100 m as truths, shifted cells as guesses.
INST = "pi AS (SELECT pid, x, y, z, classification, tile AS scene, CAST(floor(y / 100) * 10 + floor(x / 100) AS BIGINT) AS truth, CAST(floor((y + 8 * (pid % 2)) / 100) * 11 + floor((x + 12) / 100) AS BIGINT) AS guess FROM pts)"


def instances(spark, d):
    return points(spark, d).select("pid", "x", "y", "z", "classification", F.col("tile").alias("scene"), F.expr("bigint(floor(y / 100) * 10 + floor(x / 100))").alias("truth"), F.expr("bigint(floor((y + 8 * (pid % 2)) / 100) * 11 + floor((x + 12) / 100))").alias("guess"))


@query(f"-- ctes {INST} SELECT scene, truth, guess, count(*) AS n FROM pi GROUP BY 1, 2, 3")
def instance_overlaps(spark, d):
    return evaluation.instance_overlaps(instances(spark, d))


@query()
def instance_ap(spark, d):
    """Average precision of instances; the greedy match has no SQL, tests compare it with a loop over instances."""
    own = instances(spark, d)
    truths = own.groupBy("scene", "truth").agg(F.min(F.col("truth") % 3).alias("label"), F.count(F.lit(1)).alias("n"))
    made = own.groupBy("scene", "guess").agg(F.min_by(F.col("truth") % 3, "pid").alias("label"), (F.count(F.lit(1)) % 7 / 8.0).alias("confidence"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("classification") == 7).alias("void"))
    return evaluation.instance_ap(truths, made, evaluation.instance_overlaps(own), least=20)


@query(f"-- ctes {INST}, o AS (SELECT * FROM pi WHERE classification NOT IN (1, 7)) SELECT truth AS instance, round((max(x) + min(x)) / 2, 6) AS cx, round(max(y) - min(y), 6) AS sy, round(avg(z), 6) AS mz, CAST(arg_min(classification, pid) - CASE WHEN arg_min(classification, pid) > 1 THEN 1 ELSE 0 END - CASE WHEN arg_min(classification, pid) > 7 THEN 1 ELSE 0 END AS INTEGER) AS class FROM o GROUP BY 1")
def instance_boxes(spark, d):
    own = instances(spark, d).select("pid", "x", "y", "z", F.col("classification").alias("segment"), F.col("truth").alias("instance"))
    return evaluation.instance_boxes(own, (-1, 1, 7)).select("instance", _r("cx"), _r("sy"), _r("mz"), "class")


@query("-- ctes r AS (SELECT p.pid, score, tp FROM (SELECT pid, (pid % 64) / 64.0E0 AS score, (pid % 3 = 0)::INT AS tp FROM pts) p), s AS (SELECT score, sum(tp) AS t, count(*) AS n FROM r GROUP BY 1) SELECT round(score, 6) AS score, round(sum(t) OVER w / sum(n) OVER w, 6) AS precision_, round(sum(t) OVER w / (SELECT sum(t) FROM s), 6) AS recall FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")
def precision_recall(spark, d):
    """Precision and recall at every threshold, from running sums over distinct scores."""
    s = points(spark, d).groupBy(F.expr("(pid % 64) / 64.0D").alias("score")).agg(F.sum(F.expr("int(pid % 3 = 0)")).alias("t"), F.count(F.lit(1)).alias("n"))
    s = running(s, [F.desc("score")], sums={"hits": "t", "taken": "n"}, totals={"all": "hits"})
    out = s.select("score", (F.col("hits") / F.col("taken")).alias("precision_"), (F.col("hits") / F.col("all")).alias("recall"))
    return out.select(_r("score"), _r("precision_"), _r("recall"))


@query("-- ctes s AS (SELECT tile, pid, z, avg(z) OVER w AS mean, quantile_cont(z, 0.5) OVER w AS mid FROM pts WINDOW w AS (PARTITION BY tile ORDER BY pid ROWS 4 PRECEDING)) SELECT pid, round(mean, 6) AS mean, round(mid, 6) AS mid FROM s")
def windowed_scalars(spark, d):
    """Median and mean of the last five values of a history."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("tile").orderBy("pid").rowsBetween(-4, 0)
    return points(spark, d).select("pid", F.avg("z").over(w).alias("mean"), F.expr("percentile(z, 0.5)").over(w).alias("mid")).select("pid", _r("mean"), _r("mid"))


@query("SELECT tile, round(sum(z * nr) / sum(nr), 6) AS mean, CAST(sum(nr) AS BIGINT) AS n FROM pts GROUP BY 1")
def average_meter(spark, d):
    """Running average of batches: sums of values times counts over counts."""
    return points(spark, d).groupBy("tile").agg(F.round(F.sum(F.col("z") * F.col("nr")) / F.sum("nr"), 6).alias("mean"), F.sum("nr").alias("n"))


@query("-- ctes f AS (SELECT tile, max(z) - min(z) AS h FROM pts GROUP BY 1), s AS (SELECT intensity FROM pts WHERE pid % 10 = 0) SELECT round((SELECT quantile_cont(intensity, 0.999) FROM s), 6) AS intensity_max, round((SELECT quantile_cont(h, 0.95) FROM f), 6) AS z_scale")
def global_stats(spark, d):
    """Scales of a set of files: a high percentile of sampled intensities and of the files' height ranges."""
    p = points(spark, d)
    a = p.where("pid % 10 = 0").agg(F.round(F.expr("percentile(intensity, 0.999)"), 6).alias("intensity_max"))
    b = p.groupBy("tile").agg((F.max("z") - F.min("z")).alias("h")).agg(F.round(F.expr("percentile(h, 0.95)"), 6).alias("z_scale"))
    return a.crossJoin(F.broadcast(b))
