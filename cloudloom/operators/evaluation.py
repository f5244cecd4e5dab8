"""Losses, votes and scores as aggregates over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, log_softmax, softmax
from ..lineage import bounded
from ..ranges import running


def mean_scores(confusion: DataFrame) -> DataFrame:
    """miou, macc and allacc over classes (inter, uni, target)."""
    e = F.lit(1e-10)
    return confusion.agg(
        F.avg(F.col("inter") / (F.col("uni") + e)).alias("miou"), F.avg(F.col("inter") / (F.col("target") + e)).alias("macc"), (F.sum("inter") / (F.sum("target") + e)).alias("allacc")
    )


def part_scores(points: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean IoU over samples (sample, category, truth, guess), and by category; parts: (category, part). A part neither there nor guessed counts 1.

    Returns (sample, category, iou) and one row (instance_miou, category_miou).
    """
    own = points.groupBy("sample", "category", "truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    wanted = own.select("sample", "category").distinct().join(F.broadcast(parts), "category")
    met = wanted.join(own, ["sample", "category"])
    t, g = F.col("truth") == F.col("part"), F.col("guess") == F.col("part")
    sums = met.groupBy("sample", "category", "part").agg(F.sum(F.when(t & g, F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(t | g, F.col("n")).otherwise(0)).alias("u"))
    iou = F.when(F.col("u") == 0, F.lit(1.0)).otherwise(F.col("i") / (F.col("u") + 1e-10))
    samples = sums.groupBy("sample", "category").agg(F.avg(iou).alias("iou"))
    by_category = samples.groupBy("category").agg(F.sum("iou").alias("s"), F.count(F.lit(1)).alias("n"))
    return samples, by_category.agg((F.sum("s") / (F.sum("n") + 1e-10)).alias("instance_miou"), F.avg(F.col("s") / (F.col("n") + 1e-10)).alias("category_miou"))


def cross_entropy(logits: Column, target: Column) -> Column:
    return -F.element_at(log_softmax(logits), target.cast("int") + 1)


def smooth_cross_entropy(logits: Column, target: Column, classes: int, smoothing: float = 0.1) -> Column:
    """Targets spread over the other classes."""
    logs = log_softmax(logits)
    share = F.transform(logs, lambda v, i: v * F.when(i == target, F.lit(1 - smoothing)).otherwise(smoothing / (classes - 1)))
    return -F.aggregate(share, F.lit(0.0), lambda s, e: s + e)


def _bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy from a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def binary_focal(logit: Column, target: Column, gamma: float = 2.0, alpha: float = 0.5) -> Column:
    loss = _bce(logit, target)
    weight = target * alpha + (F.lit(1.0) - target) * (1 - alpha)
    return weight * F.pow(F.lit(1.0) - F.exp(-loss), F.lit(gamma)) * loss


def focal(logits: Column, target: Column, gamma: float = 2.0, alpha: float = 0.5) -> Column:
    """The mean over classes of one row's focal losses."""

    def one(v: Column, i: Column) -> Column:
        t = F.when(i == target, F.lit(1.0)).otherwise(0.0)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-v))
        off = (F.lit(1.0) - p) * t + p * (F.lit(1.0) - t)
        return _bce(v, t) * (t * alpha + (F.lit(1.0) - t) * (1 - alpha)) * F.pow(off, F.lit(gamma))

    losses = F.transform(logits, one)
    return F.aggregate(losses, F.lit(0.0), lambda s, e: s + e) / F.size(losses)


def dice(rows: DataFrame, classes: int, smooth: float = 1.0, exponent: float = 2.0) -> DataFrame:
    """One row: the mean over classes of 1 - 2 |p t| / (|p|^e + |t|^e), from (logits, target)."""
    spread = rows.select("target", F.posexplode(softmax(F.col("logits"))).alias("c", "p")).withColumn("t", F.when(F.col("target") == F.col("c"), 1.0).otherwise(0.0))
    by_class = spread.groupBy("c").agg((F.sum(F.col("p") * F.col("t")) * 2 + smooth).alias("num"), (F.sum(F.pow("p", F.lit(exponent)) + F.pow("t", F.lit(exponent))) + smooth).alias("den"))
    return by_class.agg((F.sum(1 - F.col("num") / F.col("den")) / classes).alias("dice"))


def lovasz_gradient(errors: DataFrame, by: list[str], error: str = "err", positive: str = "fg", tie: str = "id") -> DataFrame:
    """errors with ``grad``, the change of the Jaccard loss along errors in falling order, by group: running sums by ranges, so a class may hold all rows."""
    summed = running(errors, [F.desc(error), tie], tuple(by), {"_hit": positive}, {"_total": "_hit"}, "_n")

    def jaccard(hit: Column, n: Column) -> Column:
        return 1.0 - (F.col("_total") - hit) / (F.col("_total") + n - hit)

    before = F.when(F.col("_n") == 1, 0.0).otherwise(jaccard(F.col("_hit") - F.col(positive), F.col("_n") - 1))
    return summed.withColumn("grad", jaccard(F.col("_hit"), F.col("_n")) - before).drop("_hit", "_total", "_n")


def lovasz_softmax(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: the mean over classes that occur of the sum of errors times their gradient, from (id, logits, target)."""
    spread = rows.select(F.col(id_col).alias("id"), "target", F.posexplode(softmax(F.col("logits"))).alias("c", "p"))
    seen = rows.select(F.col("target").alias("c")).distinct()
    spread = spread.join(bounded(seen), "c").withColumn("fg", F.when(F.col("target") == F.col("c"), 1.0).otherwise(0.0))
    graded = lovasz_gradient(spread.withColumn("err", F.abs(F.col("fg") - F.col("p"))), ["c"])
    return graded.groupBy("c").agg(F.sum(F.col("err") * F.col("grad")).alias("loss")).agg(F.avg("loss").alias("lovasz"))


def lovasz_hinge(rows: DataFrame, id_col: str = "id", by: str = "image") -> DataFrame:
    """One row: the mean over images of the hinge form, from (image, id, logit, fg)."""
    signed = rows.withColumn("err", 1.0 - F.col("logit") * (F.col("fg") * 2.0 - 1.0))
    graded = lovasz_gradient(signed, [by], tie=id_col)
    return graded.groupBy(by).agg(F.sum(F.greatest("err", F.lit(0.0)) * F.col("grad")).alias("loss")).agg(F.avg("loss").alias("lovasz"))


def vote(fragments: DataFrame, key: str = "pid", logits: str = "logits", weight: str | None = None) -> DataFrame:
    """(key, votes, label): class probabilities of all fragments or views of a point added up, and the likeliest class."""
    own = fragments.select(key, F.posexplode(softmax(F.col(logits))).alias("c", "p"), *([F.col(weight).alias("w")] if weight else [F.lit(1.0).alias("w")]))
    sums = own.groupBy(key, "c").agg(F.sum(F.col("p") * F.col("w")).alias("p"))
    votes = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "p"))), lambda s: s["p"]).alias("votes"))
    return votes.withColumn("label", argmax(F.col("votes")))


def best_run(runs: DataFrame, metric: str, run: str = "run") -> DataFrame:
    """The run with the best metric, the earlier one at ties."""
    return runs.orderBy(F.desc(metric), run).limit(1)


def matrix_nms(members: DataFrame, masks: DataFrame, kernel: str = "gaussian", sigma: float = 2.0, least: float = -1.0, before: int = -1, most: int = -1) -> DataFrame:
    """(mask, label, score): scores of masks (mask, label, score) lowered where better masks of their label cover the same points (mask, point)."""
    if kernel not in ("gaussian", "linear"):
        raise ValueError(f"unknown kernel {kernel!r}")
    # Of two masks the smaller of these is the better one.
    ranked = masks.withColumn("place", F.struct((-F.col("score")).alias("s"), F.col("mask").alias("m")))
    if before > 0:
        ranked = ranked.orderBy("place").limit(before)
    area = members.groupBy("mask").agg(F.count(F.lit(1)).alias("area"))
    own = ranked.join(area, "mask", "left").na.fill(0, ["area"])
    near = members.join(bounded(own.select("mask", "label", "place", "area")), "mask")
    a, b = near.alias("a"), near.alias("b")
    met = a.join(b, (F.col("a.point") == F.col("b.point")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.place") < F.col("b.place")))
    pairs = met.groupBy(F.col("a.mask").alias("i"), F.col("b.mask").alias("j"), F.col("a.area").alias("ai"), F.col("b.area").alias("aj")).agg(F.count(F.lit(1)).alias("n"))
    iou = pairs.select("i", "j", (F.col("n") / (F.col("ai") + F.col("aj") - F.col("n"))).alias("iou"))
    cover = iou.groupBy(F.col("j").alias("m")).agg(F.max("iou").alias("comp"))
    both = iou.join(cover, F.col("i") == F.col("m"), "left").withColumn("comp", F.coalesce("comp", F.lit(0.0)))
    if kernel == "gaussian":
        ratio = F.exp(-sigma * F.col("iou") * F.col("iou")) / F.exp(-sigma * F.col("comp") * F.col("comp"))
    else:
        ratio = (1 - F.col("iou")) / (1 - F.col("comp"))
    decay = both.groupBy(F.col("j").alias("d")).agg(F.min(ratio).alias("decay"))
    out = own.join(decay, F.col("mask") == F.col("d"), "left").select("mask", "label", (F.col("score") * F.least(F.lit(1.0), F.coalesce("decay", F.lit(1.0)))).alias("score"))
    if least > 0:
        out = out.where(F.col("score") >= least)
    return out.orderBy(F.desc("score"), "mask").limit(most) if most > 0 else out


def instance_overlaps(points: DataFrame) -> DataFrame:
    """(scene, truth, guess, n) of points (scene, truth, guess) that have both instances."""
    return points.where("truth is not null and guess is not null").groupBy("scene", "truth", "guess").agg(F.count(F.lit(1)).alias("n"))


# Overlaps at which average precision is taken, and the least points of an instance.
AP_OVERLAPS, AP_LEAST = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.25), 100


def instance_ap(truths: DataFrame, guesses: DataFrame, overlaps: DataFrame, least: int = AP_LEAST, at: tuple = AP_OVERLAPS) -> DataFrame:
    """(label, overlap, ap) from truths (scene, truth, label, n), guesses (scene, guess, label, confidence, n, void) and overlaps (scene, truth, guess, n).

    Guesses of a class claim truths in their order, each once; a truth claimed twice makes the weaker claim a false positive, and
    guesses mostly on void or too small truths are left out. Instances of one class meet in one task, points never do.
    """
    import numpy as np
    import pandas as pd

    t = truths.select("scene", "label", F.lit(0).alias("kind"), F.col("truth").alias("a"), F.lit(-1).cast("long").alias("b"), "n", F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("void"))
    g = guesses.where(F.col("n") >= least).select("scene", "label", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("a"), F.col("guess").alias("b"), "n", "confidence", "void")
    met = overlaps.join(truths.select("scene", "truth", F.col("label").alias("lt")), ["scene", "truth"]).join(guesses.select("scene", "guess", F.col("label").alias("lg")), ["scene", "guess"])
    o = met.where("lt = lg").select("scene", F.col("lt").alias("label"), F.lit(2).alias("kind"), F.col("truth").alias("a"), F.col("guess").alias("b"), "n", F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("void"))
    # The threshold is a key as well, so a class is dealt to as many tasks as there are thresholds.
    every = t.unionByName(g).unionByName(o).withColumn("overlap", F.explode(F.array(*[F.lit(float(x)) for x in at])))

    def curve(true: np.ndarray, score: np.ndarray, lost: int) -> float:
        order = np.argsort(score, kind="stable")
        score, true = score[order], true[order]
        below = np.concatenate(([0.0], np.cumsum(true)))
        first = np.unique(score, return_index=True)[1]
        all_true = below[-1]
        hits = all_true - below[first]
        precision = np.append(hits / (len(score) - first), 1.0)
        missed = below[first] + lost
        recall = np.append(np.divide(hits, hits + missed, out=np.zeros(len(first)), where=hits + missed > 0), 0.0)
        padded = np.concatenate((recall[:1], recall, [0.0]))
        return float(precision @ ((padded[:-2] - padded[2:]) / 2))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        label, threshold = key
        true, score, lost, has_truth, has_guess = [], [], 0, False, False
        for _, own in rows.groupby("scene", sort=True):
            real = own[own.kind == 0].sort_values("a")
            made = own[own.kind == 1].sort_values("b")
            size = dict(zip(real.a, real.n))
            guess = {r.b: r for r in made.itertuples()}
            pairs = [(r.a, r.b, r.n) for r in own[own.kind == 2].sort_values(["a", "b"]).itertuples() if r.b in guess]
            good = [(a, b) for a, b, n in pairs if n / (size[a] + guess[b].n - n) > threshold]
            big = [a for a in real.a if size[a] >= least]
            has_truth, has_guess = has_truth or bool(big), has_guess or bool(len(made))
            taken: set = set()
            for a in big:
                claims = [b for x, b in good if x == a and b not in taken]
                if not claims:
                    lost += 1
                    continue
                best = claims[0]
                taken.add(best)
                top = guess[best].confidence
                for b in claims[1:]:
                    true.append(0.0)
                    score.append(min(top, guess[b].confidence))
                    top = max(top, guess[b].confidence)
                true.append(1.0)
                score.append(top)
            matched = {b for _, b in good}
            for b, r in guess.items():
                if b not in matched:
                    ignored = r.void + sum(n for a, x, n in pairs if x == b and size[a] < least)
                    if ignored / r.n <= threshold:
                        true.append(0.0)
                        score.append(r.confidence)
        ap = curve(np.array(true), np.array(score), lost) if has_truth and has_guess else 0.0 if has_truth else None
        return pd.DataFrame({"label": [label], "overlap": [threshold], "ap": [ap]})

    return every.groupBy("label", "overlap").applyInPandas(run, f"label {truths.schema['label'].dataType.simpleString()}, overlap double, ap double")


def ap_summary(ap: DataFrame) -> DataFrame:
    """One row: mean precision over all overlaps but 0.25, at 0.5 and at 0.25; classes without truths don't count."""
    near = lambda v: F.abs(F.col("overlap") - v) < 1e-8
    return ap.agg(F.avg(F.when(~near(0.25), F.col("ap"))).alias("ap"), F.avg(F.when(near(0.5), F.col("ap"))).alias("ap50"), F.avg(F.when(near(0.25), F.col("ap"))).alias("ap25"))


def instance_boxes(points: DataFrame, ignored: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """(instance, cx, cy, cz, sx, sy, sz, mx, my, mz, class): box centre and size, mean, and the class moved down by the ignored ones below it."""
    own = points.where(~F.col("segment").isin(*ignored))
    vacant = [i for i in ignored if i >= 0]
    first = F.min_by("segment", "pid")
    shifted = first - sum(F.when(first > v, 1).otherwise(0) for v in vacant) if vacant else first
    return own.groupBy("instance").agg(
        *[((F.max(c) + F.min(c)) / 2).alias("c" + c) for c in "xyz"], *[(F.max(c) - F.min(c)).alias("s" + c) for c in "xyz"], *[F.avg(c).alias("m" + c) for c in "xyz"], shifted.cast("int").alias("class")
    )
