"""Detection metrics: true positives by the best ground truth, average precision, counts of areas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, area, iou
from ..sources.files import written
from . import frames
from .metrics import running_sums

#: Points of a curve in one window.
BLOCK = 1 << 16


def true_positives(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, least: float, areas: tuple[float, float] | None = None) -> DataFrame:
    """dets(key, det, score, ...) with tp: its best ground truth (largest IoU, then smallest gt) overlaps by at least least and no
    better-scored detection has taken it. A second-best ground truth is not tried.

    With areas [from, to) also ignored: the best truth's area is outside, or no truth is matched and the detection's is.
    """
    pairs = dets.join(truth, key).withColumns({"iou": iou(box_d, box_t), "__out": (area(box_t) < areas[0]) | (area(box_t) >= areas[1]) if areas else F.lit(False)})
    best = pairs.groupBy(*key, "det", "score").agg(F.max_by(F.struct("gt", "iou", "__out"), F.struct("iou", -F.col("gt"))).alias("m")).select(*key, "det", "score", "m.gt", "m.iou", "m.__out").where(F.col("iou") >= least)
    ranked = best.withColumn("__first", F.row_number().over(Window.partitionBy(*key, "gt").orderBy(F.desc("score"), "det")) == 1)
    out = dets.join(ranked.select(*key, "det", "__first", "__out"), [*key, "det"], "left").withColumn("tp", F.coalesce(F.col("__first") & ~F.col("__out"), F.lit(False)))
    if areas:
        outside = (area(box_d) < areas[0]) | (area(box_d) >= areas[1])
        out = out.withColumn("ignored", F.coalesce("__out", outside))
    return out.drop("__first", "__out")


def detection_ap(marked: DataFrame, by: list[str], truths: DataFrame, points: int | None = None) -> DataFrame:
    """Average precision by class: the area under the monotone precision-recall curve or, with points, the mean of its height at so many
    recalls from 0 to 1 (11 as a rule). truths: (by, n_gt). Equal scores go by det. A class without truth has none."""
    rows = marked.select(*by, "key_order", "det", "tp", (-F.col("score")).alias("__down"))
    run = running_sums(rows, by, "__down", ["key_order", "det"], {"tps": F.col("tp").cast("long"), "rank": F.lit(1)})
    # of equal counts of true positives the first row has the best precision: a true positive, or the group's first row
    curve = run.where("tp OR rank = 1").select(*by, "tps", (F.col("tps") / F.col("rank")).alias("precision"), "rank")
    env = suffix_max(curve, by, "tps", "precision").join(truths, by)
    if points is None:
        return env.where("tps > 0").groupBy(*by).agg((F.sum("envelope") / F.max("n_gt")).alias("ap"))
    # the first point that reaches a recall has the envelope there
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    need = env.select(*by, "tps", "envelope", "n_gt", at.alias("i")).where(F.col("tps") * (points - 1) >= F.col("i") * F.col("n_gt"))
    return need.groupBy(*by, "i").agg(F.max("envelope").alias("h")).groupBy(*by).agg((F.sum("h") / points).alias("ap"))


def suffix_max(df: DataFrame, by: list[str], order: str, value: str, name: str = "envelope") -> DataFrame:
    """Adds the largest value among the rows of the group whose order (a whole number from 0) is at least the row's. Rows are taken in
    blocks of BLOCK; only one row a block meets in the window of the blocks."""
    cut = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    blocks = cut.groupBy(*by, "__block").agg(F.max(value).alias("__top"))
    w = Window.partitionBy(*by).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(*by, "__block", F.max("__top").over(w).alias("__later"))
    own = F.max(value).over(Window.partitionBy(*by, "__block").orderBy(F.desc(order)))
    return cut.withColumn("__own", own).join(later, [*by, "__block"]).withColumn(name, F.greatest("__own", "__later")).drop("__block", "__own", "__later")


def class_areas(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(cls, iou, dice, accuracy) of pixel (or row) classes from their counts."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    each = n.select(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("i"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"))
    each = each.union(n.select(F.col("p"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("n")))
    s = each.groupBy("cls").agg(F.sum("i").alias("i"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    i, t, p = F.col("i"), F.col("t"), F.col("p")
    return s.select("cls", (i / (t + p - i)).alias("iou"), (2 * i / (t + p)).alias("dice"), F.try_divide(i, t).alias("accuracy"))


def proposal_recall(pairs: DataFrame, truths: DataFrame, frame: str, gt: str, rank: str, iou: str, numbers: list[int], thresholds: list[float]) -> DataFrame:
    """(number, threshold, recall) of the first so many proposals of each frame. Of a frame the best pair is taken again and again, and
    its truth and proposal leave; pairs(frame, gt, rank from 1, iou) need to have only pairs that overlap.

    The pairs of one frame fold in one array.
    """
    item = F.struct((-F.col(iou)).alias("o"), F.col(gt).cast("long").alias("g"), F.col(rank).cast("long").alias("p"))
    each = pairs.withColumn("number", F.explode(F.array(*map(F.lit, numbers)))).where(F.col(rank) <= F.col("number"))
    lists = each.groupBy("number", frame).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.expr("cast(array() AS array<struct<o:double,g:bigint,p:bigint>>)")
    step = lambda acc, x: F.when(F.exists(acc, lambda a: (a["g"] == x["g"]) | (a["p"] == x["p"])), acc).otherwise(F.array_append(acc, x))
    taken = lists.select("number", F.explode(F.aggregate("items", zero, step)).alias("m")).select("number", (-F.col("m.o")).alias("iou"))
    hits = taken.select("number", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("iou"))).alias("threshold")).groupBy("number", "threshold").agg(F.count("*").alias("hits"))
    grid = truths.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*map(F.lit, numbers))).alias("number")).select("n", "number", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return grid.join(hits, ["number", "threshold"], "left").select("number", "threshold", F.try_divide(F.coalesce("hits", F.lit(0)), "n").alias("recall"))


def recall_at_k(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, ks: list[int], least: float) -> DataFrame:
    """(k, recall): the share of truths(key, gt) that one of the k best-scored detections of their key overlaps by at least least."""
    ranked = dets.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "det"))).where(F.col("__r") <= max(ks))
    first = ranked.join(truth, key).where(iou(box_d, box_t) >= least).groupBy(*key, "gt").agg(F.min("__r").alias("r"))
    hits = first.select(F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("r"))).alias("k")).groupBy("k").agg(F.count("*").alias("hits"))
    grid = truth.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return grid.join(hits, "k", "left").select("k", F.try_divide(F.coalesce("hits", F.lit(0)), "n").alias("recall"))


def one_to_one(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, least: float, thresholds: list[float], later_wins: bool = True) -> DataFrame:
    """(threshold, key, tp): by score, each detection at or over the threshold takes the free truth that it overlaps most, if by at
    least least; of equal overlaps the later truth (or the first). The detections of one key fold in one array."""
    sign = -1 if later_wins else 1
    pairs = dets.join(truth, key).withColumn("__iou", iou(box_d, box_t)).where(F.col("__iou") >= least)
    offers = pairs.groupBy(*key, "det", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("__iou")).alias("o"), (F.col("gt") * sign).alias("g")))).alias("c"))
    each = offers.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))))
    ordered = each.groupBy("threshold", *key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).cast("double").alias("s"), F.col("det").alias("d"), "c"))).alias("ds"))

    def take(used, x):
        free = F.get(F.filter(x["c"], lambda c: ~F.array_contains(used, c["g"])), F.lit(0))
        return F.when(free.isNotNull(), F.array_append(used, free["g"])).otherwise(used)

    return ordered.select("threshold", *key, F.size(F.aggregate("ds", F.expr("array_repeat(cast(0 AS bigint), 0)"), take)).cast("long").alias("tp"))


def threshold_sweep(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, thresholds: list[float], least: float = 0.5) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1, best) of one-to-one matches at each score threshold; best marks the first
    threshold with the largest F1."""
    tp = one_to_one(dets, truth, key, box_d, box_t, least, thresholds).groupBy("threshold").agg(F.sum("tp").alias("tp"))
    n = dets.agg(*[F.count_if(F.col("score") >= t).alias(f"n{i}") for i, t in enumerate(thresholds)])
    called = n.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("called")) for i, t in enumerate(thresholds)])))
    rows = called.join(F.broadcast(truth.agg(F.count("*").alias("n"))), F.lit(True)).join(tp, "threshold", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    p, r = F.col("tp") / F.greatest("called", F.lit(1)), F.col("tp") / F.greatest("n", F.lit(1))
    scored = rows.select("threshold", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"))
    first = scored.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("__t"))
    return scored.join(F.broadcast(first), F.lit(True)).withColumn("best", F.col("threshold") == F.col("__t")).drop("__t")


def mean_ap(dets: DataFrame, truth: DataFrame, frame: str, cls: str, box_d: Box, box_t: Box, thresholds: list[float], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(threshold, range, cls, n_gt, ap): average precision at several overlaps and, if given, ranges [from, to) of the truth's area.
    Truths outside the range are ignored: what they match, and free detections outside it, count neither way. cls null: the mean.

    Boxes are joined once: the best truth of a detection does not depend on overlap or range, which then are two more keys.
    """
    every = [(float(t), n, float(lo), float(hi)) for n, (lo, hi) in (ranges or {"all": (0.0, float("inf"))}).items() for t in thresholds]
    level = lambda i: F.struct(F.lit(every[i][0]).alias("threshold"), F.lit(every[i][1]).alias("range"))

    def fold(d: dict, t: dict) -> tuple:
        i, j, o = frames.near(d["of"], t["of"], lambda i, j: frames.iou(d["box"][i], t["box"][j]), min(thresholds))
        own = frames.first_of(i, -o, t["id"][j])
        i, j, o = i[own], j[own], o[own]
        size_d, size_t = frames.area(d["box"]), frames.area(t["box"])
        told = []
        for at, _, lo, hi in every:
            hit = o >= at
            a, b = i[hit], j[hit]
            out = (size_t[b] < lo) | (size_t[b] >= hi)
            ignored = (size_d < lo) | (size_d >= hi)
            ignored[a] = out
            tp = np.zeros(len(size_d), bool)
            tp[a[frames.first_of(b, -d["score"][a], d["id"][a])]] = True
            told += [tp & ~ignored, ~ignored]
        return np.arange(len(size_d)), told

    made = ", ".join(f"tp{i} boolean, in{i} boolean" for i in range(len(every)))
    marked = frames.per_frame(dets, truth, [frame, cls], box_d, box_t, {}, made, fold)
    # the order of detections is that of all levels, whose counts are summed side by side
    rows = written(marked.withColumns({"__down": -F.col("score")}).drop("score"), "marked")
    sums = {f"{n}{i}": F.col(f"{c}{i}").cast("long") for i in range(len(every)) for n, c in (("tps", "tp"), ("rank", "in"))}
    run = running_sums(rows, [cls], "__down", [frame, "det"], sums)
    points = run.select(cls, F.inline(F.array(*[F.struct(level(i).alias("l"), F.col(f"tp{i}").alias("tp"), F.col(f"tps{i}").alias("tps"), F.try_divide(F.col(f"tps{i}"), F.col(f"rank{i}")).alias("precision")) for i in range(len(every))]))).where("tp")
    by = ["threshold", "range", cls]
    levels = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(n).alias("range"), F.lit(lo).alias("__lo"), F.lit(hi).alias("__hi")) for t, n, lo, hi in every])
    inside = (F.col("__ta") >= F.col("__lo")) & (F.col("__ta") < F.col("__hi"))
    counts = truth.select(cls, area(box_t).alias("__ta")).select("*", F.inline(levels)).where(inside).groupBy(*by).agg(F.count("*").alias("n_gt"))
    env = suffix_max(points.select("l.*", cls, "tps", "precision"), by, "tps", "precision").groupBy(*by).agg(F.sum("envelope").alias("s"))
    out = counts.join(env, by, "left").select(*by, "n_gt", F.coalesce(F.col("s") / F.col("n_gt"), F.lit(0.0)).alias("ap"))
    mean = out.groupBy("threshold", "range").agg(F.lit(None).cast(dict(out.dtypes)[cls]).alias(cls), F.sum("n_gt").alias("n_gt"), F.avg("ap").alias("ap"))
    return out.unionByName(mean)


def retrieval(queries: DataFrame, gallery: DataFrame, ident: str, row: str, vector: str, ranks: list[int], block: int = 128) -> DataFrame:
    """(n, mean_ap, cmc_<rank>...): squared distances of each query to all gallery rows but itself, nearest first (ties by row); queries
    without another row of their identity are left out.

    Queries go in blocks by identity, about block of them each, and the gallery's rows stream past each block: first those of its identities, which
    are held with their distances, then all others, of which only the number before each hit is kept. So the gallery is sent once a block.
    """
    q = queries.select(F.col(row).cast("long").alias("g"), F.col(ident).alias("i"), F.col(vector).alias("v"))
    g = gallery.select(F.col(row).cast("long").alias("g"), F.col(ident).alias("i"), F.col(vector).alias("v"))
    parts = max(1, -(-q.count() // block))
    asked = written(q.where("i IS NOT NULL").repartitionByRange(parts, "i", "g").withColumn("b", F.spark_partition_id()), "asked")
    own = asked.select("b", "i").distinct().withColumn("own", F.lit(True))
    dealt = g.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(F.broadcast(own), ["b", "i"], "left")  # one row a block and identity
    kind = F.when(F.col("own"), 1).otherwise(2)
    rows = asked.select("b", F.lit(0).alias("kind"), "g", "i", "v").unionAll(dealt.select("b", kind.alias("kind"), "g", "i", "v"))

    def far(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        gap = (v - w).astype(float)
        return np.round((gap * gap).sum(1), 9)

    def places(d: np.ndarray, h: np.ndarray, far_: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How many of the rows (far_, ids) come at each place between the hits (d, h)."""
        at, to = np.searchsorted(d, far_, "left"), np.searchsorted(d, far_, "right")
        for k in np.flatnonzero(at < to):
            at[k] += np.searchsorted(h[at[k] : to[k]], ids[k])
        return np.bincount(at, minlength=len(d) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked_, held, hits = None, [], [], None

        def found() -> list:
            """(query, vector, distances, rows, counts before) of each query, from the rows of the block's identities."""
            out = []
            if held:
                ids, who, w = (np.concatenate(x) for x in zip(*held, strict=True))
                for q_, i_, v in ((x, y, z) for part in asked_ for x, y, z in zip(*part, strict=True)):
                    d, mine = far(v, w), who == i_
                    same, other = mine & (ids != q_), ~mine & (ids != q_)
                    order = np.lexsort((ids[same], d[same]))
                    at, h = d[same][order], ids[same][order]
                    if len(h):
                        out.append((q_, v, at, h, places(at, h, d[other], ids[other])))
            return out

        def told() -> pa.RecordBatch:
            ap, first = [], []
            for _, _, d, _, n in found() if hits is None else hits:
                rank = np.cumsum(n)[: len(d)] + np.arange(1, len(d) + 1)
                ap.append(float((np.arange(1, len(d) + 1) / rank).mean()))
                first.append(int(rank[0]))
            return pa.RecordBatch.from_arrays([pa.array(ap, pa.float64()), pa.array(first, pa.int64())], ["ap", "first"])

        for batch in batches:
            b, k, ids, who = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "kind", "g", "i"))
            w = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
            for x, y in zip(cuts, [*cuts[1:], len(b)], strict=True):
                if b[x] != now:
                    if now is not None:
                        yield told()
                    now, asked_, held, hits = b[x], [], [], None
                part = (ids[x:y], who[x:y], w[x:y])
                if k[x] < 2:
                    (held if k[x] else asked_).append(part)
                    continue
                hits = found() if hits is None else hits
                for q_, v, d, h, n in hits:
                    other = part[0] != q_
                    n += places(d, h, far(v, part[2])[other], part[0][other])
        if now is not None:
            yield told()

    each = rows.repartition(parts, "b").sortWithinPartitions("b", "kind").mapInArrow(run, "ap double, first long")
    return each.agg(F.count("*").alias("n"), F.avg("ap").alias("mean_ap"), *[F.avg((F.col("first") <= r).cast("double")).alias(f"cmc_{r}") for r in ranks])


def panoptic_quality(pixels: DataFrame, image: str, void: int = 0) -> DataFrame:
    """(cls, tp, fp, fn, iou_sum, pq, sq, rq) of counts pixels(image, gt, gt_cls, crowd, pred, pred_cls, n) of overlapping segments; gt
    or pred void (with class null) is unlabelled.

    Segments of one class match if they overlap by more than half of their union, void left out; crowd segments match nothing.
    Unmatched predictions that are mostly void or crowd of their class are no errors.
    """
    g = pixels.where(F.col("gt") != void).groupBy(image, "gt", "gt_cls", "crowd").agg(F.sum("n").alias("ga"))
    p = pixels.where(F.col("pred") != void).groupBy(image, "pred", "pred_cls").agg(F.sum("n").alias("pa"), F.sum(F.when(F.col("gt") == void, F.col("n")).otherwise(0)).alias("empty"), F.sum(F.when(F.coalesce("crowd", F.lit(False)) & (F.col("gt_cls") == F.col("pred_cls")), F.col("n")).otherwise(0)).alias("crowded"))
    both = pixels.where((F.col("gt") != void) & (F.col("pred") != void) & (F.col("gt_cls") == F.col("pred_cls")) & ~F.col("crowd")).groupBy(image, "gt", "gt_cls", "pred").agg(F.sum("n").alias("i"))
    iou_of = F.col("i") / (F.col("ga") + F.col("pa") - F.col("i") - F.col("empty"))
    matched = both.join(g.select(image, "gt", "ga"), [image, "gt"]).join(p.select(image, "pred", "pa", "empty"), [image, "pred"]).withColumn("iou", iou_of).where("iou > 0.5")
    tp = matched.groupBy(F.col("gt_cls").alias("cls")).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    missed = g.where("NOT crowd").join(matched, [image, "gt"], "left_anti").groupBy(F.col("gt_cls").alias("cls")).agg(F.count("*").alias("fn"))
    wrong = p.join(matched, [image, "pred"], "left_anti").where("(empty + crowded) / pa <= 0.5").groupBy(F.col("pred_cls").alias("cls")).agg(F.count("*").alias("fp"))
    s = tp.join(missed, "cls", "full").join(wrong, "cls", "full").na.fill(0)
    whole = F.col("tp") + (F.col("fp") + F.col("fn")) / 2
    return s.select("cls", "tp", "fp", "fn", "iou_sum", F.coalesce(F.try_divide("iou_sum", whole), F.lit(0.0)).alias("pq"), F.coalesce(F.try_divide("iou_sum", "tp"), F.lit(0.0)).alias("sq"), F.coalesce(F.try_divide("tp", whole), F.lit(0.0)).alias("rq"))


def region_iou(df: DataFrame, by: list[str], intersection: str, union: str) -> DataFrame:
    """(by, n, mean_iou, whole_iou): the mean of the regions' overlaps, and the sum of intersections over that of unions."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.try_divide(intersection, union), F.lit(0.0))).alias("mean_iou"), F.try_divide(F.sum(intersection), F.sum(union)).alias("whole_iou"))
