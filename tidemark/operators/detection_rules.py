"""Detection scores of particular benchmarks: thresholds by size, class trees with groups, crowds, and tracks over frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, area, intersection
from ..sources.files import written
from .frames import first_of, greedy, near, per_frame
from .frames import area as area_of
from .frames import iof as iof_of
from .frames import iou as iou_of
from .matching import least_cost_many
from .metrics import running_sums

#: fixed values: false positives an image at which the miss rate is read, from 0.01 and from 0.0001
REFERENCES = {
    "from_-2": [0.0100, 0.0178, 0.03160, 0.0562, 0.1000, 0.1778, 0.3162, 0.5623, 1.000],
    "from_-4": [0.0001, 0.0003, 0.00100, 0.0032, 0.0100, 0.0316, 0.1000, 0.3162, 1.000],
}


def sized_positives(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, least: float = 0.5, areas: tuple[float, float] | None = None) -> DataFrame:
    """dets(key, det, score, ...) with tp and ignored: by score, each detection takes the free truth it overlaps most (then the smallest gt) among those
    whose own threshold it reaches, the smaller of least and w h / ((w + 10) (h + 10)), so that small truths are met more easily.

    truth may have a boolean column ignore. What takes an ignored truth, or one whose area is outside [from, to), counts neither way; so
    does a free detection outside.
    """
    w, h = box_t[2] - box_t[0], box_t[3] - box_t[1]
    need = F.least(F.lit(least), w * h / ((w + 10.0) * (h + 10.0)))
    out = (area(box_t) < areas[0]) | (area(box_t) >= areas[1]) if areas else F.lit(False)
    own = F.col("ignore") if "ignore" in truth.columns else F.lit(False)

    def fold(d: dict, t: dict) -> tuple:
        i, j, o = near(d["of"], t["of"], lambda i, j: iou_of(d["box"][i], t["box"][j]), lambda j: t["need"][j])
        return np.arange(len(d["id"])), [greedy(d["id"], d["score"], d["of"], i, j, -o, t["id"], t["ignored"], np.zeros(len(t["id"]), bool))]

    keep = [c for c in dets.columns if c not in (*key, "det", "score")]
    marked = per_frame(dets, truth, key, box_d, box_t, {"ignored": own | out, "need": need}, "mark int", fold, keep)
    outside = (area(box_d) < areas[0]) | (area(box_d) >= areas[1]) if areas else F.lit(False)
    return marked.withColumns({"tp": F.col("mark") == 1, "ignored": (F.col("mark") == -1) | ((F.col("mark") == 0) & outside)}).drop("mark")


def class_closure(parents: DataFrame) -> DataFrame:
    """(cls, above) of each class of parents(child, parent) and all classes above it, itself included. The paths double in length each round."""
    steps = parents.where("child <> parent").select(F.col("child").alias("cls"), F.col("parent").alias("above"))
    every = steps.select("cls").union(steps.select("above")).union(parents.select("child")).distinct().select("cls", F.col("cls").alias("above"))
    found, n = written(every.union(steps).distinct(), "closure"), -1
    while (count := found.count()) != n:
        n = count
        further = found.select(F.col("cls").alias("above"), F.col("above").alias("top"))
        found = written(found.join(further, "above").select("cls", F.col("top").alias("above")).distinct(), "closure")
    return found


def with_classes_above(rows: DataFrame, cls: str, closure: DataFrame) -> DataFrame:
    """rows once for its class and once for each above it (a class that the tree lacks stays alone)."""
    up = closure.select(F.col("cls").alias("__cls"), "above")
    return rows.join(up, F.col(cls) == F.col("__cls"), "left").withColumn(cls, F.coalesce("above", F.col(cls))).drop("__cls", "above")


def allowed_detections(dets: DataFrame, truth: DataFrame, image: str, cls: str, verified: DataFrame | None = None) -> DataFrame:
    """dets of classes that their image is annotated for: those of its truths and of verified(image, cls)."""
    known = truth.select(image, cls)
    known = known.union(verified.select(image, cls)) if verified is not None else known
    return dets.join(known.distinct(), [image, cls], "left_semi")


def grouped_positives(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, least: float = 0.5, least_inside: float = 0.5, annotated: bool = False, deal: list[str] | None = None, above: tuple[str, DataFrame] | None = None) -> DataFrame:
    """(key, det, score, tp) of the detections that count, where a truth with is_group is a crowd of its class.

    Other truths first: a detection's best truth (then the smallest gt) goes to the best scored one. A detection that reaches no such truth but
    lies in a group by least_inside of its area belongs to the group that covers most of it: the best scored of a group's is its one
    true positive, the others do not count. annotated: detections of keys without any truth do not count either (see allowed_detections()). deal and
    above: see per_frame(), above as with_classes_above().
    """

    def fold(d: dict, t: dict) -> tuple:
        over = lambda f: lambda i, j: f(d["box"][i], t["box"][j])
        n = len(d["id"])
        tp, counts = np.zeros(n, bool), np.ones(n, bool)
        if annotated:
            counts = np.isin(d["of"], t["of"])
        taken = np.zeros(n, bool)
        for group, f, limit in ((False, iou_of, least), (True, iof_of, least_inside)):
            where = np.flatnonzero(t["is_group"] == group)
            some = np.flatnonzero(~taken)
            i, j, o = near(d["of"][some], t["of"][where], lambda i, j: over(f)(some[i], where[j]), limit)
            i, j = some[i], where[j]
            own = first_of(i, -o, t["id"][j])
            i, j = i[own], j[own]
            best = i[first_of(j, -d["score"][i], d["id"][i])]
            taken[i], tp[best] = True, True
            if group:
                counts[i] = False
                counts[best] = True
        told = np.flatnonzero(counts)
        return told, [tp[told]]

    return per_frame(dets, truth, key, box_d, box_t, {"is_group": F.col("is_group")}, "tp boolean", fold, None, deal, above)


def crowd_matches(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, least: float = 0.5) -> DataFrame:
    """dets with mark: by score each takes the free truth it overlaps most (1); failing that, an ignored truth (truth.ignore) that covers least of
    its area takes it out of the count (-1), any number of times; else it is false (0)."""

    def fold(d: dict, t: dict) -> tuple:
        away = t["ignore"]
        i, j, o = near(d["of"], t["of"], lambda i, j: np.where(away[j], iof_of(d["box"][i], t["box"][j]), iou_of(d["box"][i], t["box"][j])), least)
        # free truths come before ignored ones
        return np.arange(len(d["id"])), [greedy(d["id"], d["score"], d["of"], i, j, np.where(away[j], 2.0, 0.0) - o, t["id"], away, away)]

    return per_frame(dets, truth, key, box_d, box_t, {"ignore": F.col("ignore")}, "mark int", fold, [c for c in dets.columns if c not in (*key, "det", "score")])


def crowd_curve(marked: DataFrame, truths: DataFrame, images: DataFrame, order: list[str], references: list[float] | None = None) -> DataFrame:
    """(ap, miss_rate): the trapezoid under precision by recall, and the log-average of the miss rate where the false positives an image first
    reach each of the references (at the last row where they never do). marked(score, mark, order columns), rows of mark -1 do not count.
    truths and images are tables of one row (n)."""
    rows = marked.where("mark >= 0").select(*order, (-F.col("score")).alias("__down"), F.col("mark").cast("long").alias("hit"))
    run = running_sums(rows, [], "__down", order, {"tp": F.col("hit"), "rank": F.lit(1)})
    both = run.join(F.broadcast(truths.select(F.col("n").alias("n_gt"))), F.lit(True)).join(F.broadcast(images.select(F.col("n").alias("n_img"))), F.lit(True))
    miss, rate = 1 - F.col("tp") / F.col("n_gt"), (F.col("rank") - F.col("tp")) / F.col("n_img")
    now, before = F.col("tp") / F.col("rank"), (F.col("tp") - F.col("hit")) / (F.col("rank") - 1)
    area_ = F.sum(F.when((F.col("hit") == 1) & (F.col("rank") > 1), (now + before) / 2)) / F.max("n_gt")
    refs = references or REFERENCES["from_-2"]
    at = [F.coalesce(F.min_by(miss, F.when(rate >= r, F.col("rank"))), F.max_by(miss, F.col("rank"))).alias(f"m{i}") for i, r in enumerate(refs)]
    found = both.agg(F.coalesce(area_, F.lit(0.0)).alias("ap"), *at)
    mean = sum((F.when(F.col(f"m{i}") > 0, F.log(F.col(f"m{i}"))).otherwise(F.lit(float("-inf"))) for i in range(len(refs))), F.lit(0.0)) / len(refs)
    return found.select("ap", F.exp(mean).alias("miss_rate"))


def crowd_jaccard(dets: DataFrame, truth: DataFrame, image: str, box: str, thresholds: list[float], least: float = 0.5) -> DataFrame:
    """(threshold, jaccard, matched, truths, detections) at each score: of an image the most pairs of truth and detection (score over the threshold) with
    enough overlap, by the sum of overlaps among equally many; k / (m + n - k), averaged over the images that have either. Free ones that an
    ignored truth covers do not count. Both tables have a box of four numbers in column box; a batch of images is in memory, and those with equally
    many boxes are matched at once."""

    def over(a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        w = np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])
        both = np.clip(w, 0, None).prod(-1)
        size = lambda v: (v[..., 2:] - v[..., :2]).prod(-1)
        whole = size(a) + 0 * both if inside else size(a) + size(b) - both
        return np.where(whole > 0, both / np.where(whole > 0, whole, 1), 0.0)

    def covered(rows: np.ndarray, of: np.ndarray, away: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which rows, of the images of, one of the image's n ignored truths covers; away is in the order of the images."""
        each = np.repeat(np.arange(len(rows)), n[of])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(n[of]) - n[of], n[of])
        hit = over(rows[each], away[(np.cumsum(n) - n)[of[each]] + nth], True) > least
        return np.bincount(each[hit], minlength=len(rows)) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            det, score, ignore, box_ = lists.flatten().flatten()
            many = len(lists)
            of = np.repeat(np.arange(many), lists.value_lengths().to_numpy())
            det, ignore = (x.to_numpy(zero_copy_only=False).astype(bool) for x in (det, ignore))
            score, boxes = score.to_numpy(zero_copy_only=False), box_.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            count = lambda mask: np.bincount(of[mask], minlength=many)
            begin = lambda n: np.cumsum(n) - n
            is_real, is_away = ~det & ~ignore, ~det & ignore
            real, n_real = boxes[is_real], count(is_real)
            away, n_away = boxes[is_away], count(is_away)
            hidden, hidden_det = covered(real, of[is_real], away, n_away), covered(boxes[det], of[det], away, n_away)
            told = []
            for level in thresholds:
                over_level = score[det] > level
                own, own_of, hidden_own = boxes[det][over_level], of[det][over_level], hidden_det[over_level]
                n_own = np.bincount(own_of, minlength=many)
                free_d, free_t, k = np.ones(len(own), bool), np.ones(len(real), bool), np.zeros(many, np.int64)
                for n, m in {(int(x), int(y)) for x, y in zip(n_own, n_real, strict=True) if x and y}:
                    same = np.flatnonzero((n_own == n) & (n_real == m))
                    for at in np.array_split(same, -(-len(same) // 4096)):
                        d, t = begin(n_own)[at][:, None] + np.arange(n), begin(n_real)[at][:, None] + np.arange(m)
                        o = over(own[d][:, :, None], real[t][:, None])
                        # a pair without enough overlap costs more than all others together
                        cols = least_cost_many(np.where(o >= least, 1 - o, 2.0 * (n + m)))
                        i, r = np.nonzero((cols >= 0) & (np.take_along_axis(o, np.maximum(cols, 0)[..., None], 2)[..., 0] >= least))
                        free_d[d[i, r]] = free_t[t[i, cols[i, r]]] = False
                        k[at] = np.bincount(i, minlength=len(at))
                m_all = n_real - np.bincount(of[is_real][hidden & free_t], minlength=many)
                n_all = n_own - np.bincount(own_of[hidden_own & free_d], minlength=many)
                told.append([np.full(many, level), k / (m_all + n_all - k + 1e-6), k, m_all, n_all])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*told, strict=True)], ["threshold", "ratio", "k", "m", "n"])

    schema = "threshold double, ratio double, k long, m long, n long"
    row = lambda det, score, ignore: F.struct(F.lit(det).alias("det"), score.alias("score"), ignore.alias("ignore"), F.col(box).cast("array<double>").alias("box"))
    rows = dets.select(image, row(True, F.col("score").cast("double"), F.lit(False)).alias("r")).unionAll(truth.select(image, row(False, F.lit(0.0), F.col("ignore")).alias("r")))
    each = rows.groupBy(image).agg(F.collect_list("r").alias("rows")).select("rows").mapInArrow(run, schema)
    some = (F.col("m") != 0) | (F.col("n") != 0)
    return each.groupBy("threshold").agg(F.try_divide(F.sum("ratio"), F.count_if(some)).alias("jaccard"), F.sum("k").alias("matched"), F.sum("m").alias("truths"), F.sum("n").alias("detections"))


def tube_overlaps(a: DataFrame, b: DataFrame, key: list[str], frame: str, track_a: str, track_b: str, box_a: Box, box_b: Box) -> DataFrame:
    """(key, track_a, track_b, iou) of tracks that touch in some frame: the sum of their boxes' intersections over that of their unions, where a frame
    that only one of them has counts with its box."""
    size = lambda t, track, box, name: t.groupBy(*key, track).agg(F.sum(area(box)).alias(name))
    shared = a.join(b, [*key, frame]).groupBy(*key, track_a, track_b).agg(F.sum(intersection(box_a, box_b)).alias("__i")).where("__i > 0")
    both = shared.join(size(a, track_a, box_a, "__a"), [*key, track_a]).join(size(b, track_b, box_b, "__b"), [*key, track_b])
    return both.select(*key, track_a, track_b, (F.col("__i") / (F.col("__a") + F.col("__b") - F.col("__i"))).alias("iou"))


def track_scores(matches: DataFrame, truths: DataFrame, preds: DataFrame, video: list[str], frame: str, gt: str, track: str) -> DataFrame:
    """(video, n_gt, n_pred, tp, fp, fn, switches, fragments, mota) of matches(video, frame, gt, track), one truth and one track a pair and frame.

    A switch: a truth is matched by another track than when it was matched last. A fragment: a truth is matched again after frames of its own
    without a match. mota is 1 - (fn + fp + switches) / n_gt."""
    w = Window.partitionBy(*video, gt).orderBy(frame)
    rows = truths.select(*video, frame, gt).join(matches.select(*video, frame, gt, track), [*video, frame, gt], "left")
    last = F.last(track, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumns({"__last": last, "__gap": F.lag(F.col(track).isNull()).over(w)})
    found = F.col(track).isNotNull()
    each = marked.groupBy(*video).agg(F.count("*").alias("n_gt"), F.count(track).alias("tp"), F.count_if(found & (F.col("__last") != F.col(track))).alias("switches"), F.count_if(found & F.col("__gap") & F.col("__last").isNotNull()).alias("fragments"))
    out = each.join(preds.groupBy(*video).agg(F.count("*").alias("n_pred")), video, "full").na.fill(0)
    out = out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    return out.select(*video, "n_gt", "n_pred", "tp", "fp", "fn", "switches", "fragments", F.try_divide(F.col("n_gt") - F.col("fn") - F.col("fp") - F.col("switches"), "n_gt").alias("mota"))


def identity_scores(pairs: DataFrame, truths: DataFrame, preds: DataFrame, video: str, gt: str, track: str) -> DataFrame:
    """(video, idtp, idf1): each truth track goes to one track at most, so that the frames in which they overlap, pairs(video, gt, track, ...) with
    a row a frame, are as many as possible. A video's counts by pair of tracks are in memory."""
    counts = pairs.groupBy(video, gt, track).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            size = cells.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(size)), size)
            g, t, n = cells.flatten().flatten()
            # numbers from 0 of a video's truths and tracks
            at = []
            for x in (g, t):
                code = pc.fill_null(x.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                pair, back = np.unique(np.stack([of, code], 1), axis=0, return_inverse=True)
                count = np.bincount(pair[:, 0], minlength=len(size))
                at.append((back.ravel() - (np.cumsum(count) - count)[of], count))
            (row, rows), (col, cols) = at
            best = np.zeros(len(size), np.int64)
            for r, c in {(int(x), int(y)) for x, y in zip(rows, cols, strict=True)}:
                same = np.flatnonzero((rows == r) & (cols == c))
                place = np.full(len(size), -1)
                place[same] = np.arange(len(same))
                some = place[of] >= 0
                table = np.zeros((len(same), r, c))
                table[place[of[some]], row[some], col[some]] = n.to_numpy()[some]
                found = least_cost_many(-table)
                best[same] = (np.take_along_axis(table, np.maximum(found, 0)[..., None], 2)[..., 0] * (found >= 0)).sum(1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(video), pa.array(best)], [video, "idtp"])

    cells = F.collect_list(F.struct(F.col(gt).alias("g"), F.col(track).alias("t"), "n"))
    best = counts.groupBy(video).agg(cells.alias("cells")).mapInArrow(run, f"{video} {dict(counts.dtypes)[video]}, idtp long")
    size = truths.groupBy(video).agg(F.count("*").alias("__g")).join(preds.groupBy(video).agg(F.count("*").alias("__p")), video, "full").na.fill(0)
    out = size.join(best, video, "left").na.fill(0, ["idtp"])
    return out.select(video, "idtp", F.try_divide(2 * F.col("idtp"), F.col("__g") + F.col("__p")).alias("idf1"))


def limited(dets: DataFrame, by: list[str], most: int, name: str = "place", shares: int = 64) -> DataFrame:
    """The first most rows of each group by score (ties by det), with their place from 1. A group is ranked in shares first, so no task gets all of it."""
    order = [F.desc("score"), "det"]
    cut = lambda t, keys: t.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)
    return cut(cut(dets.withColumn("__share", F.pmod(F.xxhash64("det"), F.lit(shares))), [*by, "__share"]).drop("__share"), by)


def ranged_scores(dets: DataFrame, truth: DataFrame, image: str, cls: str, box_d: Box, box_t: Box, thresholds: list[float], ranges: dict[str, tuple[float, float]], limits: list[int], per_class: int | None = None) -> DataFrame:
    """(metric, range, limit, value): `ap` of each range [from, to) of areas, the mean over thresholds and classes of the precision at 101 recalls, with the
    largest limit; and `ar`, the mean recall, at each limit of detections of one image and class for the first range, and of the others at the largest.

    truth has a boolean ignore (crowds): a detection that is free otherwise and lies in one by the threshold's share of its own area does not count, and
    any number of them may. By score each detection takes the free truth it overlaps most; truths out of the range come after those within, and what takes
    one does not count, nor does a free detection out of the range. Classes without a truth within a range are left out of its means. With per_class,
    only so many detections of a class count over all images, the best scored.
    """
    from .detection import detection_ap

    kept = dets if per_class is None else limited(dets, [cls], per_class, "__all").drop("__all")
    kept = limited(kept, [image, cls], max(limits))
    levels = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(n).alias("range"), F.lit(float(lo)).alias("__lo"), F.lit(float(hi)).alias("__hi")) for n, (lo, hi) in ranges.items() for t in thresholds])
    outside = lambda v: (F.col(v) < F.col("__lo")) | (F.col(v) >= F.col("__hi"))
    every = [(float(t), float(lo), float(hi)) for lo, hi in ranges.values() for t in thresholds]

    def fold(d: dict, t: dict) -> tuple:
        away, size = t["ignore"], area_of(t["box"])
        i, j, o = near(d["of"], t["of"], lambda i, j: np.where(away[j], iof_of(d["box"][i], t["box"][j]), iou_of(d["box"][i], t["box"][j])), min(thresholds))
        marks = []
        for level, lo, hi in every:
            out, ok = away | (size < lo) | (size >= hi), o >= level
            order = np.where(out[j[ok]], 2.0, 0.0) - o[ok]
            marks.append(greedy(d["id"], d["score"], d["of"], i[ok], j[ok], order, t["id"], out, away))
        return np.arange(len(d["id"])), [pa.array(list(np.stack(marks, 1)), pa.list_(pa.int32())), area_of(d["box"])]

    key = ["threshold", "range", image, cls]
    found = per_frame(kept.drop("place"), truth, [image, cls], box_d, box_t, {"ignore": F.col("ignore")}, "marks array<int>, __da double", fold)
    placed = limited(found, [image, cls], max(limits))
    told = placed.select("*", F.posexplode(levels).alias("__i", "__l")).select(image, cls, "det", "score", "place", "__da", "__l.*", F.get("marks", F.col("__i")).alias("mark"))
    marked = told.where("mark >= 0").withColumn("tp", F.col("mark") == 1).where(F.col("tp") | ~outside("__da"))
    by = ["threshold", "range", cls]
    n = truth.where("NOT ignore").select(cls, area(box_t).alias("__ta")).select("*", F.inline(levels)).where(~outside("__ta")).groupBy(*by).agg(F.count("*").alias("n_gt"))
    marked = written(marked.select(*key, "det", "score", "place", "tp"), "marked")
    ap = n.join(detection_ap(marked.withColumn("key_order", F.col(image)), by, n, 101), by, "left").groupBy("range").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("value"))
    hits = marked.where("tp").groupBy(*by).agg(*[F.count_if(F.col("place") <= k).alias(f"k{k}") for k in limits])
    recall = n.join(hits, by, "left").select("range", F.explode(F.array(*[F.struct(F.lit(k).alias("limit"), (F.coalesce(f"k{k}", F.lit(0)) / F.col("n_gt")).alias("r")) for k in limits])).alias("x"))
    first = next(iter(ranges))
    ar = recall.where((F.col("range") == first) | (F.col("x.limit") == max(limits))).groupBy("range", F.col("x.limit").alias("limit")).agg(F.avg("x.r").alias("value"))
    return ap.select(F.lit("ap").alias("metric"), "range", F.lit(max(limits)).alias("limit"), "value").unionByName(ar.withColumn("metric", F.lit("ar")))
