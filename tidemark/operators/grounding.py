"""Scores of phrases grounded in boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, iou


def reference_precision(dets: DataFrame, targets: DataFrame, key: list[str], group: str, box_d: Box, box_t: Box, ks: list[int], least: float = 0.5) -> DataFrame:
    """(group, k, n, precision): the share of targets(key, group, one box each) that one of the first k boxes of dets(key, rank from 1) overlaps by at least
    least. group null: the mean of all groups' precisions. A target without boxes is missed."""
    near = dets.where(F.col("rank") <= max(ks)).join(targets, key).where(iou(box_d, box_t) >= least)
    first = near.groupBy(*key).agg(F.min("rank").alias("first"))
    each = targets.select(*key, group).join(first, key, "left").select(group, "first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    out = each.groupBy(group, "k").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))).alias("precision"))
    mean = out.agg(F.lit(None).cast(dict(out.dtypes)[group]).alias(group), F.lit(None).cast("int").alias("k"), F.sum("n").alias("n"), F.avg("precision").alias("precision"))
    return out.unionByName(mean)


def general_references(dets: DataFrame, truth: DataFrame, key: str, box_d: Box, box_t: Box, score: float = 0.7, least: float = 0.5, least_f1: float = 1.0) -> DataFrame:
    """(n, f1_score, target_accuracy, no_target_accuracy) of references to any number of boxes, none included.

    Detections at or over the score count. A reference whose truths have the boolean none has no target: right if nothing is detected.
    Others: the best pair of detection and truth is taken again and again while it overlaps by least; an image is right if its F1 reaches
    least_f1. target_accuracy: references with targets for which anything is detected; no_target_accuracy: those without, for which
    nothing is. Of one image the pairs fold in one array.
    """
    kept = dets.where(F.col("score") >= score)
    size = truth.groupBy(key).agg(F.bool_or("none").alias("none"), F.count("*").alias("n_gt"))
    called = kept.groupBy(key).agg(F.count("*").alias("n_det"))
    pairs = kept.join(truth.where("NOT none"), key).withColumn("o", iou(box_d, box_t)).where(F.col("o") >= least)
    item = F.struct((-F.col("o")).alias("o"), F.col("det").cast("bigint").alias("d"), F.col("gt").cast("bigint").alias("g"))
    lists = pairs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.expr("cast(array() AS array<struct<o:double,d:bigint,g:bigint>>)")
    step = lambda acc, x: F.when(F.exists(acc, lambda a: (a["d"] == x["d"]) | (a["g"] == x["g"])), acc).otherwise(F.array_append(acc, x))
    tp = lists.select(key, F.size(F.aggregate("items", zero, step)).alias("tp"))
    rows = size.join(called, key, "left").join(tp, key, "left").na.fill(0, ["n_det", "tp"])
    f1 = F.when(F.col("none"), (F.col("n_det") == 0).cast("double")).otherwise(2 * F.col("tp") / (F.col("n_det") + F.col("n_gt")))
    share = lambda what, of: F.try_divide(F.count_if(what & of), F.count_if(of))
    some = F.col("n_det") > 0
    return rows.agg(F.count("*").alias("n"), F.avg((f1 >= least_f1).cast("double")).alias("f1_score"), share(some, ~F.col("none")).alias("target_accuracy"), share(~some, F.col("none")).alias("no_target_accuracy"))


def phrase_recall(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, ks: list[int], least: float = 0.5, merged: bool = False, category: str | None = None) -> DataFrame:
    """(category, k, n, recall): the share of phrases(key) of truth for which one of the first k boxes (-1: any) of dets(key, rank from 1) overlaps one of the
    phrase's boxes by least or, if merged, the box around all of them. category `all` counts every phrase; with a column category, each of its
    values as well."""
    if merged:
        around = [F.min(box_t[0]), F.min(box_t[1]), F.max(box_t[2]), F.max(box_t[3])]
        truth = truth.groupBy(*key, *([category] if category else [])).agg(*[c.alias(f"__{n}") for c, n in zip(around, ("x1", "y1", "x2", "y2"), strict=True)])
        box_t = tuple(F.col(f"__{n}") for n in ("x1", "y1", "x2", "y2"))
    first = dets.join(truth, key).where(iou(box_d, box_t) >= least).groupBy(*key).agg(F.min("rank").alias("first"))
    kinds = F.array(F.lit("all"), F.col(category).cast("string")) if category else F.array(F.lit("all"))
    phrases = truth.select(*key, *([category] if category else [])).distinct().join(first, key, "left")
    each = phrases.select("first", F.explode(F.array_compact(kinds)).alias("category")).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = F.col("first").isNotNull() & ((F.col("k") < 0) | (F.col("first") <= F.col("k")))
    return each.groupBy("category", "k").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("recall"))


def run_comparison(reference: DataFrame, other: DataFrame, key: list[str], frame: str, cue: str, box_r: Box, box_o: Box, episode_rows: int, least: float = 0.5, cell: float = 40.0) -> DataFrame:
    """One row: frames_compared, track_coverage, cue_agreement, n_episodes_reference, n_episodes_here, episode_agreement of two runs over the same
    frames, rows (key, frame, row, cue, box).

    In frames that both have, each box of the reference is held against the best overlapping one of the other run (over least; of equal ones the smallest
    row). An episode is a run of one cue at one place, the box's centre in cells of that size, that spans episode_rows frames and is followed by another row.
    """
    both = reference.select(*key, frame).distinct().join(other.select(*key, frame).distinct(), [*key, frame])
    r = reference.join(both, [*key, frame], "left_semi").select(*key, frame, F.col("row").alias("__r"), F.col(cue).alias("__rc"), *[c.alias(f"__r{i}") for i, c in enumerate(box_r)])
    o = other.select(*key, frame, F.col("row").alias("__o"), F.col(cue).alias("__oc"), *[c.alias(f"__o{i}") for i, c in enumerate(box_o)])
    over = iou(tuple(F.col(f"__r{i}") for i in range(4)), tuple(F.col(f"__o{i}") for i in range(4)))
    pairs = r.join(o, [*key, frame]).withColumn("__iou", over).where(F.col("__iou") > least)
    best = pairs.groupBy(*key, frame, "__r", "__rc").agg(F.max_by("__oc", F.struct("__iou", -F.col("__o"))).alias("__oc"))
    seen = best.agg(F.count("*").alias("covered"), F.count_if(F.col("__oc") == F.col("__rc")).alias("agree"))
    sizes = r.agg(F.count("*").alias("total")).join(F.broadcast(both.agg(F.count("*").alias("frames_compared"))), F.lit(True))

    def episodes(rows: DataFrame, box: Box) -> DataFrame:
        # halves go to the even cell
        place = rows.select(*key, frame, "row", F.col(cue).alias("c"), F.bround((box[0] + box[2]) / cell).cast("long").alias("px"), F.bround((box[1] + box[3]) / cell).cast("long").alias("py"))
        w = Window.partitionBy(*key, "px", "py").orderBy(frame, "row")
        turn = F.coalesce((F.col("c") != F.lag("c").over(w)).cast("long"), F.lit(1))
        runs = place.withColumns({"__turn": turn, "__next": F.lead(frame).over(w)}).withColumn("__run", F.sum("__turn").over(w))
        each = runs.groupBy(*key, "px", "py", "__run", "c").agg(F.min(frame).alias("a"), F.max_by("__next", F.struct(frame, "row")).alias("b"))
        return each.where(F.col("b") - F.col("a") >= episode_rows).select(*key, "px", "py", "c").distinct()

    er, eo = episodes(reference, box_r), episodes(other, box_o)
    marks = er.withColumn("r", F.lit(1)).join(eo.withColumn("o", F.lit(1)), [*key, "px", "py", "c"], "full")
    counts = marks.agg(F.count("r").alias("n_episodes_reference"), F.count("o").alias("n_episodes_here"), F.count_if(F.col("r").isNotNull() & F.col("o").isNotNull()).alias("shared"))
    one = sizes.join(F.broadcast(seen), F.lit(True)).join(F.broadcast(counts), F.lit(True))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return one.select("frames_compared", ratio("covered", "total").alias("track_coverage"), ratio("agree", "covered").alias("cue_agreement"), "n_episodes_reference", "n_episodes_here", ratio("shared", "n_episodes_reference").alias("episode_agreement"))
