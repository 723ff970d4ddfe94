"""Classification, agreement, ranking and calibration metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.files import written
from .frames import starts


def confusion(df: DataFrame, truth: str, pred: str, k: int) -> DataFrame:
    """(t, p, n) of the pairs of class ids in [0, k)."""
    inside = F.col(truth).between(0, k - 1) & F.col(pred).between(0, k - 1)
    return df.where(inside).groupBy(F.col(truth).cast("long").alias("t"), F.col(pred).cast("long").alias("p")).agg(F.count("*").alias("n"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(cm: DataFrame, k: int) -> DataFrame:
    """(cls, precision, recall, f1, support) of each class; 0 where undefined."""
    each = cm.select(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"))
    each = each.union(cm.select(F.col("p"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("n")))
    zero = F.lit(0).cast("long")
    classes = cm.sparkSession.range(k).select(F.col("id").alias("cls"), zero.alias("tp"), zero.alias("support"), zero.alias("called"))
    s = each.union(classes).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    p, r = _ratio(F.col("tp"), F.col("called")), _ratio(F.col("tp"), F.col("support"))
    return s.select("cls", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support")


def summary(cm: DataFrame, k: int) -> DataFrame:
    """Macro F1 and balanced accuracy over the classes that occur, F1 weighted by support, accuracy."""
    c = per_class(cm, k)
    seen = F.col("support") > 0
    total = cm.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("right"))
    means = c.agg(F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return means.join(F.broadcast(total.select((F.col("right") / F.col("n")).alias("accuracy"))), F.lit(True))


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa and share of agreement of two labels, by group; kappa is 1 if chance agreement is."""
    return counted_kappa(df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")), by).drop("n")


def counted_kappa(n: DataFrame, by: list[str]) -> DataFrame:
    """kappa() of counts n(by, a, b, n), with n, the rows of the group."""
    total = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: n.groupBy(*by, F.col(c).alias("v")).agg(F.sum("n").alias(f"n{c}"))
    chance = side("a").join(side("b"), [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    joined = total.join(chance, by, "left") if by else total.join(F.broadcast(chance), F.lit(True), "left")
    po, pe = F.col("same") / F.col("total"), F.coalesce("both", F.lit(0)) / (F.col("total") * F.col("total"))
    return joined.select(*by, F.col("total").alias("n"), po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(cm: DataFrame, k: int) -> DataFrame:
    """Quadratically weighted kappa of confusion counts."""
    rows, cols = cm.groupBy("t").agg(F.sum("n").alias("r")), cm.groupBy("p").agg(F.sum("n").alias("c"))
    w = lambda x, y: F.pow(F.col(x) - F.col(y), 2) / F.lit(float((k - 1) ** 2))
    seen = cm.agg(F.sum(w("t", "p") * F.col("n")).alias("o"), F.sum("n").alias("n"))
    # k classes at most on either side
    by_chance = rows.join(F.broadcast(cols), F.lit(True)).agg(F.sum(w("t", "p") * F.col("r") * F.col("c")).alias("e"))
    return seen.join(F.broadcast(by_chance), F.lit(True)).select((1 - F.col("o") / (F.col("e") / F.col("n"))).alias("qwk"))


def running_sums(df: DataFrame, by: list[str], order: str, tie: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of a column over the rows of its group up to and with this one, by (order, tie).

    Rows are dealt by ranges of (by, order, tie), as even as a sample of them tells however uneven order is, and each range is summed in order
    and written once; only a row for each group in a range meets in the window of the ranges' totals. A null adds nothing.
    """
    keys = [*by, order, *tie]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumns({f"__{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    own = own.withColumns({f"__{n}": F.col(f"__{n}").cast("double" if dict(own.dtypes)[f"__{n}"] in ("double", "float") else "bigint") for n in sums})
    kinds = dict(own.dtypes)
    dealt = own.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    columns, names = dealt.columns, list(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = starts([batch.column(k) for k in by]) if by else np.arange(batch.num_rows) == 0
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, batch.num_rows])
            ends = [[batch.column(k)[i].as_py() for k in by] for i in (0, -1)]
            told = []
            for n in names:
                run_ = np.cumsum(batch.column(f"__{n}").to_numpy())
                # of the groups that begin here what was summed before them goes, the first may go on from the last batch
                before = np.r_[0, run_[begin[1:] - 1]].astype(run_.dtype)
                run_ = run_ - np.repeat(before, size)
                if ends[0] == last:
                    run_[: size[0]] += upto[n]
                told.append(run_)
            last, upto = ends[1], {n: t[-1] for n, t in zip(names, told, strict=True)}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *map(pa.array, told)], [*columns, *names])

    shape = StructType([*dealt.schema.fields, *[StructField(n, DoubleType() if kinds[f"__{n}"] == "double" else LongType()) for n in sums]])
    ranged = written(dealt.mapInArrow(run, shape), "running")
    key = [*by, "__part"]
    totals = ranged.groupBy(*key).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = written(totals.select(*key, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums]), "earlier")
    local = ranged.drop(*[f"__{n}" for n in sums])
    same = [local[k].eqNullSafe(earlier[k]) for k in key]
    joined = local.join(earlier, reduce(and_, same)).select(*[local[c] for c in local.columns if c != "__part"], *[earlier[f"__{n}"] for n in sums])
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums])


def mean_ranks(df: DataFrame, by: list[str], value: str, *counts: Column) -> DataFrame:
    """(by, value, n, rank, counts...): the mean rank from 1 of each distinct value, and aggregates of its rows."""
    ties = df.groupBy(*by, value).agg(F.count("*").alias("n"), *counts)
    return running_sums(ties, by, value, [], {"__upto": F.col("n")}).withColumn("rank", F.col("__upto") - F.col("n") + (F.col("n") + 1) / 2).drop("__upto")


def auroc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by mean ranks, by group; null where one class is absent. Rows of equal scores are counted together."""
    ranked = mean_ranks(df, by, score, F.sum(F.col(positive).cast("long")).alias("pos"))
    s = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return s.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], score: str, positive: str, tie: str) -> DataFrame:
    """Step-wise average precision; equal scores keep the order of tie. Null where nothing is positive."""
    rows = df.select(*by, (-F.col(score)).alias("__down"), tie, F.col(positive).cast("long").alias("__hit"))
    run = running_sums(rows, by, "__down", [tie], {"__tp": F.col("__hit"), "__rank": F.lit(1)})
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("__hit") == 1, F.col("__tp") / F.col("__rank"))), F.sum("__hit")).alias("average_precision"))


def class_ranking(df: DataFrame, probs: str, truth: str, tie: str) -> DataFrame:
    """(cls, auroc, average_precision) of each class's probability against all others; null where a class is absent or universal."""
    each = df.select(truth, tie, F.posexplode(probs).alias("cls", "score")).withColumn("pos", F.col(truth) == F.col("cls"))
    ap = average_precision(each, ["cls"], "score", "pos", tie)
    both = auroc(each, ["cls"], "score", "pos").join(ap, "cls")
    return both.select("cls", "auroc", F.when(F.col("auroc").isNotNull(), F.col("average_precision")).alias("average_precision"))


def classwise_calibration(df: DataFrame, probs: str, truth: str, bins: int = 15) -> DataFrame:
    """(cls, ece) of each class's probability against its frequency, right-closed bins; cls null: the mean of the classes."""
    each = df.select(truth, F.posexplode(probs).alias("cls", "score")).withColumn("right", (F.col(truth) == F.col("cls")).cast("double"))
    at = F.least(F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0)), F.lit(bins - 1))
    binned = each.groupBy("cls", at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("c"), F.avg("right").alias("a"))
    one = binned.groupBy("cls").agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))
    return one.unionByName(one.agg(F.lit(None).cast("int").alias("cls"), F.avg("ece").alias("ece")))


def probability_losses(df: DataFrame, probs: str, truth: str) -> DataFrame:
    """(brier, nll): the mean squared distance of the probabilities from the true class (0 to 2), and the mean negative log of its
    probability, at least 1e-12."""
    square = F.aggregate(F.transform(probs, lambda p, i: F.pow(p - (i == F.col(truth)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    own = F.get(probs, F.col(truth).cast("int"))
    return df.agg(F.avg(square).alias("brier"), F.avg(-F.log(F.least(F.greatest(own, F.lit(1e-12)), F.lit(1.0)))).alias("nll"))


def frame_metrics(df: DataFrame, probs: str, truth: str, tie: str, k: int) -> DataFrame:
    """(metric, value): accuracy and F1 scores of the top class, losses, calibration errors and mean ranking scores of rows with class
    probabilities. A negative or null label is an error."""
    bad = F.col(truth).isNull() | (F.col(truth) < 0) | (F.col(truth) >= k)
    checked = df.withColumn(truth, F.when(bad, F.raise_error(F.lit("label out of range")).cast("int")).otherwise(F.col(truth)))
    top = F.array_max(probs)
    rows = checked.select(probs, truth, tie, (F.array_position(probs, top) - 1).alias("__pred"), top.alias("__conf")).withColumn("__right", F.col("__pred") == F.col(truth))
    scores = summary(confusion(rows, truth, "__pred", k), k)
    losses = probability_losses(rows, probs, truth)
    ece = calibration_error(reliability(rows, "__conf", "__right"))
    macro_ece = classwise_calibration(rows, probs, truth).where("cls IS NULL").select(F.col("ece").alias("classwise_ece"))
    ranks = class_ranking(rows, probs, truth, tie).agg(F.avg("auroc").alias("macro_auroc"), F.avg("average_precision").alias("macro_auprc"))
    out = None
    for part in (scores, losses, ece, macro_ece, ranks):
        long = part.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in part.columns])))
        out = long if out is None else out.unionByName(long)
    return out


def risk_curve(df: DataFrame, probs: str, truth: str, k: int, abstain: int, thresholds: int = 50) -> DataFrame:
    """(threshold, coverage, selective_error, selective_macro_f1, abstain_accuracy, abstain_macro_f1) at 0, 1/thresholds, ...

    Selective scores are over the rows whose top probability reaches the threshold; for abstain scores the others are called the
    abstain class. Rows are first counted by (level, truth, prediction), so the curve costs one pass over them.
    """
    top = F.array_max(probs)
    level = F.least(F.floor(F.round(top * thresholds, 9)), F.lit(thresholds - 1)).cast("int")
    counts = df.groupBy(level.alias("level"), F.col(truth).cast("long").alias("t"), (F.array_position(probs, top) - 1).alias("p")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(thresholds).select(F.col("id").cast("int").alias("at"))
    # at most thresholds * k * k counts meet the grid
    seen = counts.join(F.broadcast(grid), F.lit(True)).withColumn("kept", F.col("level") >= F.col("at"))
    kept = _f1_by(seen.where("kept"), "at", F.col("p"))
    all_rows = _f1_by(seen, "at", F.when(F.col("kept"), F.col("p")).otherwise(F.lit(abstain)))
    both = all_rows.join(kept.toDF("at", "kn", "kacc", "kf1"), "at", "left")
    return both.select((F.col("at") / thresholds).alias("threshold"), (F.coalesce("kn", F.lit(0)) / F.col("n")).alias("coverage"), (1 - F.col("kacc")).alias("selective_error"), F.col("kf1").alias("selective_macro_f1"), F.col("acc").alias("abstain_accuracy"), F.col("f1").alias("abstain_macro_f1"))


def _f1_by(counts: DataFrame, by: str, pred: Column) -> DataFrame:
    """(by, n, acc, f1) of counts(by, t, n) with a prediction: accuracy, and F1 averaged over the classes that are there."""
    c = counts.select(by, "t", pred.alias("p"), "n")
    each = c.select(by, F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q")).unionAll(c.select(by, "p", F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    s = each.groupBy(by, "c").agg(*[F.sum(x).alias(x) for x in ("tp", "s", "q")])
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("s") + F.col("q"))).otherwise(F.lit(0.0))
    return s.groupBy(by).agg(F.sum("s").alias("n"), (F.sum("tp") / F.sum("s")).alias("acc"), F.avg(F.when(F.col("s") > 0, f1)).alias("f1"))


def area_under_risk(curve: DataFrame) -> DataFrame:
    """(aurc): the trapezoid under selective error by coverage, over the covered range; points without an error are left out."""
    w = Window.partitionBy(F.lit(0)).orderBy("coverage", "threshold")  # one row a threshold
    p = curve.where("selective_error IS NOT NULL").select("coverage", "selective_error", F.lag("coverage").over(w).alias("c0"), F.lag("selective_error").over(w).alias("e0"))
    area = F.sum((F.col("coverage") - F.col("c0")) * (F.col("selective_error") + F.col("e0")) / 2)
    return p.agg((area / F.greatest(F.max("coverage") - F.min("coverage"), F.lit(1e-9))).alias("aurc"))


def choose_thresholds(curve: DataFrame, coverage: float = 0.9, accuracy: float = 0.85, disabled: float = 1.01) -> DataFrame:
    """(display, alert): the highest threshold that still covers so much, and the lowest whose kept rows are right so often; alerts are
    disabled if there is none."""
    display = F.max(F.when(F.col("coverage") >= coverage, F.col("threshold")))
    alert = F.min(F.when(1 - F.col("selective_error") >= accuracy, F.col("threshold")))
    return curve.agg(display.alias("display"), F.coalesce(alert, F.lit(disabled)).alias("alert"))


def reliability(df: DataFrame, confidence: str, right: str, bins: int = 15, right_closed: bool = True) -> DataFrame:
    """(bin, n, confidence, accuracy) of bins of equal width: right-closed with 0 in the first, or left-closed with 1 in the last."""
    at = F.ceil(F.col(confidence) * bins) - 1 if right_closed else F.floor(F.col(confidence) * bins)
    at = F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(right).cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def coverage_risk(df: DataFrame, confidence: str, right: str, thresholds: int = 50) -> DataFrame:
    """(threshold, coverage, risk) at 0, 1/thresholds, ...: share of rows at least that sure, and their share of errors."""
    level = F.least(F.floor(F.col(confidence) * thresholds), F.lit(thresholds - 1)).cast("long")
    counts = df.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum((~F.col(right)).cast("long")).alias("bad"))
    grid = df.sparkSession.range(thresholds).select(F.col("id").alias("level"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("level"))  # one row a threshold
    full = grid.join(counts, "level", "left").withColumns({"at": F.sum(F.coalesce("n", F.lit(0))).over(w), "wrong": F.sum(F.coalesce("bad", F.lit(0))).over(w)})
    total = F.max("at").over(Window.partitionBy(F.lit(0)))
    return full.select((F.col("level") / thresholds).alias("threshold"), (F.col("at") / total).alias("coverage"), F.try_divide(F.col("wrong"), F.col("at")).alias("risk"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of mean ranks, by group."""
    pairs = df.groupBy(*by, x, y).agg(F.count("*").alias("__w"))
    rank = lambda c, name: mean_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, c).select(*by, c, F.col("rank").alias(name))
    both = pairs.join(rank(x, "rx"), [*by, x]).join(rank(y, "ry"), [*by, y])
    w = F.col("__w")
    s = both.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * F.col("rx")).alias("sx"), F.sum(w * F.col("ry")).alias("sy"), F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"), F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(w * F.col("ry") * F.col("ry")).alias("syy"))
    top = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    side = lambda a, b: F.col(b) - F.col(a) * F.col(a) / F.col("n")
    return s.select(*by, F.try_divide(top, F.sqrt(side("sx", "sxx") * side("sy", "syy"))).alias("spearman"))


def spearman_ordinal(df: DataFrame, by: list[str], x: str, y: str, tie: str) -> DataFrame:
    """Correlation of ranks without ties, by group: equal values go by tie."""
    one = running_sums(df.select(*by, x, y, tie), by, x, [tie], {"rx": F.lit(1)})
    two = running_sums(one, by, y, [tie], {"ry": F.lit(1)})
    return two.groupBy(*by).agg(F.corr("rx", "ry").alias("spearman"))


def ordinal_scores(df: DataFrame, truth: str, pred: str, k: int) -> DataFrame:
    """One row of ordinal scores of two level ids: n, accuracy, average_accuracy, macro_f1, mae, qwk, spearman."""
    cm = confusion(df, truth, pred, k)
    s = summary(cm, k).select("accuracy", F.col("balanced_accuracy").alias("average_accuracy"), "macro_f1")
    mae = df.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(truth) - F.col(pred))).alias("mae"))
    return mae.join(F.broadcast(s), F.lit(True)).join(F.broadcast(weighted_kappa(cm, k)), F.lit(True)).join(F.broadcast(spearman(df, [], truth, pred)), F.lit(True))


def flag_rates(df: DataFrame, flag: str, cls: str, high: str, low: str) -> DataFrame:
    """(cls, n, rate, spread, contrast): the flag's rate in each class, the largest less the smallest rate, and the rate of one class
    less that of another."""
    r = df.groupBy(cls).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))
    whole = r.agg((F.max("rate") - F.min("rate")).alias("spread"), (F.max(F.when(F.col(cls) == high, F.col("rate"))) - F.max(F.when(F.col(cls) == low, F.col("rate")))).alias("contrast"))
    return r.join(F.broadcast(whole), F.lit(True))


def mutual_information(df: DataFrame, flag: str, cls: str) -> DataFrame:
    """Bits that a flag and a class share."""
    n = df.groupBy(F.col(flag).alias("f"), F.col(cls).alias("c")).agg(F.count("*").alias("n"))
    whole = lambda *by: F.sum("n").over(Window.partitionBy(*(by or (F.lit(0),))))
    s = n.withColumns({"nf": whole("f"), "nc": whole("c"), "all": whole()})
    return s.agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("nf") * F.col("nc")))).alias("bits"))


def temperature_grid(df: DataFrame, probability: str, positive: str, grid: list[float]) -> DataFrame:
    """(temperature, nll) of two-class probabilities whose log odds are divided by each temperature; one pass over the rows."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-12)), F.lit(1 - 1e-12))
    wrong = F.when(F.col(positive), -1).otherwise(1) * F.log(p / (1 - p))
    sums = df.select(wrong.alias("z")).agg(*[F.avg(F.log1p(F.exp(F.col("z") / t))).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])
    return sums.select(F.inline(pairs))


def class_weights(df: DataFrame, label: str, k: int) -> DataFrame:
    """(cls, n, weight) of each class id in [0, k): weights go with 1 / sqrt(n), n at least 1, and sum to k. Other ids are ignored."""
    n = df.where(F.col(label).between(0, k - 1)).groupBy(F.col(label).cast("long").alias("cls")).agg(F.count("*").alias("n"))
    classes = df.sparkSession.range(k).select(F.col("id").alias("cls"))
    each = classes.join(F.broadcast(n), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    w = 1 / F.sqrt(F.greatest("n", F.lit(1)))
    total = each.agg(F.sum(w).alias("total"))
    return each.join(F.broadcast(total), F.lit(True)).select("cls", "n", (w * k / F.col("total")).alias("weight"))
