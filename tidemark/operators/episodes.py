"""Episodes with hysteresis, their matching and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episodes(df: DataFrame, key: list[str], time: str, tie: str, active: Column, max_gap: int, min_duration: int | Column) -> DataFrame:
    """(key, episode, t_start, t_end) of the stretches of active rows of each key that last at least min_duration, a number or a
    column of the key (so that each channel has its own).

    A stretch ends only when an inactive row comes more than max_gap after the last active one: silence alone ends nothing.
    """
    w = Window.partitionBy(*key).orderBy(time, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("__on", F.coalesce(active, F.lit(False)))
    seen = marked.withColumns({"__last": F.last(F.when(F.col("__on"), F.col(time)), True).over(before), "__pt": F.lag(time).over(w), "__pa": F.lag("__on").over(w)})
    # among the inactive rows since the last active one, the latest decides
    breaks = F.col("__last").isNull() | (~F.col("__pa") & (F.col("__pt") - F.col("__last") > max_gap))
    numbered = seen.where("__on").withColumn("episode", F.sum(breaks.cast("long")).over(w))
    return numbered.groupBy(*key, "episode").agg(F.min(time).alias("t_start"), F.max(time).alias("t_end")).where(F.col("t_end") - F.col("t_start") >= min_duration)


def return_markers(found: DataFrame, on_runs: DataFrame, key: list[str], confirm: int) -> DataFrame:
    """For each episode the start of the first run of on_runs(key, t_start, t_end) after it that lasts at least confirm.

    Both go through one window of the key's episodes and runs, the latest first.
    """
    on = on_runs.where(F.col("t_end") - F.col("t_start") >= confirm).select(*key, F.col("t_start").alias("__at"), F.lit(1).alias("__kind"), F.col("t_start").alias("__on"))
    ends = found.withColumns({"__at": F.col("t_end"), "__kind": F.lit(0)})
    # of one time, an episode comes before a run: the run must start after it
    w = Window.partitionBy(*key).orderBy(F.desc("__at"), "__kind")
    seen = ends.unionByName(on, allowMissingColumns=True).withColumn("t_return", F.last("__on", True).over(w))
    return seen.where("__kind = 0 AND t_return IS NOT NULL").select(*found.columns, "t_return")


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two intervals; where both have no length, 1 if they are at the same time, else 0."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, inter / union).otherwise((a0 == b0).cast("double"))


def overlapping(gold: DataFrame, pred: DataFrame, key: list[str], least: float, bucket: int) -> DataFrame:
    """Pairs of intervals (key, id, t_start, t_end) of equal keys with temporal IoU of at least least.

    Both sides are cut into buckets of time, so that the join is by key and bucket; each pair is taken in its first
    common bucket only.
    """
    spread = lambda d, p: d.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "t_start", "t_end")]).withColumn("b", F.explode(F.sequence(F.floor(F.col(f"{p}_t_start") / bucket), F.floor(F.col(f"{p}_t_end") / bucket))))
    both = spread(gold, "g").join(spread(pred, "p"), [*key, "b"])
    first = F.floor(F.greatest("g_t_start", "p_t_start") / bucket) == F.col("b")
    iou = temporal_iou(F.col("g_t_start"), F.col("g_t_end"), F.col("p_t_start"), F.col("p_t_end"))
    return both.where(first).withColumn("tiou", iou).where(F.col("tiou") >= least).drop("b")


def islands(df: DataFrame, key: list[str], start: Column, end: Column) -> DataFrame:
    """Adds island: rows of a key whose intervals touch, directly or through others, have the same number."""
    w = Window.partitionBy(*key).orderBy("__lo", "__hi")
    spans = df.withColumns({"__lo": start, "__hi": end})
    spans = spans.withColumn("__reach", F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce(F.col("__lo") > F.col("__reach"), F.lit(True)).cast("long")
    return spans.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__lo", "__hi", "__reach", "__new")


def greedy_matches(pairs: DataFrame, key: list[str], small_first: bool = False) -> DataFrame:
    """One-to-one matches of pairs(key, g_id, p_id, tiou): best first; equal ones by larger ids, or smaller if small_first.

    If the pairs have their intervals (as overlapping() gives them), a key is first cut into islands of intervals that touch: no
    decision reaches beyond one. The pairs of one island are folded in one array.
    """
    out = key
    if "g_t_start" in pairs.columns:
        pairs = islands(pairs, key, F.least("g_t_start", "p_t_start"), F.greatest("g_t_end", "p_t_end"))
        key = [*key, "island"]
    sign = 1 if small_first else -1
    item = F.struct((-F.col("tiou")).alias("o"), (F.col("g_id") * sign).alias("g"), (F.col("p_id") * sign).alias("p"))
    if small_first:  # variant B: by prediction, then gold
        item = F.struct((-F.col("tiou")).alias("o"), F.col("p_id").alias("p"), F.col("g_id").alias("g"))
    ranked = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.expr("named_struct('g', array_repeat(cast(0 AS bigint), 0), 'p', array_repeat(cast(0 AS bigint), 0), 'o', array_repeat(cast(0 AS double), 0))")

    def take(acc, x):
        free = ~F.array_contains(acc["g"], x["g"]) & ~F.array_contains(acc["p"], x["p"])
        more = F.struct(F.array_append(acc["g"], x["g"]).alias("g"), F.array_append(acc["p"], x["p"]).alias("p"), F.array_append(acc["o"], x["o"]).alias("o"))
        return F.when(free, more).otherwise(acc)

    folded = ranked.select(*key, F.aggregate("items", empty, take).alias("m"))
    return folded.select(*key, F.inline(F.arrays_zip("m.g", "m.p", "m.o"))).select(*out, (F.col("g") * sign).alias("g_id"), (F.col("p") * sign).alias("p_id"), (-F.col("o")).alias("tiou"))


def deduplicated(found: DataFrame, key: list[str], channel: str, aliases: list[str], digits: int = 6) -> DataFrame:
    """Episodes without those of alias channels, and one of each group with equal key, channel and rounded times (in seconds)."""
    near = lambda c: F.round(F.col(c), digits)
    return found.where(~F.col(channel).isin(aliases)).withColumns({"__a": near("t_start"), "__b": near("t_end")}).dropDuplicates([*key, channel, "__a", "__b"]).drop("__a", "__b")


def event_scores(gold: DataFrame, pred: DataFrame, key: list[str], thresholds: list[float], seconds: float, bucket: int, unit: float = 1e6) -> DataFrame:
    """Detection scores of episodes (key, channel, id, t_start, t_end) at several overlaps, by channel and over all (channel null).

    (threshold, channel, n_gt, n_pred, matched, precision, recall, f1, missed_rate, false_alerts_per_hour, onset_mae, offset_mae,
    duration_mae, delay); times are in units of 1 / unit seconds, errors in seconds, null where nothing matched. Matches are
    one-to-one, the best overlap first (variant B).
    """
    matched = matches_at(gold, pred, key, thresholds, bucket)
    levels = F.explode(F.array(*map(F.lit, sorted(thresholds)))).alias("threshold")
    sizes = gold.select("channel", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select("channel", F.lit(0).alias("g"), F.lit(1).alias("p"))).groupBy("channel").agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred")).select("*", levels)
    sums = matched.groupBy("threshold", "channel").agg(F.count("*").alias("matched"), *[F.sum(c).alias(c) for c in _errors(unit)])
    each = sizes.join(sums, ["threshold", "channel"], "left")
    rows = each.select("threshold", "channel", "n_gt", "n_pred", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", *_errors(unit))])
    total = rows.groupBy("threshold").agg(F.lit(None).cast("string").alias("channel"), *[F.sum(c).alias(c) for c in rows.columns[2:]])
    r = rows.unionByName(total)
    p, q = F.coalesce(F.try_divide("matched", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "n_gt"), F.lit(0.0))
    return r.select(
        "threshold", "channel", "n_gt", "n_pred", "matched", p.alias("precision"), q.alias("recall"),
        F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)).alias("f1"),
        F.try_divide(F.col("n_gt") - F.col("matched"), "n_gt").alias("missed_rate"),
        ((F.col("n_pred") - F.col("matched")) / (seconds / 3600)).alias("false_alerts_per_hour"),
        *[F.try_divide(c, "matched").alias(c) for c in _errors(unit)],
    )


def _errors(unit: float) -> dict[str, Column]:
    d = lambda a, b: (F.col(a) - F.col(b)) / unit
    onset, offset = d("p_t_start", "g_t_start"), d("p_t_end", "g_t_end")
    return {"onset_mae": F.abs(onset), "offset_mae": F.abs(offset), "duration_mae": F.abs(offset - onset), "delay": F.greatest(onset, F.lit(0.0))}


def matches_at(gold: DataFrame, pred: DataFrame, key: list[str], thresholds: list[float], bucket: int, unit: float = 1e6) -> DataFrame:
    """(threshold, key, channel, g_id, p_id, and the errors of onset, offset, duration and delay in seconds) of the matches."""
    by = [*key, "channel"]
    pairs = overlapping(gold, pred, by, min(thresholds), bucket)
    leveled = pairs.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: t <= F.col("tiou"))))
    taken = greedy_matches(leveled, ["threshold", *by], True).drop("tiou")
    whole = leveled.join(taken, ["threshold", *by, "g_id", "p_id"], "left_semi")
    return whole.select("threshold", *by, "g_id", "p_id", *[c.alias(n) for n, c in _errors(unit).items()])


def common_boundaries(gold: DataFrame, systems: dict[str, DataFrame], key: list[str], threshold: float, bucket: int) -> DataFrame:
    """(system, n, onset_mae, offset_mae, duration_mae, delay) over the gold episodes that every system matches."""
    every = None
    for name, pred in systems.items():
        one = matches_at(gold, pred, key, [threshold], bucket).withColumn("system", F.lit(name))
        every = one if every is None else every.unionByName(one)
    by = [*key, "channel", "g_id"]
    common = every.groupBy(*by).agg(F.count_distinct("system").alias("n")).where(F.col("n") == len(systems)).select(*by)
    return every.join(common, by, "left_semi").groupBy("system").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _errors(1.0)])


def segments(df: DataFrame, key: list[str], time: list[str], label: str, background: int | None = None) -> DataFrame:
    """(key, seg, cls, a, b) of the runs of a label as row positions [a, b), numbered in order."""
    from .timeline import with_runs

    at = F.row_number().over(Window.partitionBy(*key).orderBy(*time)) - 1
    runs = with_runs(df.withColumn("__at", at), key, time, label).groupBy(*key, F.col("run").alias("seg"), F.col(label).alias("cls")).agg(F.min("__at").alias("a"), (F.max("__at") + 1).alias("b"))
    return runs if background is None else runs.where(F.col("cls") != background)


def segment_matches(df: DataFrame, key: list[str], time: list[str], truth: str, pred: str, overlap: float, background: int | None = None) -> DataFrame:
    """(key, tp, fp, fn) of the segments of two labels: in the order of the predictions, each takes the free true segment of its class
    that it overlaps most (of equal ones the first), and counts if the overlap reaches the threshold.

    Only segments that overlap meet, so a key's segments fold in one array for each class.
    """
    g = segments(df, key, time, truth, background)
    p = segments(df, key, time, pred, background)
    gs = g.select(*key, "cls", F.col("seg").alias("g"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    ps = p.select(*key, "cls", F.col("seg").alias("p"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    both = gs.join(ps, [*key, "cls"]).where("least(gb, pb) > greatest(ga, pa)")
    iou = (F.least("gb", "pb") - F.greatest("ga", "pa")) / (F.greatest("gb", "pb") - F.least("ga", "pa"))
    cut = islands(both, [*key, "cls"], F.least("ga", "pa"), F.greatest("gb", "pb") - 1)
    offers = cut.groupBy(*key, "cls", "island", "p").agg(F.array_sort(F.collect_list(F.struct((-iou).alias("o"), "g"))).alias("c"))
    ordered = offers.groupBy(*key, "cls", "island").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("ps"))

    def take(used, x):
        free = F.get(F.filter(x["c"], lambda c: ~F.array_contains(used, c["g"])), F.lit(0))
        return F.when(-free["o"] >= overlap, F.array_append(used, free["g"])).otherwise(used)

    tp = ordered.select(*key, F.size(F.aggregate("ps", F.expr("array_repeat(cast(0 AS bigint), 0)"), take)).alias("tp")).groupBy(*key).agg(F.sum("tp").alias("tp"))
    n = g.groupBy(*key).agg(F.count("*").alias("ng")).join(p.groupBy(*key).agg(F.count("*").alias("np")), key, "full").join(tp, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return n.select(*key, zero("tp").alias("tp"), (zero("np") - zero("tp")).alias("fp"), (zero("ng") - zero("tp")).alias("fn"))


def segment_f1(counts: DataFrame) -> DataFrame:
    """(tp, fp, fn, f1) summed over all keys."""
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("*", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def relabelled(df: DataFrame, key: list[str], time: list[str], cut: Column, probs: str) -> DataFrame:
    """Adds refined: every row of a segment gets the class of the largest mean probability in it (of equal ones the first). A segment
    begins at a row with the cut condition, but for a key's first row, which begins one anyway. Means are of decimals, so that equal ones are equal
    in whatever order rows are summed."""
    w = Window.partitionBy(*key).orderBy(*time)
    begins = F.when(F.row_number().over(w) > 1, F.coalesce(cut, F.lit(False)).cast("long")).otherwise(0)
    parted = df.withColumn("__cut", begins).withColumn("__seg", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mean = parted.select(*key, "__seg", F.posexplode(probs).alias("c", "p")).groupBy(*key, "__seg", "c").agg(F.avg(F.col("p").cast("decimal(20,18)")).alias("p"))
    best = mean.groupBy(*key, "__seg").agg(F.max(F.struct("p", (-F.col("c")).alias("i"))).alias("m")).select(*key, "__seg", (-F.col("m.i")).alias("refined"))
    return parted.join(best, [*key, "__seg"]).drop("__seg", "__cut")


def transitions(df: DataFrame, key: list[str], time: list[str], label: str) -> DataFrame:
    """Adds changed: the label differs from the row before and neither is null; a key's first row never is."""
    w = Window.partitionBy(*key).orderBy(*time)
    return df.withColumn("changed", F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(False)))


#: Labels that an edit score can tell apart.
MOST_LABELS = 20_000


def edit_score(df: DataFrame, key: list[str], time: list[str], a: str, b: str, background: int | None = None) -> DataFrame:
    """(key, n, edit): rows, and 100 * (1 - edit distance / longer length) of the run sequences of two labels; both empty: 100.

    Labels are integers from 0 to MOST_LABELS, one character each; others are an error. A key's runs are one string.
    """
    fits = F.col("cls").between(0, MOST_LABELS)
    # one character of the plane from U+4E00 on for each label
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, F.col("cls") + 0x4E00).otherwise(F.raise_error(F.lit("label out of range")).cast("long"))), 4, "0")), "UTF-16BE")

    def sequence(label: str, name: str) -> DataFrame:
        r = segments(df, key, time, label, background)
        s = F.array_sort(F.collect_list(F.struct("seg", char.alias("c"))))
        return r.groupBy(*key).agg(F.array_join(F.transform(s, lambda x: x["c"]), "").alias(name))

    n = df.groupBy(*key).agg(F.count("*").alias("n"))
    both = n.join(sequence(a, "sa"), key, "left").join(sequence(b, "sb"), key, "left").na.fill("", ["sa", "sb"])
    longer = F.greatest(F.length("sa"), F.length("sb"))
    return both.select(*key, "n", F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein("sa", "sb") / longer)).alias("edit"))
