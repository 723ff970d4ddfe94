"""Timelines: rows of one key in the order of time. Times are whole microseconds; ties are broken by a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], time: list[str]):
    return Window.partitionBy(*key).orderBy(*time)


def with_runs(df: DataFrame, key: list[str], time: list[str], label: str) -> DataFrame:
    """Adds run, the number from 1 of the row's run of equal labels (null is a label of its own)."""
    w = ordered(key, time)
    changed = (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w))
    return df.withColumn("__new", changed.cast("long")).withColumn("run", F.sum("__new").over(w)).drop("__new")


def runs(df: DataFrame, key: list[str], time: list[str], label: str) -> DataFrame:
    """One row for each run of equal labels: its label, first and last time, and rows."""
    t = time[0]
    return with_runs(df, key, time, label).groupBy(*key, "run", label).agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"))


def with_dwell(df: DataFrame, key: list[str], time: list[str], label: str) -> DataFrame:
    """Adds dwell: time since the row's run began."""
    return with_runs(df, key, time, label).withColumn("dwell", F.col(time[0]) - F.min(time[0]).over(Window.partitionBy(*key, "run"))).drop("run")


def with_trailing_majority(df: DataFrame, key: list[str], time: str, label: str, labels: list[str], width: int) -> DataFrame:
    """Adds majority: the most frequent of labels in (t - width, t]; of equal ones the first in the list."""
    w = Window.partitionBy(*key).orderBy(time).rangeBetween(-width + 1, 0)
    counted = [F.struct(F.count(F.when(F.col(label) == v, 1)).over(w).alias("n"), F.lit(-i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(labels)]
    return df.withColumn("majority", F.array_max(F.array(*counted))["v"])


def with_streak(df: DataFrame, key: list[str], time: list[str], inside: Column, name: str = "streak") -> DataFrame:
    """Adds the time since the row's stretch of rows with the condition began; 0 for rows without it."""
    w = ordered(key, time)
    out = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    out = out.withColumn("__from", F.when(F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False)), F.col(time[0])))
    since = F.last("__from", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(F.col("__in"), F.col(time[0]) - since).otherwise(0)).drop("__in", "__from")


def with_rule_state(df: DataFrame, key: list[str], time: str, tie: str, cue: str, window: int, majority: float, aside: int, down: int, history: int, most_uncertain: float = 0.5) -> DataFrame:
    """Adds state from the row's cue: unknown before the key has that much history; phone_use_alert; off_task_cue after a long streak
    of heads down or of these and looks aside; possible_distraction after a streak of looks aside; then by the trailing window
    (t - window, t]: unknown if too much is uncertain, on_task if enough of the rest is screen_oriented, else possible_distraction."""
    order, side = [time, tie], ["looking_away", "turned_to_peer"]
    out = with_streak(df, key, order, F.col(cue) == "head_down", "__down")
    out = with_streak(out, key, order, F.col(cue).isin("head_down", *side), "__off")
    out = with_streak(out, key, order, F.col(cue).isin(*side), "__side")
    trail = Window.partitionBy(*key).orderBy(time).rangeBetween(-window + 1, 0)
    count = lambda v: F.count(F.when(F.col(cue) == v, 1)).over(trail)
    out = out.withColumns({"__n": F.count("*").over(trail), "__unc": count("uncertain"), "__on": count("screen_oriented"), "__first": F.min(time).over(Window.partitionBy(*key))})
    rest = F.col("__n") - F.col("__unc")
    state = (
        F.when(F.col(time) - F.col("__first") < history, "unknown")
        .when(F.col(cue) == "phone_use", "phone_use_alert")
        .when((F.col("__down") >= down) | (F.col("__off") >= down), "off_task_cue")
        .when(F.col("__side") >= aside, "possible_distraction")
        .when(F.col("__unc") / F.col("__n") > most_uncertain, "unknown")
        .when((rest > 0) & (F.try_divide(F.col("__on"), rest) >= majority), "on_task")
        .otherwise("possible_distraction")
    )
    return out.withColumn("state", state).drop("__down", "__off", "__side", "__n", "__unc", "__on", "__first")


def with_chunks(df: DataFrame, key: list[str], time: list[str], max_gap: int, max_rows: int, min_rows: int) -> DataFrame:
    """Adds part (numbered by gaps over max_gap) and chunk (at most max_rows rows of a part); chunks under min_rows rows go."""
    w = ordered(key, time)
    gap = F.col(time[0]) - F.lag(time[0]).over(w) > max_gap
    parted = df.withColumn("__gap", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("part", F.sum("__gap").over(w)).drop("__gap")
    chunk = F.floor((F.row_number().over(ordered([*key, "part"], time)) - 1) / max_rows)
    out = parted.withColumn("chunk", chunk)
    return out.withColumn("__n", F.count("*").over(Window.partitionBy(*key, "part", "chunk"))).where(F.col("__n") >= min_rows).drop("__n")


def with_motion(df: DataFrame, key: list[str], time: list[str], value: str, rows: int = 5) -> DataFrame:
    """Adds step (change from the row before, 0 at first), and the trailing mean and population deviation of the steps."""
    w = ordered(key, time)
    out = df.withColumn("step", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))
    trail = w.rowsBetween(-(rows - 1), 0)
    return out.withColumns({"step_mean": F.avg("step").over(trail), "step_dev": F.stddev_pop("step").over(trail)})


def with_baseline(df: DataFrame, key: list[str], value: str, valid: Column, least: int = 3) -> DataFrame:
    """Adds deviation: of valid rows from their key's median over all of its valid rows if there are enough, else 0."""
    w = Window.partitionBy(*key)
    median = F.median(F.when(valid, F.col(value))).over(w)
    enough = F.count(F.when(valid, 1)).over(w) >= least
    return df.withColumn("deviation", F.when(valid & enough, F.col(value) - median).otherwise(F.lit(0.0)))


def interpolated(df: DataFrame, key: list[str], step: str, value: str, max_gap: int) -> DataFrame:
    """Rows (key, step, value, filled) with the whole steps between neighbours less than max_gap apart filled in by a line."""
    w = ordered(key, [step])
    out = df.select(*key, step, value, F.lead(step).over(w).alias("s2"), F.lead(value).over(w).alias("v2"))
    gap = F.col("s2") - F.col(step)
    last = F.when((gap > 1) & (gap < max_gap), F.col("s2") - 1).otherwise(F.col(step))
    each = out.select(*key, F.col(step).alias("s1"), F.col(value).alias("v1"), "s2", "v2", F.explode(F.sequence(step, last)).alias(step))
    filled = F.col(step) != F.col("s1")
    share = (F.col(step) - F.col("s1")) / (F.col("s2") - F.col("s1"))
    return each.select(*key, step, F.when(filled, F.col("v1") + (F.col("v2") - F.col("v1")) * share).otherwise(F.col("v1")).alias(value), filled.alias("filled"))


def best_rows(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key; the limit is pushed below the shuffle by the optimizer."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)


def numbered_samples(parts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds sample, a number from 0 in the order of a key's parts."""
    return parts.withColumn("sample", F.row_number().over(ordered(key, order)) - 1)


def with_mode_filter(df: DataFrame, key: list[str], time: list[str], label: str, width: int, name: str = "smooth") -> DataFrame:
    """Adds the most frequent label (of equal ones the smallest) among width rows around each row; a key's ends are repeated."""
    half = width // 2
    w = ordered(key, time)
    whole = Window.partitionBy(*key)
    around = df.withColumns({"__near": F.collect_list(label).over(w.rowsBetween(-half, half)), "__at": F.row_number().over(w), "__n": F.count("*").over(whole)})
    before = F.greatest(half + 1 - F.col("__at"), F.lit(0)).cast("int")
    after = F.greatest(F.col("__at") + half - F.col("__n"), F.lit(0)).cast("int")
    padded = F.concat(F.array_repeat(F.element_at("__near", 1), before), F.col("__near"), F.array_repeat(F.element_at("__near", -1), after))
    votes = F.transform(F.array_distinct(padded), lambda v: F.struct((-F.size(F.filter(padded, lambda x: x == v))).alias("o"), v.alias("v")))
    return around.withColumn(name, F.array_min(votes)["v"]).drop("__near", "__at", "__n")


def oversampled(df: DataFrame, times: int) -> DataFrame:
    """Each row so many times, with copy counting from 0: a timeline at a higher rate. where("copy = 0") reads it back."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def causal_windows(df: DataFrame, key: list[str], time: list[str], value: str, size: int, every: int) -> DataFrame:
    """The rows at positions 0, every, 2 * every, ... of each key that have size rows up to and with them, and these rows' values as
    window."""
    w = ordered(key, time)
    each = df.withColumns({"__at": F.row_number().over(w), "window": F.collect_list(value).over(w.rowsBetween(-(size - 1), 0))})
    return each.where((F.col("__at") >= size) & ((F.col("__at") - 1) % every == 0)).drop("__at")
