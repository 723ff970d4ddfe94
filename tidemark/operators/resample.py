"""Cluster bootstrap from pre-aggregated clusters and their draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds i, a number from 0 for each row, in the order of (first 3 hex digits of the key's md5, key); keys are unique.

    Rows are numbered in 4096 parts; only the parts' sizes meet in one task.
    """
    rows = rows.withColumn("__b", F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__n")).alias("__before"))
    within = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(key)))
    return within.join(F.broadcast(before), "__b").withColumn("i", F.col("__before") + F.col("__r") - 1).drop("__b", "__r", "__before")


def drawn(clusters: DataFrame, cluster: str, reps: int, seed: str = "0") -> DataFrame:
    """clusters' rows with rep, once for each time that their cluster is drawn: for each replicate as many clusters as there are, drawn with
    replacement by md5 of the draw's number.

    Draws are made in all tasks and stream past the clusters of their part, which alone are in memory.
    """
    each = numbered(clusters.select(cluster).distinct(), cluster)
    n = each.agg(F.count("*").alias("__n"))
    # as many draws as clusters, made beside them: draw j of replicate r has the number r * n + j. The clusters are a small table, whose parts Spark
    # would put together, so they are dealt to a stated number of tasks before they are multiplied
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = each.select("i").repartition(tasks, "i").join(F.broadcast(n), F.lit(True)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("rep", F.col("rep").cast("long"))
    number = F.col("rep") * F.col("__n") + F.col("i")
    taken = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), number.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.col("__n"))
    rows = each.join(clusters, cluster).hint("shuffle_hash")
    return every.select("rep", taken.alias("i")).join(rows, "i").drop("i")


Ratios = dict[str, tuple[str, str]]


def _replicates(clusters: DataFrame, cluster: str, ratios: Ratios, reps: int, seed: str) -> DataFrame:
    """(rep, one column for each ratio): sum(top) / sum(bottom) over each replicate's clusters, all from the same draws."""
    return drawn(clusters, cluster, reps, seed).groupBy("rep").agg(*[F.try_divide(F.sum(t), F.sum(b)).alias(n) for n, (t, b) in ratios.items()])


def _points(clusters: DataFrame, ratios: Ratios) -> DataFrame:
    return clusters.agg(*[F.try_divide(F.sum(t), F.sum(b)).alias(n) for n, (t, b) in ratios.items()])


def bootstrap_ratio(clusters: DataFrame, cluster: str, top: str, bottom: str, reps: int, level: float = 0.95, seed: str = "0") -> DataFrame:
    """(estimate, low, high) of sum(top) / sum(bottom) with a percentile interval over resampled clusters."""
    many = bootstrap_ratios(clusters, cluster, {"s": (top, bottom)}, reps, level, seed)
    return many.select(F.col("point").alias("estimate"), "low", "high")


def bootstrap_metrics(clusters: DataFrame, cluster: str, partials: list[str], finals: dict[str, Column], reps: int, level: float = 0.95, seed: str = "0") -> DataFrame:
    """(statistic, point, low, high, boot_mean, boot_std) of any metrics that are made of sums: partials are the clusters' columns to be summed, and each of
    finals an expression over these sums by the same names. All metrics share the draws; replicates without a value are left out."""
    sums = drawn(clusters, cluster, reps, seed).groupBy("rep").agg(*[F.sum(p).alias(p) for p in partials])
    told = lambda t, name: t.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), c.cast("double").alias(name)) for n, c in finals.items()])))
    ends = told(sums, "s").groupBy("statistic").agg(F.percentile("s", F.lit((1 - level) / 2)).alias("low"), F.percentile("s", F.lit((1 + level) / 2)).alias("high"), F.avg("s").alias("boot_mean"), F.stddev_samp("s").alias("boot_std"))
    points = told(clusters.agg(*[F.sum(p).alias(p) for p in partials]), "point")
    return points.join(F.broadcast(ends), "statistic").select("statistic", "point", "low", "high", "boot_mean", "boot_std")


def bootstrap_ratios(clusters: DataFrame, cluster: str, ratios: Ratios, reps: int, level: float = 0.95, seed: str = "0") -> DataFrame:
    """(statistic, point, low, high, boot_mean, boot_std) of several ratios from one set of draws; replicates without a value are
    left out."""
    stat = _replicates(clusters, cluster, ratios, reps, seed)
    long = stat.select("rep", F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("s")) for n in ratios])))
    ends = long.groupBy("statistic").agg(F.percentile("s", F.lit((1 - level) / 2)).alias("low"), F.percentile("s", F.lit((1 + level) / 2)).alias("high"), F.avg("s").alias("boot_mean"), F.stddev_samp("s").alias("boot_std"))
    points = _points(clusters, ratios).select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("point")) for n in ratios])))
    return points.join(F.broadcast(ends), "statistic").select("statistic", "point", "low", "high", "boot_mean", "boot_std")


def paired_bootstrap(clusters: DataFrame, cluster: str, a: Ratios, b: Ratios, reps: int, level: float = 0.95, seed: str = "0") -> DataFrame:
    """(statistic, a, b, difference, low, high, boot_std, p_value, significant): both systems' ratios, by the same names, on the same
    draws. p_value is twice the smaller share of differences on either side of zero, at most 1; significant if the interval
    leaves zero out."""
    both = {f"a_{n}": r for n, r in a.items()} | {f"b_{n}": r for n, r in b.items()}
    pair = lambda n: F.struct(F.lit(n).alias("statistic"), F.col(f"a_{n}").alias("a"), F.col(f"b_{n}").alias("b"))
    long = _replicates(clusters, cluster, both, reps, seed).select(F.inline(F.array(*map(pair, a)))).withColumn("d", F.col("a") - F.col("b")).where("d IS NOT NULL")
    share = lambda c: F.avg(c.cast("double"))
    ends = long.groupBy("statistic").agg(F.percentile("d", F.lit((1 - level) / 2)).alias("low"), F.percentile("d", F.lit((1 + level) / 2)).alias("high"), F.stddev_samp("d").alias("boot_std"), F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))).alias("p_value"))
    points = _points(clusters, both).select(F.inline(F.array(*map(pair, a)))).withColumn("difference", F.col("a") - F.col("b"))
    return points.join(F.broadcast(ends), "statistic").select("statistic", "a", "b", "difference", "low", "high", "boot_std", "p_value", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def draws_for(statistic: str, reps: int = 2000) -> int:
    """Draws for a statistic: a quarter, at least 200, for those of probabilities, which cost most."""
    #: fixed values: names of these statistics
    return max(200, reps // 4) if statistic in ("macro_auroc", "macro_auprc", "ece", "brier", "nll") else reps


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, std, n, ci_low, ci_high) over seeds: sample deviation (0 for one seed) and a normal interval; NaN and null are left
    out."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    s = ok.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    half = 1.96 * F.col("std") / F.sqrt("n")
    return s.select(*by, "mean", "std", "n", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def verdicts(df: DataFrame, by: list[str], significant: str) -> DataFrame:
    """(by, n, n_significant, verdict): supported if the contrast is significant for every seed, mixed if for some, else not."""
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(significant)).alias("n_significant"))
    return s.withColumn("verdict", F.when(F.col("n_significant") == F.col("n"), "supported").when(F.col("n_significant") > 0, "mixed").otherwise("not supported"))


def permutation_test(df: DataFrame, row: str, x: str, y: str, reps: int, seed: str = "0") -> DataFrame:
    """(statistic, p_value) of the covariance of x and the values y against shuffles of y: the share of shuffles at least as far from
    zero. Values are dealt anew by the order of a hash of (replicate, row).

    Each replicate orders all rows: meant for tables of rated items, not of frames; replicates are spread over the tasks.
    """
    s = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    centred = df.join(F.broadcast(s), F.lit(True)).select(F.col(row).alias("row"), (F.col(x) - F.col("mx")).alias("x"), (F.col(y) - F.col("my")).alias("y"))
    placed = numbered(centred, "row").select("i", "row", "x", "y")
    each = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    mixed = each.withColumn("j", F.row_number().over(Window.partitionBy("rep").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "rep", "row").cast("binary")), "row")) - 1).select("rep", F.col("j").alias("i"), F.col("y").alias("dealt"))
    null = mixed.join(placed.select("i", "x"), "i").groupBy("rep").agg(F.abs(F.sum(F.col("x") * F.col("dealt"))).alias("t"))
    own = centred.agg(F.sum(F.col("x") * F.col("y")).alias("t0"))
    return null.join(F.broadcast(own), F.lit(True)).agg(F.first("t0").alias("statistic"), F.avg((F.col("t") >= F.abs("t0") - 1e-9).cast("double")).alias("p_value"))
