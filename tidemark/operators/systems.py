"""Timelines from annotations, and whole systems compared with a teacher and a majority control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins


def annotated(manifest: DataFrame, log: DataFrame, name: str, order: list[str], fields: list[str], status: str = "status") -> DataFrame:
    """manifest with fields from the last row of log(name, status, fields, ...) of its name, and source.

    A rejected row is a gap: it goes. Of rows with status ok or uncertain the fields that are there (not null) count and source is human; all others
    keep their own and are pseudo. Names that come several times in the manifest are each overridden.
    """
    last = joins.latest(log.select(name, *order, status, *[F.col(f).alias(f"__{f}") for f in fields]), [name], order).select(name, F.col(status).alias("__status"), *[f"__{f}" for f in fields])
    both = manifest.join(last, name, "left").where(~F.col("__status").eqNullSafe(F.lit("rejected")))
    human = F.coalesce(F.col("__status").isin("ok", "uncertain"), F.lit(False))
    out = both.withColumns({f: F.when(human, F.coalesce(f"__{f}", f)).otherwise(F.col(f)) for f in fields}).withColumn("source", F.when(human, "human").otherwise("pseudo"))
    return out.drop("__status", *[f"__{f}" for f in fields])


def with_controls(frames: DataFrame, teacher: str, systems: dict[str, Column]) -> DataFrame:
    """frames once for each system with columns system and pred: the given ones, `teacher` (its own label) and `majority` (the teacher's
    most frequent label everywhere, of equally frequent ones the smallest)."""
    counts = frames.groupBy(F.col(teacher).alias("__l")).agg(F.count("*").alias("__n"))
    most = counts.agg(F.max_by("__l", F.struct("__n", -F.col("__l"))).alias("__most"))
    one = frames.join(F.broadcast(most), F.lit(True))
    every = {**systems, "teacher": F.col(teacher), "majority": F.col("__most")}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("system"), c.cast("int").alias("pred")) for n, c in every.items()]))
    return one.withColumn("__row", rows).select(*frames.columns, "__row.*")


def frame_scores(rows: DataFrame, system: str, truth: str, pred: str, k: int) -> DataFrame:
    """(system, n_frames, accuracy, balanced_accuracy, macro_f1) over the rows whose truth is known, classes 0 to k - 1; means over the classes that occur."""
    known = rows.where(F.col(truth).between(0, k - 1) & F.col(pred).between(0, k - 1))
    n = known.groupBy(system, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    each = n.select(system, F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"), F.col("n").alias("s"), zero.alias("q"))
    each = each.unionAll(n.select(system, "p", zero, zero, "n")).groupBy(system, "c").agg(*[F.sum(x).alias(x) for x in ("tp", "s", "q")])
    f1, recall = 2 * F.col("tp") / (F.col("s") + F.col("q")), F.try_divide("tp", "s")
    here = F.col("s") > 0
    return each.groupBy(system).agg(F.sum("s").alias("n_frames"), (F.sum("tp") / F.sum("s")).alias("accuracy"), F.avg(F.when(here, recall)).alias("balanced_accuracy"), F.avg(F.when(here, f1)).alias("macro_f1"))


def compared(rows: DataFrame, truth: str, k: int, events: Callable[[DataFrame], DataFrame], scores: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """frame_scores() of rows(system, pred, ...) beside what scores(events(rows of one system)) says, a row or more a system.

    The systems are few and known by name; each one's events are matched on their own."""
    found = None
    for name in [r[0] for r in rows.select("system").distinct().orderBy("system").limit(256).collect()]:
        one = scores(events(rows.where(F.col("system") == name))).withColumn("system", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return frame_scores(rows, "system", truth, "pred", k).join(found, "system")


def state_agreement(a: DataFrame, b: DataFrame, key: list[str], state: str) -> DataFrame:
    """(state, labels, model, agreement): how often each state is in either timeline of the same rows, and the share of rows with equal states
    (the same in each row)."""
    both = a.select(*key, F.col(state).alias("__a")).join(b.select(*key, F.col(state).alias("__b")), key)
    n = both.groupBy("__a", "__b").agg(F.count("*").alias("n"))
    total = n.agg((F.sum(F.when(F.col("__a").eqNullSafe(F.col("__b")), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    each = n.select(F.col("__a").alias(state), F.col("n").alias("labels"), F.lit(0).cast("long").alias("model")).unionAll(n.select("__b", F.lit(0).cast("long"), "n"))
    return each.groupBy(state).agg(F.sum("labels").alias("labels"), F.sum("model").alias("model")).join(F.broadcast(total), F.lit(True))


