"""Samples and splits that depend on a hash of the row's id alone, so they are the same at any partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*cols: str, seed: str = "0") -> Column:
    """A fixed random order: the md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def share(*cols: str, seed: str = "0") -> Column:
    """A fixed number in [0, 1) of each row."""
    return F.conv(F.substring(draw(*cols, seed=seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def per_class_floor(df: DataFrame, by: list[str], id_cols: list[str], least: int, seed: str = "0") -> DataFrame:
    """Up to least rows of each class."""
    w = Window.partitionBy(*by).orderBy(draw(*id_cols, seed=seed), *id_cols)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= least).drop("__r")


def round_robin(df: DataFrame, strata: list[str], id_cols: list[str], n: int, seed: str = "0") -> DataFrame:
    """n rows taken in turns: the first of each stratum in the strata's order, then the second of each, ..."""
    w = Window.partitionBy(*strata).orderBy(draw(*id_cols, seed=seed), *id_cols)
    turn = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turn.orderBy("turn", *strata).limit(n)


def head(df: DataFrame, n: Column, ids: list[str], seed: str = "0") -> DataFrame:
    """The first n rows (a column that is the same in all rows) by (draw, ids), without ordering all rows in one task.

    Rows are counted by the draw's first three digits; parts that fit whole are kept, and only the one in which the limit falls is
    ordered.
    """
    marked = df.withColumns({"__d": draw(*ids, seed=seed), "__want": n}).withColumn("__b", F.substring("__d", 1, 3))
    sizes = marked.groupBy("__b").agg(F.count("*").alias("__c"))
    upto = sizes.select("__b", "__c", (F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__c")).alias("__before"))  # 4096 rows at most
    near = marked.join(F.broadcast(upto), "__b").where(F.col("__before") < F.col("__want"))
    inside = near.where(F.col("__before") + F.col("__c") <= F.col("__want"))
    edge = near.where(F.col("__before") + F.col("__c") > F.col("__want"))
    cut = edge.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__d", *ids))).where(F.col("__r") <= F.col("__want") - F.col("__before"))
    return inside.select(*df.columns).unionByName(cut.select(*df.columns))


def majority_cap(df: DataFrame, label: str, major, id_cols: list[str], cap: float, seed: str = "0") -> DataFrame:
    """df with so many rows of the major labels (one, or several together) that they are at most the share cap of the result."""
    majors = list(major) if isinstance(major, list | tuple | set) else [major]
    is_major = F.coalesce(F.col(label).isin(majors), F.lit(False))
    target = df.where(~is_major).agg(F.floor(F.count("*") * cap / (1 - cap)).alias("__target"))
    kept = head(df.where(is_major).join(F.broadcast(target), F.lit(True)), F.col("__target"), id_cols, seed).drop("__target")
    return df.where(~is_major).unionByName(kept)


def golden_sample(df: DataFrame, fields: list[str], id_col: str, confidence: str, n: int, floor: int, hard: float, seed: str = "0") -> DataFrame:
    """Adds group: representative rows are a floor of each value of each field, filled at random up to n less the hard ones; hard ones,
    int(hard * n), are those of the lowest confidence of the rest, filled at random. Floors may overshoot; then nothing is filled."""
    n_hard = int(hard * n)
    picked = None
    for f in fields:
        one = per_class_floor(df.select(id_col, f), [f], [id_col], floor, seed + f).select(id_col)
        picked = one if picked is None else picked.unionByName(one)
    picked = picked.distinct()
    missing = picked.agg(F.greatest(F.lit(n - n_hard) - F.count("*"), F.lit(0)).alias("__m"))
    rest = df.select(id_col).join(picked, id_col, "left_anti").join(F.broadcast(missing), F.lit(True))
    chosen = picked.unionByName(head(rest, F.col("__m"), [id_col], seed).select(id_col)).withColumn("group", F.lit("representative"))
    left = df.select(id_col, confidence).join(chosen, id_col, "left_anti")
    # rows without a confidence come after all others, at random
    worst = lowest(left.withColumn("__none", F.col(confidence).isNull()), id_col, confidence, n_hard, seed).select(id_col).withColumn("group", F.lit("hard"))
    return df.join(chosen.unionByName(worst), id_col)


def lowest(df: DataFrame, id_col: str, confidence: str, n: int, seed: str) -> DataFrame:
    """The n rows of the lowest confidence, those without one last; each task keeps n rows at most."""
    return df.orderBy(F.asc_nulls_last(confidence), draw(id_col, seed=seed), id_col).limit(n)


def rare_first(df: DataFrame, rare: Column, by: str, strata: list[str], id_col: str, n: int, ceiling: int, seed: str = "0") -> DataFrame:
    """n rows: first up to ceiling rare rows of each value of by, then the rest in turns over the strata (in a drawn order). Rare rows
    over n stay."""
    first = per_class_floor(df.where(rare), [by], [id_col], ceiling, seed)
    left = df.join(first.select(id_col), id_col, "left_anti")
    missing = first.agg(F.greatest(F.lit(n) - F.count("*"), F.lit(0)).alias("__m"))
    w = Window.partitionBy(*strata).orderBy(draw(id_col, seed=seed), id_col)
    turns = left.withColumn("__turn", F.row_number().over(w)).where(F.col("__turn") <= n)
    order = draw(*strata, seed=seed + "s")
    # of each stratum one row a turn: a global limit by turn keeps n rows in each task
    placed = turns.withColumn("__at", F.row_number().over(Window.partitionBy("__turn").orderBy(order, *strata)))
    before = turns.groupBy("__turn").agg(F.count("*").alias("__c")).withColumn("__before", F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__turn")) - F.col("__c"))
    kept = placed.join(before, "__turn").join(F.broadcast(missing), F.lit(True)).where(F.col("__before") + F.col("__at") <= F.col("__m"))
    return first.unionByName(kept.select(*first.columns))


def even_draw(df: DataFrame, by: str, classes: int, id_col: str, n: int, seed: str = "0") -> DataFrame:
    """n rows: max(1, n // classes) of each class as far as there are, then any."""
    first = per_class_floor(df, [by], [id_col], max(1, n // classes), seed)
    missing = first.agg(F.greatest(F.lit(n) - F.count("*"), F.lit(0)).alias("__m"))
    rest = df.join(first.select(id_col), id_col, "left_anti").join(F.broadcast(missing), F.lit(True))
    return first.unionByName(head(rest, F.col("__m"), [id_col], seed).select(*first.columns))


def greedy_split(df: DataFrame, group: str, parts: dict[str, float], profile: str | None = None) -> DataFrame:
    """Adds split: groups from the largest on (then by name) go to the part that is furthest below its share, of equal ones the first.
    With profile, a thousandth part of a need for the group's classes breaks near ties.

    Each choice depends on all before it, so one row a group, with its size and class counts, passes through one task in that order; only the parts'
    sizes and class counts are held. The driver has the sums by class.
    """
    cls = F.col(profile).cast("string") if profile else F.lit("")
    counts = df.groupBy(F.col(group).alias("g"), F.coalesce(cls, F.lit("")).alias("c")).agg(F.count("*").alias("n"))
    of_class = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    total = max(sum(of_class.values()), 1)
    sums = counts.groupBy("g").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("c", "n"))).alias("p"))
    ordered = sums.select(F.col("g").alias("__group"), "size", F.col("p.c").alias("c"), F.col("p.n").alias("n")).repartition(1).sortWithinPartitions(F.desc("size"), "__group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = dict.fromkeys(parts, 0), {p: {} for p in parts}
        for batch in batches:
            found = []
            for size, classes, numbers in zip(*(batch.column(c).to_pylist() for c in ("size", "c", "n")), strict=True):
                need = lambda p, size=size, classes=classes: sum(max(0, parts[p] * of_class[c] - seen[p].get(c, 0)) for c in classes) / max(size, 1) if profile else 0.0
                best = max(parts, key=lambda p: (parts[p] - sizes[p] / total) * 1000 + need(p) * 0.001)
                found.append(best)
                sizes[best] += size
                for c, n in zip(classes, numbers, strict=True):
                    seen[best][c] = seen[best].get(c, 0) + n
            yield pa.RecordBatch.from_arrays([batch.column("__group"), pa.array(found, pa.string())], ["__group", "split"])

    placed = ordered.mapInArrow(run, f"__group {dict(df.dtypes)[group]}, split string")
    return df.join(placed, df[group].eqNullSafe(placed["__group"])).drop("__group")


def drawn_split(df: DataFrame, group: str, share_of: float, seed: str = "0") -> DataFrame:
    """Adds held: round(groups * share) groups, one at least, none if there is a single group, in a drawn order."""
    groups = df.select(group).distinct()
    n = groups.agg(F.when(F.count("*") > 1, F.greatest(F.lit(1), F.bround(F.count("*") * share_of).cast("long"))).otherwise(0).alias("__n"))
    picked = head(groups.join(F.broadcast(n), F.lit(True)), F.col("__n"), [group], seed).select(group).withColumn("held", F.lit(True))
    return df.join(picked, group, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def calibration_split(df: DataFrame, unit: str, share_of: float, seed: str = "0") -> DataFrame:
    """Adds calibration: whole units in a drawn order until they have the share of the rows; the unit that reaches it is in.

    Only one row a unit meets in the running sum, in parts by the draw's first digits.
    """
    sizes = df.groupBy(unit).agg(F.count("*").alias("__c")).withColumn("__d", draw(unit, seed=seed))
    part = sizes.withColumn("__b", F.substring("__d", 1, 3))
    whole = part.groupBy("__b").agg(F.sum("__c").alias("__t"))
    before = whole.select("__b", (F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__t")).alias("__before"))
    total = sizes.agg((F.sum("__c") * share_of).alias("__target"))
    inner = part.withColumn("__in", F.sum("__c").over(Window.partitionBy("__b").orderBy("__d", unit)) - F.col("__c"))
    placed = inner.join(F.broadcast(before), "__b").join(F.broadcast(total), F.lit(True)).select(unit, (F.col("__before") + F.col("__in") < F.col("__target")).alias("calibration"))
    return df.join(placed, unit)


def batch_quotas(sizes: dict[str, float], batch: int) -> dict[str, int]:
    """Rows of each source in a batch: int(batch * ratio / sum of ratios), what is left to the first."""
    total = sum(sizes.values())
    out = {s: int(batch * r / total) for s, r in sizes.items()}
    first = next(iter(out))
    out[first] += batch - sum(out.values())
    return out


def source_batches(df: DataFrame, source: str, id_cols: list[str], ratios: dict[str, float], batch: int, seed: str = "0") -> DataFrame:
    """Adds batch: rows of each source in a drawn order fill its quota of one batch after another; batches that a source can't fill are
    left out."""
    quotas = batch_quotas(ratios, batch)
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(source))
    w = Window.partitionBy(source).orderBy(draw(*id_cols, seed=seed), *id_cols)
    placed = df.where(F.col(source).isin([s for s, q in quotas.items() if q])).withColumn("batch", F.floor((F.row_number().over(w) - 1) / quota))
    full = placed.groupBy("batch").agg(F.count("*").alias("__n")).where(F.col("__n") == batch).select("batch")
    return placed.join(full, "batch", "left_semi")


def drawn_cyclic(df: DataFrame, id_cols: list[str], size: int, seed: str = "0") -> DataFrame:
    """Adds turn from 0: so many rows in a drawn order, from the beginning again where there are fewer; -1 takes each once."""
    from .resample import numbered

    marked = numbered(df.withColumn("__key", F.concat(draw(*id_cols, seed=seed), F.lit("|"), F.concat_ws("|", *id_cols))), "__key").drop("__key")
    if size < 0:
        return marked.withColumnRenamed("i", "turn")
    n = df.agg(F.count("*").alias("__n"))
    both = marked.join(F.broadcast(n), F.lit(True)).where(F.col("i") < size)
    return both.withColumn("turn", F.explode(F.sequence(F.col("i"), F.lit(size - 1).cast("long"), F.col("__n")))).drop("i", "__n")


def group_split(df: DataFrame, group: str, parts: dict[str, float], seed: str = "0") -> DataFrame:
    """Adds split: every row of a group in the same part; parts by their shares of the hash range."""
    value, out, at = share(group, seed=seed), None, 0.0
    for name, s in parts.items():
        at += s
        out = F.when(value < at, F.lit(name)) if out is None else out.when(value < at, F.lit(name))
    return df.withColumn("split", out.otherwise(F.lit(list(parts)[-1])))


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that are on more than one side."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("sides")).where("sides > 1")


def cyclic(df: DataFrame, by: str, id_cols: list[str], per_class: int, seed: str = "0") -> DataFrame:
    """per_class rows of each class; rows of smaller classes are repeated in turn. Adds turn from 0."""
    w = Window.partitionBy(by).orderBy(draw(*id_cols, seed=seed), *id_cols)
    head = df.withColumn("__r", F.row_number().over(w) - 1).where(F.col("__r") < per_class)
    size = F.count("*").over(Window.partitionBy(by))
    times = F.ceil((F.lit(per_class) - F.col("__r")) / F.col("__n")).cast("int")
    return head.withColumn("__n", size).withColumn("turn", F.explode(F.transform(F.sequence(F.lit(0), times - 1), lambda k: F.col("__r") + k * F.col("__n")))).drop("__r", "__n")
