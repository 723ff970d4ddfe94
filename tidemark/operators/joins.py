"""Joins by ranges, by time and with fallback keys, all as equi-joins on buckets or keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, contains_centre, iou


def band_join(left: DataFrame, right: DataFrame, key: list[str], lt: str, rt: str, width: int) -> DataFrame:
    """Rows of equal keys whose times differ by at most width: the right side is spread over three buckets of that width."""
    lo = left.withColumn("__b", F.floor(F.col(lt) / width))
    hi = right.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(rt) / width) + d)))
    return lo.join(hi, [*key, "__b"]).where(F.abs(F.col(lt) - F.col(rt)) <= width).drop("__b")


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], time: str, tie: str, values: list[str], max_age: int) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time, and its age; nulls if older than max_age.

    Both sides go through one window: right rows before left rows of the same time.
    """
    packed = F.struct(F.col(time).alias("t"), *values)
    both = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)})
    other = right.select(*key, time, F.col(tie), F.lit(0).alias("__side"), packed.alias("__v"))
    w = Window.partitionBy(*key).orderBy(time, "__side", tie)
    seen = both.unionByName(other, allowMissingColumns=True).withColumn("__last", F.last("__v", True).over(w)).where("__side = 1")
    age = F.col(time) - F.col("__last.t")
    fresh = age <= max_age
    return seen.select(*left.columns, F.when(fresh, age).alias("age"), *[F.when(fresh, F.col(f"__last.{v}")).alias(v if v not in left.columns else f"right_{v}") for v in values])


def fallback_join(left: DataFrame, lookup: DataFrame, keys: list[Column], lookup_key: str, value: str) -> DataFrame:
    """left with value from a lookup of unique keys, by the first of several keys that is there."""
    out = left
    for i, k in enumerate(keys):
        one = lookup.select(F.col(lookup_key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(one, k == F.col(f"__k{i}"), "left")
    return out.select(*left.columns, F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))]).alias(value))


def spatial_join(a: DataFrame, b: DataFrame, key: list[str], box_a: Box, box_b: Box, least: float) -> DataFrame:
    """Pairs of boxes of one frame with IoU of at least least."""
    return a.join(b, key).withColumn("iou", iou(box_a, box_b)).where(F.col("iou") >= least)


def containment_join(outer: DataFrame, inner: DataFrame, key: list[str], box_outer: Box, box_inner: Box) -> DataFrame:
    """Pairs of one frame where the inner box's centre lies in the outer box."""
    return outer.join(inner, key).where(contains_centre(box_outer, box_inner))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order)).alias("__row")).select(*key, "__row.*")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of the keys that more than one row has; empty where keys are unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def second_opinion(first: DataFrame, second: DataFrame, key: list[str], differs: Column, rejected: Column) -> DataFrame:
    """first with the columns of second where it has the key, and disagree (false without it); rows that second rejects go."""
    marked = second.withColumn("__there", F.lit(True))
    both = first.join(marked, key, "left").where(~F.coalesce(rejected, F.lit(False)))
    return both.withColumn("disagree", F.coalesce(F.col("__there") & differs, F.lit(False))).drop("__there")


def fill_from(rows: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with nulls in some columns filled from the source's row of the same key."""
    other = source.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(other, key, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def paired(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, a, b, delta): two runs' values of equal keys, such as configuration and seed; keys of one run alone are left out."""
    left, right = a.select(*key, F.col(value).alias("a")), b.select(*key, F.col(value).alias("b"))
    return left.join(right, key).withColumn("delta", F.col("a") - F.col("b"))


def mapped(rows: DataFrame, lookup: DataFrame, key: list[str], value: str) -> DataFrame:
    """(mapped, dropped): how many rows a lookup of unique keys maps, and how many have no entry."""
    both = rows.select(*key).join(lookup.select(*key, value), key, "left")
    return both.agg(F.count(value).alias("mapped"), F.count_if(F.col(value).isNull()).alias("dropped"))


def keys_of(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key).distinct()


def union_of(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def intersection_of(*sets: DataFrame) -> DataFrame:
    """Rows that all sets have; each is shuffled once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def difference_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def best_row(df: DataFrame, key: list[str], order: list[Column], smallest: bool = False) -> DataFrame:
    """The row of each key with the largest (or smallest) order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    pick = F.min if smallest else F.max
    named = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    return df.groupBy(*key).agg(pick(F.struct(*named, F.struct(*rest).alias("__row"))).alias("__m")).select(*key, "__m.__row.*")


def top_rows(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key; results of parts can be merged by applying it again."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__r") <= most).drop("__r")
