"""Greedy passes over ordered groups: each decision depends on the rows kept before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import in_order


def _one_key(key: list[str]):
    """The key as one column."""
    return F.col(key[0]) if len(key) == 1 else F.struct(*key)


def _apart(key: list[str]) -> list:
    return [F.col("k").alias(key[0])] if len(key) == 1 else [F.col(f"k.{c}").alias(c) for c in key]


def keep_by_stride(df: DataFrame, key: list[str], time: str, state: str, stride: int) -> DataFrame:
    """(key, time, state) of the rows kept: the state differs from the row before, or stride has passed since the last kept one.

    A key's rows pass through one task in order of (time, state), one at a time: only the last state and the last time kept are held.
    """
    kind = dict(df.dtypes)[time]

    def step(held, row):
        t, s = row
        keep = held["at"] is None or s != held["state"] or t - held["at"] >= stride
        held["state"] = s
        if keep:
            held["at"] = t
        return (keep,)

    rows = df.select(_one_key(key).alias("k"), F.col(time).alias("t"), F.col(state).cast("string").alias("s"))
    kept = in_order(rows, "k", ["t", "s"], ["t", "s"], "keep boolean", lambda: {"at": None, "state": None}, step).where("keep")
    return kept.select(*_apart(key), F.col("t").cast(kind).alias(time), F.col("s").cast(dict(df.dtypes)[state]).alias(state))


def keep_by_hash(df: DataFrame, key: list[str], order: str, hash_col: str, least: int) -> DataFrame:
    """(key, order, hash) of the rows kept: a 64-bit hash at least so many bits from the last kept one; a null hash is always kept.

    A key's rows pass through one task in order, one at a time: only the last hash kept is held.
    """

    def step(held, row):
        h = None if row[0] is None else int(row[0])
        keep = h is None or held[0] is None or ((h ^ held[0]) & ((1 << 64) - 1)).bit_count() >= least
        if keep and h is not None:
            held[0] = h
        return (keep,)

    # as text, since a column of numbers with nulls would be rounded on its way
    rows = df.select(_one_key(key).alias("k"), F.col(order).alias("o"), F.col(hash_col).alias("n"), F.col(hash_col).cast("string").alias("h"))
    kept = in_order(rows, "k", ["o", "n"], ["h"], "keep boolean", lambda: [None], step).where("keep")
    return kept.select(*_apart(key), F.col("o").alias(order), F.col("h").cast("bigint").alias(hash_col))


def suppress(df: DataFrame, key: list[str], score: str, tie: str, x1: str, y1: str, x2: str, y2: str, most: float) -> DataFrame:
    """Non-maximum suppression: (key, tie) of the boxes kept, best score first, none overlapping a kept one by an IoU over most."""
    item = F.struct((-F.col(score)).cast("double").alias("s"), F.col(tie).cast("bigint").alias("i"), *[F.col(c).cast("double").alias(n) for c, n in ((x1, "a"), (y1, "b"), (x2, "c"), (y2, "d"))])
    zero = F.expr("cast(array() AS array<struct<s:double,i:bigint,a:double,b:double,c:double,d:double>>)")

    def over(k, x):
        w = F.greatest(F.least(k["c"], x["c"]) - F.greatest(k["a"], x["a"]), F.lit(0.0))
        h = F.greatest(F.least(k["d"], x["d"]) - F.greatest(k["b"], x["b"]), F.lit(0.0))
        union = (k["c"] - k["a"]) * (k["d"] - k["b"]) + (x["c"] - x["a"]) * (x["d"] - x["b"]) - w * h
        return F.when(union > 0, w * h / union).otherwise(0.0) > most

    step = lambda acc, x: F.when(F.exists(acc, lambda k: over(k, x)), acc).otherwise(F.array_append(acc, x))
    folded = df.groupBy(*key).agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step).alias("kept"))
    return folded.select(*key, F.inline("kept")).select(*key, F.col("i").alias(tie))
