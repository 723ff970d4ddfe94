"""Two opinions as arrays of class probabilities, fused into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: names of the policies
POLICIES = ["agreement", "pool", "product"]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column, k: int | None = None) -> Column:
    """Scores that sum to 1; an error if one is negative, none is positive, or their number is not k. Null stays null."""
    wrong = F.exists(values, lambda x: x < 0) | (total(values) <= 0)
    if k is not None:
        wrong = wrong | (F.size(values) != k)
    whole = total(values)
    return F.when(values.isNull(), None).when(wrong, F.raise_error(F.lit("no probabilities"))).otherwise(F.transform(values, lambda x: x / whole))


def top(values: Column) -> Column:
    """Index of the largest value, of equal ones the first."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def tempered(probs: Column, temperature: float) -> Column:
    """Probabilities whose logs are divided by a temperature."""
    z = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12))) / temperature)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / total(e))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: (p * q).cast("double")))
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def fuse(first: Column, second: Column, policy: str = "agreement", weight: float = 0.5) -> Column:
    """struct(first_cue, second_cue, agree, cue, contested) by index of the class; second may be null, then first counts alone.

    agreement: the common top class, none if they differ. pool: the top of weight * first + (1 - weight) * second. product: the top
    of their product, none if they share no class. Sums are compared to nine decimals.
    """
    t, v = normalised(first), normalised(second)
    ti, vi = top(t), top(v)
    agree = ti == vi
    if policy == "agreement":
        cue, contested = F.when(v.isNull() | agree, ti), ~agree
    else:
        w = min(max(weight, 0.0), 1.0)
        mixed = F.zip_with(t, v, (lambda p, q: w * p + (1 - w) * q) if policy == "pool" else (lambda p, q: p * q))
        overlap = total(mixed) > 0
        cue = F.when(v.isNull(), ti).when(overlap, top(F.transform(mixed, lambda x: F.round(x, 9))))
        contested = ~agree | ~overlap
    return F.struct(ti.alias("first_cue"), vi.alias("second_cue"), agree.alias("agree"), cue.alias("cue"), F.coalesce(contested, F.lit(False)).alias("contested"))


def agreement_summary(df: DataFrame, by: list[str], fused: str) -> DataFrame:
    """(by, n, n_compared, n_agree, n_contested, rate): rate is over the rows with both opinions, null if there are none."""
    agree = F.col(f"{fused}.agree")
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(agree).alias("n_compared"), F.count_if(agree).alias("n_agree"), F.count_if(~agree).alias("n_contested"))
    return s.withColumn("rate", F.try_divide("n_agree", "n_compared"))
