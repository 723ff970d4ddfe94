"""Calibration models fitted by aggregates: each step is one pass over the rows, and only its sums come to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fusion import total
from ..sources.files import written

#: The smallest probability whose log is taken.
LEAST = 1e-12
#: Scores are dealt to blocks by so many buckets.
BUCKETS = 1024


def logs(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.log(F.greatest(p.cast("double"), F.lit(LEAST))))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / total(e))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(z, y) of rows with equally many classes: a matrix of logits and the true classes. Rows whose truth is none of their classes do not count."""
    for batch in batches:
        z, y = batch.column("z"), batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
        flat, size = z.flatten().to_numpy(zero_copy_only=False).astype(float), z.value_lengths().to_numpy()
        begin = np.cumsum(size) - size
        for k in np.unique(size):
            same = np.flatnonzero((size == k) & (y >= 0) & (y < k))
            yield flat[begin[same][:, None] + np.arange(k)], y[same]


def _summed(rows: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray], numbers: int) -> np.ndarray:
    """The means over all rows of the numbers whose sums each(z, y) gives for a block of rows; a task sends its sums only. Without rows it is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_, n = np.zeros(numbers), 0
        for z, y in _blocks(batches):
            total_, n = total_ + each(z, y), n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(numbers)), pa.array(total_), pa.array([n] * numbers)], ["i", "s", "n"])

    found = rows.select("z", "y").mapInArrow(run, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean")).orderBy("i").collect()
    if not found:
        raise ValueError("no rows to fit")
    return np.array([r["mean"] for r in found])


def _cross_entropy(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(losses, probabilities) of rows of logits."""
    high = z.max(1, keepdims=True)
    e = np.exp(z - high)
    whole = e.sum(1, keepdims=True)
    return np.log(whole[:, 0]) + high[:, 0] - z[np.arange(len(y)), y], e / whole


def golden_temperature(df: DataFrame, probs: str, truth: str, low: float = 0.05, high: float = 10.0, steps: int = 60, ahead: int = 4) -> float:
    """The temperature with the least mean negative log-likelihood, by a golden-section search on its log.

    A pass over the rows answers for all points that the next steps (ahead of them) may ask for, so there are about steps / ahead
    passes. Rows whose truth or probs are null do not count; without rows it is an error.
    """
    rows = written(df.where(F.col(truth).isNotNull() & F.col(probs).isNotNull()).select(logs(F.col(probs)).alias("z"), F.col(truth).alias("y")), "logits")
    share = (math.sqrt(5) - 1) / 2
    known: dict[float, float] = {}

    def inner(a: float, b: float) -> tuple[float, float]:
        return b - share * (b - a), a + share * (b - a)

    def asked(a: float, b: float, c: float, d: float, depth: int) -> Iterator[float]:
        yield from (c, d)
        if depth:
            yield from asked(a, d, inner(a, d)[0], c, depth - 1)
            yield from asked(c, b, d, inner(c, b)[1], depth - 1)

    def value(at: float, points: Iterator[float]) -> float:
        if at not in known:
            new = sorted({p for p in points} - set(known))
            steps_ = [max(math.exp(p), 1e-6) for p in new]
            found = _summed(rows, lambda z, y: np.array([_cross_entropy(z / t, y)[0].sum() for t in steps_]), len(steps_)).tolist()
            known.update(zip(new, found, strict=True))
        return known[at]

    a, b = math.log(low), math.log(high)
    c, d = inner(a, b)
    for _ in range(steps):
        if value(c, asked(a, b, c, d, ahead)) < value(d, asked(a, b, c, d, ahead)):
            b, d = d, c
            c = inner(a, b)[0]
        else:
            a, c = c, d
            d = inner(a, b)[1]
    return math.exp((a + b) / 2)


def lbfgs(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, held: int = 10, tolerance: float = 1e-8) -> np.ndarray:
    """The minimum of a smooth function that gives its value and gradient; each evaluation may be a pass over a table."""
    x = np.asarray(start, float)
    value, grad = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < tolerance:
            break
        way, weights = grad.copy(), []
        for s, y in reversed(past):
            w = (s @ way) / (s @ y)
            weights.append(w)
            way -= w * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, float(np.abs(grad).sum()))
        for (s, y), w in zip(past, reversed(weights), strict=True):
            way += (w - (y @ way) / (s @ y)) * s
        step, slope = 1.0, -(grad @ way)
        for _ in range(30):
            new_value, new_grad = evaluate(x - step * way)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * way, new_grad - grad
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            past = [*past, (s, y)][-held:]
        x, value, grad = x - step * way, new_value, new_grad
    return x


def vector_scaling(df: DataFrame, probs: str, truth: str, classes: int, steps: int = 100) -> tuple[list[float], list[float]]:
    """(scales, biases) by class of the logs of the probabilities, with the least mean cross-entropy. A pass gives the loss and all
    2 * classes slopes. Rows whose truth or probs are null do not count."""
    rows = written(df.where(F.col(truth).isNotNull() & F.col(probs).isNotNull()).select(logs(F.col(probs)).alias("z"), F.col(truth).cast("int").alias("y")), "logits")

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:classes], x[classes:]

        def each(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            loss, p = _cross_entropy(z * w + b, y)
            off = p - (y[:, None] == np.arange(classes))
            return np.concatenate([[loss.sum()], (off * z).sum(0), off.sum(0)])

        found = _summed(rows, each, 1 + 2 * classes)
        return float(found[0]), found[1:]

    best = lbfgs(evaluate, np.concatenate([np.ones(classes), np.zeros(classes)]), steps)
    return best[:classes].tolist(), best[classes:].tolist()


def vector_scaled(probs: Column, scales: list[float], biases: list[float]) -> Column:
    z = logs(probs)
    return softmax(F.array(*[F.get(z, F.lit(k)) * w + b for k, (w, b) in enumerate(zip(scales, biases, strict=True))]))


def logistic(df: DataFrame, features: list[str], label: str, penalty: float = 1.0, steps: int = 30, tolerance: float = 1e-10) -> list[float]:
    """Weights of the features and, last, the intercept of the logistic model of a boolean label: the least sum of log-losses and penalty / 2 times
    the squared weights (not the intercept's), by Newton steps. A pass gives the slopes and the upper half of the curvature. Rows with a
    null do not count; without rows it is an error."""
    rows = written(df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y")).dropna(), "rows")
    d = len(features)
    x = [*[F.col(f"x{i}") for i in range(d)], F.lit(1.0)]
    pull = np.array([penalty] * d + [0.0])
    w = np.zeros(d + 1)

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((x[i] * float(w[i]) for i in range(d + 1)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        found = rows.withColumns({"p": p, "l": loss}).agg(F.sum("l"), *[F.sum((F.col("p") - F.col("y")) * c) for c in x], *[F.sum(F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i, j in pairs]).first()
        if found[0] is None:
            raise ValueError("no rows to fit")
        bent = np.zeros((d + 1, d + 1))
        for (i, j), v in zip(pairs, found[d + 2 :], strict=True):
            bent[i, j] = bent[j, i] = v
        return float(found[0]) + float(pull @ (w * w)) / 2, np.array(found[1 : d + 2], float) + pull * w, bent + np.diag(pull)

    value, slope, bent = look(w)
    for _ in range(steps):
        way = np.linalg.lstsq(bent, slope, rcond=None)[0]
        step = 1.0
        while True:
            new = look(w - step * way)
            if new[0] <= value or step < 1e-6:
                break
            step /= 2
        w, gain = w - step * way, value - new[0]
        value, slope, bent = new
        if gain <= tolerance * max(1.0, abs(value)):
            break
    return w.tolist()


def logistic_score(features: list[str], weights: list[float]) -> Column:
    z = sum((F.col(f) * w for f, w in zip(features, weights[:-1], strict=True)), F.lit(weights[-1]))
    return 1 / (1 + F.exp(-z))


def _pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring blocks (low, high, top, n) in order, pooled while the one before has the same mean or a larger one."""
    held: list[list[float]] = []
    for frame in frames:
        for low, high, top, n in frame[["low", "high", "top", "n"]].itertuples(index=False):
            block = [low, high, top, n]
            while held and held[-1][2] * block[3] >= block[2] * held[-1][3]:
                before = held.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            held.append(block)
    yield pd.DataFrame(held, columns=["low", "high", "top", "n"])


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """(low, high, n, value) of the blocks of the best non-decreasing fit of label (a number or boolean) by score: equal scores are one
    block at first, neighbours are pooled while their means do not rise. Rows with a null do not count.

    Blocks are dealt by ranges of score and pooled within them; where the last block of a range and the first of the next do not
    rise, all blocks are dealt anew to half as many ranges, until all borders rise (one range in the end). The order of pooling
    does not change the fit.
    """
    rows = df.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y")).dropna()
    blocks = rows.groupBy("low").agg(F.sum("y").alias("top"), F.count("*").alias("n")).select("low", F.col("low").alias("high"), "top", "n")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low")
        blocks = written(dealt.mapInPandas(_pool, "low double, high double, top double, n long").withColumn("part", F.spark_partition_id()), "blocks")
        mean = F.col("top") / F.col("n")
        ends = blocks.groupBy("part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"), F.min("low").alias("low"))
        before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("low"))  # one row a range
        blocks = blocks.drop("part")
        if parts == 1 or ends.withColumn("before", before).where("before >= first").isEmpty():
            return blocks.select("low", "high", "n", mean.alias("value"))
        parts = max(1, parts // 2)


def isotonic_score(df: DataFrame, score: str, blocks: DataFrame, out: str) -> DataFrame:
    """df with the column out, the fit at score: a block's value within it, on the line between two blocks outside, the first or last value beyond
    them; null where score is. Blocks and rows meet by buckets of the score."""
    ends = blocks.agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
    rows = df.join(F.broadcast(ends), F.lit(True))  # one row
    at = F.when(F.col(score).isNotNull(), F.least(F.greatest(F.col(score).cast("double"), F.col("__low")), F.col("__high")))
    bucket = lambda c: F.coalesce(F.floor(F.try_divide(c - F.col("__low"), F.col("__high") - F.col("__low")) * BUCKETS), F.lit(0))
    rows = rows.withColumn("__at", at).withColumn("__b", bucket(F.col("__at")))
    place = Window.partitionBy("g").orderBy("low")
    # the next block is found range by range, and over their borders by one row a range
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(blocks.repartitionByRange(parts, "low").withColumn("g", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("g").agg(F.min(F.struct("low", "value")).alias("f"))
    firsts = firsts.select("g", F.lead("f").over(Window.partitionBy(F.lit(0)).orderBy("g")).alias("f"))
    near = ranged.withColumn("next", F.lead(F.struct("low", "value")).over(place)).join(F.broadcast(firsts), "g")
    near = near.withColumn("next", F.coalesce("next", "f")).join(F.broadcast(ends), F.lit(True))
    spread = near.withColumn("__b", F.explode(F.sequence(bucket(F.col("low")), bucket(F.coalesce("next.low", "high")))))
    side = spread.select("__b", F.col("low").alias("__l"), F.col("high").alias("__h"), F.col("value").alias("__v"), F.col("next.low").alias("__nl"), F.col("next.value").alias("__nv"))
    hit = (rows["__b"] == side["__b"]) & (F.col("__at") >= F.col("__l")) & (F.col("__nl").isNull() | (F.col("__at") < F.col("__nl")))
    line = F.col("__v") + (F.col("__nv") - F.col("__v")) * (F.col("__at") - F.col("__h")) / (F.col("__nl") - F.col("__h"))
    value = F.when((F.col("__at") <= F.col("__h")) | F.col("__nl").isNull(), F.col("__v")).otherwise(line)
    return rows.join(side, hit, "left").select(*df.columns, value.alias(out))
