"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds between grades.

P(grade <= k) = sigmoid(threshold_k - w.x). Grades come from human ratings: 0 toxic, 1 of low quality, 2 good. The weights
are shared by all thresholds, so every grade's rows teach one direction; the expected grade and the probability of the
upper grades (the tail) serve for selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import Ftrl
from .textbytes import NOT_ALPHANUMERIC, mix, slices, string_buffers, word_hashes

WORD_BITS, CHAR_BITS = 18, 12
WORD_BINS, CHAR_BINS = 1 << WORD_BITS, 1 << CHAR_BITS
BINS = WORD_BINS + CHAR_BINS
GRADES = 3
#: The fit uses at most about this many rated rows of each grade, drawn by a hash of the row's id.
SAMPLE_PER_GRADE = 2000
#: A row stays if the probability of the top grade is at least this.
KEEP_TAIL = 0.5


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bins, values) of each row of a string column: words by presence, byte trigrams with a mark or capital by share."""
    data, offsets = string_buffers(column)
    with np.errstate(over="ignore"):
        for a, b in slices(offsets):
            words, bounds = word_hashes(data, offsets[a : b + 1], NOT_ALPHANUMERIC)
            word_bins = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
            lo = offsets[a]
            piece = data[lo : offsets[b]]
            shape = np.where((piece >= 97) & (piece <= 122) | (piece >= 128), 97, np.where((piece >= 65) & (piece <= 90), 65, np.where((piece >= 48) & (piece <= 57), 48, piece))).astype(np.uint64)
            tri = shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:] if len(shape) > 2 else shape[:0]
            tri = (mix(tri) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
            for i in range(b - a):
                own = np.unique(word_bins[bounds[i] : bounds[i + 1]])
                s, e = offsets[a + i] - lo, max(offsets[a + i + 1] - lo - 2, offsets[a + i] - lo)
                counts = np.bincount(tri[s:e], minlength=CHAR_BINS)
                chars = np.flatnonzero(counts)
                share = np.sqrt(counts[chars] / max(e - s, 1))
                yield a + i, np.concatenate((own, WORD_BINS + chars)), np.concatenate((np.full(len(own), 1.0), 4 * share))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of the grades for each score."""
        below = _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])
        return np.diff(np.concatenate((np.zeros((len(below), 1)), below, np.ones((len(below), 1))), 1), axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for row, at, x in features(column):
            out[row] = self.weights[at] @ x
        return out


def grade_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels(doc_id, quality, toxic): 0 toxic, 1 not toxic but of low quality, 2 good; rows with a null are left out."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins, values = [], []
        for _, at, x in features(batch.column(1)):
            bins.append(at.astype(np.int32).tobytes())
            values.append(x.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bins, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "grade", "bins", "values"])


def fit_rows(data: list[tuple[np.ndarray, np.ndarray, int]], shares: np.ndarray, grades: int = GRADES, epochs: int = 10, seed: int = 7) -> OrdinalModel:
    """Fit by FTRL-proximal steps on the likelihood; an L1 penalty leaves only telling words.

    shares: of each grade in the population; a grade's rows weigh as a mean (geometric, 0.6 to 0.4) of its share and of an
    equal one. Thresholds stay in order as a first one plus positive gaps.
    """
    state = Ftrl(1, BINS, alpha=0.2, l1=15.0, l2=0.1)
    first, gaps = -1.0, np.zeros(grades - 2)
    side = np.full(grades - 1, 1e-1)
    sample = np.maximum(np.bincount([y for *_, y in data], minlength=grades), 1) / len(data)
    weight_of = (shares / sample) ** 0.6 * (1 / sample / max((shares > 0).sum(), 1)) ** 0.4
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            at, x, y = data[i]
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            seen = {}

            def slope(scores, y=y, t=t, seen=seen):
                up = _sigmoid(t[y] - scores[0]) if y < grades - 1 else 1.0
                low = _sigmoid(t[y - 1] - scores[0]) if y else 0.0
                p = max(up - low, 1e-9)
                seen["du"], seen["dl"] = up * (1 - up) / p, low * (1 - low) / p
                return np.array([weight_of[y] * np.clip(seen["du"] - seen["dl"], -1, 1)])

            state.step(at, x, slope)
            dt = np.zeros(grades - 1)
            if y < grades - 1:
                dt[y] -= seen["du"]
            if y:
                dt[y - 1] += seen["dl"]
            dt = weight_of[y] * np.clip(dt, -1, 1)
            steps = np.concatenate(([dt.sum()], [dt[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]))
            side += steps * steps
            moved = 0.1 * steps / np.sqrt(side)
            first -= moved[0]
            gaps -= moved[1:]
    return OrdinalModel(state.weights()[0].astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE_PER_GRADE) -> OrdinalModel:
    """Learn from docs(doc_id, text) and labels(doc_id, quality, toxic). Without rated rows everything has the top grade.

    Of several ratings of one doc_id the lowest counts; null ids and ids without a document are not learned from. The sample takes of each
    grade the ids whose hash falls under per_grade / their number. Rows of equal id and text are one; never more than
    2 * per_grade rows for each grade come to the driver, those with the smallest hashes. Texts are read whole, null ones as empty; other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lowest = grade_of(labels).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").alias("grade"))
    rated = lowest.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("grade")), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    sizes = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return OrdinalModel(np.zeros(BINS, np.float32), np.array([-30.0, -29.0]))
    rate = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, per_grade / n))])
    drawn = rated.where(F.col("h") < F.element_at(rate, F.col("grade"))).select("doc_id", "grade").orderBy("h").limit(2 * per_grade * GRADES)
    rows = docs.join(F.broadcast(drawn), "doc_id").withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "h"])
    rows = rows.orderBy("h", "doc_id").limit(2 * per_grade * GRADES).select("doc_id", "text", "grade")
    sample = sorted(rows.mapInArrow(_sparse, "doc_id long, grade int, bins binary, values binary").collect(), key=lambda r: (r["doc_id"], r["bins"]))
    if not sample:
        return OrdinalModel(np.zeros(BINS, np.float32), np.array([-30.0, -29.0]))
    shares = np.array([sizes.get(g, 0) for g in range(GRADES)], float) / sum(sizes.values())
    return fit_rows([(np.frombuffer(r["bins"], np.int32), np.frombuffer(r["values"], np.float32).astype(np.float64), r["grade"]) for r in sample], shares)


def predict(spark: SparkSession, model: OrdinalModel, docs: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, grade, kept) for each row of docs(doc_id, text); a null text counts as empty.

    Each row is judged by its own text, read whole; repeated rows and null ids come out as they are, of equally probable grades the lowest
    is given. Other columns are not read. An empty table gives an empty one."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            p = m.grades(m.score(batch.column(1)))
            tail = p[:, -1]
            cols = [batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(p.argmax(1).astype(np.int32)), pa.array(tail >= KEEP_TAIL)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", "tail_prob", "grade", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, grade int, kept boolean")


def keep_good(spark: SparkSession, model: OrdinalModel, docs: DataFrame, least: float = KEEP_TAIL) -> DataFrame:
    """The rows (all their columns, unchanged) whose tail probability is at least this."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array(m.grades(m.score(batch.column(at)))[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)
