"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes a space, and the 1- to 3-grams of the whole text are hashed. The weights
are fitted by FTRL-proximal steps with L1 and L2 penalties, then one temperature is fitted on rows that the steps left out.
Document frequencies cover all labelled rows; the steps run over a bounded sample of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 1 << 14
#: The fit uses at most about this many rows of each language, drawn by a hash of id and text.
SAMPLE_PER_LANGUAGE = 800
#: More labels than this are refused: the weights have a row of BINS for each.
MOST_LANGUAGES = 512
UNKNOWN = "und"
_PIECE = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, None if it has no letter. Long texts are taken in pieces."""
    counts, any_letter = None, False
    for a in range(0, max(len(text), 1), _PIECE):
        piece = text[max(0, a - 2) : a + _PIECE].lower()
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letter_table()[cp]
        if not letter.any():
            continue
        any_letter = True
        c = np.where(letter, cp, np.uint32(32))
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        one = c * np.uint32(0x165667B1)
        h = np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) for x in (one, two[letter[1:] | letter[:-1]], three[letter[1:-1]])])
        more = np.bincount(h >> np.uint32(32 - 14), minlength=BINS)
        counts = more if counts is None else counts + more
    return counts if any_letter else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class Ftrl:
    """FTRL-proximal state of a classes x bins weight table with elastic-net penalties."""

    classes: int
    bins: int = BINS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5

    def __post_init__(self):
        self.z, self.n = np.zeros((self.classes, self.bins)), np.zeros((self.classes, self.bins))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, slope) -> None:
        """slope: from the scores of all classes to the loss's derivative by each."""
        w = self.weights(at)
        g = slope(w @ x)[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (und, 0) for null, for texts without letters, or if nothing was learned."""
        counts = ngram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = _vector(counts, self.idf)
        p = _softmax((self.weights[:, at] @ x) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from the fit: crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = ngram_counts(text.as_py() or "")
            if counts is not None:
                df += counts > 0
                rows += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], names=["bin", "df"])


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, bins, counts = [], [], [], []
        for i, (text, label) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            c = ngram_counts(text.as_py() or "")
            if c is not None:
                at = np.flatnonzero(c)
                ids.append(batch.column(0)[i].as_py())
                labels.append(label.as_py())
                bins.append(at.astype(np.int32).tobytes())
                counts.append(c[at].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())], names=["h", "label", "bins", "counts"])


def fit(spark: SparkSession, rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, epochs: int = 3) -> LanguageModel:
    """Learn from rows(id, text, label); rows with a null label are left out. Without rows the model answers und.

    The sample takes of each language the rows whose hash of id and text falls under per_language / their approximate number: about
    that many, fewer where there are fewer. Rows of equal id, text and label are one, so ids that are null or repeat do not matter; never
    more than 2 * per_language rows for each language come to the driver. The same rows give the same model.
    """
    rows = rows.where("label IS NOT NULL").select(F.xxhash64("id", "text", F.lit("sample")).alias("h"), F.xxhash64("id", F.lit("sample")).alias("turn"), "text", "label")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, BINS)), np.ones(BINS), 1.0)
    counted = rows.select("text").mapInArrow(_document_frequencies, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).toPandas()
    total = max(int(counted.loc[counted["bin"] < 0, "df"].sum()), 1)
    df = np.zeros(BINS)
    counted = counted[counted["bin"] >= 0]
    df[counted["bin"].to_numpy(np.int64)] = counted["df"].to_numpy(np.float64)
    idf = np.log((1 + total) / (1 + df)) + 1
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / max(sizes[k], 1)))])
    drawn = rows.where(F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.element_at(rate, F.col("label"))).dropDuplicates(["h", "label"])
    drawn = drawn.orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "h", "label").limit(2 * per_language * len(languages))
    sample = sorted(drawn.select(F.col("turn").alias("h"), "text", "label").mapInArrow(_sparse_rows, "h long, label string, bins binary, counts binary").collect(), key=lambda r: (r["h"], zlib.crc32(r["bins"]), r["label"], r["bins"]))
    data = []
    for r in sample:
        counts = np.zeros(BINS, np.int64)
        counts[np.frombuffer(r["bins"], np.int32)] = np.frombuffer(r["counts"], np.int32)
        data.append((*_vector(counts, idf), languages.index(r["label"])))
    learn = [d for i, d in enumerate(data) if i % 5 or len(data) < 20]
    check = [d for i, d in enumerate(data) if not i % 5] or data
    state = Ftrl(len(languages))
    for _ in range(epochs):
        for at, x, y in learn:
            state.step(at, x, lambda s, y=y: _softmax(s) - np.eye(len(languages))[y])
    weights = state.weights()
    scores = [(weights[:, at] @ x, y) for at, x, y in check]
    loss = lambda t: -sum(np.log(max(_softmax(s / t)[y], 1e-12)) for s, y in scores)
    best = min(np.geomspace(0.05, 10, 60), key=loss) if scores else 1.0
    return LanguageModel(languages, weights.astype(np.float32), idf, float(best))


def predict(spark: SparkSession, model: LanguageModel, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row, in any order; only these two columns are read. Repeated rows and null ids come out as
    they are; null texts and texts without letters are und with score 0; of equal probabilities the first language by name
    wins. Texts of any length are read whole. An empty table gives an empty one."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(spark: SparkSession, model: LanguageModel, rows: DataFrame, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows (all their columns, unchanged) whose text has a language of at least this calibrated probability."""
    shared = spark.sparkContext.broadcast(model)
    at = rows.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= least for g in got], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
