"""The corpus pipeline: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, ordinal
from tidemark.llm.exact import exact_dedup, keep_rows, sha256, small, unused
from tidemark.llm.jaccard import JaccardJoin
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary_file
from tidemark.llm.workspace import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters (null and empty texts too) or of no known language go.

    Each row is judged by its own text, repeated rows and null doc_ids too. Without labelled rows nothing is recognised. An empty
    table gives an empty one; columns of any other name stay as they are.
    """
    rows = docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    return langid.keep_identified(spark, langid.fit(spark, rows), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the top grade; toxic ones and those of low quality go.

    Each row is judged by its own text (a null one counts as empty), repeated rows and null doc_ids too. Of several ratings of one
    doc_id the lowest counts; without ratings all rows stay. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal.keep_good(spark, ordinal.fit(spark, docs, labels), docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id (a null one only if the group has no other); null and
    empty texts are equal. Of rows with that same doc_id one stays. An empty table gives an empty one."""
    return exact_dedup(spark, docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; a null doc_id comes after all others, and
    of equal ones the smallest digest decides. Rows are told apart by doc_id and text, so other rows of a doc_id (or without
    one) stay or go by their own text. Of repeated rows with the doc_id and text that stay, one stays. Rows without words
    (null and empty texts too) stay. An empty table gives an empty one."""
    ws = Workspace(spark, "near")
    mark = unused(docs, "digest")
    marked = docs.withColumn(mark, F.xxhash64(sha256(F.coalesce("text", F.lit("")))))
    choices = JaccardJoin(spark).choices(marked.select("doc_id", "text", F.col(mark).alias("digest"))).where("n_shingles > 0")
    many = ws.save(choices.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("short"), "stays").agg(F.count("*").alias("n")).where("NOT stays OR n > 1"), "choices")
    gone, twice = (many.where(c).select("id", "short") for c in ("NOT stays", "stays"))
    return keep_rows(marked, "doc_id", mark, small(gone), twice).drop(mark)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; each row is a document of its own, a null or empty text
    gives one piece of one token. An empty table gives an empty one."""
    return pack(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packing),
]

#: The fitted classifiers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
