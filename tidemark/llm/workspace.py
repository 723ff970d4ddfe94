"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where a local session names none (as in tests), a new temporary one is set. On a cluster it must be named."""
    named = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set(SETTING, named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Workspace:
    """Tables written once and read back, so that lineage ends there and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        to = self.path(name)
        df.write.options(compression="zstd", **options).parquet(to)
        kept = self.spark.read.schema(df.schema).parquet(to)
        kept.workspace_path = to
        return kept

    def drop(self, df_or_path) -> None:
        """Delete a table that nothing reads any more."""
        at = df_or_path if isinstance(df_or_path, str) else df_or_path.workspace_path
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_keys(ws: Workspace, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a unique column key in the order of doc_id, nulls first: doc_id itself as a long where no id comes
    twice or is null, else (doc_id, hash of the text, number of the row), with which the rows are written once.

    So rows that share a doc_id are never taken for one another; their order among themselves goes by the text.
    """
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if unique:
        return docs.withColumn("key", F.col("doc_id"))
    numbered = docs.withColumn("key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")))
    return ws.save(numbered, "numbered")
