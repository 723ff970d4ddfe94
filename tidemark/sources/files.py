"""Files: scratch folders, Parquet and CSV sinks, done marks, runs, manifests of contents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; a local session that names none gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back, so that its lineage ends there."""
    to = scratch(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def jsonl_to_parquet(spark: SparkSession, source: str, schema: str, to: str) -> None:
    """JSON lines of a path or glob as Parquet."""
    spark.read.schema(schema).json(source).write.parquet(to)


def write_csv(df: DataFrame, to: str) -> None:
    """One file with a header: for tables of results, which are small."""
    df.coalesce(1).write.csv(to, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def with_base(df: DataFrame, bases: DataFrame, group: Column) -> DataFrame:
    """df with base, the first of bases(group, rank, base) that its group has; null if there is none."""
    first = bases.groupBy(F.col("group").alias("__g")).agg(F.min_by("base", "rank").alias("base"))
    return df.join(first, group == F.col("__g"), "left").drop("__g")


def done_shards(spark: SparkSession, folder: str, schema: str = "shard string") -> DataFrame:
    """(shard) of the marks written by mark_done(); empty before the first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).json(folder).distinct() if there else spark.createDataFrame([], schema)


def mark_done(shards: DataFrame, folder: str) -> None:
    """Append marks of finished shards(shard)."""
    shards.select("shard").distinct().write.mode("append").json(folder)


def remaining(rows: DataFrame, shard: str, done: DataFrame) -> DataFrame:
    """rows of shards that have no mark."""
    return rows.join(done.select(F.col("shard").alias(shard)), shard, "left_anti")


def append_new(rows: DataFrame, sink: str, key: list[str]) -> DataFrame:
    """Append to a Parquet sink the rows whose key it does not have (one of each key), and give the whole sink."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(sink).select(*key), key, "left_anti")
    rows.dropDuplicates(key).write.mode("append").parquet(sink)
    return spark.read.schema(rows.schema).parquet(sink)


def runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row for each result file of a glob of run folders, with run, the folder's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def contents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, bytes, sha256) of the files under a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_contents(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status) of files that are missing, unexpected or changed, against a manifest as contents() makes it."""
    e = expected.select("name", F.col("sha256").alias("__e"))
    f = found.select("name", F.col("sha256").alias("__f"))
    status = F.when(F.col("__f").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__e") != F.col("__f"), "changed")
    return e.join(f, "name", "full").select("name", status.alias("status")).where("status IS NOT NULL")


def listed_sample(listing: DataFrame, path: str, n: int, seed: int | None = 0) -> DataFrame:
    """n files of a listing: drawn by a hash of the seed and the path or, without a seed, the first by path. Each task keeps n at most."""
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col(path)).cast("binary")), F.col(path)] if seed is not None else [F.col(path)]
    return listing.orderBy(*order).limit(n)
