"""JSON lines and JSON dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, provenance: bool = False) -> DataFrame:
    """Rows of the JSON lines of a file, folder or glob; blank lines are skipped. provenance adds the file's path as source_file."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_path")) if provenance else rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def dict_entries(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(*keep, key, value) of each entry of a column of JSON dictionaries; what is no dictionary has none."""
    return df.select(*keep, F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))
