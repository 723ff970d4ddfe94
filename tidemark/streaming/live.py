"""Live streams: opinions that arrive on the side, and sources of which only the newest row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch


def side_opinions(frames: DataFrame, opinions: DataFrame, key: str, time: str, ident: str, values: list[str], tie: str, max_age: str) -> DataFrame:
    """(key, time, ident, own columns of frames, age_us, values) of each frame: the newest opinion of its key at or before its time and no older
    than max_age (an interval), by time and then tie; nulls where there is none, so that the frame stands alone.

    Both are streams with a watermark on time. The join keeps, per side, only rows that the other may still ask for; a frame comes out
    once, when the watermarks have passed what could still matter to it. Rows later than the watermark are dropped. Keys, times and idents
    that are null have no opinion and come out by themselves at that point as well, but for a null time, which is dropped.
    """
    own = [c for c in frames.columns if c not in (key, time, ident)]
    left = frames.where(F.col(time).isNotNull()).select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.col(ident).alias("__i"), F.struct(*own, F.lit(0).alias("__")).alias("__own"))
    right = opinions.select(F.col(key).alias("__ok"), F.col(time).alias("__ot"), F.struct(F.col(time).alias("__at"), F.col(tie).alias("__tie"), *values).alias("__told"))
    near = F.expr(f"__k = __ok AND __ot <= __t AND __ot >= __t - INTERVAL {max_age}")
    newest = left.join(right, near, "leftOuter").groupBy("__k", "__t", "__i", "__own").agg(F.max("__told").alias("__told"))
    age = F.unix_micros("__t") - F.unix_micros("__told.__at")
    return newest.select(F.col("__k").alias(key), F.col("__t").alias(time), F.col("__i").alias(ident), *[F.col(f"__own.{c}").alias(c) for c in own], age.alias("age_us"), *[F.col(f"__told.{v}").alias(v if v not in frames.columns else f"side_{v}") for v in values])


def take_newest(stream: DataFrame, source: str, order: list[str], folder: str):
    """Writer of a stream of which, in each micro-batch, only the newest row of each source is processed: the others are dropped and counted.

    A batch's rows and counts (n_read of the source's rows) are one write to its own folder, which replaces what an earlier try of the
    same batch has left: a batch run twice changes nothing. Of a source's rows only the newest is ever held.
    """

    def commit(batch: DataFrame, number: int) -> None:
        row = F.struct(*batch.columns)
        newest = batch.groupBy(source).agg(F.max_by(row, F.struct(*order)).alias("row"), F.count("*").alias("n_read"))
        newest.select("row.*", "n_read").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{scratch(stream.sparkSession, 'newest')}")


def newest_rows(spark, folder: str, schema) -> DataFrame:
    """The rows that were taken, with n_read and the batch."""
    return spark.read.schema(f"{schema}, n_read long, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")


def drop_counts(taken: DataFrame, source: str) -> DataFrame:
    """(source, n_read, n_taken, n_dropped) of each source so far."""
    return taken.groupBy(source).agg(F.sum("n_read").alias("n_read"), F.count("*").alias("n_taken"), (F.sum("n_read") - F.count("*")).alias("n_dropped"))


def push_counts(stream: DataFrame, by: list[str], sums: dict, folder: str):
    """Writer of running aggregates in update mode: each micro-batch pushes the groups that it changed, with their values so far (sums: name to an
    aggregate expression), as one write to its own folder. A batch run twice replaces itself. With a watermark on a column of by, groups that are past it
    are forgotten."""
    changed = stream.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])

    def push(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(push).option("checkpointLocation", scratch(stream.sparkSession, "push"))


def pushed(spark, folder: str, schema: str, by: list[str]) -> DataFrame:
    """The last values pushed of each group, and n_pushed, how often it was pushed."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")
    own = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*own), "batch").alias("v"), F.count("*").alias("n_pushed")).select(*by, "v.*", "n_pushed")
