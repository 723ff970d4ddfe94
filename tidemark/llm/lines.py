"""Removal of repeated passages of lines, by DataFrame functions only.

Every window of three consecutive lines of a document is hashed (128 bits). Windows that occur more than once anywhere
are found by a grouping that combines before its shuffle; the first occurrence by (doc_id, line) stays, and lines that
a later occurrence covers are removed, overlapping windows being merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, with_row_keys

WINDOW = 3


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(key, pos, h1, h2) of each window of width consecutive lines of docs(key, text); documents with fewer lines have none."""
    lines = docs.select("key", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).where(F.size("lines") >= width)
    cut = lines.select("key", *[F.slice("lines", i + 1, F.size("lines") - (width - 1)).alias(f"l{i}") for i in range(width)])
    names = [f"l{i}" for i in range(width)]
    each = cut.select("key", F.posexplode(F.arrays_zip(*names)).alias("pos", "w"))
    return each.select("key", "pos", F.xxhash64(*[f"w.{c}" for c in names]).alias("h1"), F.xxhash64(F.lit(1), *[f"w.{c}" for c in reversed(names)]).alias("h2"))


def line_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of docs(doc_id, text): each text without its later occurrences of repeated windows.

    A line is removed when a later occurrence of a window covers it, unless the first occurrence of that same window
    covers it too (self-overlap). So the earliest copy of every passage stays whole: that of the smallest doc_id (a null one comes
    first), of rows with one doc_id that of the first in a fixed order. Each row is its own document, repeated rows too. Texts
    without removed lines come out unchanged; a null text stays null with 0 lines. Other columns are not read. An empty table
    gives an empty one.
    """
    docs = with_row_keys(Workspace(docs.sparkSession, "lines"), docs)
    found = windows(docs, width)
    repeated = found.groupBy("h1", "h2").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # occurrences of one common window are small rows, and a skewed join is split at run time
    later = found.join(repeated, ["h1", "h2"]).where((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
    # (document, start, end) of the lines that this occurrence gives up
    start = F.when(F.col("key") == F.col("first.key"), F.greatest("pos", F.col("first.pos") + width)).otherwise(F.col("pos"))
    covered = later.select("key", start.alias("s"), (F.col("pos") + width - 1).alias("e")).where("s <= e")
    spans = covered.select("key", F.explode(F.sequence("s", "e")).alias("line")).groupBy("key").agg(F.collect_set("line").alias("gone"))
    # split before the join, so that the lines are there once
    whole = docs.select("key", F.split("text", "\n").alias("lines")).join(spans, "key", "left")
    positions = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(positions, F.col("gone")), lambda i: F.get("lines", i))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(left, "\n"))
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    doc_id = F.col("key") if dict(docs.dtypes)["key"] == "bigint" else F.col("key.id")
    return whole.select(doc_id.alias("doc_id"), text.alias("text"), n.alias("n_lines"), removed.alias("n_removed"))
