"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) of nodes(node): the smallest node that edges(a, b) reach. Nodes may be of any type with an order; edges in either
    direction, repeated ones and loops are harmless, ends that are no node count as nodes as well.

    Each round hangs all larger neighbours of a node on its smallest one, then the smaller neighbours likewise, until only stars
    are left: some log n rounds, each a grouping and a join whose tables are written.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    now = written(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        around = now.union(now.select("b", "a"))
        low = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = around.join(low, "a").where("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = written(small.union(low).distinct(), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    every = nodes.select("node").union(both.select("a")).union(both.select("b")).distinct()
    return every.join(now.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("comp"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and a sum of hashes, equal where a round changes nothing."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])
