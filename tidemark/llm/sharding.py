"""Shards by a weighted hash tree: a row descends from the root to a region, a rack and a shard.

At each level every child draws -ln(u) / weight, u in (0, 1) from a hash of the row's id and the child's name; the smallest draw
wins, so a child gets rows in proportion to its weight. A node weighs what its shards weigh. Where a shard's weight changes, only
the draws of the nodes above it change, so rows move only into or out of these subtrees; no row moves between two subtrees whose
weights stay.

Shards that are added later draw beside the earlier ones: a region (or rack) draws once for each addition, with the weight that
the addition brought to it, and a row won by an addition descends among its shards alone. So a row leaves its shard for an added one only,
and the others stay where they are.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    addition: int = 0
    weight: float = 1.0


class ShardTree:
    """Shards in racks in regions. A shard of weight 0 gets no rows."""

    def __init__(self, shards: list[Shard]):
        if len({s.number for s in shards}) != len(shards) or any(s.weight < 0 for s in shards) or not any(s.weight for s in shards):
            raise ValueError("shards need numbers of their own and weights of 0 or more, not all 0")
        self.shards = sorted(shards, key=lambda s: s.number)

    @classmethod
    def even(cls, shards: int, regions: int = 2, racks: int = 2) -> ShardTree:
        """So many shards of weight 1, dealt round to the regions and, in each, to the racks."""
        return cls([Shard(i, i % regions, i // regions % racks) for i in range(shards)])

    def grown(self, region: int = 0, rack: int = 0, weights: tuple[float, ...] = (1.0,)) -> ShardTree:
        """The tree with more shards in one rack, as an addition of its own."""
        number, addition = 1 + max(s.number for s in self.shards), 1 + max(s.addition for s in self.shards)
        return ShardTree([*self.shards, *(Shard(number + i, region, rack, addition, w) for i, w in enumerate(weights))])

    def reweighted(self, number: int, weight: float) -> ShardTree:
        return ShardTree([replace(s, weight=weight) if s.number == number else s for s in self.shards])

    def children(self) -> dict[str, list[tuple[str, float, int]]]:
        """(name, weight, number) of each node's children; the root is "", the number counts for shards only."""
        weights, below = defaultdict(float), defaultdict(set)
        for s in self.shards:
            region, rack, leaf = f"{s.addition}/{s.region}", f"{s.addition}/{s.region}/{s.rack}", f"{s.addition}/{s.region}/{s.rack}/{s.number}"
            for parent, child in (("", region), (region, rack), (rack, leaf)):
                if s.weight:
                    weights[child] += s.weight
                    below[parent].add((child, s.number if child == leaf else -1))
        return {p: [(c, weights[c], n) for c, n in sorted(found)] for p, found in below.items()}


def _lowest(row: Column, children: Column) -> Column:
    """The child with the smallest draw, ties by name: struct(draw, name, number)."""

    def draw(child):
        bits = F.conv(F.substring(F.md5(F.concat(row, F.lit("|"), child["name"])), 1, 13), 16, 10).cast("long")
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / child["weight"]).alias("draw"), child["name"].alias("name"), child["number"].alias("number"))

    return F.array_min(F.transform(children, draw))


def place(rows: DataFrame, row: Column, tree: ShardTree, out: str) -> DataFrame:
    """rows with the int column out: the shard of each by the string row; a null one counts as the text null."""
    each = lambda c: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("number")) for n, w, i in c])
    nodes = tree.children()
    top = nodes.pop("")
    below = F.create_map(*[x for name, c in nodes.items() for x in (F.lit(name), each(c))])
    row = F.coalesce(row, F.lit("null"))
    # a step of its own for each level, so that no draw is made twice
    region = rows.withColumn(out, _lowest(row, each(top))["name"])
    rack = region.withColumn(out, _lowest(row, F.element_at(below, F.col(out)))["name"])
    return rack.withColumn(out, _lowest(row, F.element_at(below, F.col(out)))["number"])


def with_slots(ws: Workspace, rows: DataFrame, shard: str, order: list[str], partitions: int) -> DataFrame:
    """rows with the long column slot: their number in their shard, from 0 and without gaps, by the columns of order.

    Rows are dealt by ranges of shard and order, with a row number that keeps equal ones apart, and written once; a shard's
    slots run over its ranges. Only a row for each shard of a range meets in one task.
    """
    keys = [shard, *order, "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("row")
    ranged = ws.save(dealt.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33).alias("part")  # the partition is in the upper bits, the row's place in the lower
    starts = ranged.groupBy(part, shard).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", shard, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    found = ranged.withColumn("part", part).join(F.broadcast(starts), ["part", shard])  # a row for each range and the shards it has
    return found.withColumn("slot", F.col("at") - F.col("first") + F.col("begin")).drop("part", "at", "first", "begin")


def shard_documents(spark: SparkSession, docs: DataFrame, tree: ShardTree, grown: ShardTree) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs(doc_id, text).

    size is the text's bytes in UTF-8 and one, text_crc32 their checksum (a null text has none: 1 and 0). The law is `key`: doc_id
    and the tree alone decide; grown_shard is the shard in the grown tree, which is the same or one of its added shards. Rows of one
    doc_id share a shard, and so do all rows without one; rows with equal texts go by their doc_id as any others. Slots follow
    doc_id (nulls first), then checksum and size. Repeated rows come out as often as they come in; other columns are not read.
    An empty table gives an empty one.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    key = F.col("doc_id").cast("string")
    placed = place(place(rows, key, tree, "shard"), key, grown, "grown_shard")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = with_slots(Workspace(spark, "shards"), placed, "shard", ["doc_id", "text_crc32", "size"], parts)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
