"""Connected components of an edge table by repeated contraction, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges(a, b); comp is one node of its component.

    Each round maps every node to the smallest of itself and its neighbours and contracts the edges; as node keys are
    hashes, the number of nodes falls by a constant factor in each round. Nulls in a or b are ignored, self-loops kept
    as nodes, repeated edges harmless; an empty table gives an empty result.
    """
    ids = edges.where("a IS NOT NULL AND b IS NOT NULL")
    current = ws.save(ids.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    labels = None
    while not current.isEmpty():
        both = current.union(current.selectExpr("b", "a"))
        step = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "step")
        side = lambda c: step.selectExpr(f"node AS {c}", f"to AS {c}_to")
        after = current.join(side("a"), "a").join(side("b"), "b").where("a_to <> b_to")
        contracted = ws.save(after.selectExpr("least(a_to, b_to) AS a", "greatest(a_to, b_to) AS b").distinct(), "edges")
        if labels is None:
            composed = step.selectExpr("node", "to AS comp")
        else:
            moved = labels.join(step.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            composed = moved
        following = ws.save(composed, "labels")
        ws.drop(current)
        ws.drop(step)
        if labels is not None:
            ws.drop(labels)
        current, labels = contracted, following
    loops = ids.where("a = b").select(F.col("a").alias("node")).distinct()
    if labels is None:
        return loops.select("node", F.col("node").alias("comp"))
    return labels.union(loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp")))
