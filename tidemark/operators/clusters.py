"""Density clusters of points in the plane, on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .graphs import components

#: A cell is eps / DIAGONAL wide, so that any two of its points are within eps, and neighbours lie two cells away at most.
DIAGONAL = 1.4143
#: A cell has so many parts a side, by which most pairs of cells are decided without looking at points.
PARTS = 4
#: Cells are joined by blocks of 2**BLOCK a side: what looks at the cells around it goes to the one to four blocks that they lie in.
BLOCK = 3
#: Distinct points of one block go to one task up to about this many.
SHARE = 4096


def _blocked(cells: DataFrame) -> DataFrame:
    """cells(cx, cy, ...) with bx, by of their block."""
    return cells.withColumns({"bx": F.shiftright("cx", BLOCK), "by": F.shiftright("cy", BLOCK)})


def _around(cells: DataFrame, left: int = 2) -> DataFrame:
    """cells(cx, cy, ...) once for each block bx, by of the cells up to two away, of those with a smaller cx up to left away."""
    blocks = lambda c, back: F.explode(F.sequence(F.shiftright(F.col(c) - back, BLOCK), F.shiftright(F.col(c) + 2, BLOCK)))
    return cells.withColumn("bx", blocks("cx", left)).withColumn("by", blocks("cy", 2))


def _probe(probes: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of probes(key, x, y, eps, cx, cy, ...) and points(key, cx, cy, x2, y2, ...) within eps. A full block's points are spread over
    several tasks, its probes go to each: they are of thin cells, so no more than a few hundred. There is a full block for SHARE points at most."""
    block = [*key, "bx", "by"]
    points = _blocked(points).drop("cx", "cy")
    share = points.groupBy(*block).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    many = F.broadcast(share.where("shares > 1"))
    dealt = points.join(many, block, "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("x2", "y2"), F.col("shares")).cast("int"), F.lit(0))).drop("shares")
    asked = _around(probes).join(many, block, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return asked.join(dealt, [*block, "share"]).where(_within("x", "y", "x2", "y2", F.col("eps")))


def _within(x: str, y: str, x2: str, y2: str, r: Column) -> Column:
    dx, dy = F.col(x) - F.col(x2), F.col(y) - F.col(y2)
    return dx * dx + dy * dy <= r * r


def _touching(core: DataFrame, key: list[str]) -> DataFrame:
    """(a, b) of neighbouring cells that have core points within eps of each other.

    The cells' parts decide most pairs: by their corners they are near enough, or too far. Only where no two parts are surely near are
    the points of the doubtful parts compared.
    """
    q = F.col("eps") / (DIAGONAL * PARTS)
    parts = core.select(*key, "eps", "cx", "cy", F.floor(F.col("x") / q).alias("sx"), F.floor(F.col("y") / q).alias("sy")).distinct()
    a = _around(parts, 0)
    b = _blocked(parts).select(*key, "bx", "by", F.col("cx").alias("cx2"), F.col("cy").alias("cy2"), F.col("sx").alias("sx2"), F.col("sy").alias("sy2"))
    i, j = F.col("cx2") - F.col("cx"), F.col("cy2") - F.col("cy")
    later = ((i > 0) | ((i == 0) & (j > 0))) & (i <= 2) & j.between(-2, 2)
    dx, dy = F.abs(F.col("sx") - F.col("sx2")), F.abs(F.col("sy") - F.col("sy2"))
    length = lambda i, j: F.sqrt(i * i + j * j) * q
    zero = F.lit(0)
    near = length(dx + 1, dy + 1) <= F.col("eps") * (1 - 1e-9)
    far = length(F.greatest(dx - 1, zero), F.greatest(dy - 1, zero)) > F.col("eps") * (1 + 1e-9)
    cell = lambda x, y: F.struct(*key, F.col(x).alias("cx"), F.col(y).alias("cy"))
    both = a.join(b, [*key, "bx", "by"]).where(later & ~far).select(*key, "eps", cell("cx", "cy").alias("a"), cell("cx2", "cy2").alias("b"), "sx", "sy", "sx2", "sy2", near.alias("near"))
    both = written(both, "parts")
    sure = both.where("near").select("a", "b").distinct()
    open_ = both.join(sure, ["a", "b"], "left_anti")
    at = core.select(*key, F.floor(F.col("x") / q).alias("sx"), F.floor(F.col("y") / q).alias("sy"), "x", "y")
    other = at.select(*key, F.col("sx").alias("sx2"), F.col("sy").alias("sy2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    found = open_.join(at, [*key, "sx", "sy"]).join(other, [*key, "sx2", "sy2"]).where(_within("x", "y", "x2", "y2", F.col("eps")))
    return sure.union(found.select("a", "b").distinct())


def density_clusters(df: DataFrame, key: list[str], ident: str, x: str, y: str, eps: str, min_samples: int = 5, stray: float = 2.0) -> DataFrame:
    """(key, ident, seat) of each row of df, whose ident is unique in its key; eps is the same for all rows of a key.

    A point with min_samples points within eps (itself included) is a core; cores within eps of each other are one cluster, and
    other points within eps of a core join its cluster, that of the lowest number if there are several. Clusters of a key are
    numbered from 0 by the smallest ident of their cores. Points of no cluster take that of the nearest mean, if it is nearer than
    stray * eps, else seat is -1; so it is where x, y or eps is null or eps is not positive.

    Equal points count as one with a weight. A cell of the grid with min_samples points has cores only, so pairs are looked at from
    thin cells, of fewer points than that, and between the parts of neighbouring cells: work grows with the points, however dense.
    """
    side = F.col("eps") / DIAGONAL
    rows = df.select(*key, F.col(ident).alias("ident"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(eps).cast("double").alias("eps"))
    placed = rows.where(" AND ".join(["eps > 0", *[f"`{c}` IS NOT NULL" for c in ("x", "y", *key)]])).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    place = [*key, "x", "y"]
    spots = placed.groupBy(*place, "eps", "cx", "cy").agg(F.count("*").alias("n"), F.min("ident").alias("first"))
    full = spots.groupBy(*key, "cx", "cy").agg(F.sum("n").alias("total")).where(F.col("total") >= min_samples).select(*key, "cx", "cy", F.lit(True).alias("full"))
    spots = written(spots.join(full, [*key, "cx", "cy"], "left").withColumn("full", F.coalesce("full", F.lit(False))), "spots")
    second = lambda t, *more: t.select(*key, "cx", "cy", F.col("x").alias("x2"), F.col("y").alias("y2"), *more)
    thin = spots.where("NOT full")
    counted = _probe(thin, second(spots, F.col("n").alias("n2")), key).groupBy(thin.columns).agg(F.sum("n2").alias("around"))  # a point is around itself
    cored = counted.withColumn("core", F.col("around") >= min_samples).drop("around")
    spots = written(spots.where("full").withColumn("core", F.lit(True)).unionByName(cored), "cores")
    core = spots.where("core")
    cell = F.struct(*key, "cx", "cy")
    joined = components(core.select(cell.alias("node")).distinct(), _touching(core, key))
    labelled = core.withColumn("node", cell).join(joined, "node")
    order = labelled.groupBy(*key, "comp").agg(F.min("first").alias("begin"))
    order = order.withColumn("seat", (F.row_number().over(Window.partitionBy(*key).orderBy("begin")) - 1).cast("int"))
    labelled = written(labelled.join(order.select("comp", "seat"), "comp").select(*place, "eps", "cx", "cy", "n", "seat"), "labelled")
    rest = spots.where("NOT core")
    border = _probe(rest.select(*place, "eps", "cx", "cy"), second(labelled, F.col("seat").alias("near")), key).groupBy(*place).agg(F.min("near").alias("seat"))
    rest = written(rest.join(border, place, "left").select(*place, "eps", "n", "seat"), "rest")
    known = labelled.select(*place, "eps", "n", "seat").unionByName(rest.where("seat IS NOT NULL"))
    means = known.groupBy(*key, "seat").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("my"), F.first("eps").alias("reach"))
    wide = lambda c, r: F.floor(F.col(c) / (r * stray))
    means = means.withColumns({"gx": wide("mx", F.col("reach")), "gy": wide("my", F.col("reach"))}).drop("reach")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    means = means.withColumn("o", near).withColumns({"gx": F.col("gx") + F.col("o.i"), "gy": F.col("gy") + F.col("o.j")}).drop("o")  # means are fewer than points
    lone = rest.where("seat IS NULL").drop("seat").withColumns({"gx": wide("x", F.col("eps")), "gy": wide("y", F.col("eps"))})
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    taken = lone.join(means, [*key, "gx", "gy"]).withColumn("d", d).where(F.col("d") < F.col("eps") * stray).groupBy(*place).agg(F.min(F.struct("d", "seat")).alias("m"))
    seats = known.select(*place, "seat").unionByName(taken.select(*place, F.col("m.seat").alias("seat")))
    return rows.join(seats, place, "left").select(*key, F.col("ident").alias(ident), F.coalesce("seat", F.lit(-1)).alias("seat"))
