"""Detection data sets in the files they come in, as instances: one row a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_XML = "filename string, size struct<width: int, height: int>, object array<struct<name: string, difficult: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
_SIDES = "array<double>"
_CROWD = f"ID string, gtboxes array<struct<tag: string, fbox: {_SIDES}, hbox: {_SIDES}, vbox: {_SIDES}, extra: struct<ignore: int>>>"
_MOT = "frame int, track int, x double, y double, w double, h double, conf double, cls int, visibility double"
_OPEN = "ImageID string, Source string, LabelName string, Confidence double, XMin double, XMax double, YMin double, YMax double, IsOccluded int, IsTruncated int, IsGroupOf int, IsDepiction int, IsInside int"


def corners(box: Column) -> Column:
    """[x1, y1, x2, y2] of [x, y, w, h]."""
    return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])


def xml_instances(spark: SparkSession, path: str, classes: list[str], least_side: float | None = None) -> DataFrame:
    """(image, width, height, cls, box, ignore) of XML annotations; the image goes by its file name, or else by that of the XML file. A file may
    hold several annotations.

    Corners are whole and count from 1 in the files, from 0 here. Objects of other classes go. Difficult ones, and those with a side under least_side,
    are to be ignored. An image without objects of the classes has no row.
    """
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(_XML).load(path)
    stem = lambda c: F.nullif(F.regexp_extract(F.element_at(F.split(c, "/"), -1), r"^(.*)\.[^.]*$", 1), F.lit(""))
    each = rows.select(F.coalesce(stem("filename"), stem("_metadata.file_path")).alias("image"), "size.width", "size.height", F.explode("object").alias("o"))
    side = lambda c: F.col(f"o.bndbox.{c}").cast("int") - 1
    box = F.array(*[side(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")])
    small = (side("xmax") - side("xmin") < least_side) | (side("ymax") - side("ymin") < least_side) if least_side is not None else F.lit(False)
    return each.where(F.col("o.name").isin(classes)).select("image", "width", "height", F.col("o.name").alias("cls"), box.alias("box"), (F.coalesce(F.col("o.difficult") != 0, F.lit(False)) | small).alias("ignore"))


def crowd_instances(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """(image, cls, box, head, visible, ignore) of JSON lines of people with full, head and visible boxes [x, y, w, h]; other tags than classes (person) and
    those marked so are to be ignored, with a null class. Nothing is left out."""
    each = spark.read.schema(_CROWD).json(path).select(F.col("ID").alias("image"), F.explode("gtboxes").alias("g"))
    away = ~F.col("g.tag").isin(classes or ["person"]) | F.coalesce(F.col("g.extra.ignore") != 0, F.lit(False))
    away = F.coalesce(away, F.lit(True))
    return each.select("image", F.when(~away, F.col("g.tag")).alias("cls"), *[corners(F.col(f"g.{c}")).alias(n) for c, n in (("fbox", "box"), ("hbox", "head"), ("vbox", "visible"))], away.alias("ignore"))


def track_instances(spark: SparkSession, path: str, width: int, height: int, classes: list[int] | None = None, least_visible: float = -1.0) -> DataFrame:
    """(video, frame, track, cls, box, conf, visibility) of headless comma-separated tracks, `<video>/gt/gt.txt` or several files there; boxes outside the frame, with a side under
    1, of other classes, or seen by less than least_visible go."""
    rows = spark.read.schema(_MOT).csv(path).withColumn("video", F.element_at(F.split("_metadata.file_path", "/"), -3))
    x, y, w, h = (F.col(c) for c in "xywh")
    inside = F.greatest(F.lit(0.0), F.least(x + w, F.lit(float(width))) - F.greatest(x, F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(y + h, F.lit(float(height))) - F.greatest(y, F.lit(0.0)))
    kept = rows.where((inside > 0) & (w >= 1) & (h >= 1) & (F.col("visibility") >= least_visible))
    kept = kept if classes is None else kept.where(F.col("cls").isin(classes))
    return kept.select("video", "frame", "track", "cls", F.array(x, y, x + w, y + h).alias("box"), "conf", "visibility")


def open_instances(spark: SparkSession, path: str, sizes: DataFrame, names: DataFrame) -> DataFrame:
    """(image, cls, box, is_occluded, is_truncated, is_group, is_depiction, is_inside) of a table of boxes as shares of their image, with sizes(image, width, height)
    and names(label, cls); a label without a name, or an image without a size, is an error."""
    rows = spark.read.schema(_OPEN).csv(path, header=True)
    # a row for each label: joined by label, all boxes would come to a few tasks
    both = rows.join(F.broadcast(names.withColumnRenamed("label", "LabelName")), "LabelName", "left").join(sizes.withColumnRenamed("image", "ImageID"), "ImageID", "left")
    known = F.when(F.col("cls").isNotNull() & F.col("width").isNotNull(), F.col("cls")).otherwise(F.raise_error(F.concat(F.lit("unknown label or image: "), "LabelName", F.lit(" "), "ImageID")).cast(dict(names.dtypes)["cls"]))
    box = F.array(F.col("XMin") * F.col("width"), F.col("YMin") * F.col("height"), F.col("XMax") * F.col("width"), F.col("YMax") * F.col("height"))
    marks = {"IsOccluded": "is_occluded", "IsTruncated": "is_truncated", "IsGroupOf": "is_group", "IsDepiction": "is_depiction", "IsInside": "is_inside"}
    return both.select(F.col("ImageID").alias("image"), known.alias("cls"), box.alias("box"), *[(F.col(c) == 1).alias(n) for c, n in marks.items()])
