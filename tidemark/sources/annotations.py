"""Nested annotation files: grounding lines, detection dictionaries, cue logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cues import keyword_label
from ..functions.geometry import Box

#: schema of one line of grounding data
GROUNDING = "filename string, height int, width int, grounding struct<caption: string, regions: array<struct<bbox: array<double>, phrase: string, tokens_positive: array<array<int>>>>>, detection struct<instances: array<struct<bbox: array<double>, label: int>>>"
#: schema of one moment of a cue log
CUE_LOG = "t double, dt double, cue_names array<string>, students map<string, struct<cue: string, conf: double, bbox: array<double>, dwell: double, alerted: boolean, alert_allowed: boolean>>"


def usable(b: Box, width: Column, height: Column) -> Column:
    """The box shares an area with the frame and is one pixel wide and high at least."""
    inside = lambda lo, hi, most: F.least(hi, most) > F.greatest(lo, F.lit(0))
    return inside(b[0], b[2], width) & inside(b[1], b[3], height) & (b[2] - b[0] >= 1) & (b[3] - b[1] >= 1)


def _corners(c: str) -> Box:
    return tuple(F.get(c, F.lit(i)) for i in range(4))


def grounding_regions(lines: DataFrame, text: str) -> DataFrame:
    """(filename, caption, label, phrase, x1, y1, x2, y2, span_from, span_to) of each usable region of JSON lines; label is the region's
    place in its line. Lines that are no such record have none."""
    rec = lines.select(F.from_json(text, GROUNDING).alias("r")).select("r.*")
    each = rec.select("filename", "height", "width", F.col("grounding.caption").alias("caption"), F.posexplode("grounding.regions").alias("label", "g"))
    flat = each.select("filename", "height", "width", "caption", "label", F.col("g.phrase").alias("phrase"), F.col("g.bbox").alias("b"), F.get(F.get("g.tokens_positive", F.lit(0)), F.lit(0)).alias("span_from"), F.get(F.get("g.tokens_positive", F.lit(0)), F.lit(1)).alias("span_to"))
    b = _corners("b")
    return flat.where(usable(b, F.col("width"), F.col("height"))).select("filename", "caption", "label", "phrase", *[v.alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)], "span_from", "span_to")


def detection_instances(lines: DataFrame, text: str) -> DataFrame:
    """(filename, label, x1, y1, x2, y2) of each usable instance of JSON lines."""
    rec = lines.select(F.from_json(text, GROUNDING).alias("r")).select("r.*")
    each = rec.select("filename", "height", "width", F.inline("detection.instances"))
    b = _corners("bbox")
    return each.where(usable(b, F.col("width"), F.col("height"))).select("filename", "label", *[v.alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


def dictionary_instances(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_id, label, ignored, x1, y1, x2, y2) of images(image_id, width, height), annotations(image_id, category_id, x, y, w, h, area,
    ignore, iscrowd) and categories(category_id, label): corners for corner and size; unknown categories, ignored, empty and
    unusable boxes go, crowds are marked."""
    both = annotations.where("NOT coalesce(ignore, false) AND area > 0").join(images, "image_id").join(categories, "category_id")
    b = (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    return both.where(usable(b, F.col("width"), F.col("height"))).select("image_id", "label", F.coalesce("iscrowd", F.lit(False)).alias("ignored"), *[v.alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


def with_annotations(images: DataFrame, instances: DataFrame, key: str, least_side: int) -> DataFrame:
    """images(key, width, height) that have an instance and are large enough."""
    big = images.where(F.least("width", "height") >= least_side)
    return big.join(instances.select(key).distinct(), key, "left_semi")


def cue_log_rows(log: DataFrame) -> DataFrame:
    """(t, student, cue, conf, dwell, alerted, alert_allowed) of each student at each moment of a log with the schema CUE_LOG; a log
    without alert_allowed allows alerts."""
    each = log.select("t", F.explode("students").alias("student", "s"))
    return each.select("t", "student", "s.cue", "s.conf", "s.dwell", F.coalesce("s.alerted", F.lit(False)).alias("alerted"), F.coalesce("s.alert_allowed", F.lit(True)).alias("alert_allowed"))


def weak_regions(lines: DataFrame, text: Column, words: dict[str, list[str]]) -> DataFrame:
    """(file, video, frame, box, label) of the regions of JSON records {filename, grounding: {regions: [{bbox, phrase}]}}: each is labelled by the
    keywords in its own phrase. Regions without four sides or without a keyword go, and so do records that are no JSON.

    Of a name like t000012_500_f000375_video_3.jpg the frame is 375 and the video what follows it; names of another form have none.
    """
    kind = "filename string, grounding struct<regions array<struct<bbox array<double>, phrase string>>>"
    each = lines.select(F.from_json(text, kind).alias("r")).select(F.col("r.filename").alias("file"), F.explode("r.grounding.regions").alias("x"))
    label = keyword_label(F.coalesce("x.phrase", F.lit("")), words)
    whole = (F.size("x.bbox") == 4) & ~F.exists("x.bbox", lambda v: v.isNull())
    found = each.where(F.coalesce(whole, F.lit(False))).withColumn("label", label).where("label IS NOT NULL")
    part = lambda i: F.nullif(F.regexp_extract("file", r"_f(\d+)(?:_([^.]+))?\.", i), F.lit(""))
    return found.select("file", part(2).alias("video"), part(1).cast("int").alias("frame"), F.col("x.bbox").alias("box"), "label")
