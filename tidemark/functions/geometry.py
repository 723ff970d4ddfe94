"""Boxes as (x1, y1, x2, y2) columns; one function for each convention of the denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str) -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union; eps is added to the union. An empty union gives 0."""
    i = intersection(a, b)
    u = area(a) + area(b) - i + F.lit(eps)
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def iof(a: Box, b: Box) -> Column:
    """Intersection over the first box's area, at least 1e-6."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1e-6))


def giou(a: Box, b: Box) -> Column:
    """IoU less the share of the common hull that the union leaves free; denominators are at least 1e-6."""
    i = intersection(a, b)
    u = F.greatest(area(a) + area(b) - i, F.lit(1e-6))
    hull = F.greatest((F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1])), F.lit(1e-6))
    return i / u - (hull - u) / hull


def iou_closed(a: Box, b: Box) -> Column:
    """IoU where both edges belong to the box (sides are one longer)."""
    side = lambda lo, hi: hi - lo + 1
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1, F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1, F.lit(0))
    i = w * h
    return i / (side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - i)


def to_cxcywh(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def from_xywh(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def clip(b: Box, width: Column, height: Column) -> Box:
    inside = lambda v, hi: F.least(F.greatest(v, F.lit(0)), hi)
    return inside(b[0], width), inside(b[1], height), inside(b[2], width), inside(b[3], height)


def contains_centre(outer: Box, inner: Box) -> Column:
    cx, cy, _, _ = to_cxcywh(inner)
    return cx.between(outer[0], outer[2]) & cy.between(outer[1], outer[3])


def int_box(b: Box) -> Box:
    return tuple(v.cast("int") for v in b)


def clip_inside(b: Box, width: int, height: int) -> Box:
    """Whole corners inside the frame (the last pixel is width - 1)."""
    inside = lambda v, hi: F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(hi - 1)))
    return inside(b[0], width), inside(b[1], height), inside(b[2], width), inside(b[3], height)


def is_degenerate(b: Box) -> Column:
    return (b[2] <= b[0]) | (b[3] <= b[1])


def padded(b: Box, width: int, height: int, pad: float) -> Box:
    """Whole corners of the box widened by a share of its sides on each side, inside the frame."""
    px, py = (b[2] - b[0]) * pad, (b[3] - b[1]) * pad
    low = lambda v: F.greatest(v, F.lit(0)).cast("int")
    return low(b[0] - px), low(b[1] - py), F.least(b[2] + px, F.lit(width)).cast("int"), F.least(b[3] + py, F.lit(height)).cast("int")


#: share of a person's box, from above, that a crop shows
CROP_SHARE = {"person": 1.0, "upper_body": 0.65}


def crop_box(b: Box, width: int, height: int, mode: str = "head_wide", head: float = 0.3, margin: float = 0.25) -> Box:
    """A person's box cut to its upper part by mode, with a margin (a fifth more above), whole corners inside the frame."""
    bottom = b[1] + CROP_SHARE.get(mode, head) * (b[3] - b[1])
    px, py = (b[2] - b[0]) * margin, (bottom - b[1]) * margin
    low = lambda v: F.greatest(v.cast("int"), F.lit(0))
    return low(b[0] - px), low(b[1] - py * 1.2), F.least((b[2] + px).cast("int"), F.lit(width)), F.least((bottom + py).cast("int"), F.lit(height))


def keypoint_box(points: Column, person: Box, width: int, height: int, confidence: float, head: list[int], shoulders: list[int], margin: float = 0.25, down: float = 1.5) -> Column:
    """struct(x1, y1, x2, y2, head_kpts, head_span) around the sure ones of an array of points struct(x, y, c): the head's points and,
    for context, the shoulders', widened aside and above, and down, but not below the person's box. Null without a head point."""
    point = lambda i: F.get(points, F.lit(i))
    sure = lambda i: point(i)["c"] >= confidence
    # least and greatest pass over nulls
    ends = lambda f, c: f(F.lit(None), F.lit(None), *[F.when(sure(i), point(i)[c]) for i in (*head, *shoulders)])
    n_own = sum((F.when(sure(i), 1).otherwise(0) for i in head), F.lit(0))
    low = lambda v: F.greatest(v.cast("int"), F.lit(0))
    high = lambda v, most: F.least(v.cast("int"), F.lit(most))

    def found(m: Column) -> Column:
        x1, x2, y1, y2 = (m[c] for c in ("x1", "x2", "y1", "y2"))
        span = F.greatest(x2 - x1, y2 - y1)
        unit = F.greatest(y2 - y1, span)
        aside = (x2 - x1 + 1) * margin
        bottom = F.least(y2 + unit * down, m["bottom"])
        told = F.struct(low(x1 - aside).alias("x1"), low(y1 - unit * margin * 1.6).alias("y1"), high(x2 + aside, width).alias("x2"), high(bottom, height).alias("y2"), m["n"].alias("head_kpts"), span.alias("head_span"))
        return F.when(m["n"] > 0, told)

    # the ends are found once for all that is made of them
    known = F.struct(ends(F.least, "x").alias("x1"), ends(F.greatest, "x").alias("x2"), ends(F.least, "y").alias("y1"), ends(F.greatest, "y").alias("y2"), n_own.alias("n"), person[3].alias("bottom"))
    return F.get(F.transform(F.array(known), found), F.lit(0))


def box_features(b: Box, width: int, height: int) -> dict[str, Column]:
    """Centre, area and edges as shares of the frame, and the aspect ratio; sides are one pixel at least."""
    w, h = F.greatest(b[2] - b[0], F.lit(1)), F.greatest(b[3] - b[1], F.lit(1))
    return {
        "cx": (b[0] + b[2]) / 2 / width, "cy": (b[1] + b[3]) / 2 / height, "area": w * h / F.lit(float(width * height)), "aspect": w / h,
        "left": b[0] / width, "right": b[2] / width, "top": b[1] / height, "bottom": b[3] / height,
    }


def head_box(b: Box, width: int, height: int, share: float = 0.3) -> Box:
    """A square at the top of a person's box, in its middle, rounded, inside the frame."""
    side = F.greatest(share * F.greatest(b[3] - b[1], F.lit(1)), F.lit(8.0))
    cx, cy = b[0] + F.greatest(b[2] - b[0], F.lit(1)) / 2, b[1] + side / 2
    low = lambda v: F.bround(F.greatest(v, F.lit(0.0))).cast("int")
    high = lambda v, most: F.bround(F.least(v, F.lit(float(most)))).cast("int")
    return low(cx - side / 2), low(cy - side / 2), high(cx + side / 2, width), high(cy + side / 2, height)


def plausible(b: Box, width: int, height: int, area_from: float, area_to: float, aspect_from: float, aspect_to: float) -> Column:
    """The box's share of the frame and its aspect ratio are within bounds; sides are one pixel at least."""
    f = box_features(b, width, height)
    return f["area"].between(area_from, area_to) & f["aspect"].between(aspect_from, aspect_to)


def flipped(b: Box, width: Column) -> Box:
    return width - b[2], b[1], width - b[0], b[3]


def scaled(b: Box, fx: Column, fy: Column) -> Box:
    return b[0] * fx, b[1] * fy, b[2] * fx, b[3] * fy


def distances(x: Column, y: Column, b: Box) -> Box:
    """From a point to the left, top, right and bottom edge."""
    return x - b[0], y - b[1], b[2] - x, b[3] - y
