"""Queries on boxes: crops, filters, detection and retrieval scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection, timeline
from .base import query, rounded, table
from .queries import _PAIRS, _boxes, _sql_boxes

_W, _H = 90, 80
_A = f"a AS ({_sql_boxes('a', 0)})"
_cut = "trunc"


def _a(spark, d):
    return _boxes(spark, d, "a", 0)


def _named(b: G.Box, p: str) -> list:
    return [v.cast("long").alias(f"{p}{c}") for v, c in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]


@query(f"WITH {_A}, c AS (SELECT aid, greatest(0, least(ax1 - 5, {_W - 1})) AS x1, greatest(0, least(ay1, {_H - 1})) AS y1, greatest(0, least(ax2 - 5, {_W - 1})) AS x2, greatest(0, least(ay2 + 30, {_H - 1})) AS y2 FROM (SELECT aid, ax1, ay1 + 30 AS ay1, ax2, ay2 FROM a)) SELECT aid, x1, y1, x2, y2 FROM c WHERE x2 > x1 AND y2 > y1")
def clipped_boxes(spark, d):
    """Boxes inside the frame with their ids; those without area go."""
    b = G.box("a")
    moved = (b[0] - 5, b[1] + 30, b[2] - 5, b[3] + 30)
    c = G.clip_inside(moved, _W, _H)
    return _a(spark, d).where(~G.is_degenerate(c)).select("aid", *_named(c, ""))


@query(f"""WITH {_A}, p AS (SELECT aid, (ax2 - ax1) * 0.1 AS px, (ay2 - ay1) * 0.1 AS py, ax1, ay1, ax2, ay2 FROM a)
SELECT aid, CAST(trunc(greatest(ax1 - px, 0)) AS BIGINT) AS px1, CAST(trunc(greatest(ay1 - py, 0)) AS BIGINT) AS py1, CAST(trunc(least(ax2 + px, {_W})) AS BIGINT) AS px2, CAST(trunc(least(ay2 + py, {_H})) AS BIGINT) AS py2,
  greatest(CAST(trunc(ax1 - (ax2 - ax1) * 0.25) AS BIGINT), 0) AS hx1, greatest(CAST(trunc(ay1 - 0.3 * (ay2 - ay1) * 0.25 * 1.2) AS BIGINT), 0) AS hy1, least(CAST(trunc(ax2 + (ax2 - ax1) * 0.25) AS BIGINT), {_W}) AS hx2, least(CAST(trunc(ay1 + 0.3 * (ay2 - ay1) + 0.3 * (ay2 - ay1) * 0.25) AS BIGINT), {_H}) AS hy2 FROM p""")
def crop_boxes(spark, d):
    """Padded boxes, and wide crops of the head."""
    b = G.box("a")
    return _a(spark, d).select("aid", *_named(G.padded(b, _W, _H, 0.1), "p"), *_named(G.crop_box(b, _W, _H), "h"))


@query(f"""WITH {_A}, f AS (SELECT *, (ax2 - ax1) * (ay2 - ay1) / {float(_W * _H)} AS area, (ax2 - ax1) / CAST(ay2 - ay1 AS DOUBLE) AS aspect FROM a)
SELECT acls, count(*) AS n, round(avg((ax1 + ax2) / 2.0 / {_W}), 6) AS cx, round(avg(area), 6) AS area, round(avg(aspect), 6) AS aspect, round(avg(ay2 / {float(_H)}), 6) AS bottom FROM f WHERE ascore >= 0.3 AND area BETWEEN 0.1 AND 0.3 AND aspect BETWEEN 0.5 AND 1.8 AND acls IN ('A', 'N') GROUP BY 1""")
def plausible_boxes(spark, d):
    """Boxes left by score, area, aspect and a list of classes, and their mean features."""
    b = G.box("a")
    f = G.box_features(b, _W, _H)
    kept = _a(spark, d).where((F.col("ascore") >= 0.3) & G.plausible(b, _W, _H, 0.1, 0.3, 0.5, 1.8) & F.col("acls").isin("A", "N"))
    return kept.groupBy("acls").agg(F.count("*").alias("n"), *[F.round(F.avg(f[c]), 6).alias(c) for c in ("cx", "area", "aspect", "bottom")])


@query(f"""WITH {_A}, s AS (SELECT *, greatest(0.3 * (ay2 - ay1), 8.0) AS side FROM a), h AS (SELECT aid, round_even(greatest(ax1 + (ax2 - ax1) / 2.0 - side / 2, 0), 0) AS x1, round_even(greatest(CAST(ay1 AS DOUBLE), 0), 0) AS y1, round_even(least(ax1 + (ax2 - ax1) / 2.0 + side / 2, {_W}), 0) AS x2, round_even(least(ay1 + side, {_H}), 0) AS y2 FROM s)
SELECT aid, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM h""")
def head_boxes(spark, d):
    return _a(spark, d).select("aid", *_named(G.head_box(G.box("a"), _W, _H), ""))


@query(f"WITH {_A} SELECT aid, {_W} - ax2 AS fx1, ay1 AS fy1, {_W} - ax1 AS fx2, ay2 AS fy2, CAST(trunc(ax1 * 0.3) AS BIGINT) AS sx1, CAST(trunc(ay1 * 1.7) AS BIGINT) AS sy1, CAST(trunc(ax2 * 0.3) AS BIGINT) AS sx2, CAST(trunc(ay2 * 1.7) AS BIGINT) AS sy2, ax1 AS wx1, ay1 AS wy1, ax1 + (ax2 - ax1) // 2 AS wx2, ay1 + ay2 - ay1 AS wy2 FROM a")
def box_forms(spark, d):
    """Boxes mirrored, scaled to whole numbers, and made from a corner and half the width."""
    b = G.box("a")
    half = G.from_xywh((b[0], b[1], F.floor((b[2] - b[0]) / 2), b[3] - b[1]))
    return _a(spark, d).select("aid", *_named(G.flipped(b, F.lit(_W)), "f"), *_named(G.int_box(G.scaled(b, F.lit(0.3), F.lit(1.7))), "s"), *_named(half, "w"))


_PTS = "[{'x': ax1 + 2, 'y': ay1 + 3, 'c': ascore}, {'x': ax1 + 8, 'y': ay1 + 2, 'c': 1 - ascore}, {'x': ax2 - 3, 'y': ay1 + 9, 'c': 0.5}]"


@query(f"""WITH {_A}, p AS (SELECT *, list_filter([{_PTS[1:-1].split('}, ')[0]}}}, {_PTS[1:-1].split('}, ')[1]}}}], lambda q: q.c >= 0.4) AS own, list_filter([{_PTS[1:-1].split('}, ')[2]}], lambda q: q.c >= 0.4) AS sh FROM a), e AS (SELECT *, list_concat(own, sh) AS ev FROM p WHERE len(own) > 0
), m AS (SELECT *, list_min([q.x FOR q IN ev]) AS x1, list_max([q.x FOR q IN ev]) AS x2, list_min([q.y FOR q IN ev]) AS y1, list_max([q.y FOR q IN ev]) AS y2 FROM e), u AS (SELECT *, greatest(x2 - x1, y2 - y1) AS span FROM m)
SELECT aid, greatest(CAST(trunc(x1 - (x2 - x1 + 1) * 0.25) AS BIGINT), 0) AS x1, greatest(CAST(trunc(y1 - greatest(y2 - y1, span) * 0.25 * 1.6) AS BIGINT), 0) AS y1, least(CAST(trunc(x2 + (x2 - x1 + 1) * 0.25) AS BIGINT), {_W}) AS x2, least(CAST(trunc(least(y2 + greatest(y2 - y1, span) * 1.5, ay2)) AS BIGINT), {_H}) AS y2, len(own) AS head_kpts, span AS head_span FROM u""")
def keypoint_boxes(spark, d):
    """Crops around the sure points of a head and a shoulder; none without a head point."""
    x1, y1, x2, _ = G.box("a")
    point = lambda x, y, c: F.struct(x.alias("x"), y.alias("y"), c.alias("c"))
    pts = F.array(point(x1 + 2, y1 + 3, F.col("ascore")), point(x1 + 8, y1 + 2, 1 - F.col("ascore")), point(x2 - 3, y1 + 9, F.lit(0.5)))
    k = G.keypoint_box(pts, G.box("a"), _W, _H, 0.4, [0, 1], [2])
    out = _a(spark, d).select("aid", k.alias("k")).where("k IS NOT NULL").select("aid", "k.*")
    return out.select("aid", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2", "head_kpts", "head_span")])


_IOU = "i / CAST(sa + sb - i AS DOUBLE)"


@query(f"""WITH {_PAIRS}, t AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS th), o AS (SELECT th, frame, bid, bscore, list({{'g': aid, 'o': {_IOU}}} ORDER BY {_IOU} DESC, aid DESC) AS c FROM ab, t WHERE {_IOU} >= 0.5 AND bscore >= th GROUP BY 1, 2, 3, 4
), f AS (SELECT th, frame, list_reduce(list([{{'c': c, 'u': CAST(-1 AS BIGINT)}}] ORDER BY bscore DESC, bid), lambda acc, x: list_append(acc, {{'c': x[1].c, 'u': coalesce((list_filter(x[1].c, lambda q: NOT list_contains(list_transform(acc, lambda a: a.u), q.g))[1]).g, -1)}}), [{{'c': CAST([] AS STRUCT(g BIGINT, o DOUBLE)[]), 'u': CAST(-1 AS BIGINT)}}]) AS r FROM o GROUP BY 1, 2
), tp AS (SELECT th, CAST(sum(len(list_filter(r, lambda a: a.u >= 0))) AS BIGINT) AS tp FROM f GROUP BY 1), n AS (SELECT th, (SELECT count(*) FROM b WHERE bscore >= th) AS called, (SELECT count(*) FROM a) AS n FROM t
), s AS (SELECT th AS threshold, tp, called - tp AS fp, n - tp AS fn, tp / called AS precision, tp / n AS recall FROM tp JOIN n USING (th)), z AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM s)
SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, threshold = (SELECT threshold FROM z ORDER BY f1 DESC, threshold LIMIT 1) AS best FROM z""")
def threshold_sweep(spark, d):
    dets = _boxes(spark, d, "b", 9).withColumnsRenamed({"bid": "det", "bscore": "score"})
    truth = _a(spark, d).withColumnRenamed("aid", "gt")
    return rounded(detection.threshold_sweep(dets, truth, ["frame"], G.box("b"), G.box("a"), [0.2, 0.5, 0.8]), "precision", "recall", "f1")


@query(f"""WITH {_PAIRS}, r AS (SELECT bid, frame, row_number() OVER (PARTITION BY frame ORDER BY bscore DESC, bid) AS rk FROM b), k AS (SELECT unnest([1, 2, 5]) AS k), h AS (SELECT k, count(DISTINCT (ab.frame, aid)) AS hits FROM ab JOIN r ON r.frame = ab.frame AND r.bid = ab.bid, k WHERE {_IOU} >= 0.5 AND rk <= k GROUP BY 1)
SELECT k, round(coalesce(hits, 0) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) AS recall FROM k LEFT JOIN h USING (k)""")
def recall_at_k(spark, d):
    dets = _boxes(spark, d, "b", 9).withColumnsRenamed({"bid": "det", "bscore": "score"})
    truth = _a(spark, d).withColumnRenamed("aid", "gt")
    return rounded(detection.recall_at_k(dets, truth, ["frame"], G.box("b"), G.box("a"), [1, 2, 5], 0.5), "recall")


@query(f"""WITH {_PAIRS}, r AS (SELECT bid, frame, row_number() OVER (PARTITION BY frame ORDER BY bscore DESC, bid) AS rk FROM b), n AS (SELECT unnest([1, 3]) AS number), p AS (SELECT number, ab.frame, list([{{'g': aid, 'p': rk, 'o': {_IOU}}}] ORDER BY {_IOU} DESC, aid, rk) AS c FROM ab JOIN r ON r.frame = ab.frame AND r.bid = ab.bid, n WHERE rk <= number AND i > 0 GROUP BY 1, 2
), m AS (SELECT number, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.g = x[1].g OR a.p = x[1].p)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m FROM p), t AS (SELECT unnest([0.3, 0.6]::DOUBLE[]) AS threshold)
SELECT number, threshold, round((SELECT count(*) FROM m WHERE m.number = n.number AND m.m.o >= threshold) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) AS recall FROM n, t""")
def proposal_recall(spark, d):
    dets = timeline.best_rows(_boxes(spark, d, "b", 9), ["frame"], [F.desc("bscore"), F.asc("bid")], 3)
    pairs = dets.join(_a(spark, d), "frame").select("frame", "aid", "rank", G.iou(G.box("a"), G.box("b")).alias("iou")).where("iou > 0")
    return rounded(detection.proposal_recall(pairs, _a(spark, d), "frame", "aid", "rank", "iou", [1, 3], [0.3, 0.6]), "recall")


def _map_sql(th: float, name: str, lo: float, hi: float) -> str:
    return f"""(WITH best AS (SELECT frame, bcls AS cls, bid AS det, bscore AS score, aid AS gt, {_IOU} AS o, sa < {lo} OR sa >= {hi} AS out FROM ab WHERE acls = bcls QUALIFY row_number() OVER (PARTITION BY frame, bcls, bid ORDER BY {_IOU} DESC, aid) = 1
  ), k AS (SELECT *, row_number() OVER (PARTITION BY frame, cls, gt ORDER BY score DESC, det) = 1 AS first FROM best WHERE o >= {th}
  ), m AS (SELECT b.frame, b.bcls AS cls, b.bid AS det, b.bscore AS score, coalesce(k.first AND NOT k.out, false) AS tp, coalesce(k.out, (bx2 - bx1) * (by2 - by1) < {lo} OR (bx2 - bx1) * (by2 - by1) >= {hi}) AS ign FROM b LEFT JOIN k ON k.frame = b.frame AND k.cls = b.bcls AND k.det = b.bid
  ), r AS (SELECT *, sum(CAST(tp AS INT)) OVER w AS tps, row_number() OVER w AS rk FROM m WHERE NOT ign WINDOW w AS (PARTITION BY cls ORDER BY score DESC, frame, det)
  ), e AS (SELECT cls, tp, max(tps / rk) OVER (PARTITION BY cls ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r
  ), n AS (SELECT acls AS cls, count(*) AS n_gt FROM a WHERE (ax2 - ax1) * (ay2 - ay1) >= {lo} AND (ax2 - ax1) * (ay2 - ay1) < {hi} GROUP BY 1), s AS (SELECT cls, sum(env) FILTER (tp) AS s FROM e GROUP BY 1)
  SELECT CAST({th} AS DOUBLE) AS threshold, '{name}' AS range, cls, n_gt, coalesce(s / n_gt, 0) AS ap FROM n LEFT JOIN s USING (cls))"""


_RANGES = {"small": (0.0, 1600.0), "large": (1600.0, 1e9)}


@query(f"WITH {_PAIRS}, x AS ({' UNION ALL '.join(_map_sql(t, n, *r) for n, r in _RANGES.items() for t in (0.5, 0.7))}) SELECT threshold, range, cls, n_gt, round(ap, 6) AS ap FROM x UNION ALL SELECT threshold, range, NULL, CAST(sum(n_gt) AS BIGINT), round(avg(ap), 6) FROM x GROUP BY 1, 2")
def mean_ap(spark, d):
    """Average precision at two overlaps and two ranges of area, by class and over the classes."""
    dets = _boxes(spark, d, "b", 9).withColumnsRenamed({"bid": "det", "bscore": "score", "bcls": "cls"})
    truth = _a(spark, d).withColumnsRenamed({"aid": "gt", "acls": "cls"}).drop("ascore")
    return rounded(detection.mean_ap(dets, truth, "frame", "cls", G.box("b"), G.box("a"), [0.5, 0.7], _RANGES), "ap")


@query(f"""WITH {_PAIRS}, best AS (SELECT frame, bcls AS cls, bid AS det, bscore AS score, aid AS gt, {_IOU} AS o FROM ab WHERE acls = bcls QUALIFY row_number() OVER (PARTITION BY frame, bcls, bid ORDER BY {_IOU} DESC, aid) = 1
), f AS (SELECT frame, cls, det FROM best WHERE o >= 0.5 QUALIFY row_number() OVER (PARTITION BY frame, cls, gt ORDER BY score DESC, det) = 1), m AS (SELECT b.frame, b.bcls AS cls, b.bid AS det, b.bscore AS score, f.det IS NOT NULL AS tp FROM b LEFT JOIN f ON f.frame = b.frame AND f.cls = b.bcls AND f.det = b.bid
), r AS (SELECT *, sum(CAST(tp AS INT)) OVER w AS tps, row_number() OVER w AS rk FROM m WINDOW w AS (PARTITION BY cls ORDER BY score DESC, frame, det)), n AS (SELECT acls AS cls, count(*) AS n FROM a GROUP BY 1), q AS (SELECT n.cls, i, (SELECT max(tps / rk) FROM r WHERE r.cls = n.cls AND tps * 10 >= i * n) AS h FROM n, (SELECT unnest(range(11)) AS i))
SELECT cls, round(sum(coalesce(h, 0)) / 11, 6) AS ap FROM q GROUP BY 1""")
def eleven_point_ap(spark, d):
    from .queries import _marked

    truths = _a(spark, d).groupBy(F.col("acls").alias("cls")).agg(F.count("*").alias("n_gt"))
    return rounded(detection.detection_ap(_marked(spark, d).withColumn("key_order", F.col("frame")), ["cls"], truths, 11), "ap")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT q.vec_id AS q, g.vec_id AS g, round(list_sum(list_transform(range(1, 65), lambda i: power(CAST(q.embedding[i] - g.embedding[i] AS DOUBLE), 2))), 9) AS d, CAST(q.label = g.label AS INT) AS hit FROM q JOIN embeddings g ON q.vec_id <> g.vec_id
), r AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER w AS tp FROM x WINDOW w AS (PARTITION BY q ORDER BY d, g)), e AS (SELECT q, sum(hit) AS rel, sum(tp / rank) FILTER (hit = 1) AS s, min(rank) FILTER (hit = 1) AS first FROM r GROUP BY 1 HAVING sum(hit) > 0)
SELECT count(*) AS n, round(avg(s / rel), 4) AS mean_ap, round(avg(CAST(first <= 1 AS INT)), 6) AS cmc_1, round(avg(CAST(first <= 5 AS INT)), 6) AS cmc_5 FROM e""")
def retrieval_scores(spark, d):
    """Mean average precision and first ranks of every fiftieth vector against all others."""
    e = table(spark, d, "embeddings")
    out = detection.retrieval(e.where("vec_id % 50 = 0"), e, "label", "vec_id", "embedding", [1, 5])
    return rounded(rounded(out, "mean_ap", digits=4), "cmc_1", "cmc_5")


#: overlaps of segments: parts stand for images, suppliers for true segments, quantities for predicted ones; some are void
_PIX = "px AS (SELECT l_partkey % 50 AS image, l_suppkey % 4 AS gt, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 % 2 END AS gt_cls, l_suppkey % 4 = 3 AND l_partkey % 50 < 10 AS crowd, CASE WHEN l_linenumber > 2 THEN l_suppkey % 4 ELSE CAST(l_quantity AS BIGINT) % 4 END AS pred FROM lineitem), pc AS (SELECT *, CASE WHEN pred > 0 THEN pred % 2 END AS pred_cls, count(*) AS n FROM px GROUP BY ALL)"


@query(f"""WITH {_PIX}, g AS (SELECT image, gt, gt_cls, crowd, sum(n) AS ga FROM pc WHERE gt > 0 GROUP BY ALL), p AS (SELECT image, pred, pred_cls, sum(n) AS pa, coalesce(sum(n) FILTER (gt = 0), 0) AS e, coalesce(sum(n) FILTER (crowd AND gt_cls = pred_cls), 0) AS c FROM pc WHERE pred > 0 GROUP BY ALL
), b AS (SELECT image, gt, gt_cls, pred, sum(n) AS i FROM pc WHERE gt > 0 AND pred > 0 AND gt_cls = pred_cls AND NOT crowd GROUP BY ALL), m AS (SELECT b.*, i / (ga + pa - i - e) AS iou FROM b JOIN g USING (image, gt) JOIN p USING (image, pred) WHERE i / (ga + pa - i - e) > 0.5
), s AS (SELECT cls, (SELECT count(*) FROM m WHERE gt_cls = cls) AS tp, coalesce((SELECT sum(iou) FROM m WHERE gt_cls = cls), 0) AS iou_sum, (SELECT count(*) FROM g WHERE gt_cls = cls AND NOT crowd AND NOT EXISTS (SELECT 1 FROM m WHERE m.image = g.image AND m.gt = g.gt)) AS fn,
  (SELECT count(*) FROM p WHERE pred_cls = cls AND (e + c) / pa <= 0.5 AND NOT EXISTS (SELECT 1 FROM m WHERE m.image = p.image AND m.pred = p.pred)) AS fp FROM (SELECT unnest([0, 1]) AS cls))
SELECT cls, tp, fp, fn, round(iou_sum, 6) AS iou_sum, round(iou_sum / (tp + (fp + fn) / 2.0), 6) AS pq, round(coalesce(iou_sum / nullif(tp, 0), 0), 6) AS sq, round(tp / (tp + (fp + fn) / 2.0), 6) AS rq FROM s""")
def panoptic_quality(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    gt, img = F.col("l_suppkey") % 4, F.col("l_partkey") % 50
    pred = F.when(F.col("l_linenumber") > 2, gt).otherwise(F.col("l_quantity").cast("long") % 4)
    px = l.select(img.alias("image"), gt.alias("gt"), F.when(gt > 0, gt % 2).alias("gt_cls"), ((gt == 3) & (img < 10)).alias("crowd"), pred.alias("pred"))
    counts = px.withColumn("pred_cls", F.when(F.col("pred") > 0, F.col("pred") % 2)).groupBy("image", "gt", "gt_cls", "crowd", "pred", "pred_cls").agg(F.count("*").alias("n"))
    return rounded(detection.panoptic_quality(counts, "image"), "iou_sum", "pq", "sq", "rq")


@query(f"WITH {_PAIRS} SELECT acls, count(*) AS n, round(avg({_IOU}), 6) AS mean_iou, round(sum(i) / CAST(sum(sa + sb - i) AS DOUBLE), 6) AS whole_iou FROM ab GROUP BY 1")
def region_iou(spark, d):
    a, b = G.box("a"), G.box("b")
    both = _a(spark, d).join(_boxes(spark, d, "b", 9), "frame").select("acls", G.intersection(a, b).alias("i"), (G.area(a) + G.area(b) - G.intersection(a, b)).alias("u"))
    return rounded(detection.region_iou(both, ["acls"], "i", "u"), "mean_iou", "whole_iou")
