"""Queries on the rules of particular detection benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection
from ..operators import detection_rules as R
from ..sources.files import written
from .base import query, rounded
from .queries import _PAIRS, _boxes, _sql_boxes

_IOU = "i / CAST(sa + sb - i AS DOUBLE)"


def _dets(spark, d):
    return _boxes(spark, d, "a", 0).withColumnsRenamed({"aid": "det", "ascore": "score", "acls": "cls"})


def _truth(spark, d):
    """Shifted boxes of other lines; every sixth part is a crowd, every fifth is to be ignored."""
    b = _boxes(spark, d, "b", 9).withColumnsRenamed({"bid": "gt", "bcls": "cls"}).drop("bscore")
    part = F.floor(F.col("gt") / 1000) % 1_000_000
    return b.withColumns({"ignore": part % 5 == 0, "is_group": part % 6 == 0})


_FOLD = """lists AS (SELECT {key}, list({{'d': det, 'c': c}} ORDER BY score DESC, det) AS ds FROM (SELECT {key}, det, score, list({{'g': gt, 'x': ignored, 'r': again}} ORDER BY o, gt) AS c FROM offers GROUP BY ALL) GROUP BY ALL
), marks AS (SELECT {key}, unnest(list_reduce(ds, lambda acc, x: list_transform([list_filter(x.c, lambda c: NOT list_contains(acc.used, c.g))], lambda f: {{'used': CASE WHEN len(f) > 0 AND NOT f[1].r THEN list_append(acc.used, f[1].g) ELSE acc.used END,
    'out': list_append(acc.out, {{'det': x.d, 'mark': CASE WHEN len(f) = 0 THEN 0 WHEN f[1].x THEN -1 ELSE 1 END}})}})[1], {{'used': CAST([] AS BIGINT[]), 'out': CAST([] AS STRUCT(det BIGINT, mark INTEGER)[])}}).out) AS m FROM lists)"""


@query(f"""WITH {_PAIRS}, offers AS (SELECT frame, acls, aid AS det, ascore AS score, -{_IOU} AS o, bid AS gt, bid // 1000 % 1000000 % 5 = 0 OR sb < 700 OR sb >= 2600 AS ignored, false AS again FROM ab WHERE acls = bcls AND {_IOU} >= least(0.5, sb / CAST((bx2 - bx1 + 10.0) * (by2 - by1 + 10.0) AS DOUBLE))
), {_FOLD.format(key='frame, acls')}, d AS (SELECT a.*, coalesce(m.mark, 0) AS mark FROM a LEFT JOIN (SELECT frame, acls, m.det, m.mark FROM marks) m ON m.frame = a.frame AND m.acls = a.acls AND m.det = a.aid)
SELECT acls AS cls, count(*) AS n, count(*) FILTER (mark = 1) AS tp, count(*) FILTER (mark = -1 OR (mark = 0 AND ((ax2 - ax1) * (ay2 - ay1) < 700 OR (ax2 - ax1) * (ay2 - ay1) >= 2600))) AS ignored FROM d GROUP BY 1""")
def sized_positives(spark, d):
    """True positives where small truths are easier to meet, within a range of areas."""
    marked = R.sized_positives(_dets(spark, d), _truth(spark, d), ["frame", "cls"], G.box("a"), G.box("b"), 0.5, (700.0, 2600.0))
    return marked.groupBy("cls").agg(F.count("*").alias("n"), F.count_if("tp").alias("tp"), F.count_if("ignored").alias("ignored"))


_TREE = [("A", "X"), ("N", "X"), ("R", "Y"), ("X", "Z")]


@query(f"""WITH RECURSIVE p(child, parent) AS (VALUES {', '.join(map(str, _TREE))}), up(cls, above) AS (SELECT x, x FROM (SELECT child AS x FROM p UNION SELECT parent FROM p) UNION SELECT up.cls, p.parent FROM up JOIN p ON p.child = up.above
), a AS (SELECT x.*, above AS cls FROM ({_sql_boxes('a', 0)}) x JOIN up ON up.cls = acls), b AS (SELECT x.*, above AS cls, bid // 1000 % 1000000 % 6 = 0 AS grp FROM ({_sql_boxes('b', 9)}) x JOIN up ON up.cls = bcls
), d AS (SELECT * FROM a WHERE (frame, cls) IN (SELECT frame, cls FROM b)
), ab AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i, (ax2 - ax1) * (ay2 - ay1) AS sa, (bx2 - bx1) * (by2 - by1) AS sb FROM d JOIN b USING (frame, cls)
), s AS (SELECT frame, cls, aid, ascore, arg_max(bid, ({_IOU}, -bid)) AS gt FROM ab WHERE NOT grp AND {_IOU} >= 0.5 GROUP BY ALL), h AS (SELECT frame, cls, aid, row_number() OVER (PARTITION BY frame, cls, gt ORDER BY ascore DESC, aid) = 1 AS tp FROM s
), g AS (SELECT frame, cls, aid, ascore, arg_max(bid, (i / CAST(sa AS DOUBLE), -bid)) AS gt FROM ab WHERE grp AND i / CAST(sa AS DOUBLE) >= 0.5 AND (frame, cls, aid) NOT IN (SELECT frame, cls, aid FROM h) GROUP BY ALL
), r AS (SELECT frame, cls, aid, row_number() OVER (PARTITION BY frame, cls, gt ORDER BY ascore DESC, aid) AS r FROM g
), m AS (SELECT d.frame, d.cls, d.aid, d.ascore, coalesce(r = 1, h.tp, false) AS tp FROM d LEFT JOIN h USING (frame, cls, aid) LEFT JOIN r USING (frame, cls, aid) WHERE r IS NULL OR r = 1
), n AS (SELECT cls, count(*) AS n_gt FROM b GROUP BY 1), c AS (SELECT *, sum(CAST(tp AS INT)) OVER w / CAST(row_number() OVER w AS DOUBLE) AS p, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY cls ORDER BY ascore DESC, frame, aid)
), e AS (SELECT *, max(p) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM c)
SELECT cls, any_value(n_gt) AS n_gt, count(*) AS n, count(*) FILTER (tp) AS tp, round(coalesce(sum(v) FILTER (tp), 0) / any_value(n_gt), 6) AS ap FROM e JOIN n USING (cls) GROUP BY cls""")
def class_tree_ap(spark, d):
    """Average precision where truths and detections count for the classes above them too, crowds of a class as one truth."""
    closure = R.class_closure(spark.createDataFrame(_TREE, "child string, parent string"))
    found = R.grouped_positives(_dets(spark, d), _truth(spark, d), ["frame", "cls"], G.box("a"), G.box("b"), annotated=True, deal=["frame"], above=("cls", closure))
    marked = written(found, "marked")
    truths = R.with_classes_above(_truth(spark, d).select("cls"), "cls", closure).groupBy("cls").agg(F.count("*").alias("n_gt"))
    ap = detection.detection_ap(marked.withColumn("key_order", F.col("frame")), ["cls"], truths)
    counts = marked.groupBy("cls").agg(F.count("*").alias("n"), F.count_if("tp").alias("tp"))
    return truths.join(counts, "cls").join(ap, "cls", "left").select("cls", "n_gt", "n", "tp", F.round(F.coalesce("ap", F.lit(0.0)), 6).alias("ap"))


_CROWD = f"""{_PAIRS}, offers AS (SELECT frame, aid AS det, ascore AS score, CASE WHEN x THEN 2 ELSE 0 END - o AS o, bid AS gt, x AS ignored, x AS again FROM (SELECT *, bid // 1000 % 1000000 % 5 = 0 AS x, CASE WHEN bid // 1000 % 1000000 % 5 = 0 THEN i / CAST(sa AS DOUBLE) ELSE {_IOU} END AS o FROM ab) WHERE o >= 0.5
), {_FOLD.format(key='frame')}, d AS (SELECT a.frame, aid, ascore, coalesce(m.mark, 0) AS mark FROM a LEFT JOIN (SELECT frame, m.det, m.mark FROM marks) m ON m.frame = a.frame AND m.det = a.aid)"""


@query(f"""WITH {_CROWD}, t AS (SELECT count(*) FILTER (bid // 1000 % 1000000 % 5 <> 0) AS n_gt, count(DISTINCT frame) AS n_img FROM b
), c AS (SELECT *, CAST(sum(mark) OVER w AS DOUBLE) AS tp, CAST(row_number() OVER w AS DOUBLE) AS k FROM d WHERE mark >= 0 WINDOW w AS (ORDER BY ascore DESC, frame, aid)
), e AS (SELECT *, 1 - tp / n_gt AS miss, (k - tp) / n_img AS rate FROM c, t), f AS (SELECT r, coalesce(arg_min(miss, k) FILTER (rate >= r), arg_max(miss, k)) AS m FROM e, (SELECT unnest([{', '.join(map(str, R.REFERENCES['from_-2']))}]) AS r) GROUP BY r)
SELECT round((SELECT sum((tp / k + (tp - 1) / (k - 1)) / 2) FILTER (mark = 1 AND k > 1) / max(n_gt) FROM e), 6) AS ap, round(exp(avg(ln(m))), 6) AS miss_rate FROM f""")
def crowd_scores(spark, d):
    """Precision by recall and the log-average miss rate of boxes without classes, with truths to ignore."""
    truth = _truth(spark, d)
    marked = R.crowd_matches(_dets(spark, d), truth, ["frame"], G.box("a"), G.box("b"))
    n, images = truth.where("NOT ignore").agg(F.count("*").alias("n")), truth.agg(F.count_distinct("frame").alias("n"))
    return rounded(R.crowd_curve(marked, n, images, ["frame", "det"]), "ap", "miss_rate")


@query()
def crowd_jaccard(spark, d):
    """Matched boxes by most pairs, at ten scores; tested against all assignments."""
    arr = lambda p: F.array(*[F.col(f"{p}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])
    dets, truth = _dets(spark, d).withColumn("box", arr("a")), _truth(spark, d).withColumn("box", arr("b"))
    return rounded(R.crowd_jaccard(dets, truth, "frame", "box", [i / 10 for i in range(10)]), "jaccard")


def _tracks(spark, d):
    """Boxes as tracks of sixty-four frames a video: truths by line, tracks by line and the sixteenth of the video."""
    line = F.floor(F.col("det") / 1_000_000_000)
    video = F.floor(F.col("frame") / 64)
    a = _dets(spark, d).withColumns({"video": video, "gt": line}).where(F.col("det") % 7 > 0)
    b = _boxes(spark, d, "b", 9).withColumns({"video": video, "track": (F.floor(F.col("bid") / 1_000_000_000) + F.floor(F.col("frame") / 16)) % 8})
    return a, b.where(F.col("bid") % 5 > 0)


_TRACKS = f"""a AS (SELECT *, frame // 64 AS video, aid // 1000000000 AS gt FROM ({_sql_boxes('a', 0)}) WHERE aid % 7 > 0), b AS (SELECT *, frame // 64 AS video, (bid // 1000000000 + frame // 16) % 8 AS track FROM ({_sql_boxes('b', 9)}) WHERE bid % 5 > 0)"""


@query(f"""WITH {_TRACKS}, i AS (SELECT video, gt, track, sum(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0)) AS i FROM a JOIN b USING (video, frame) GROUP BY ALL
), sa AS (SELECT video, gt, sum((ax2 - ax1) * (ay2 - ay1)) AS s FROM a GROUP BY ALL), sb AS (SELECT video, track, sum((bx2 - bx1) * (by2 - by1)) AS s FROM b GROUP BY ALL)
SELECT video, gt, track, round(i / CAST(sa.s + sb.s - i AS DOUBLE), 6) AS iou FROM i JOIN sa USING (video, gt) JOIN sb USING (video, track) WHERE i > 0""")
def tube_overlaps(spark, d):
    """Overlap of whole tracks in space and time."""
    a, b = _tracks(spark, d)
    return rounded(R.tube_overlaps(a, b, ["video"], "frame", "gt", "track", G.box("a"), G.box("b")), "iou")


def _track_matches(spark, d):
    a, b = _tracks(spark, d)
    pairs = a.join(b.withColumnRenamed("bid", "det"), ["video", "frame", "det"])
    return a, b, pairs.where(G.iou(G.box("a"), G.box("b")) >= 0.4).select("video", "frame", "gt", "track")


@query(f"""WITH {_TRACKS}, m AS (SELECT a.video, a.frame, a.gt, b.track FROM a JOIN b ON a.video = b.video AND a.frame = b.frame AND aid = bid WHERE greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) / CAST((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS DOUBLE) >= 0.4
), r AS (SELECT a.video, a.frame, a.gt, m.track FROM a LEFT JOIN m ON m.video = a.video AND m.frame = a.frame AND m.gt = a.gt
), w AS (SELECT *, last_value(track IGNORE NULLS) OVER (PARTITION BY video, gt ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(track IS NULL) OVER (PARTITION BY video, gt ORDER BY frame) AS gap FROM r
), s AS (SELECT video, count(*) AS n_gt, count(track) AS tp, count(*) FILTER (track <> last) AS switches, count(*) FILTER (track IS NOT NULL AND gap AND last IS NOT NULL) AS fragments FROM w GROUP BY 1), p AS (SELECT video, count(*) AS n_pred FROM b GROUP BY 1)
SELECT video, n_gt, n_pred, tp, n_pred - tp AS fp, n_gt - tp AS fn, switches, fragments, round((n_gt - (n_gt - tp) - (n_pred - tp) - switches) / CAST(n_gt AS DOUBLE), 6) AS mota FROM s JOIN p USING (video)""")
def track_scores(spark, d):
    """Misses, false boxes, switches and fragments of tracks."""
    a, b, m = _track_matches(spark, d)
    return rounded(R.track_scores(m, a, b, ["video"], "frame", "gt", "track"), "mota")


@query()
def identity_scores(spark, d):
    """Frames in the best pairing of whole tracks; tested against all pairings."""
    a, b, m = _track_matches(spark, d)
    return rounded(R.identity_scores(m, a, b, "video", "gt", "track"), "idf1")


_RANGES = {"all": (0.0, 1e9), "small": (0.0, 1200.0), "large": (1200.0, 1e9)}
_LIMITS = [1, 2, 3]


def _ranged_sql() -> str:
    ranges = ", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in _RANGES.items())
    return f"""WITH lv AS (SELECT * FROM (VALUES {ranges}) r(range, lo, hi), (SELECT unnest([0.4, 0.6]::DOUBLE[]) AS threshold)
), a AS (SELECT *, row_number() OVER (PARTITION BY frame, acls ORDER BY ascore DESC, aid) AS place FROM (SELECT * FROM ({_sql_boxes('a', 0)}) QUALIFY row_number() OVER (PARTITION BY acls ORDER BY ascore DESC, aid) <= 3000) QUALIFY place <= 3
), b AS (SELECT *, bid // 1000 % 1000000 % 5 = 0 AS ig FROM ({_sql_boxes('b', 9)})
), ab AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i, (ax2 - ax1) * (ay2 - ay1) AS sa, (bx2 - bx1) * (by2 - by1) AS sb FROM a JOIN b USING (frame) WHERE acls = bcls
), p AS (SELECT *, CASE WHEN ig THEN i / CAST(sa AS DOUBLE) ELSE {_IOU} END AS ov, ig OR sb < lo OR sb >= hi AS x FROM ab, lv), offers AS (SELECT threshold, range, frame, acls, aid AS det, ascore AS score, CASE WHEN x THEN 2 ELSE 0 END - ov AS o, bid AS gt, x AS ignored, ig AS again FROM p WHERE ov >= threshold
), {_FOLD.format(key='threshold, range, frame, acls')}, d AS (SELECT a.*, lv.threshold, lv.range, lo, hi, coalesce(m.mark, 0) AS mark FROM a CROSS JOIN lv LEFT JOIN (SELECT threshold, range, frame, acls, m.det, m.mark FROM marks) m ON m.threshold = lv.threshold AND m.range = lv.range AND m.frame = a.frame AND m.acls = a.acls AND m.det = a.aid
), k AS (SELECT *, mark = 1 AS tp FROM d WHERE mark = 1 OR (mark = 0 AND (ax2 - ax1) * (ay2 - ay1) >= lo AND (ax2 - ax1) * (ay2 - ay1) < hi)
), n AS (SELECT threshold, range, bcls AS acls, count(*) AS n_gt FROM b, lv WHERE NOT ig AND (bx2 - bx1) * (by2 - by1) >= lo AND (bx2 - bx1) * (by2 - by1) < hi GROUP BY ALL
), c AS (SELECT *, sum(CAST(tp AS INT)) OVER w AS t, sum(CAST(tp AS INT)) OVER w / CAST(row_number() OVER w AS DOUBLE) AS pr, row_number() OVER w AS r FROM k WINDOW w AS (PARTITION BY threshold, range, acls ORDER BY ascore DESC, frame, aid)
), e AS (SELECT *, max(pr) OVER (PARTITION BY threshold, range, acls ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM c
), h AS (SELECT threshold, range, acls, q, max(v) AS h FROM e JOIN n USING (threshold, range, acls), (SELECT unnest(range(101)) AS q) WHERE t * 100 >= q * n_gt GROUP BY ALL
), f AS (SELECT threshold, range, acls, sum(h) / 101 AS ap FROM h GROUP BY ALL), z AS (SELECT n.threshold, n.range, n.acls, n_gt, {', '.join(f'(SELECT count(*) FROM k WHERE k.threshold = n.threshold AND k.range = n.range AND k.acls = n.acls AND tp AND place <= {q}) AS k{q}' for q in _LIMITS)} FROM n
), y AS (SELECT range, unnest({_LIMITS}) AS lim, unnest([{', '.join(f'k{q} / CAST(n_gt AS DOUBLE)' for q in _LIMITS)}]) AS r FROM z)
SELECT 'ap' AS metric, range, 3 AS "limit", round(avg(coalesce(ap, 0)), 6) AS value FROM n LEFT JOIN f USING (threshold, range, acls) GROUP BY range UNION ALL SELECT 'ar', range, lim, round(avg(r), 6) FROM y WHERE range = 'all' OR lim = 3 GROUP BY range, lim"""


@query(_ranged_sql())
def ranged_scores(spark, d):
    """Precision and recall by ranges of area and limits of detections, crowds aside."""
    out = R.ranged_scores(_dets(spark, d), _truth(spark, d), "frame", "cls", G.box("a"), G.box("b"), [0.4, 0.6], _RANGES, _LIMITS, 3000)
    return rounded(out, "value")
