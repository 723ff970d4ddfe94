"""Queries on annotated timelines, comparisons of systems and runs, and grounded phrases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import episodes as E
from ..operators import grounding, systems
from .base import DAY, HOUR, query, rounded
from .event_queries import _BUCKET, _SECONDS, _found_sql, _matched_sql
from .queries import _PAIRS, _YP, EV, _boxes, _predicted, _sql_boxes, events


def _episodes(ev, label="event_type", names=("error", "click")):
    """Episodes of two channels, each with its own least duration; names are the labels that stand for them."""
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(n).alias("of")) for c, n in zip(("error", "click"), names, strict=True)])
    each = ev.withColumn("__c", F.explode(channels)).withColumns({"channel": F.col("__c.channel"), "__of": F.col("__c.of")})
    least = F.when(F.col("channel") == "error", 12 * HOUR).otherwise(6 * HOUR)
    return E.episodes(each, ["user_id", "channel"], "us", "event_id", F.col(label) == F.col("__of"), DAY, least).withColumnRenamed("episode", "id")


_ANNOTATED = f"""{EV.replace('ev AS', 'ev0 AS', 1)}, lg AS (SELECT event_id, 0 AS seq, CASE k % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN k % 2 = 0 THEN 'error' ELSE event_type END AS label FROM ev0 WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 1, CASE k % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'uncertain' ELSE 'ok' END, CASE WHEN k % 5 = 0 THEN 'click' END FROM ev0 WHERE event_id % 6 = 0
), la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1
), an AS (SELECT ev0.* REPLACE (CASE WHEN status IN ('ok', 'uncertain') THEN coalesce(label, event_type) ELSE event_type END AS event_type), coalesce(status IN ('ok', 'uncertain'), false) AS human FROM ev0 LEFT JOIN la USING (event_id) WHERE status IS DISTINCT FROM 'rejected'), ev AS (SELECT * FROM an)"""


def _annotated(spark, d):
    ev = events(spark, d)
    k, i = F.col("k"), F.col("event_id")
    first = ev.where(i % 3 == 0).select("event_id", F.lit(0).alias("seq"), F.when(k % 4 == 0, "rejected").when(k % 4 == 1, "skipped").otherwise("ok").alias("status"), F.when(k % 2 == 0, "error").otherwise(F.col("event_type")).alias("event_type"))
    second = ev.where(i % 6 == 0).select("event_id", F.lit(1).alias("seq"), F.when(k % 3 == 0, "rejected").when(k % 3 == 1, "uncertain").otherwise("ok").alias("status"), F.when(k % 5 == 0, "click").alias("event_type"))
    return systems.annotated(ev, first.unionByName(second), "event_id", ["seq"], ["event_type"])


@query(f"WITH {_ANNOTATED}, {_found_sql('ep')} SELECT ep.*, (SELECT count(*) FROM ev WHERE ev.user_id = ep.user_id AND human) AS n_human FROM ep")
def gold_events(spark, d):
    """Episodes of timelines whose labels come from an annotation log where it has them; rejected events are gaps."""
    rows = _annotated(spark, d)
    human = rows.groupBy("user_id").agg(F.count_if(F.col("source") == "human").alias("n_human"))
    return _episodes(rows).join(human, "user_id")


_SYSTEMS = {"rule": "CASE WHEN k % 3 = 0 THEN k % 5 ELSE y END", "teacher": "t", "majority": "(SELECT t FROM tc ORDER BY n DESC, t LIMIT 1)"}
_NAMES = "['click', 'error', 'purchase', 'signup', 'view']"


def _one_system(name: str, pred: str) -> str:
    return f"""ev_{name} AS (SELECT * REPLACE ({_NAMES}[1 + CAST({pred} AS INTEGER)] AS event_type), CAST({pred} AS INTEGER) AS q FROM sy), {_found_sql(f'e_{name}').replace('FROM ev WHERE', f'FROM ev_{name} WHERE')}, {_matched_sql(f'm_{name}', f'e_{name}', [0.3])},
c_{name} AS (SELECT c, count(*) FILTER (z = c AND q = c) AS tp, count(*) FILTER (z = c) AS s, count(*) FILTER (q = c) AS p FROM (SELECT * FROM ev_{name} WHERE z IS NOT NULL), (SELECT unnest(range(5)) AS c) GROUP BY 1),
r_{name} AS (SELECT '{name}' AS system, CAST(sum(s) AS BIGINT) AS n_frames, round(sum(tp) / CAST(sum(s) AS DOUBLE), 6) AS accuracy, round(avg(CASE WHEN s > 0 THEN tp / CAST(s AS DOUBLE) END), 6) AS balanced_accuracy, round(avg(CASE WHEN s > 0 THEN 2 * tp / CAST(s + p AS DOUBLE) END), 6) AS macro_f1,
  (SELECT count(*) FROM e_{name}) AS n_pred, (SELECT count(*) FROM m_{name}) AS matched, round(2 * (SELECT count(*) FROM m_{name}) / CAST((SELECT count(*) FROM gold) + (SELECT count(*) FROM e_{name}) AS DOUBLE), 6) AS event_f1 FROM c_{name})"""


@query(f"""WITH {_YP.removeprefix('WITH ')}, sy AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN y END AS z, CASE WHEN k % 7 = 0 THEN (y + 1) % 5 ELSE y END AS t FROM x), tc AS (SELECT t, count(*) AS n FROM sy GROUP BY 1), {_found_sql('gold')}, {', '.join(_one_system(n, p) for n, p in _SYSTEMS.items())}
{' UNION ALL '.join(f'SELECT * FROM r_{n}' for n in _SYSTEMS)}""")
def system_comparison(spark, d):
    """A rule, its teacher and the teacher's majority class against human labels: frames and episodes."""
    y, k = F.col("y"), F.col("k")
    frames = _predicted(spark, d).drop("p").withColumns({"z": F.when(F.col("event_id") % 4 != 0, y), "t": F.when(k % 7 == 0, (y + 1) % 5).otherwise(y)})
    rows = systems.with_controls(frames, "t", {"rule": F.when(k % 3 == 0, k % 5).otherwise(y)})
    gold = _episodes(frames, "y", (1, 0))
    scores = lambda found: E.event_scores(gold, found, ["user_id"], [0.3], _SECONDS, _BUCKET).where("channel IS NULL").select("n_pred", "matched", F.col("f1").alias("event_f1"))
    out = systems.compared(rows, "z", 5, lambda one: _episodes(one, "pred", (1, 0)), scores)
    return rounded(out, "accuracy", "balanced_accuracy", "macro_f1", "event_f1")


@query(f"{_YP}, n AS (SELECT y, p, count(*) AS n FROM x GROUP BY 1, 2) SELECT s AS state, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM n WHERE y = s), 0) AS labels, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM n WHERE p = s), 0) AS model, round((SELECT sum(n) FILTER (y = p) / CAST(sum(n) AS DOUBLE) FROM n), 6) AS agreement FROM (SELECT y AS s FROM n UNION SELECT p FROM n)")
def state_agreement(spark, d):
    """Distribution of states in labels and predictions, and how often they agree."""
    rows = _predicted(spark, d)
    state = lambda c: rows.select("event_id", F.col(c).cast("long").alias("state"))
    return rounded(systems.state_agreement(state("y"), state("p"), ["event_id"], "state"), "agreement")


_PLACE = "SELECT *, row_number() OVER w AS i, lag(c) OVER w AS pc, lead(frame) OVER w AS nf FROM (SELECT frame % 4 AS lane, frame, {p}id AS id, {c} AS c, CAST(round_even(({p}x1 + {p}x2) / 40.0, 0) AS BIGINT) AS px, CAST(round_even(({p}y1 + {p}y2) / 40.0, 0) AS BIGINT) AS py FROM {t}) WINDOW w AS (PARTITION BY lane, px, py ORDER BY frame, id)"
_EPISODE = "SELECT DISTINCT lane, px, py, c FROM (SELECT lane, px, py, c, run, min(frame) AS a, CASE WHEN count(*) = count(nf) THEN max(nf) END AS b FROM (SELECT *, sum(CASE WHEN pc = c THEN 0 ELSE 1 END) OVER (PARTITION BY lane, px, py ORDER BY i) AS run FROM ({s})) GROUP BY ALL) WHERE b - a >= 20"


@query(f"""WITH a AS ({_sql_boxes('a', 0)}), b AS (SELECT * FROM ({_sql_boxes('b', 3)}) WHERE frame % 3 <> 0), fr AS (SELECT DISTINCT frame FROM a INTERSECT SELECT DISTINCT frame FROM b
), ra AS (SELECT * FROM a WHERE frame IN (SELECT frame FROM fr)), p AS (SELECT frame, aid, acls, CASE WHEN bid % 4 = 0 THEN 'X' ELSE bcls END AS bc, bid, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i, (ax2 - ax1) * (ay2 - ay1) AS sa, (bx2 - bx1) * (by2 - by1) AS sb FROM ra JOIN b USING (frame)
), m AS (SELECT frame, aid, acls, arg_max(bc, (i / CAST(sa + sb - i AS DOUBLE), -bid)) AS bc FROM p WHERE i / CAST(sa + sb - i AS DOUBLE) > 0.5 GROUP BY ALL
), ea AS ({_EPISODE.format(s=_PLACE.format(p='a', c='acls', t='a'))}), eb AS ({_EPISODE.format(s=_PLACE.format(p='b', c="CASE WHEN bid % 4 = 0 THEN 'X' ELSE bcls END", t='b'))})
SELECT (SELECT count(*) FROM fr) AS frames_compared, round((SELECT count(*) FROM m) / CAST((SELECT count(*) FROM ra) AS DOUBLE), 6) AS track_coverage, round((SELECT count(*) FILTER (acls = bc) / CAST(count(*) AS DOUBLE) FROM m), 6) AS cue_agreement, (SELECT count(*) FROM ea) AS n_episodes_reference, (SELECT count(*) FROM eb) AS n_episodes_here,
  round((SELECT count(*) FROM (SELECT * FROM ea INTERSECT SELECT * FROM eb)) / CAST(greatest((SELECT count(*) FROM ea), 1) AS DOUBLE), 6) AS episode_agreement""")
def run_comparison(spark, d):
    """A run that leaves out frames and moves boxes, against the full one."""
    named = lambda t, p: t.withColumns({"row": F.col(f"{p}id"), "lane": F.col("frame") % 4})
    a = named(_boxes(spark, d, "a", 0), "a").withColumn("cue", F.col("acls"))
    b = named(_boxes(spark, d, "b", 3), "b").where("frame % 3 <> 0").withColumn("cue", F.when(F.col("bid") % 4 == 0, "X").otherwise(F.col("bcls")))
    out = grounding.run_comparison(a, b, ["lane"], "frame", "cue", G.box("a"), G.box("b"), 20)
    return rounded(out, "track_coverage", "cue_agreement", "episode_agreement")


_RANKED = f"{_PAIRS}, ar AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ascore DESC, aid) AS rank FROM a)"


def _ranked(spark, d, *by):
    return _boxes(spark, d, "a", 0).withColumn("rank", F.row_number().over(Window.partitionBy("frame", *by).orderBy(F.desc("ascore"), "aid")))


@query(f"""WITH {_RANKED}, t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY frame ORDER BY bid) = 1), f AS (SELECT frame, min(rank) AS first FROM ar JOIN t USING (frame) WHERE greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) / CAST((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS DOUBLE) >= 0.5 GROUP BY 1
), e AS (SELECT bcls AS dataset, k, count(*) AS n, avg(CAST(coalesce(first <= k, false) AS INT)) AS precision FROM t LEFT JOIN f USING (frame), (SELECT unnest([1, 2, 5]) AS k) GROUP BY 1, 2)
SELECT dataset, k, n, round(precision, 6) AS precision FROM e UNION ALL SELECT NULL, NULL, CAST(sum(n) AS BIGINT), round(avg(precision), 6) FROM e""")
def reference_precision(spark, d):
    """Each frame's first box as the target of a phrase, by kind."""
    first = Window.partitionBy("frame").orderBy("bid")
    targets = _boxes(spark, d, "b", 9).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r").withColumnRenamed("bcls", "dataset")
    return rounded(grounding.reference_precision(_ranked(spark, d), targets, ["frame"], "dataset", G.box("a"), G.box("b"), [1, 2, 5]), "precision")


@query(f"""WITH {_PAIRS}, t AS (SELECT frame, bool_or(frame % 5 = 0) AS none, count(*) AS n_gt FROM b WHERE bid % 3 = 0 GROUP BY 1), c AS (SELECT frame, count(*) AS n_det FROM a WHERE ascore >= 0.6 GROUP BY 1
), p AS (SELECT frame, list({{'d': aid, 'g': bid}} ORDER BY i / CAST(sa + sb - i AS DOUBLE) DESC, aid, bid) AS l FROM ab WHERE ascore >= 0.6 AND bid % 3 = 0 AND frame % 5 <> 0 AND i / CAST(sa + sb - i AS DOUBLE) >= 0.4 GROUP BY 1
), m AS (SELECT frame, len(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: q.d = x.d OR q.g = x.g)) > 0 THEN acc ELSE list_append(acc, x) END, CAST([] AS STRUCT(d BIGINT, g BIGINT)[]))) AS tp FROM p
), r AS (SELECT *, coalesce(n_det, 0) AS nd, CASE WHEN none THEN CAST(n_det IS NULL AS DOUBLE) ELSE 2 * coalesce(tp, 0) / CAST(coalesce(n_det, 0) + n_gt AS DOUBLE) END AS f1 FROM t LEFT JOIN c USING (frame) LEFT JOIN m USING (frame))
SELECT count(*) AS n, round(avg(CAST(f1 >= 0.4 AS INT)), 6) AS f1_score, round(count(*) FILTER (nd > 0 AND NOT none) / CAST(count(*) FILTER (NOT none) AS DOUBLE), 6) AS target_accuracy, round(count(*) FILTER (nd = 0 AND none) / CAST(count(*) FILTER (none) AS DOUBLE), 6) AS no_target_accuracy FROM r""")
def general_references(spark, d):
    """References to several boxes or none."""
    dets = _boxes(spark, d, "a", 0).withColumnsRenamed({"aid": "det", "ascore": "score"})
    truth = _boxes(spark, d, "b", 9).withColumnRenamed("bid", "gt").where("gt % 3 = 0").withColumn("none", F.col("frame") % 5 == 0)
    return rounded(grounding.general_references(dets, truth, "frame", G.box("a"), G.box("b"), 0.6, 0.4, 0.4), "f1_score", "target_accuracy", "no_target_accuracy")


def _recall_sql(name: str, truth: str) -> str:
    cut = "greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0)"
    return f"""{name}_f AS (SELECT frame, cls, min(rank) AS first FROM ac JOIN {truth} t USING (frame, cls) WHERE {cut} / CAST((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {cut} AS DOUBLE) >= 0.5 GROUP BY 1, 2
), {name} AS (SELECT category, k, count(*) AS n, round(avg(CAST(first IS NOT NULL AND (k < 0 OR first <= k) AS INT)), 6) AS recall FROM (SELECT DISTINCT frame, cls, first, unnest(['all', cls]) AS category FROM {truth} LEFT JOIN {name}_f USING (frame, cls)), (SELECT unnest([1, 2, -1]) AS k) GROUP BY 1, 2)"""


@query(f"""WITH b AS (SELECT *, bcls AS cls FROM ({_sql_boxes('b', 9)})), ac AS (SELECT *, acls AS cls, row_number() OVER (PARTITION BY frame, acls ORDER BY ascore DESC, aid) AS rank FROM ({_sql_boxes('a', 0)})), bm AS (SELECT frame, cls, min(bx1) AS bx1, min(by1) AS by1, max(bx2) AS bx2, max(by2) AS by2 FROM b GROUP BY 1, 2), {_recall_sql('o', 'b')}, {_recall_sql('m', 'bm')}
SELECT 'any' AS boxes, * FROM o UNION ALL SELECT 'merged', * FROM m""")
def phrase_recall(spark, d):
    """Classes of a frame as phrases: found by any of their boxes, or by the box around all."""
    dets = _ranked(spark, d, "acls").withColumnRenamed("acls", "cls")
    truth = _boxes(spark, d, "b", 9).withColumn("cls", F.col("bcls")).withColumn("kind", F.col("bcls"))
    each = [grounding.phrase_recall(dets, truth, ["frame", "cls"], G.box("a"), G.box("b"), [1, 2, -1], 0.5, m, "kind").withColumn("boxes", F.lit(n)) for m, n in ((False, "any"), (True, "merged"))]
    return rounded(each[0].unionByName(each[1]), "recall")
