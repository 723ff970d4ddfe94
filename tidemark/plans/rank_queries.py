"""Queries on ranking, calibration and fused probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fusion
from ..operators import metrics
from .base import query, rounded, table
from .cue_queries import _P, _probs
from .queries import _SCORED, EV, _scored

#: event types as the classes of three probabilities
_Y = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END"
_PY = f"{EV}, {_P}, py AS (SELECT p.event_id, p.ps, {_Y} AS y FROM p JOIN ev USING (event_id))"


def _classed(spark, d):
    return _probs(spark, d).withColumn("y", F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2))


_EACH = "e AS (SELECT event_id, y = c - 1 AS pos, c - 1 AS cls, ps[c] AS score FROM py, (SELECT unnest([1, 2, 3]) AS c))"


@query(f"""WITH {_PY}, {_EACH}, r AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk, sum(CAST(pos AS INT)) OVER w AS tp, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY cls ORDER BY score DESC, event_id))
SELECT cls, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auroc, round(sum(tp / n) FILTER (pos) / count(*) FILTER (pos), 6) AS average_precision FROM r GROUP BY 1""")
def class_ranking(spark, d):
    return rounded(metrics.class_ranking(_classed(spark, d), "ps", "y", "event_id"), "auroc", "average_precision")


_CECE = "ce AS (SELECT cls, sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT cls, least(greatest(CAST(ceil(score * 15) AS BIGINT) - 1, 0), 14) AS b, count(*) AS n, avg(score) AS c, avg(CAST(pos AS INT)) AS a FROM e GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {_PY}, {_EACH}, {_CECE} SELECT cls, round(ece, 6) AS ece FROM ce UNION ALL SELECT NULL, round(avg(ece), 6) FROM ce")
def classwise_calibration(spark, d):
    return rounded(metrics.classwise_calibration(_classed(spark, d), "ps", "y"), "ece")


_LOSS = "(SELECT avg(list_sum(list_transform(ps, lambda p, i: power(p - CASE WHEN i - 1 = y THEN 1 ELSE 0 END, 2)))) FROM py)"
_NLL = "(SELECT avg(-ln(least(greatest(ps[y + 1], 1e-12), 1))) FROM py)"


@query(f"WITH {_PY} SELECT round({_LOSS}, 6) AS brier, round({_NLL}, 6) AS nll")
def probability_losses(spark, d):
    return rounded(metrics.probability_losses(_classed(spark, d), "ps", "y"), "brier", "nll")


_TOP = "tp AS (SELECT y, list_max(ps) AS conf, list_position(ps, list_max(ps)) - 1 AS p FROM py)"
_F1 = "s AS (SELECT cls, count(*) FILTER (y = cls AND p = cls) AS t, count(*) FILTER (y = cls) AS s, count(*) FILTER (p = cls) AS q FROM tp, (SELECT unnest([0, 1, 2]) AS cls) GROUP BY 1), f AS (SELECT *, CASE WHEN t > 0 THEN 2 * t / (s + q) ELSE 0 END AS f1, t / s AS re FROM s WHERE s > 0)"
_RANKED = "rk AS (SELECT cls, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS a, sum(tp / n) FILTER (pos) / count(*) FILTER (pos) AS ap FROM (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk, sum(CAST(pos AS INT)) OVER w AS tp, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY cls ORDER BY score DESC, event_id)) GROUP BY 1)"


@query(f"""WITH {_PY}, {_EACH}, {_CECE}, {_TOP}, {_F1}, {_RANKED}, m AS (SELECT 'macro_f1' AS metric, (SELECT avg(f1) FROM f) AS value UNION ALL SELECT 'balanced_accuracy', (SELECT avg(re) FROM f) UNION ALL SELECT 'weighted_f1', (SELECT sum(f1 * s) / sum(s) FROM f) UNION ALL SELECT 'accuracy', (SELECT avg(CAST(y = p AS INT)) FROM tp)
  UNION ALL SELECT 'brier', {_LOSS} UNION ALL SELECT 'nll', {_NLL} UNION ALL SELECT 'classwise_ece', (SELECT avg(ece) FROM ce) UNION ALL SELECT 'macro_auroc', (SELECT avg(a) FROM rk) UNION ALL SELECT 'macro_auprc', (SELECT avg(ap) FROM rk)
  UNION ALL SELECT 'ece', (SELECT sum(n * abs(a - c)) / sum(n) FROM (SELECT least(greatest(CAST(ceil(conf * 15) AS BIGINT) - 1, 0), 14) AS b, count(*) AS n, avg(conf) AS c, avg(CAST(y = p AS INT)) AS a FROM tp GROUP BY 1)))
SELECT metric, round(value, 6) AS value FROM m""")
def frame_metrics(spark, d):
    return rounded(metrics.frame_metrics(_classed(spark, d), "ps", "y", "event_id", 3), "value")


def _curve_sql():
    f1 = lambda pred, where: f"(SELECT avg(CASE WHEN t > 0 THEN 2 * t / (s + q) ELSE 0 END) FROM (SELECT count(*) FILTER (y = c AND {pred} = c) AS t, count(*) FILTER (y = c) AS s, count(*) FILTER ({pred} = c) AS q FROM tl, (SELECT unnest([0, 1, 2]) AS c) {where} GROUP BY c) WHERE s > 0)"
    z = "CASE WHEN lv >= i THEN p ELSE 2 END"
    return f"""tl AS (SELECT y, p, least(CAST(floor(round(conf * 50, 9)) AS BIGINT), 49) AS lv FROM tp), cv AS (
  SELECT i / 50.0 AS threshold, (SELECT avg(CAST(lv >= i AS INT)) FROM tl) AS coverage, (SELECT avg(CAST(y <> p AS INT)) FROM tl WHERE lv >= i) AS selective_error, {f1('p', 'WHERE lv >= i')} AS selective_macro_f1,
    (SELECT avg(CAST(y = {z} AS INT)) FROM tl) AS abstain_accuracy, {f1(z, '')} AS abstain_macro_f1 FROM (SELECT unnest(range(50)) AS i))"""


@query(f"WITH {_PY}, {_TOP}, {_curve_sql()} SELECT threshold, round(coverage, 6) AS coverage, round(selective_error, 6) AS selective_error, round(selective_macro_f1, 6) AS selective_macro_f1, round(abstain_accuracy, 6) AS abstain_accuracy, round(abstain_macro_f1, 6) AS abstain_macro_f1 FROM cv")
def risk_curve(spark, d):
    out = metrics.risk_curve(_classed(spark, d), "ps", "y", 3, 2)
    return rounded(out, *out.columns[1:])


@query(f"WITH {_PY}, {_TOP}, {_curve_sql()}, g AS (SELECT coverage, selective_error AS e, lag(coverage) OVER w AS c0, lag(selective_error) OVER w AS e0 FROM cv WHERE selective_error IS NOT NULL WINDOW w AS (ORDER BY coverage, threshold)) SELECT round(sum((coverage - c0) * (e + e0) / 2) / greatest(max(coverage) - min(coverage), 1e-9), 6) AS aurc FROM g")
def area_under_risk(spark, d):
    return rounded(metrics.area_under_risk(metrics.risk_curve(_classed(spark, d), "ps", "y", 3, 2)), "aurc")


@query(f"WITH {_PY}, {_TOP}, {_curve_sql()} SELECT max(threshold) FILTER (coverage >= 0.8) AS display, coalesce(min(threshold) FILTER (1 - selective_error >= 0.45), 1.01) AS alert FROM cv")
def chosen_thresholds(spark, d):
    return metrics.choose_thresholds(metrics.risk_curve(_classed(spark, d), "ps", "y", 3, 2), 0.8, 0.45)


@query(f"WITH {EV}, r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY k, event_id) AS b FROM ev) SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman_ordinal(spark, d):
    from .queries import events

    return rounded(metrics.spearman_ordinal(events(spark, d), ["event_type"], "value", "k", "event_id"), "spearman")


@query("""WITH x AS (SELECT l_linenumber % 4 AS t, CAST(l_quantity AS BIGINT) % 4 AS p FROM lineitem), s AS (SELECT c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t = c) AS s, count(*) FILTER (p = c) AS q FROM x, (SELECT unnest(range(4)) AS c) GROUP BY 1
), r AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM x)
SELECT (SELECT count(*) FROM x) AS n, round((SELECT avg(abs(t - p)) FROM x), 6) AS mae, round((SELECT sum(tp) / sum(s) FROM s), 6) AS accuracy, round((SELECT avg(tp / s) FROM s WHERE s > 0), 6) AS average_accuracy, round((SELECT avg(CASE WHEN tp > 0 THEN 2 * tp / (s + q) ELSE 0 END) FROM s WHERE s > 0), 6) AS macro_f1,
  round(1 - (SELECT sum(power(t - p, 2) / 9.0) FROM x) / ((SELECT sum(power(a.c - b.c, 2) / 9.0 * a.s * b.q) FROM s a, s b) / CAST((SELECT count(*) FROM x) AS DOUBLE)), 6) AS qwk, round((SELECT corr(a, b) FROM r), 6) AS spearman""")
def ordinal_scores(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("t"), (F.col("l_quantity").cast("long") % 4).alias("p"))
    out = metrics.ordinal_scores(x, "t", "p", 4)
    return rounded(out, *[c for c in out.columns if c != "n"])


@query(f"WITH {EV}, r AS (SELECT event_type, count(*) AS n, avg(CAST(k % 2 = 0 AS INT)) AS r FROM ev GROUP BY 1) SELECT event_type, n, round(r, 6) AS rate, round((SELECT max(r) - min(r) FROM r), 6) AS spread, round((SELECT max(r) FILTER (event_type = 'error') - max(r) FILTER (event_type = 'view') FROM r), 6) AS contrast FROM r")
def flag_rates(spark, d):
    from .queries import events

    return rounded(metrics.flag_rates(events(spark, d).withColumn("even", F.col("k") % 2 == 0), "even", "event_type", "error", "view"), "rate", "spread", "contrast")


#: a second opinion on each event: null, the same order reversed, or one with no overlap
_V = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN [ps[3], ps[2], ps[1]] WHEN event_id % 4 = 2 THEN [CASE WHEN ps[1] > 0 THEN 0.0 ELSE 2.0 END, CASE WHEN ps[2] > 0 THEN 0.0 ELSE 1.0 END, CASE WHEN ps[3] > 0 THEN 0.0 ELSE 1.0 END] ELSE ps END"


def _opinions(spark, d):
    ps, m = F.col("ps"), F.col("event_id") % 4
    none = lambda i, v: F.when(F.get(ps, F.lit(i)) > 0, 0.0).otherwise(v)
    v = F.when(m == 1, F.reverse(ps)).when(m == 2, F.array(none(0, 2.0), none(1, 1.0), none(2, 1.0))).when(m == 3, ps)
    return _probs(spark, d).withColumn("v", v).where("v IS NULL OR v[0] + v[1] + v[2] > 0")


def _fused_sql(policy: str) -> str:
    t, v = "[x / list_sum(ps) FOR x IN ps]", "[x / list_sum(v) FOR x IN v]"
    mix = {"pool": "list_transform(t, lambda x, i: 0.5 * x + 0.5 * w[i])", "product": "list_transform(t, lambda x, i: x * w[i])"}
    base = f"(SELECT event_id, {t} AS t, CASE WHEN v IS NOT NULL THEN {v} END AS w FROM op)"
    ids = "list_position(t, list_max(t)) AS ti, list_position(w, list_max(w)) AS wi"
    if policy == "agreement":
        return f"SELECT event_id, 'agreement' AS policy, CASE WHEN w IS NULL OR ti = wi THEN ti - 1 END AS cue, w IS NOT NULL AND ti <> wi AS contested FROM (SELECT *, {ids} FROM {base})"
    return f"SELECT event_id, '{policy}' AS policy, CASE WHEN w IS NULL THEN ti - 1 WHEN list_sum(f) > 0 THEN list_position(list_transform(f, lambda x: round(x, 9)), list_max(list_transform(f, lambda x: round(x, 9)))) - 1 END AS cue, w IS NOT NULL AND (ti <> wi OR list_sum(f) <= 0) AS contested FROM (SELECT *, {ids}, {mix[policy]} AS f FROM {base})"


@query(f"WITH {EV}, {_P}, op0 AS (SELECT event_id, ps, {_V} AS v FROM p), op AS (SELECT * FROM op0 WHERE v IS NULL OR list_sum(v) > 0), r AS ({' UNION ALL '.join(map(_fused_sql, ('agreement', 'pool', 'product')))}) SELECT policy, cue, contested, count(*) AS n FROM r GROUP BY 1, 2, 3")
def fused_cues(spark, d):
    """Two opinions of each event, fused by three policies."""
    each = F.array(*[F.struct(F.lit(p).alias("policy"), fusion.fuse(F.col("ps"), F.col("v"), p).alias("r")) for p in fusion.POLICIES])
    out = _opinions(spark, d).select(F.inline(each)).select("policy", "r.cue", "r.contested")
    return out.groupBy("policy", "cue", "contested").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, {_P}, op0 AS (SELECT event_id, ps, {_V} AS v FROM p), op AS (SELECT *, list_position(ps, list_max(ps)) AS ti, list_position(v, list_max(v)) AS vi FROM op0 WHERE v IS NULL OR list_sum(v) > 0)
SELECT event_type, count(*) AS n, count(v) AS n_compared, count(*) FILTER (ti = vi) AS n_agree, count(*) FILTER (ti <> vi) AS n_contested, round(count(*) FILTER (ti = vi) / CAST(nullif(count(v), 0) AS DOUBLE), 6) AS rate FROM op JOIN ev USING (event_id) GROUP BY 1""")
def fusion_agreement(spark, d):
    o = _opinions(spark, d).select("event_type", fusion.fuse(F.col("ps"), F.col("v"), "agreement").alias("f"))
    return rounded(fusion.agreement_summary(o, ["event_type"], "f"), "rate")


@query(f"WITH {_SCORED}, c AS (SELECT CAST(pos AS INT) AS y, least(greatest(score, 1e-12), 1 - 1e-12) AS p FROM s), l AS (SELECT y, ln(p / (1 - p)) AS z FROM c) SELECT count(*) AS n, round(avg(1 / (1 + exp(-z / 2.0))), 6) AS mean_at_2, round(avg(1 / (1 + exp(-z / 0.5))), 6) AS mean_at_half FROM l")
def tempered_means(spark, d):
    """Mean probabilities after two temperatures."""
    p = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    at = lambda t: F.round(F.avg(F.get(fusion.tempered(F.array(p, 1 - p), t), F.lit(0))), 6)
    return _scored(spark, d).agg(F.count("*").alias("n"), at(2.0).alias("mean_at_2"), at(0.5).alias("mean_at_half"))
