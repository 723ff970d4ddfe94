"""Queries on episodes, segments, resampling and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import folds, joins, resample, timeline
from .base import DAY, HOUR, query, rounded, table
from .queries import EV, RUNS, _YP, _predicted, events

#: overlaps at which episodes are scored
_LEVELS = [0.1, 0.25, 0.3, 0.5]
_SECONDS = 7200.0
_BUCKET = 5 * DAY


def _found(spark, d, keep=None):
    """Episodes of two channels, each with its own least duration, in the events that keep leaves."""
    ev = events(spark, d) if keep is None else events(spark, d).where(keep)
    each = ev.withColumn("channel", F.explode(F.array(F.lit("error"), F.lit("click"))))
    least = F.when(F.col("channel") == "error", 12 * HOUR).otherwise(6 * HOUR)
    return E.episodes(each, ["user_id", "channel"], "us", "event_id", F.col("event_type") == F.col("channel"), DAY, least).withColumnRenamed("episode", "id")


def _found_sql(name: str, keep: str = "true") -> str:
    return f"""{name}_s AS (
  SELECT *, lag(us) OVER w AS pt, lag(act) OVER w AS pa, max(CASE WHEN act THEN us END) OVER (PARTITION BY user_id, channel ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst
  FROM (SELECT e.*, c.channel, e.event_type = c.channel AS act FROM (SELECT * FROM ev WHERE {keep}) e, (SELECT unnest(['error', 'click']) AS channel) c) WINDOW w AS (PARTITION BY user_id, channel ORDER BY us, event_id)
), {name}_n AS (
  SELECT *, sum(CASE WHEN lst IS NULL OR (NOT pa AND pt - lst > {DAY}) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, channel ORDER BY us, event_id) AS episode FROM {name}_s WHERE act
), {name} AS (
  SELECT user_id, channel, CAST(episode AS BIGINT) AS id, min(us) AS t_start, max(us) AS t_end FROM {name}_n GROUP BY 1, 2, 3 HAVING max(us) - min(us) >= CASE WHEN channel = 'error' THEN {12 * HOUR} ELSE {6 * HOUR} END
)"""


@query(f"WITH {EV}, {_found_sql('ep')} SELECT * FROM ep")
def channel_episodes(spark, d):
    return _found(spark, d)


def _matched_sql(name: str, pred: str, levels: list[float]) -> str:
    return f"""{name}_c AS (
  SELECT g.user_id, g.channel, th, g.id AS g, p.id AS p, g.t_start AS gs, g.t_end AS ge, p.t_start AS ps, p.t_end AS pe,
    CASE WHEN greatest(g.t_end, p.t_end) > least(g.t_start, p.t_start) THEN greatest(least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start), 0) / CAST(greatest(g.t_end, p.t_end) - least(g.t_start, p.t_start) AS DOUBLE) ELSE CAST(g.t_start = p.t_start AS DOUBLE) END AS o
  FROM gold g JOIN {pred} p USING (user_id, channel), (SELECT unnest({levels}::DOUBLE[]) AS th)
), {name}_m AS (
  SELECT user_id, channel, th, unnest(list_reduce(list([{{'g': g, 'p': p, 'gs': gs, 'ge': ge, 'ps': ps, 'pe': pe}}] ORDER BY o DESC, p, g), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.g = x[1].g OR a.p = x[1].p)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m
  FROM {name}_c WHERE o >= th GROUP BY 1, 2, 3
), {name} AS (SELECT user_id, channel, th, m.g AS g, m.p AS p, abs(m.ps - m.gs) / 1e6 AS onset, abs(m.pe - m.ge) / 1e6 AS off, abs((m.pe - m.ps) - (m.ge - m.gs)) / 1e6 AS dur, greatest((m.ps - m.gs) / 1e6, 0) AS delay FROM {name}_m)"""


@query(f"""WITH {EV}, {_found_sql('gold')}, {_found_sql('pred', 'k % 5 <> 0')}, {_matched_sql('m', 'pred', _LEVELS)}, z AS (
  SELECT th, channel, 1 AS g, 0 AS p, 0 AS t, 0.0 AS onset, 0.0 AS off, 0.0 AS dur, 0.0 AS delay FROM gold, (SELECT unnest({_LEVELS}::DOUBLE[]) AS th) UNION ALL SELECT th, channel, 0, 1, 0, 0, 0, 0, 0 FROM pred, (SELECT unnest({_LEVELS}::DOUBLE[]) AS th) UNION ALL SELECT th, channel, 0, 0, 1, onset, off, dur, delay FROM m
), s AS (SELECT th, channel, CAST(sum(g) AS BIGINT) AS n_gt, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(t) AS BIGINT) AS matched, sum(onset) AS onset, sum(off) AS off, sum(dur) AS dur, sum(delay) AS delay FROM z GROUP BY GROUPING SETS ((th, channel), (th)))
SELECT th AS threshold, channel, n_gt, n_pred, matched, round(CASE WHEN n_pred > 0 THEN matched / n_pred ELSE 0 END, 6) AS precision, round(CASE WHEN n_gt > 0 THEN matched / n_gt ELSE 0 END, 6) AS recall,
  round(CASE WHEN matched > 0 THEN 2 * matched / CAST(n_gt + n_pred AS DOUBLE) ELSE 0 END, 6) AS f1, round((n_gt - matched) / CAST(nullif(n_gt, 0) AS DOUBLE), 6) AS missed_rate, round((n_pred - matched) / 2.0, 6) AS false_alerts_per_hour,
  round(onset / nullif(matched, 0), 4) AS onset_mae, round(off / nullif(matched, 0), 4) AS offset_mae, round(dur / nullif(matched, 0), 4) AS duration_mae, round(delay / nullif(matched, 0), 4) AS delay FROM s""")
def event_scores(spark, d):
    """Episodes found in four fifths of the events against those found in all of them."""
    out = E.event_scores(_found(spark, d), _found(spark, d, "k % 5 <> 0"), ["user_id"], _LEVELS, _SECONDS, _BUCKET)
    return rounded(rounded(out, "precision", "recall", "f1", "missed_rate", "false_alerts_per_hour"), "onset_mae", "offset_mae", "duration_mae", "delay", digits=4)


@query(f"""WITH {EV}, {_found_sql('gold')}, {_found_sql('p5', 'k % 5 <> 0')}, {_found_sql('p7', 'k % 7 <> 0')}, {_matched_sql('m5', 'p5', [0.3])}, {_matched_sql('m7', 'p7', [0.3])}, a AS (SELECT *, 'fifths' AS system FROM m5 UNION ALL SELECT *, 'sevenths' FROM m7
), c AS (SELECT user_id, channel, g FROM a GROUP BY 1, 2, 3 HAVING count(DISTINCT system) = 2)
SELECT system, count(*) AS n, round(avg(onset), 4) AS onset_mae, round(avg(off), 4) AS offset_mae, round(avg(dur), 4) AS duration_mae, round(avg(delay), 4) AS delay FROM a JOIN c USING (user_id, channel, g) GROUP BY 1""")
def common_boundaries(spark, d):
    """Boundary errors over the episodes that both of two systems find."""
    out = E.common_boundaries(_found(spark, d), {"fifths": _found(spark, d, "k % 5 <> 0"), "sevenths": _found(spark, d, "k % 7 <> 0")}, ["user_id"], 0.3, _BUCKET)
    return rounded(out, "onset_mae", "offset_mae", "duration_mae", "delay", digits=4)


@query(f"WITH {EV}, {_found_sql('gold')}, {_found_sql('p5', 'k % 5 <> 0')}, u AS (SELECT * FROM gold UNION ALL SELECT * FROM p5 UNION ALL SELECT user_id, 'alias', id, t_start, t_end FROM gold) SELECT channel, count(*) AS n FROM (SELECT DISTINCT user_id, channel, t_start // {HOUR}, t_end // {HOUR} FROM u WHERE channel <> 'alias') GROUP BY 1")
def distinct_episodes(spark, d):
    """Episodes of two systems without an alias channel and without doubles, times in whole hours."""
    gold = _found(spark, d)
    both = gold.unionByName(_found(spark, d, "k % 5 <> 0")).unionByName(gold.withColumn("channel", F.lit("alias")))
    hours = both.withColumns({c: F.floor(F.col(c) / HOUR) for c in ("t_start", "t_end")})
    return E.deduplicated(hours, ["user_id"], "channel", ["alias"], 0).groupBy("channel").agg(F.count("*").alias("n"))


def _segments_sql(name: str, col: str, p: str) -> str:
    return f"""{name} AS (SELECT user_id, CAST(seg AS BIGINT) AS {p}, {col} AS cls, min(pos) AS {p}a, max(pos) + 1 AS {p}b FROM (SELECT *, sum(CASE WHEN {col} IS NOT DISTINCT FROM pv THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS seg
  FROM (SELECT user_id, {col}, lag({col}) OVER (PARTITION BY user_id ORDER BY us, event_id) AS pv, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS pos FROM x)) GROUP BY 1, 2, 3)"""


def _seg_sql(th: float) -> str:
    return f"""o AS (SELECT user_id, cls, p, list({{'g': g, 'o': (least(gb, pb) - greatest(ga, pa)) / CAST(greatest(gb, pb) - least(ga, pa) AS DOUBLE)}} ORDER BY (least(gb, pb) - greatest(ga, pa)) / CAST(greatest(gb, pb) - least(ga, pa) AS DOUBLE) DESC, g) AS c FROM sg JOIN sp USING (user_id, cls) WHERE least(gb, pb) > greatest(ga, pa) GROUP BY 1, 2, 3
), f AS (SELECT user_id, cls, list_reduce(list([{{'c': c, 'u': CAST(-1 AS BIGINT)}}] ORDER BY p), lambda acc, x: list_append(acc, {{'c': x[1].c, 'u': coalesce((list_filter(list_filter(x[1].c, lambda q: NOT list_contains(list_transform(acc, lambda a: a.u), q.g))[1:1], lambda q: q.o >= {th}))[1].g, -1)}}), [{{'c': CAST([] AS STRUCT(g BIGINT, o DOUBLE)[]), 'u': CAST(-1 AS BIGINT)}}]) AS r FROM o GROUP BY 1, 2
), tp AS (SELECT user_id, sum(len(list_filter(r, lambda a: a.u >= 0))) AS tp FROM f GROUP BY 1)"""


@query(f"""WITH {_YP.removeprefix('WITH ')}, {_segments_sql('sg', 'y', 'g')}, {_segments_sql('sp', 'p', 'p')}, {_seg_sql(0.25)}
SELECT u.user_id, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST((SELECT count(*) FROM sp WHERE sp.user_id = u.user_id) - coalesce(tp, 0) AS BIGINT) AS fp, CAST((SELECT count(*) FROM sg WHERE sg.user_id = u.user_id) - coalesce(tp, 0) AS BIGINT) AS fn FROM (SELECT DISTINCT user_id FROM x) u LEFT JOIN tp USING (user_id)""")
def segment_matches(spark, d):
    """Segments of predicted types that match segments of true ones, by user."""
    return E.segment_matches(_predicted(spark, d), ["user_id"], ["us", "event_id"], "y", "p", 0.25)


@query(f"""WITH {_YP.removeprefix('WITH ')}, {_segments_sql('sg', 'y', 'g')}, {_segments_sql('sp', 'p', 'p')}, {_seg_sql(0.5)}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp FROM tp
), e AS (SELECT user_id, (SELECT string_agg(chr(CAST(65 + cls AS INTEGER)), '' ORDER BY g) FROM sg WHERE sg.user_id = u.user_id) AS a, (SELECT string_agg(chr(CAST(65 + cls AS INTEGER)), '' ORDER BY p) FROM sp WHERE sp.user_id = u.user_id) AS b, n FROM (SELECT user_id, count(*) AS n FROM x GROUP BY 1) u
), w AS (SELECT sum(n * 100.0 * (1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE))) / sum(n) AS edit FROM e)
SELECT tp, (SELECT count(*) FROM sp) - tp AS fp, (SELECT count(*) FROM sg) - tp AS fn, round(2 * tp / CAST((SELECT count(*) FROM sp) + (SELECT count(*) FROM sg) AS DOUBLE), 6) AS f1, round((SELECT edit FROM w), 6) AS edit FROM t""")
def segment_summary(spark, d):
    """F1 over the segments of all users, and their edit scores weighted by length."""
    x = _predicted(spark, d)
    f1 = E.segment_f1(E.segment_matches(x, ["user_id"], ["us", "event_id"], "y", "p", 0.5))
    edit = E.edit_score(x, ["user_id"], ["us", "event_id"], "y", "p").agg((F.sum(F.col("n") * F.col("edit")) / F.sum("n")).alias("edit"))
    return rounded(f1.join(F.broadcast(edit), F.lit(True)), "f1", "edit")


@query(f"""WITH {EV}, s AS (SELECT *, [k / 100.0, (100 - k) / 200.0, (100 - k) / 200.0] AS ps, CASE WHEN value > 60 AND row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) > 1 THEN 1 ELSE 0 END AS cut FROM ev
), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seg FROM s), m AS (SELECT user_id, seg, avg(k) AS k FROM g GROUP BY 1, 2)
SELECT event_id, CASE WHEN m.k * 2 >= 100 - m.k THEN 0 ELSE 1 END AS refined FROM g JOIN m USING (user_id, seg)""")
def relabelled(spark, d):
    """Classes of whole segments, cut where a value is high."""
    ev = events(spark, d).withColumn("ps", F.array(F.col("k") / 100.0, (100 - F.col("k")) / 200.0, (100 - F.col("k")) / 200.0))
    return E.relabelled(ev, ["user_id"], ["us", "event_id"], F.col("value") > 60, "ps").select("event_id", "refined")


@query(f"WITH {EV}, s AS (SELECT event_id, user_id, us, CASE WHEN k % 4 <> 0 THEN event_type END AS label FROM ev) SELECT event_id, coalesce(label <> lag(label) OVER (PARTITION BY user_id ORDER BY us, event_id), false) AS changed FROM s")
def label_changes(spark, d):
    ev = events(spark, d).withColumn("label", F.when(F.col("k") % 4 != 0, F.col("event_type")))
    return E.transitions(ev, ["user_id"], ["us", "event_id"], "label").select("event_id", "changed")


_CL = """c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS err, count(*) FILTER (event_type = 'click') AS clk, count(*) AS n, row_number() OVER (ORDER BY substr(md5(CAST(user_id AS VARCHAR)), 1, 3), user_id) - 1 AS i FROM events GROUP BY 1
), n AS (SELECT count(*) AS n FROM c), dr AS (SELECT id // n AS rep, CAST('0x' || substr(md5('0|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % n AS i FROM n, (SELECT unnest(range(100 * (SELECT n FROM n))) AS id)
), st AS (SELECT rep, sum(err) / CAST(sum(c.n) AS DOUBLE) AS e, sum(clk) / CAST(sum(c.n) AS DOUBLE) AS k FROM dr JOIN c USING (i) GROUP BY 1)"""


def _clusters(spark, d):
    kind = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, d, "events").groupBy("user_id").agg(kind("error").alias("err"), kind("click").alias("clk"), F.count("*").alias("n"))


@query(f"""WITH {_CL}, l AS (SELECT 'errors' AS statistic, e AS s, (SELECT sum(err) / CAST(sum(n) AS DOUBLE) FROM c) AS pt FROM st UNION ALL SELECT 'clicks', k, (SELECT sum(clk) / CAST(sum(n) AS DOUBLE) FROM c) FROM st)
SELECT statistic, round(max(pt), 6) AS point, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, round(avg(s), 6) AS boot_mean, round(stddev_samp(s), 6) AS boot_std FROM l GROUP BY 1""")
def bootstrap_many(spark, d):
    """Two shares from one set of draws of users."""
    out = resample.bootstrap_ratios(_clusters(spark, d), "user_id", {"errors": ("err", "n"), "clicks": ("clk", "n")}, resample.draws_for("share", 100))
    return rounded(out, "point", "low", "high", "boot_mean", "boot_std")


@query(f"""WITH {_CL}, sm AS (SELECT rep, sum(err) AS err, sum(clk) AS clk, sum(c.n) AS n FROM dr JOIN c USING (i) GROUP BY 1 UNION ALL SELECT NULL, sum(err), sum(clk), sum(n) FROM c
), l AS (SELECT rep, 'odds' AS statistic, err / CAST(n - err AS DOUBLE) AS s FROM sm UNION ALL SELECT rep, 'f1', 2 * err / CAST(err + clk + n AS DOUBLE) FROM sm)
SELECT statistic, round(max(s) FILTER (rep IS NULL), 6) AS point, round(quantile_cont(s, 0.025) FILTER (rep IS NOT NULL), 6) AS low, round(quantile_cont(s, 0.975) FILTER (rep IS NOT NULL), 6) AS high, round(avg(s) FILTER (rep IS NOT NULL), 6) AS boot_mean, round(stddev_samp(s) FILTER (rep IS NOT NULL), 6) AS boot_std FROM l GROUP BY 1""")
def bootstrap_metrics(spark, d):
    """Metrics given as expressions over the users' summed counts."""
    e, c, n = F.col("err"), F.col("clk"), F.col("n")
    out = resample.bootstrap_metrics(_clusters(spark, d), "user_id", ["err", "clk", "n"], {"odds": e / (n - e), "f1": 2 * e / (e + c + n)}, 100)
    return rounded(out, "point", "low", "high", "boot_mean", "boot_std")


@query(f"""WITH {_CL}, p AS (SELECT sum(err) / CAST(sum(n) AS DOUBLE) AS a, sum(clk) / CAST(sum(n) AS DOUBLE) AS b FROM c), q AS (SELECT quantile_cont(e - k, 0.025) AS low, quantile_cont(e - k, 0.975) AS high, stddev_samp(e - k) AS sd, least(1, 2 * least(avg(CAST(e - k <= 0 AS INT)), avg(CAST(e - k >= 0 AS INT)))) AS pv FROM st)
SELECT 'share' AS statistic, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(sd, 6) AS boot_std, round(pv, 6) AS p_value, low > 0 OR high < 0 AS significant FROM p, q""")
def bootstrap_paired(spark, d):
    """The difference of two shares on the same draws of users."""
    out = resample.paired_bootstrap(_clusters(spark, d), "user_id", {"share": ("err", "n")}, {"share": ("clk", "n")}, 100)
    return rounded(out, "a", "b", "difference", "low", "high", "boot_std", "p_value")


@query("""WITH v AS (SELECT o_orderpriority, year(o_orderdate) AS seed, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd, count(*) AS n FROM v GROUP BY 1)
SELECT o_orderpriority, round(m, 4) AS mean, round(sd, 4) AS std, n, round(m - 1.96 * sd / sqrt(n), 4) AS ci_low, round(m + 1.96 * sd / sqrt(n), 4) AS ci_high FROM s""")
def seed_summary(spark, d):
    """Mean and spread over years, which stand for seeds."""
    v = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(resample.seed_summary(v, ["o_orderpriority"], "v"), "mean", "std", "ci_low", "ci_high", digits=4)


@query("""WITH v AS (SELECT o_orderstatus AS cfg, o_orderpriority AS contrast, year(o_orderdate) AS seed, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3
), p AS (SELECT a.contrast, a.seed, a.v - b.v AS delta FROM v a JOIN v b ON a.contrast = b.contrast AND a.seed = b.seed AND a.cfg = 'F' AND b.cfg = 'O'), s AS (SELECT contrast, count(*) AS n, count(*) FILTER (delta > 500) AS n_significant FROM p GROUP BY 1)
SELECT contrast, n, n_significant, CASE WHEN n_significant = n THEN 'supported' WHEN n_significant > 0 THEN 'mixed' ELSE 'not supported' END AS verdict FROM s""")
def contrast_verdicts(spark, d):
    """Runs of two configurations paired by seed, and whether their difference holds for all seeds."""
    v = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("cfg"), F.col("o_orderpriority").alias("contrast"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    pairs = joins.paired(v.where("cfg = 'F'"), v.where("cfg = 'O'"), ["contrast", "seed"], "v").withColumn("significant", F.col("delta") > 500)
    return resample.verdicts(pairs, ["contrast"], "significant")


@query("""WITH c AS (SELECT doc_id, CAST(quality AS DOUBLE) AS x, CAST(n_chars % 100 AS DOUBLE) AS y FROM labels JOIN documents USING (doc_id)), z AS (SELECT doc_id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), doc_id) - 1 AS i FROM c
), m AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY md5('0|' || CAST(rep AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i FROM z, (SELECT unnest(range(40)) AS rep)), t AS (SELECT rep, abs(sum(z.x * m.y)) AS t FROM m JOIN z USING (i) GROUP BY 1), o AS (SELECT sum(x * y) AS t0 FROM z)
SELECT round(max(t0), 4) AS statistic, round(avg(CAST(t >= abs(t0) - 1e-9 AS INT)), 6) AS p_value FROM t, o""")
def permutation_test(spark, d):
    """Whether a document's length goes with its rating, by forty shuffles."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("x"), (F.col("n_chars") % 100).cast("double").alias("y"))
    out = resample.permutation_test(x, "doc_id", "x", "y", 40)
    return out.select(F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {DAY} THEN 1 ELSE 0 END AS gap FROM ev), p AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS part FROM g)
SELECT user_id, part, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY part) - 1 AS sample FROM p GROUP BY 1, 2 HAVING count(*) >= 3""")
def sample_numbers(spark, d):
    """Numbers of each user's stretches without gaps, in order."""
    parts = timeline.with_chunks(events(spark, d), ["user_id"], ["us", "event_id"], DAY, 1 << 30, 3)
    return timeline.numbered_samples(parts.groupBy("user_id", "part").agg(F.count("*").alias("n")), ["user_id"], ["part"])


_AROUND = "list_transform(range(-2, 3), lambda o: ys[greatest(least(pos + o, len(ys)), 1)])"


@query(f"""WITH {_YP.removeprefix('WITH ')}, a AS (SELECT event_id, list(p) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ys, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM x
), w AS (SELECT event_id, {_AROUND} AS v FROM a), c AS (SELECT event_id, u, count(*) AS n FROM (SELECT event_id, unnest(v) AS u FROM w) GROUP BY 1, 2) SELECT event_id, u AS smooth FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, u) = 1""")
def mode_filter(spark, d):
    """The most frequent label among five around each event; ends are repeated."""
    return timeline.with_mode_filter(_predicted(spark, d), ["user_id"], ["us", "event_id"], "p", 5).select("event_id", F.col("smooth").cast("long").alias("smooth"))


@query(f"WITH {EV}, s AS (SELECT event_id, user_id, us, (value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id), value)) AS step FROM ev) SELECT event_id, 3 AS copies, round(step, 6) AS step FROM s")
def oversampled(spark, d):
    """Each event three times on a finer clock, a step computed there and read back at the first copy."""
    fine = timeline.oversampled(events(spark, d), 3)
    stepped = timeline.with_motion(fine, ["user_id"], ["us", "event_id", "copy"], "value")
    back = stepped.where("copy = 0").select("event_id", F.lit(3).alias("copies"), F.round("step", 6).alias("step"))
    return back


@query(f"""WITH {EV}, a AS (SELECT user_id, event_id, row_number() OVER w AS pos, avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m8, avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m4 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, round(m4, 6) AS mean_4, round(m8, 6) AS mean_8 FROM a WHERE pos >= 8 AND (pos - 1) % 5 = 0""")
def causal_windows(spark, d):
    """Means of windows of 4 and 8 events at every fifth position that both have."""
    four = timeline.causal_windows(events(spark, d), ["user_id"], ["us", "event_id"], "value", 4, 5)
    eight = timeline.causal_windows(events(spark, d), ["user_id"], ["us", "event_id"], "value", 8, 5)
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c), 6)
    return four.select("event_id", mean("window").alias("mean_4")).join(eight.select("event_id", mean("window").alias("mean_8")), "event_id")


@query(f"""WITH {EV}, l AS (SELECT user_id, list_reduce(list([{{'o': us, 'h': CASE WHEN event_id % 11 > 0 THEN k END, 'a': CASE WHEN event_id % 11 > 0 THEN k END, 'keep': true}}] ORDER BY us), lambda acc, x: list_append(acc, CASE WHEN x[1].h IS NULL THEN {{'o': x[1].o, 'h': x[1].h, 'a': acc[-1].a, 'keep': true}}
  WHEN acc[-1].a IS NULL OR bit_count(xor(x[1].h, acc[-1].a)) >= 3 THEN x[1] ELSE {{'o': x[1].o, 'h': x[1].h, 'a': acc[-1].a, 'keep': false}} END)) AS r FROM ev GROUP BY 1)
SELECT user_id, m.o AS us, m.h AS h FROM (SELECT user_id, unnest(r) AS m FROM l) WHERE m.keep""")
def hash_anchors(spark, d):
    """Events whose hash differs by three bits or more from the last one kept; those without a hash are kept and move nothing."""
    ev = events(spark, d).withColumn("h", F.when(F.col("event_id") % 11 > 0, F.col("k")))
    return folds.keep_by_hash(ev, ["user_id"], "us", "h", 3)
