"""Queries over the given tables, each with the same result as SQL.

Stand-ins: events are timelines (user_id is the track, event_type the cue, times in microseconds), labels are annotations,
boxes are integer functions of lineitem keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import labels as L
from ..functions.geometry import box, giou, iof, iou_closed
from ..operators import detection, folds, joins, metrics, resample, sampling, timeline
from ..operators import episodes as E
from ..sources import jsonl
from ..streaming import stateful
from .base import DAY, HOUR, QUERIES, SQL, query, table  # noqa: F401

CUES = ["click", "error", "purchase", "signup", "view"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
EPISODES = f"""{EV}, s AS (
  SELECT *, lag(us) OVER w AS pt, lag(act) OVER w AS pa, max(CASE WHEN act THEN us END) OVER (PARTITION BY user_id, channel ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst
  FROM (SELECT e.*, c.channel, e.event_type = c.channel AS act FROM ev e, (SELECT unnest(['error', 'click']) AS channel) c) WINDOW w AS (PARTITION BY user_id, channel ORDER BY us, event_id)
), n AS (
  SELECT *, sum(CASE WHEN lst IS NULL OR (NOT pa AND pt - lst > {24 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, channel ORDER BY us, event_id) AS episode FROM s WHERE act
), ep AS (
  SELECT user_id, channel, episode, min(us) AS t_start, max(us) AS t_end FROM n GROUP BY 1, 2, 3 HAVING max(us) - min(us) >= {12 * HOUR}
)"""


def _episodes(spark, d, *channels: str) -> DataFrame:
    each = events(spark, d).withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return E.episodes(each, ["user_id", "channel"], "us", "event_id", F.col("event_type") == F.col("channel"), 24 * HOUR, 12 * HOUR)


@query(f"WITH {EPISODES} SELECT user_id, channel, CAST(episode AS BIGINT) AS episode, t_start, t_end FROM ep")
def episodes(spark, d):
    return _episodes(spark, d, "error", "click")


@query(f"WITH {EPISODES} SELECT channel, count(*) AS n, CAST(sum(t_end - t_start) AS BIGINT) AS total_us, round(avg(t_end - t_start) / 1e6, 6) AS mean_s FROM ep GROUP BY ROLLUP (channel)")
def episode_summary(spark, d):
    return _episodes(spark, d, "error", "click").rollup("channel").agg(F.count("*").alias("n"), F.sum(F.col("t_end") - F.col("t_start")).alias("total_us"), F.round(F.avg(F.col("t_end") - F.col("t_start")) / 1e6, 6).alias("mean_s"))


RUNS = f"""{EV}, f AS (
  SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS run FROM f)"""


@query(f"WITH {RUNS} SELECT user_id, run, event_type, min(us) AS t_start, max(us) AS t_end, count(*) AS n FROM r GROUP BY 1, 2, 3")
def run_length(spark, d):
    return timeline.runs(events(spark, d), ["user_id"], ["us", "event_id"], "event_type")


@query(f"""WITH {EPISODES}, {RUNS.removeprefix(EV + ", ")}, o AS (
  SELECT user_id, min(us) AS a FROM r WHERE event_type <> 'error' GROUP BY user_id, run HAVING max(us) - min(us) >= {HOUR}
) SELECT ep.user_id, ep.t_end, (SELECT min(a) FROM o WHERE o.user_id = ep.user_id AND o.a > ep.t_end) AS t_return FROM ep WHERE channel = 'error'
  AND EXISTS (SELECT 1 FROM o WHERE o.user_id = ep.user_id AND o.a > ep.t_end)""")
def return_markers(spark, d):
    ev = events(spark, d)
    on = timeline.runs(ev, ["user_id"], ["us", "event_id"], "event_type").where("event_type <> 'error'")
    return E.return_markers(_episodes(spark, d, "error"), on, ["user_id"], HOUR).select("user_id", "t_end", "t_return")


@query(f"WITH {RUNS} SELECT event_id, us - min(us) OVER (PARTITION BY user_id, run) AS dwell FROM r")
def dwell(spark, d):
    return timeline.with_dwell(events(spark, d), ["user_id"], ["us", "event_id"], "event_type").select("event_id", "dwell")


_COUNTS = ", ".join(f"count(*) FILTER (event_type = '{c}') OVER w AS c{i}" for i, c in enumerate(CUES))
_PICK = "CASE " + " ".join(f"WHEN c{i} = greatest(c0, c1, c2, c3, c4) THEN '{c}'" for i, c in enumerate(CUES)) + " END"


@query(f"WITH {EV}, c AS (SELECT event_id, {_COUNTS} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW)) SELECT event_id, {_PICK} AS majority FROM c")
def trailing_majority(spark, d):
    return timeline.with_trailing_majority(events(spark, d), ["user_id"], "us", "event_type", CUES, 7 * DAY).select("event_id", "majority")


@query(f"""WITH {EV}, g AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {DAY} THEN 1 ELSE 0 END AS gap FROM ev
), p AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS part FROM g
), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, part ORDER BY us, event_id) - 1) // 8 AS chunk FROM p)
SELECT user_id, part, chunk, count(*) AS n, min(us) AS t_start, max(us) AS t_end FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def chunks(spark, d):
    out = timeline.with_chunks(events(spark, d), ["user_id"], ["us", "event_id"], DAY, 8, 3)
    return out.groupBy("user_id", "part", "chunk").agg(F.count("*").alias("n"), F.min("us").alias("t_start"), F.max("us").alias("t_end"))


@query(f"""WITH {EV}, s AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id), 0.0) AS step FROM ev)
SELECT event_id, round(step, 6) AS step, round(avg(step) OVER w, 6) AS step_mean, round(stddev_pop(step) OVER w, 6) AS step_dev FROM s
WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def motion(spark, d):
    out = timeline.with_motion(events(spark, d), ["user_id"], ["us", "event_id"], "value")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("step", "step_mean", "step_dev")])


@query(f"""WITH {EV}, m AS (SELECT user_id, median(value) AS med, count(*) AS n FROM ev WHERE event_type <> 'error' GROUP BY 1)
SELECT event_id, round(CASE WHEN event_type <> 'error' AND n >= 3 THEN value - med ELSE 0 END, 6) AS deviation FROM ev LEFT JOIN m USING (user_id)""")
def baseline_deviation(spark, d):
    return timeline.with_baseline(events(spark, d), ["user_id"], "value", F.col("event_type") != "error").select("event_id", F.round("deviation", 6).alias("deviation"))


@query(f"""WITH {EV}, p AS (SELECT user_id, us // {DAY} AS day, avg(value) AS v FROM ev GROUP BY 1, 2
), n AS (SELECT *, lead(day) OVER w AS d2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day)
), x AS (SELECT user_id, day AS d1, v AS v1, d2, v2, unnest(range(day, CASE WHEN d2 - day > 1 AND d2 - day < 20 THEN d2 ELSE day + 1 END)) AS day FROM n)
SELECT user_id, day, round(CASE WHEN day > d1 THEN v1 + (v2 - v1) * (CAST(day - d1 AS DOUBLE) / (d2 - d1)) ELSE v1 END, 6) AS v, day > d1 AS filled FROM x""")
def gap_filling(spark, d):
    days = events(spark, d).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.avg("value").alias("v"))
    return timeline.interpolated(days, ["user_id"], "day", "v", 20).withColumn("v", F.round("v", 6))


@query(f"WITH {EV} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev QUALIFY rank <= 3")
def rank_cap(spark, d):
    return timeline.best_rows(events(spark, d), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "rank")


@query(f"WITH {EV} SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 4) AS z FROM ev WINDOW w AS (PARTITION BY user_id)")
def z_scores(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return events(spark, d).select("event_id", F.round((F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-8), 4).alias("z"))


def _rules() -> list:
    t, k, v = F.col("event_type"), F.col("k"), F.col("value")
    return [("alert", (t == "error") & (k >= 50)), ("off_task", t.isin("error", "signup") | (v < 5)), ("engaged", (t == "purchase") & (k < 80)), ("on_task", t.isin("view", "click"))]


_RULES = {"alert": "event_type = 'error' AND k >= 50", "off_task": "event_type IN ('error', 'signup') OR value < 5", "engaged": "event_type = 'purchase' AND k < 80", "on_task": "event_type IN ('view', 'click')"}
_FIRST = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULES.items()) + " ELSE 'uncertain' END"


@query(f"WITH {EV} SELECT {_FIRST} AS cue, count(*) AS n, round(avg(value), 6) AS mean_value FROM ev GROUP BY 1")
def first_match_rules(spark, d):
    return events(spark, d).withColumn("cue", L.first_match(_rules(), "uncertain")).groupBy("cue").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


_ALL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {EV}, m AS (SELECT CASE WHEN {_RULES['alert']} THEN ['alert'] WHEN len({_ALL}) = 0 THEN ['uncertain'] ELSE {_ALL} END AS cand FROM ev) SELECT array_to_string(cand, '+') AS combination, len(cand) AS size, count(*) AS n FROM m GROUP BY 1, 2")
def candidate_sets(spark, d):
    c = L.all_matches(_rules(), "uncertain", "alert")
    return events(spark, d).select(c.alias("c")).groupBy(F.array_join("c", "+").alias("combination"), F.size("c").cast("long").alias("size")).agg(F.count("*").alias("n"))


_MAP = "(VALUES ('view', 'on'), ('click', 'on'), ('purchase', 'on'), ('error', 'off')) m(event_type, grp)"


@query(f"WITH {EV} SELECT grp, count(*) AS n, count(DISTINCT user_id) AS users FROM ev LEFT JOIN {_MAP} USING (event_type) GROUP BY 1")
def taxonomy_regroup(spark, d):
    lookup = spark.sql(f"SELECT * FROM VALUES ('view', 'on'), ('click', 'on'), ('purchase', 'on'), ('error', 'off') AS m(event_type, grp)")
    return events(spark, d).join(F.broadcast(lookup), "event_type", "left").groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {EV}, m AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, event_type FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def majority_label(spark, d):
    n = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "event_type")).alias("m")).select("user_id", "m.event_type")


@query(r"""SELECT role, clean, count(*) AS n FROM (SELECT role, CASE WHEN c IN ('user', 'assistant', 'other') THEN c ELSE 'other' END AS clean FROM (SELECT role, replace(lower(regexp_replace(chr(9) || ' ' || upper(role) || ' ' || chr(10), '^\s+|\s+$', '', 'g')), ' ', '_') AS c FROM conversations)) GROUP BY 1, 2""")
def coerce_labels(spark, d):
    raw = F.concat(F.lit("\t "), F.upper("role"), F.lit(" \n"))
    return table(spark, d, "conversations").select("role", L.coerce_enum(raw, ["user", "assistant", "other"]).alias("clean")).groupBy("role", "clean").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, k, k % 2 = 0 AS even FROM ev")
def parse_answers(spark, d):
    text = F.concat(F.lit("<think>{\"k\": 0}\n</think> The answer is "), F.col("props"), F.lit("."))
    out = table(spark, d, "events").select("event_id", L.parse_answer(text, "k bigint")["k"].alias("k"))
    return out.select("event_id", "k", L.coerce_bool(F.when(F.col("k") % 2 == 0, " Yes\n").otherwise("no")).alias("even"))


@query("SELECT event_id % 5 < 4 AS parsed, CASE WHEN event_id % 5 < 4 AND event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS activity, event_id % 5 < 4 AND event_id % 2 = 0 AS talking, count(*) AS n, count(*) FILTER (event_id % 5 < 2) AS with_confidence FROM events GROUP BY 1, 2, 3")
def parsed_records(spark, d):
    """Records parsed from model answers; those without a JSON object have all defaults."""
    i = F.col("event_id")
    confidence = F.when(i % 5 < 2, F.lit("0.5")).otherwise(F.lit('"high"'))
    body = F.concat(F.lit('{"activity": " '), F.upper("event_type"), F.lit('\\t", "talking": '), F.when(i % 2 == 0, "true").otherwise('"maybe"'), F.lit(', "model_confidence": '), confidence, F.lit("}"))
    text = F.when(i % 5 < 4, F.concat(F.lit("<think>{}</think>"), body, F.lit(" ok"))).otherwise(F.lit("I can't say"))
    rec = L.parsed_record(text, {"activity": ["click", "view", "unknown"]}, ["talking"])
    out = table(spark, d, "events").select(rec.alias("r")).select("r.*")
    return out.groupBy("parsed", "activity", "talking").agg(F.count("*").alias("n"), F.count("model_confidence").alias("with_confidence"))


_REASON = "CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discount' WHEN l_extendedprice < 2000 THEN 'cheap' END"


@query(f"SELECT {_REASON} AS drop_reason, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def ordered_gates(spark, d):
    gate = L.first_match([("small", F.col("l_quantity") < 5), ("discount", F.col("l_discount") > 0.08), ("cheap", F.col("l_extendedprice") < 2000)], "")
    return table(spark, d, "lineitem").groupBy(F.nullif(gate, F.lit("")).alias("drop_reason")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS top FROM events GROUP BY 1")
def latency_profile(spark, d):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("value").alias("top"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    return table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


_YP = f"WITH {EV}, x AS (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS y, CASE WHEN k % 3 = 0 THEN k % 5 ELSE list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 END AS p FROM ev)"


def _predicted(spark, d) -> DataFrame:
    y = F.array_position(F.array(*map(F.lit, CUES)), F.col("event_type")) - 1
    return events(spark, d).withColumn("y", y).withColumn("p", F.when(F.col("k") % 3 == 0, F.col("k") % 5).otherwise(y))


@query(f"{_YP} SELECT y AS t, p, count(*) AS n FROM x GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_predicted(spark, d), "y", "p", 5)


_PRF = f"""{_YP}, c AS (SELECT unnest(range(5)) AS cls), s AS (
  SELECT cls, count(*) FILTER (y = cls AND p = cls) AS tp, count(*) FILTER (y = cls) AS support, count(*) FILTER (p = cls) AS called FROM x, c GROUP BY 1
), m AS (SELECT cls, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re, support, tp FROM s
), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""


@query(f"{_PRF} SELECT cls, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def class_scores(spark, d):
    out = metrics.per_class(metrics.confusion(_predicted(spark, d), "y", "p", 5), 5)
    return out.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"{_PRF} SELECT round(avg(f1), 6) AS macro_f1, round(avg(re), 6) AS balanced_accuracy, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(support), 6) AS accuracy FROM f WHERE support > 0")
def score_summary(spark, d):
    out = metrics.summary(metrics.confusion(_predicted(spark, d), "y", "p", 5), 5)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (quality = 1 - toxic) AS s FROM labels
), e AS (SELECT sum(a.n * b.n) AS e FROM (SELECT quality AS v, count(*) AS n FROM labels GROUP BY 1) a JOIN (SELECT 1 - toxic AS v, count(*) AS n FROM labels GROUP BY 1) b USING (v))
SELECT round(s / n, 6) AS agreement, round(CASE WHEN e / (n * n) = 1 THEN 1 ELSE (s / n - e / (n * n)) / (1 - e / (n * n)) END, 6) AS kappa FROM n, e""")
def cohen_kappa(spark, d):
    out = metrics.kappa(table(spark, d, "labels").withColumn("safe", 1 - F.col("toxic")), [], "quality", "safe")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""{_YP}, o AS (SELECT sum(power(y - p, 2) / 16.0) AS o, CAST(count(*) AS DOUBLE) AS n FROM x
), e AS (SELECT sum(power(a.y - b.p, 2) / 16.0 * a.n * b.n) AS e FROM (SELECT y, count(*) AS n FROM x GROUP BY 1) a, (SELECT p, count(*) AS n FROM x GROUP BY 1) b)
SELECT round(1 - o / (e / n), 6) AS qwk FROM o, e""")
def quadratic_kappa(spark, d):
    return metrics.weighted_kappa(metrics.confusion(_predicted(spark, d), "y", "p", 5), 5).select(F.round("qwk", 6).alias("qwk"))


@query(f"{_YP} SELECT y AS a, p AS b, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM x WHERE y <> p GROUP BY 1, 2")
def transition_table(spark, d):
    n = _predicted(spark, d).where("y <> p").groupBy(F.col("y").alias("a"), F.col("p").alias("b")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("a", "b", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_SCORED = "s AS (SELECT doc_id, quality = 1 AS pos, round((n_chars % 1000) / 1000.0, 3) AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("pos"), F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("score"), (F.col("n_chars") % 3).alias("grp"))


@query(f"WITH {_SCORED}, r AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auroc FROM r")
def auroc(spark, d):
    return metrics.auroc(_scored(spark, d), [], "score", "pos").select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {_SCORED}, r AS (SELECT pos, sum(CAST(pos AS INT)) OVER w AS tp, row_number() OVER w AS rk FROM s WINDOW w AS (ORDER BY score DESC, doc_id)) SELECT round(sum(tp / rk) FILTER (pos) / count(*) FILTER (pos), 6) AS average_precision FROM r")
def average_precision(spark, d):
    one = _scored(spark, d).withColumn("all", F.lit(0))
    return metrics.average_precision(one, ["all"], "score", "pos", "doc_id").select(F.round("average_precision", 6).alias("average_precision"))


_BIN = "least(greatest(CAST(ceil(score * 15) AS BIGINT) - 1, 0), 14)"


@query(f"WITH {_SCORED} SELECT {_BIN} AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(CAST(pos AS INT)), 6) AS accuracy FROM s GROUP BY 1")
def reliability_bins(spark, d):
    return metrics.reliability(_scored(spark, d), "score", "pos").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


_ECE = "(SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM (SELECT count(*) AS n, avg(score) AS c, avg(CAST(pos AS INT)) AS a FROM s GROUP BY {}))"


@query(f"WITH {_SCORED} SELECT {_ECE.format(_BIN)} AS ece_right, {_ECE.format('least(CAST(floor(score * 10) AS BIGINT), 9)')} AS ece_left, (SELECT round(avg(power(score - CAST(pos AS INT), 2)), 6) FROM s) AS brier, (SELECT round(avg(-ln(greatest(CASE WHEN pos THEN score ELSE 1 - score END, 1e-12))), 6) FROM s) AS nll")
def calibration_errors(spark, d):
    s = _scored(spark, d)
    right = metrics.calibration_error(metrics.reliability(s, "score", "pos")).select(F.round("ece", 6).alias("ece_right"))
    left = metrics.calibration_error(metrics.reliability(s, "score", "pos", 10, False)).select(F.round("ece", 6).alias("ece_left"))
    rest = s.agg(F.round(F.avg(F.pow(F.col("score") - F.col("pos").cast("int"), 2)), 6).alias("brier"), F.round(F.avg(-F.log(F.greatest(F.when(F.col("pos"), F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-12)))), 6).alias("nll"))
    return right.join(F.broadcast(left), F.lit(True)).join(F.broadcast(rest), F.lit(True))


@query(f"WITH {_SCORED}, t AS (SELECT unnest(range(50)) AS i) SELECT i / 50.0 AS threshold, round(count(*) FILTER (lv >= i) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (lv >= i AND NOT pos) / CAST(nullif(count(*) FILTER (lv >= i), 0) AS DOUBLE), 6) AS risk FROM t, (SELECT least(CAST(floor(score * 50) AS BIGINT), 49) AS lv, pos FROM s) GROUP BY 1")
def coverage_risk(spark, d):
    return metrics.coverage_risk(_scored(spark, d), "score", "pos").select("threshold", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(f"WITH {EV}, r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS b FROM ev) SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman(spark, d):
    return metrics.spearman(events(spark, d), ["event_type"], "value", "k").withColumn("spearman", F.round("spearman", 6))


@query(f"WITH {EV}, n AS (SELECT k % 2 AS f, event_type AS c, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY f) AS nf, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS al FROM n) SELECT round(sum(n / al * log2(n * al / (nf * nc))), 8) AS bits FROM m")
def mutual_information(spark, d):
    return metrics.mutual_information(events(spark, d).withColumn("f", F.col("k") % 2), "f", "event_type").select(F.round("bits", 8).alias("bits"))


@query(f"""WITH o AS (SELECT o_orderkey AS key, epoch_us(o_orderdate) AS t FROM orders), l AS (SELECT l_orderkey AS key, epoch_us(l_shipdate) AS s, l_quantity FROM lineitem)
SELECT key, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM o JOIN l USING (key) WHERE abs(t - s) <= {30 * DAY} GROUP BY 1 HAVING count(*) >= 2""")
def band_join(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), us("o_orderdate").alias("t"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), us("l_shipdate").alias("s"), "l_quantity")  # noqa: E741
    return joins.band_join(o, l, ["key"], "t", "s", 30 * DAY).groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity")).where("n >= 2")


@query(f"""WITH {EV}, j AS (SELECT e.event_id, e.us - p.us AS age, p.value FROM (SELECT * FROM ev WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.us >= p.us)
SELECT event_id, CASE WHEN age <= {3 * DAY} THEN age END AS age, CASE WHEN age <= {3 * DAY} THEN value END AS purchase FROM j""")
def as_of_join(spark, d):
    ev = events(spark, d)
    errors, bought = ev.where("event_type = 'error'").select("user_id", "us", "event_id"), ev.where("event_type = 'purchase'").select("user_id", "us", "event_id", F.col("value").alias("purchase"))
    return joins.as_of_join(errors, bought, ["user_id"], "us", "event_id", ["purchase"], 3 * DAY).select("event_id", "age", "purchase")


@query(f"""WITH {EPISODES} SELECT g.user_id, CAST(g.episode AS BIGINT) AS g_id, CAST(p.episode AS BIGINT) AS p_id, round((least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / CAST(greatest(g.t_end, p.t_end) - least(g.t_start, p.t_start) AS DOUBLE), 6) AS tiou
FROM ep g JOIN ep p ON g.user_id = p.user_id AND g.channel = 'error' AND p.channel = 'click' AND least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start) >= 0.1 * (greatest(g.t_end, p.t_end) - least(g.t_start, p.t_start))""")
def interval_overlaps(spark, d):
    ep = _episodes(spark, d, "error", "click").withColumnRenamed("episode", "id")
    return E.overlapping(ep.where("channel = 'error'"), ep.where("channel = 'click'"), ["user_id"], 0.1, 5 * DAY).select("user_id", "g_id", "p_id", F.round("tiou", 6).alias("tiou"))


_ONE = "list_reduce({items}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.g = x[1].g OR a.p = x[1].p)) > 0 THEN acc ELSE list_concat(acc, x) END)"


@query(f"""WITH {EPISODES}, c AS (SELECT g.user_id, CAST(g.episode AS BIGINT) AS g, CAST(p.episode AS BIGINT) AS p, (least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / CAST(greatest(g.t_end, p.t_end) - least(g.t_start, p.t_start) AS DOUBLE) AS o
  FROM ep g JOIN ep p ON g.user_id = p.user_id AND g.channel = 'error' AND p.channel = 'click' AND least(g.t_end, p.t_end) >= greatest(g.t_start, p.t_start)
), m AS (SELECT user_id, unnest({_ONE.format(items="list([{'g': g, 'p': p, 'o': o}] ORDER BY o DESC, g DESC, p DESC)")}) AS m FROM c WHERE o >= 0.05 GROUP BY 1)
SELECT user_id, m.g AS g_id, m.p AS p_id, round(m.o, 6) AS tiou FROM m""")
def episode_matching(spark, d):
    """Greedy one-to-one matches."""
    ep = _episodes(spark, d, "error", "click").withColumnRenamed("episode", "id")
    pairs = E.overlapping(ep.where("channel = 'error'"), ep.where("channel = 'click'"), ["user_id"], 0.05, 5 * DAY)
    return E.greedy_matches(pairs, ["user_id"]).withColumn("tiou", F.round("tiou", 6))


_SEQ = "{name} AS (SELECT user_id, string_agg(chr(CAST(65 + {col} AS INTEGER)), '' ORDER BY us, event_id) AS {name} FROM (SELECT *, lag({col}) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b FROM x) WHERE b IS NULL OR b <> {col} GROUP BY 1)"


@query(f"{_YP}, {_SEQ.format(name='sy', col='y')}, {_SEQ.format(name='sp', col='p')} SELECT user_id, round(100.0 * (1 - levenshtein(sy, sp) / CAST(greatest(length(sy), length(sp)) AS DOUBLE)), 6) AS edit FROM sy JOIN sp USING (user_id)")
def edit_scores(spark, d):
    """Edit score of two run sequences."""
    return E.edit_score(_predicted(spark, d), ["user_id"], ["us", "event_id"], "y", "p").select("user_id", F.round("edit", 6).alias("edit"))


@query(f"""WITH {RUNS}, k AS (SELECT user_id, event_type, unnest(list_reduce(list([us] ORDER BY us, event_id), lambda acc, x: CASE WHEN x[1] - acc[-1] >= {2 * DAY} THEN list_concat(acc, x) ELSE acc END)) AS us FROM r GROUP BY user_id, run, event_type)
SELECT user_id, us, event_type FROM k""")
def stride_dedup(spark, d):
    """Rows kept by state change or stride."""
    return folds.keep_by_stride(events(spark, d), ["user_id"], "us", "event_type", 2 * DAY)


@query("SELECT conv_id, turn, text, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r = 1")
def latest_per_key(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    counts = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return joins.latest(c, ["conv_id"], ["turn", "text"]).join(counts, "conv_id").select("conv_id", "turn", "text", "n")


@query("SELECT d.doc_id, coalesce(l.quality, CAST(d.n_chars > 1000 AS INT)) AS quality, l.quality IS NULL AS pseudo FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic = 0")
def annotation_override(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    return docs.join(lab, "doc_id", "left").where("toxic IS NULL OR toxic = 0").select("doc_id", F.coalesce("quality", (F.col("n_chars") > 1000).cast("int")).alias("quality"), F.col("quality").isNull().alias("pseudo"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)")
def restore_frames(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.join(l.where("l_discount >= 0.1").select("l_orderkey"), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, d):
    left = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT s_suppkey, coalesce(n1.n_name, n2.n_name) AS n_name FROM supplier s LEFT JOIN nation n1 ON n1.n_nationkey = s.s_nationkey + 10 LEFT JOIN nation n2 ON n2.n_nationkey = s.s_nationkey")
def fallback_keys(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return joins.fallback_join(s, n, [F.col("s_nationkey") + 10, F.col("s_nationkey")], "n_nationkey", "n_name").select("s_suppkey", "n_name")


def _boxes(spark, d, p: str, shift: int) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_suppkey")
    x, y = (k * 7 + shift) % 60, (n * 11 + shift) % 60
    w, h = 20 + (k * 13) % 40, 20 + (n * 17) % 40
    score = ((F.col("l_partkey") * 31 + F.col("l_linenumber") * 7) % 100) / 100.0
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias(f"{p}id"), x.alias(f"{p}x1"), y.alias(f"{p}y1"), (x + w).alias(f"{p}x2"), (y + h).alias(f"{p}y2"), score.alias(f"{p}score"), F.col("l_returnflag").alias(f"{p}cls"))


def _sql_boxes(p: str, shift: int) -> str:
    x, y = f"(l_partkey * 7 + {shift}) % 60", f"(l_suppkey * 11 + {shift}) % 60"
    return f"SELECT l_orderkey AS frame, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS {p}id, {x} AS {p}x1, {y} AS {p}y1, {x} + 20 + (l_partkey * 13) % 40 AS {p}x2, {y} + 20 + (l_suppkey * 17) % 40 AS {p}y2, ((l_partkey * 31 + l_linenumber * 7) % 100) / 100.0 AS {p}score, l_returnflag AS {p}cls FROM lineitem"


_PAIRS = f"""a AS ({_sql_boxes('a', 0)}), b AS ({_sql_boxes('b', 9)}), ab AS (
  SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i, (ax2 - ax1) * (ay2 - ay1) AS sa, (bx2 - bx1) * (by2 - by1) AS sb FROM a JOIN b USING (frame))"""


@query(f"WITH {_PAIRS} SELECT frame, aid, bid, round(i / CAST(sa + sb - i AS DOUBLE), 6) AS iou FROM ab WHERE i / CAST(sa + sb - i AS DOUBLE) >= 0.5")
def spatial_join(spark, d):
    return joins.spatial_join(_boxes(spark, d, "a", 0), _boxes(spark, d, "b", 9), ["frame"], box("a"), box("b"), 0.5).select("frame", "aid", "bid", F.round("iou", 6).alias("iou"))


@query(f"WITH {_PAIRS} SELECT frame, aid, count(*) AS inside, max(bscore) AS best FROM ab WHERE (bx1 + bx2) / 2.0 BETWEEN ax1 AND ax2 AND (by1 + by2) / 2.0 BETWEEN ay1 AND ay2 GROUP BY 1, 2")
def containment_join(spark, d):
    both = joins.containment_join(_boxes(spark, d, "a", 0), _boxes(spark, d, "b", 9), ["frame"], box("a"), box("b"))
    return both.groupBy("frame", "aid").agg(F.count("*").alias("inside"), F.max("bscore").alias("best"))


@query(f"""WITH {_PAIRS}, h AS (SELECT *, CAST(greatest(ax2, bx2) - least(ax1, bx1) AS DOUBLE) * (greatest(ay2, by2) - least(ay1, by1)) AS hull, CAST(sa + sb - i AS DOUBLE) AS u, CAST(greatest(least(ax2, bx2) - greatest(ax1, bx1) + 1, 0) AS DOUBLE) * greatest(least(ay2, by2) - greatest(ay1, by1) + 1, 0) AS i1 FROM ab)
SELECT acls, round(avg(i / CAST(sa AS DOUBLE)), 6) AS iof, round(avg(i / u - (hull - u) / hull), 6) AS giou, round(avg(i1 / ((ax2 - ax1 + 1) * (ay2 - ay1 + 1) + (bx2 - bx1 + 1) * (by2 - by1 + 1) - i1)), 6) AS closed FROM h GROUP BY 1""")
def box_overlaps(spark, d):
    both = _boxes(spark, d, "a", 0).join(_boxes(spark, d, "b", 9), "frame")
    a, b = box("a"), box("b")
    return both.groupBy("acls").agg(F.round(F.avg(iof(a, b)), 6).alias("iof"), F.round(F.avg(giou(a, b)), 6).alias("giou"), F.round(F.avg(iou_closed(a, b)), 6).alias("closed"))


_HIT = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)".format(a="a", b="x[1]")


@query(f"""WITH b AS ({_sql_boxes('a', 0)}), k AS (SELECT frame, unnest(list_reduce(list([{{'id': aid, 'x1': CAST(ax1 AS DOUBLE), 'y1': CAST(ay1 AS DOUBLE), 'x2': CAST(ax2 AS DOUBLE), 'y2': CAST(ay2 AS DOUBLE)}}] ORDER BY ascore DESC, aid), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda a: {_HIT} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_HIT}) > 0.3)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM b GROUP BY 1) SELECT frame, k.id AS aid FROM k""")
def suppression(spark, d):
    """Boxes left by non-maximum suppression."""
    return folds.suppress(_boxes(spark, d, "a", 0), ["frame"], "ascore", "aid", "ax1", "ay1", "ax2", "ay2", 0.3)


_TP = f"""{_PAIRS}, best AS (
  SELECT frame, bcls AS cls, bid AS det, bscore AS score, aid AS gt, i / CAST(sa + sb - i AS DOUBLE) AS iou FROM ab WHERE acls = bcls QUALIFY row_number() OVER (PARTITION BY frame, bcls, bid ORDER BY i / CAST(sa + sb - i AS DOUBLE) DESC, aid) = 1
), f AS (SELECT frame, cls, det FROM best WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY frame, cls, gt ORDER BY score DESC, det) = 1
), m AS (SELECT b.frame, b.bcls AS cls, b.bid AS det, b.bscore AS score, f.det IS NOT NULL AS tp FROM b LEFT JOIN f ON f.frame = b.frame AND f.cls = b.bcls AND f.det = b.bid)"""


def _marked(spark, d) -> DataFrame:
    dets = _boxes(spark, d, "b", 9).withColumnsRenamed({"bid": "det", "bscore": "score", "bcls": "cls"})
    truth = _boxes(spark, d, "a", 0).withColumnsRenamed({"aid": "gt", "acls": "cls"}).drop("ascore")
    return detection.true_positives(dets, truth, ["frame", "cls"], box("b"), box("a"), 0.5)


@query(f"WITH {_TP} SELECT cls, count(*) AS n, count(*) FILTER (tp) AS tp FROM m GROUP BY 1")
def detection_matches(spark, d):
    return _marked(spark, d).groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.col("tp").cast("long")).alias("tp"))


@query(f"""WITH {_TP}, r AS (SELECT *, sum(CAST(tp AS INT)) OVER w AS tps, row_number() OVER w AS rk FROM m WINDOW w AS (PARTITION BY cls ORDER BY score DESC, frame, det)
), e AS (SELECT cls, tp, max(tps / rk) OVER (PARTITION BY cls ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r)
SELECT cls, round(sum(env) FILTER (tp) / (SELECT count(*) FROM a WHERE acls = cls), 6) AS ap FROM e GROUP BY 1""")
def detection_ap(spark, d):
    truths = _boxes(spark, d, "a", 0).groupBy(F.col("acls").alias("cls")).agg(F.count("*").alias("n_gt"))
    return detection.detection_ap(_marked(spark, d).withColumn("key_order", F.col("frame")), ["cls"], truths).select("cls", F.round("ap", 6).alias("ap"))


@query(f"{_YP}, c AS (SELECT unnest(range(5)) AS cls), s AS (SELECT cls, count(*) FILTER (y = cls AND p = cls) AS i, count(*) FILTER (y = cls) AS t, count(*) FILTER (p = cls) AS q FROM x, c GROUP BY 1) SELECT cls, round(i / (t + q - i), 6) AS iou, round(2 * i / (t + q), 6) AS dice, round(i / t, 6) AS accuracy FROM s")
def class_areas(spark, d):
    out = detection.class_areas(_predicted(spark, d), "y", "p")
    return out.select(F.col("cls").cast("long").alias("cls"), *[F.round(c, 6).alias(c) for c in ("iou", "dice", "accuracy")])


_SHARE = "CAST('0x' || substr(md5({} || '|' || CAST({} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT CASE WHEN s < 0.8 THEN 'train' WHEN s < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, {_SHARE.format(repr('7'), 'user_id')} AS s FROM events) GROUP BY 1")
def group_split(spark, d):
    out = sampling.group_split(table(spark, d, "events"), "user_id", {"train": 0.8, "val": 0.1, "test": 0.1}, "7")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('0|' || CAST(event_id AS VARCHAR)), event_id) <= 20")
def per_class_floor(spark, d):
    return sampling.per_class_floor(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 20)


@query("SELECT event_id, event_type, turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('0|' || CAST(event_id AS VARCHAR)), event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 33")
def round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 33).select("event_id", "event_type", F.col("turn").cast("long").alias("turn"))


@query("""WITH n AS (SELECT CAST(count(*) FILTER (lang <> 'en') * 0.4 / 0.6 AS DOUBLE) AS t FROM documents), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents)
SELECT doc_id, lang FROM r, n WHERE lang <> 'en' OR r <= floor(t)""")
def majority_cap(spark, d):
    return sampling.majority_cap(table(spark, d, "documents").select("doc_id", "lang"), "lang", "en", ["doc_id"], 0.4)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS top, count(*) AS bottom, row_number() OVER (ORDER BY substr(md5(CAST(user_id AS VARCHAR)), 1, 3), user_id) - 1 AS i FROM events GROUP BY 1
), n AS (SELECT count(*) AS n FROM c), dr AS (SELECT id // n AS rep, CAST('0x' || substr(md5('0|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % n AS i FROM n, (SELECT unnest(range(200 * (SELECT n FROM n))) AS id)
), s AS (SELECT rep, sum(top) / CAST(sum(bottom) AS DOUBLE) AS s FROM dr JOIN c USING (i) GROUP BY 1)
SELECT round((SELECT sum(top) / CAST(sum(bottom) AS DOUBLE) FROM c), 6) AS estimate, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s""")
def cluster_bootstrap(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("top"), F.count("*").alias("bottom"))
    out = resample.bootstrap_ratio(c, "user_id", "top", "bottom", 200)
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = stateful.parquet_stream(spark, f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "ts", F.unix_micros("ts").alias("us"), "user_id", "event_type")


@query(f"WITH {EV}, n AS (SELECT us // {HOUR} * {HOUR} AS start_us, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT * FROM n WHERE start_us + {HOUR} <= (SELECT max(us) FROM ev) - {DAY}")
def stream_windows(spark, d):
    out = stateful.run_to_end(stateful.windowed_counts(event_stream(spark, d), "ts", ["event_type"], "1 hour", "1 day"))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(f"WITH {RUNS}, w AS (SELECT user_id, run, event_id, event_type, us, us - min(us) OVER (PARTITION BY user_id, run) AS dwell FROM r WHERE event_type IN ('error', 'click')) SELECT user_id, event_id, event_type, dwell FROM w WHERE dwell >= {HOUR} QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY us, event_id) = 1")
def stream_alerts(spark, d):
    return stateful.run_to_end(stateful.dwell_alerts(event_stream(spark, d), "user_id", "us", "event_id", "event_type", ["error", "click"], HOUR))


@query(f"""WITH {EV}, k AS (SELECT user_id, unnest(list_reduce(list([{{'i': event_id, 'u': us}}] ORDER BY event_id), lambda acc, x: CASE WHEN x[1].u < acc[-1].u OR x[1].u - acc[-1].u >= {DAY} THEN list_concat(acc, x) ELSE acc END)) AS k FROM ev GROUP BY 1)
SELECT user_id, k.i AS event_id, k.u AS us FROM k""")
def stream_admission(spark, d):
    """Rows admitted at a matched rate."""
    return stateful.run_to_end(stateful.admit_by_rate(event_stream(spark, d), "user_id", "us", "event_id", DAY))


@query("SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT key, json_extract_string(props, '$.' || key) AS value FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)) GROUP BY 1")
def dict_source(spark, d):
    each = jsonl.dict_entries(table(spark, d, "events"), F.col("props"))
    return each.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("""WITH a AS (SELECT NOT list_has_any(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No', 'not', 'no']) AS p, turn % 2 = 0 AS y FROM conversations
), c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM a)
SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + fp) / (tp + fp + tn + fn), 6) AS yes_ratio, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def yes_no_answers(spark, d):
    p, y = F.col("p"), F.col("y")
    a = table(spark, d, "conversations").select(answers.says_yes(F.col("text")).alias("p"), (F.col("turn") % 2 == 0).alias("y"))
    c = a.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    share = lambda a, b: F.round(F.expr(f"try_divide({a}, {b})"), 6)
    every = "tp + fp + tn + fn"
    return c.select("tp", "fp", "tn", "fn", share("tp + tn", every).alias("accuracy"), share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("tp + fp", every).alias("yes_ratio"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query("WITH v AS (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS c FROM lineitem GROUP BY 1) SELECT l_partkey, round((c * least(1, (c - 1) / 3) + (n - c) * least(1, c / 3)) / n, 6) AS score FROM v")
def soft_votes(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("c"))
    return v.select("l_partkey", F.round(answers.soft_vote(F.col("c"), F.col("n")), 6).alias("score"))


@query("WITH s AS (SELECT p_type, lower(trim(p_brand)) = lower(trim(upper(p_brand) || ' ')) AS e, 1 - levenshtein(lower(trim(p_name)), lower(trim(p_brand))) / greatest(length(trim(p_name)), length(trim(p_brand)), 1) AS s FROM part) SELECT p_type, round(avg(CASE WHEN s >= 0.2 THEN s ELSE 0 END), 6) AS similarity, round(avg(CAST(e AS INT)), 6) AS exact, count(*) AS n FROM s GROUP BY 1")
def answer_similarity(spark, d):
    s = answers.levenshtein_similarity(F.col("p_name"), F.col("p_brand"), 0.2)
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg(s), 6).alias("similarity"), F.round(F.avg(answers.exact_match(F.col("p_brand"), F.concat(F.upper("p_brand"), F.lit(" "))).cast("double")), 6).alias("exact"), F.count("*").alias("n"))


@query(f"WITH {_SCORED}, g AS (SELECT unnest(range(1, 41)) / 8.0 AS t), c AS (SELECT pos, least(greatest(score, 1e-12), 1 - 1e-12) AS p FROM s) SELECT t AS temperature, round(avg(ln(1 + exp((CASE WHEN pos THEN -1 ELSE 1 END) * ln(p / (1 - p)) / t))), 5) AS nll FROM c, g GROUP BY 1")
def temperature_grid(spark, d):
    return metrics.temperature_grid(_scored(spark, d), "score", "pos", [i / 8 for i in range(1, 41)]).withColumn("nll", F.round("nll", 5))


@query("SELECT text, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return joins.duplicate_keys(table(spark, d, "documents"), ["text", "lang"])
