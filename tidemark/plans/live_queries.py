"""Queries on live streams and calibration models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fusion
from ..operators import calibrate, metrics
from ..sources import files
from ..streaming import live, stateful
from .base import DAY, HOUR, query
from .queries import EV, event_stream, events

_OPINIONS = f"""{EV}, f AS (SELECT * FROM ev WHERE event_type <> 'error'), o AS (SELECT * FROM ev WHERE event_type = 'error'), j AS (
  SELECT f.user_id, f.event_id, f.event_type, f.us, f.us - o.us AS age_us, o.event_id AS opinion FROM f LEFT JOIN o ON o.user_id = f.user_id AND o.us <= f.us AND o.us >= f.us - {6 * HOUR}
  QUALIFY row_number() OVER (PARTITION BY f.user_id, f.event_id ORDER BY o.us DESC NULLS LAST, o.event_id DESC NULLS LAST) = 1)"""


@query(f"WITH {_OPINIONS} SELECT user_id, event_id, event_type, age_us, opinion FROM j WHERE us < (SELECT least(max(us) FILTER (event_type <> 'error'), max(us) FILTER (event_type = 'error')) FROM ev) - {DAY} - {6 * HOUR}")
def stream_opinions(spark, d):
    """Events with the user's last error within six hours as an opinion from the side."""
    frames = event_stream(spark, d).where("event_type <> 'error'").select("user_id", "ts", "event_id", "event_type").withWatermark("ts", "1 day")
    told = event_stream(spark, d).where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("opinion")).withWatermark("ts", "1 day")
    out = stateful.run_to_end(live.side_opinions(frames, told, "user_id", "ts", "event_id", ["opinion"], "opinion", "6 HOURS"))
    last = events(spark, d).groupBy((F.col("event_type") == "error").alias("e")).agg(F.max("us").alias("us")).agg(F.min("us").alias("last"))
    return out.join(F.broadcast(last), F.unix_micros("ts") < F.col("last") - DAY - 6 * HOUR).select("user_id", "event_id", "event_type", "age_us", "opinion")


@query(f"WITH {EV}, p AS (SELECT *, event_id * 4 // ((SELECT max(event_id) FROM ev) + 1) AS part FROM ev), n AS (SELECT user_id, part, count(*) AS n, arg_max(event_id, (us, event_id)) AS id FROM p GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS n_read, count(*) AS n_taken, CAST(sum(n) - count(*) AS BIGINT) AS n_dropped, CAST(sum(id) AS BIGINT) AS ids FROM n GROUP BY 1")
def newest_only(spark, d):
    """Four micro-batches of events, of each of which a user's newest is taken."""
    folder, out = files.scratch(spark, "split"), files.scratch(spark, "taken")
    ev = events(spark, d).select("event_id", "us", "user_id")
    last = ev.agg(F.max("event_id")).first()[0]
    for part in range(4):
        ev.where(F.floor(F.col("event_id") * 4 / (last + 1)) == part).coalesce(1).write.mode("append").parquet(folder)
    stream = stateful.parquet_stream(spark, folder, 1)
    live.take_newest(stream, "user_id", ["us", "event_id"], out).trigger(availableNow=True).start().awaitTermination()
    taken = live.newest_rows(spark, out, "event_id long, us long, user_id long")
    return live.drop_counts(taken, "user_id").join(taken.groupBy("user_id").agg(F.sum("event_id").alias("ids")), "user_id")


_BLOCKS = f"""{EV}, q AS (SELECT (k + 0.5) / 100 AS score, CAST(event_type = 'error' OR value > 60 - k * 0.4 AS INT) AS y FROM ev WHERE k IS NOT NULL
), u AS (SELECT score, sum(y) AS y, count(*) AS n, row_number() OVER (ORDER BY score) AS i FROM q GROUP BY 1
), c AS (SELECT *, sum(y) OVER (ORDER BY i) AS sy, sum(n) OVER (ORDER BY i) AS sn FROM u
), m AS (SELECT x.score, x.n, max(low) AS value FROM u x, LATERAL (SELECT min((b.sy - a.sy + a.y) / CAST(b.sn - a.sn + a.n AS DOUBLE)) AS low FROM c a, c b WHERE a.i <= x.i AND b.i >= x.i GROUP BY a.i) GROUP BY 1, 2)"""


def _judged(spark, d):
    k = F.col("k")
    ev = events(spark, d).where("k IS NOT NULL")
    return ev.select("event_id", "user_id", "k", "value", ((k + 0.5) / 100).alias("score"), ((F.col("event_type") == "error") | (F.col("value") > 60 - k * 0.4)).alias("y"))


@query(f"WITH {_BLOCKS} SELECT round(value, 6) AS value, min(score) AS low, max(score) AS high, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY value")
def isotonic_blocks(spark, d):
    """The best non-decreasing fit of a label by a score."""
    return calibrate.isotonic(_judged(spark, d), "score", "y").select(F.round("value", 6).alias("value"), "low", "high", "n")


def _three(s: str, name: str) -> str:
    area = f"(SELECT round((sum(r) FILTER (y = 1) - max(p) * (max(p) + 1) / 2) / (max(p) * (count(*) - max(p))), 6) FROM (SELECT y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r, CAST((SELECT sum(y) FROM z) AS DOUBLE) AS p FROM z))"
    error = f"(SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM (SELECT count(*) AS n, avg({s}) AS c, avg(y) AS a FROM z GROUP BY least(CAST(floor({s} * 10) AS BIGINT), 9)))"
    return f"SELECT '{name}' AS kind, {area} AS auroc, {error} AS ece, (SELECT round(avg(power({s} - y, 2)), 6) FROM z) AS brier"


@query(f"WITH {_BLOCKS}, z AS (SELECT q.score, q.y, round(m.value, 9) AS value FROM q JOIN m USING (score)) {_three('score', 'raw')} UNION ALL {_three('value', 'isotonic')}")
def isotonic_calibration(spark, d):
    """Scores before and after the fit: area under the ROC, calibration error, squared error."""
    rows = _judged(spark, d)
    fitted = calibrate.isotonic_score(rows, "score", calibrate.isotonic(rows, "score", "y"), "fit").withColumn("fit", F.round("fit", 9))
    fitted = files.written(fitted, "fitted")

    def three(score: str, kind: str):
        area = metrics.auroc(fitted, [], score, "y")
        error = metrics.calibration_error(metrics.reliability(fitted, score, "y", 10, False))
        brier = fitted.agg(F.avg(F.pow(F.col(score) - F.col("y").cast("int"), 2)).alias("brier"))
        one = area.join(F.broadcast(error), F.lit(True)).join(F.broadcast(brier), F.lit(True))
        return one.select(F.lit(kind).alias("kind"), *[F.round(c, 6).alias(c) for c in ("auroc", "ece", "brier")])

    return three("score", "raw").unionAll(three("fit", "isotonic"))


@query()
def logistic_calibration(spark, d):
    """A logistic model of the label by two features, fitted on half of the users and scored on the others; tested against gradient
    descent."""
    rows = _judged(spark, d).withColumns({"a": F.col("k") / 100, "b": F.col("value") / 50})
    weights = calibrate.logistic(rows.where("user_id % 2 = 0"), ["a", "b"], "y")
    held = files.written(rows.where("user_id % 2 = 1").withColumn("p", calibrate.logistic_score(["a", "b"], weights)), "held")
    brier = held.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y").cast("int"), 2)), 6).alias("brier"))
    area = metrics.auroc(held, [], "p", "y").select(F.round("auroc", 6).alias("auroc"))
    return area.join(F.broadcast(brier), F.lit(True))


def _classed(spark, d):
    """Three class probabilities of each event, and the class it has."""
    k, v = F.col("k"), F.least(F.col("value"), F.lit(100.0))
    raw = F.array(k + 1.0, 101.0 - k, v + 1.0)
    truth = F.when(F.col("event_type") == "error", 0).when(F.col("value") > F.col("k"), 2).otherwise(1)
    return events(spark, d).where("k IS NOT NULL").select("event_id", fusion.normalised(raw).alias("probs"), truth.alias("truth"))


@query()
def scaled_probabilities(spark, d):
    """Losses of class probabilities as they are, tempered by the best temperature, and with scales and biases by class; tested against a
    plain optimiser."""
    rows = files.written(_classed(spark, d), "classed")
    t = calibrate.golden_temperature(rows, "probs", "truth")
    scales, biases = calibrate.vector_scaling(rows, "probs", "truth", 3)
    kinds = {"raw": F.col("probs"), "temperature": fusion.tempered(F.col("probs"), t), "vector": calibrate.vector_scaled(F.col("probs"), scales, biases)}
    each = [metrics.probability_losses(rows.withColumn("probs", p), "probs", "truth").select(F.lit(k).alias("kind"), F.round("brier", 5).alias("brier"), F.round("nll", 5).alias("nll")) for k, p in kinds.items()]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query(f"WITH {EV}, p AS (SELECT *, event_id * 4 // ((SELECT max(event_id) FROM ev) + 1) AS part FROM ev) SELECT event_type, k % 10 AS seat, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT part) AS n_pushed FROM p GROUP BY 1, 2")
def pushed_counts(spark, d):
    """Counts and means by type as a display gets them: only what changed, in four micro-batches."""
    folder, out = files.scratch(spark, "split"), files.scratch(spark, "pushed")
    ev = events(spark, d).select("event_id", "event_type", "value", (F.col("k") % 10).alias("seat"))
    last = ev.agg(F.max("event_id")).first()[0]
    for part in range(4):
        ev.where(F.floor(F.col("event_id") * 4 / (last + 1)) == part).coalesce(1).write.mode("append").parquet(folder)
    stream = stateful.parquet_stream(spark, folder, 1)
    live.push_counts(stream, ["event_type", "seat"], {"n": F.count("*"), "mean": F.avg("value")}, out).trigger(availableNow=True).start().awaitTermination()
    return live.pushed(spark, out, "event_type string, seat long, n long, mean double", ["event_type", "seat"]).withColumn("mean", F.round("mean", 6))
