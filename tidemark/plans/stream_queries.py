"""Queries on streams, files and nested annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..sources import annotations, binary, files, jsonl
from ..streaming import stateful
from .base import DAY, HOUR, query, table
from .queries import EV, RUNS, _boxes, _sql_boxes, event_stream, events

_PART = f"g AS (SELECT *, sum(CASE WHEN us - pu > {2 * DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS part FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS pu FROM ev))"


def _valued(spark, d):
    rows = stateful.parquet_stream(spark, f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    return rows.select("event_id", "ts", F.unix_micros("ts").alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {EV}, n AS (SELECT us // {HOUR} * {HOUR} - s * {2 * HOUR} AS start_us, event_type FROM (SELECT us // {2 * HOUR} * 2 * {HOUR} AS us, event_type FROM ev), (SELECT unnest([0, 1, 2]) AS s)) SELECT start_us, event_type, count(*) AS n FROM n WHERE start_us + {6 * HOUR} <= (SELECT max(us) FROM ev) - {DAY} GROUP BY 1, 2")
def stream_sliding(spark, d):
    """Six-hour windows, one beginning every two hours."""
    out = stateful.run_to_end(stateful.sliding_counts(event_stream(spark, d), "ts", ["event_type"], "6 hours", "2 hours", "1 day"))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(f"""WITH {EV}, s AS (SELECT user_id, us, sum(CASE WHEN us - pu > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS part FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS pu FROM ev))
SELECT user_id, min(us) AS start_us, max(us) + {DAY} AS end_us, count(*) AS n FROM s GROUP BY user_id, part HAVING max(us) + {DAY} <= (SELECT max(us) FROM ev) - {DAY}""")
def stream_sessions(spark, d):
    """Each user's sessions; a day's pause ends one, and an event seen twice counts once."""
    twice = event_stream(spark, d)
    out = stateful.run_to_end(stateful.sessions(twice.union(event_stream(spark, d)), "ts", "user_id", "1 day", "1 day", ["event_id"]))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"WITH {EV}, {_PART} SELECT user_id, event_id, count(*) OVER w < 4 AS warming, round(avg(value) OVER w, 6) AS mean FROM g WINDOW w AS (PARTITION BY user_id, part ORDER BY us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def stream_history(spark, d):
    """The last eight values of each user, forgotten after two days without an event."""
    out = stateful.run_to_end(stateful.with_history(_valued(spark, d), "user_id", ["us", "event_id"], "value", "event_id", 8, 4, 2 * DAY))
    return out.select("user_id", "event_id", "warming", F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / F.size("history"), 6).alias("mean"))


@query(f"""WITH {EV}, {_PART}, l AS (SELECT user_id, part, list_reduce(list([{{'i': event_id, 'v': value, 'k': CAST(k AS DOUBLE)}}] ORDER BY us, event_id), lambda acc, x: list_append(acc, CASE WHEN greatest(abs(acc[-1].v - x[1].v), abs(acc[-1].k - x[1].k)) > 60 THEN x[1] ELSE {{'i': x[1].i, 'v': 0.35 * x[1].v + 0.65 * acc[-1].v, 'k': 0.35 * x[1].k + 0.65 * acc[-1].k}} END)) AS r FROM g GROUP BY 1, 2)
SELECT user_id, m.i AS event_id, round(m.v + 3.1e-8, 6) AS v, round(m.k + 3.1e-8, 6) AS k FROM (SELECT user_id, unnest(r) AS m FROM l)""")
def stream_smooth_boxes(spark, d):
    """A pair of values of each user, smoothed; jumps start anew."""
    out = stateful.run_to_end(stateful.smooth_boxes(_valued(spark, d), "user_id", ["us", "event_id"], ["value", "k"], "event_id", 0.35, 60.0, 2 * DAY))
    # moved off the halves, which sums in another order may round either way
    side = lambda i: F.round(F.col("smooth")[i] + 3.1e-8, 6)
    return out.select("user_id", "event_id", side(0).alias("v"), side(1).alias("k"))


@query()
def stream_smooth_labels(spark, d):
    """The label shown for each user, by majority with hysteresis; a fold with a window in its state, so its test is by plain loops."""
    out = stateful.run_to_end(stateful.smooth_labels(_valued(spark, d), "user_id", ["us", "event_id"], "event_type", "event_id", 5, 1, 2 * DAY))
    return out.select("user_id", "event_id", "shown")


@query(f"""WITH {EV}, l AS (SELECT user_id, list_reduce(list([{{'i': event_id, 'f': event_id, 'h': value, 'a': event_id}}] ORDER BY us, event_id), lambda acc, x: list_append(acc, CASE WHEN x[1].f - acc[-1].a >= 40 THEN x[1] ELSE {{'i': x[1].i, 'f': x[1].f, 'h': acc[-1].h, 'a': acc[-1].a}} END)) AS r FROM ev GROUP BY 1)
SELECT user_id, m.i AS event_id, m.a = m.f AS predicted, round(m.h, 6) AS held FROM (SELECT user_id, unnest(r) AS m FROM l)""")
def stream_strides(spark, d):
    """Values taken every forty frames of a user and held between, event numbers standing for frames."""
    rows = _valued(spark, d).withColumn("frame", F.col("event_id"))
    out = stateful.run_to_end(stateful.predict_every(rows, "user_id", ["us", "event_id"], "frame", "value", "event_id", 40))
    return out.select("user_id", "event_id", "predicted", F.round("held", 6).alias("held"))


@query(f"WITH {RUNS}, w AS (SELECT user_id, run, event_id, event_type, us, k, us - min(us) OVER (PARTITION BY user_id, run) AS dwell FROM r WHERE event_type IN ('error', 'click')) SELECT user_id, event_id, event_type, dwell FROM w WHERE dwell >= {HOUR} AND k < 70 QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY us, event_id) = 1")
def stream_allowed_alerts(spark, d):
    """One alert a dwell, only where the row allows it."""
    rows = _valued(spark, d).withColumn("allowed", F.col("k") < 70)
    return stateful.run_to_end(stateful.dwell_alerts(rows, "user_id", "us", "event_id", "event_type", ["error", "click"], HOUR, "allowed"))


@query("SELECT doc_id % 4 AS shard, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 4 < 3 GROUP BY 1")
def jsonl_shards(spark, d):
    """Documents written as JSON lines in shards, and three of the four read again by a glob, with the file each row came from."""
    folder = files.scratch(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 4).alias("shard"))
    docs.repartition("shard").write.partitionBy("shard").json(folder)
    rows = jsonl.read_jsonl(spark, f"{folder}/shard=[0-2]", "doc_id long, n_chars long", provenance=True)
    shard = F.regexp_extract("source_file", r"shard=(\d+)", 1).cast("long")
    return rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def csv_table(spark, d):
    """A table of results written as one CSV file with a header, read again."""
    folder = files.scratch(spark, "csv")
    files.write_csv(table(spark, d, "nation"), folder)
    back = files.read_csv(spark, folder, "n_nationkey int, n_name string, n_regionkey int")
    return back.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def jsonl_to_parquet(spark, d):
    folder = files.scratch(spark, "convert")
    jsonl.write_jsonl(table(spark, d, "documents").select("doc_id", "lang"), f"{folder}/jsonl")
    files.jsonl_to_parquet(spark, f"{folder}/jsonl", "doc_id long, lang string", f"{folder}/parquet")
    return spark.read.parquet(f"{folder}/parquet").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS shard, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def unfinished_shards(spark, d):
    """Rows of the shards that no mark calls finished."""
    folder = files.scratch(spark, "done")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("shard"), "o_orderkey")
    assert files.done_shards(spark, folder).isEmpty()
    files.mark_done(rows.where("shard = 'F'").select("shard"), folder)
    return files.remaining(rows, "shard", files.done_shards(spark, folder)).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS first, count(*) FILTER (doc_id % 2 = 1) AS later FROM documents")
def resumed_sink(spark, d):
    """A sink filled by half of the documents, then by all of them: each comes in once."""
    sink = files.scratch(spark, "sink")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    files.append_new(docs.where("doc_id % 2 = 0").withColumn("turn", F.lit(1)), sink, ["doc_id"])
    whole = files.append_new(docs.withColumn("turn", F.lit(2)), sink, ["doc_id"])
    return whole.agg(F.count("*").alias("n"), F.count_if(F.col("turn") == 1).alias("first"), F.count_if(F.col("turn") == 2).alias("later"))


@query("SELECT 'run_' || CAST(n_regionkey AS VARCHAR) AS run, count(*) AS n FROM nation GROUP BY 1")
def run_folders(spark, d):
    """Folders of runs, one result file each, found by a glob."""
    folder = files.scratch(spark, "runs")
    n = table(spark, d, "nation").groupBy(F.concat(F.lit("run_"), F.col("n_regionkey").cast("string")).alias("run")).agg(F.count("*").alias("n"))
    n.withColumn("key", F.col("run")).repartition("run").write.partitionBy("run").json(folder)
    found = files.runs(spark, f"{folder}/run=*", "n long, key string")
    return found.select(F.regexp_replace("run", "^run=", "").alias("run"), "n")


@query(f"""WITH {EV}, u AS (SELECT user_id AS id, count(*) AS n FROM ev GROUP BY 1), f AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'missing' WHEN id % 7 = 0 THEN 'changed' END AS status FROM u UNION ALL SELECT id, 'unexpected' FROM u WHERE id % 11 = 0)
SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f WHERE status IS NOT NULL GROUP BY 1""")
def content_manifest(spark, d):
    """A folder of one file a user against the manifest of an earlier one: files that are gone, changed and new."""
    old, new = files.scratch(spark, "manifest"), files.scratch(spark, "manifest")
    text = events(spark, d).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "us", "event_type"))), "\n").alias("t"))
    named = lambda t, mark="u": t.select(F.format_string(f"{mark}%06d.csv", "user_id").alias("name"), F.encode("t", "UTF-8").alias("content"))
    binary.write_files(named(text), old)
    edited = text.where("user_id % 5 <> 0").withColumn("t", F.when(F.col("user_id") % 7 == 0, F.concat("t", F.lit("\n"))).otherwise(F.col("t")))
    binary.write_files(named(edited).unionByName(named(text.where("user_id % 11 = 0"), "x")), new)
    found = files.verify_contents(files.contents(spark, old), files.contents(spark, new))
    return found.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.regexp_extract("name", r"(\d+)", 1).cast("long")).alias("ids"))


@query("SELECT url FROM pages ORDER BY md5('3|' || url), url LIMIT 20")
def listed_sample(spark, d):
    return files.listed_sample(table(spark, d, "pages").select("url"), "url", 20, 3)


@query("SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'store/r' WHEN l_returnflag = 'N' THEN 'backup/n' END AS base, count(*) AS n FROM lineitem GROUP BY 1, 2")
def based_rows(spark, d):
    """Rows with the first folder that exists for their group."""
    bases = spark.sql("SELECT * FROM VALUES ('R', 0, 'store/r'), ('R', 1, 'backup/r'), ('N', 1, 'backup/n') AS b(`group`, rank, base)")
    return files.with_base(table(spark, d, "lineitem"), bases, F.col("l_returnflag")).groupBy("l_orderkey", "base").agg(F.count("*").alias("n"))


_LINES = f"""ln AS (SELECT frame, aid, acls, ax1 - 30 AS x1, ay1 - 30 AS y1, ax2 - 30 AS x2, ay2 - 30 AS y2, row_number() OVER (PARTITION BY frame ORDER BY aid) - 1 AS label FROM ({_sql_boxes('a', 0)}))"""


@query(f"WITH {_LINES} SELECT 'f' || CAST(frame AS VARCHAR) AS filename, label, acls AS phrase, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM ln WHERE least(x2, 40) > greatest(x1, 0) AND least(y2, 40) > greatest(y1, 0)")
def grounding_regions(spark, d):
    """Regions of nested JSON lines made from boxes, those outside the frame left out."""
    return annotations.grounding_regions(_grounding_lines(spark, d), "line").select("filename", F.col("label").cast("long").alias("label"), "phrase", "x1", "y1", "x2", "y2")


def _grounding_lines(spark, d):
    a = _boxes(spark, d, "a", 0)
    corner = lambda c: (F.col(c) - 30).cast("double")
    box = F.array(*map(corner, ("ax1", "ay1", "ax2", "ay2")))
    region = F.struct("aid", box.alias("bbox"), F.col("acls").alias("phrase"), F.array(F.array(F.lit(0), F.lit(1))).alias("tokens_positive"), F.ascii("acls").alias("label"))
    g = a.groupBy("frame").agg(F.sort_array(F.collect_list(region)).alias("r"))
    line = F.struct(F.concat(F.lit("f"), F.col("frame").cast("string")).alias("filename"), F.lit(40).alias("height"), F.lit(40).alias("width"), F.struct(F.lit("a. b.").alias("caption"), F.col("r").alias("regions")).alias("grounding"), F.struct(F.col("r").alias("instances")).alias("detection"))
    return g.select(F.to_json(line).alias("line"))


@query(f"WITH {_LINES} SELECT ascii(acls) AS label, count(*) AS n, round(avg(x2 - x1), 6) AS width FROM ln WHERE least(x2, 40) > greatest(x1, 0) AND least(y2, 40) > greatest(y1, 0) GROUP BY 1")
def detection_instances(spark, d):
    rows = annotations.detection_instances(_grounding_lines(spark, d), "line")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x2") - F.col("x1")), 6).alias("width"))


@query(f"""WITH a AS ({_sql_boxes('a', 0)}), r AS (SELECT frame AS image_id, acls, ax1 - 30 AS x1, ay1 - 30 AS y1, ax2 - 30 AS x2, ay2 - 30 AS y2, frame % 7 = 0 AS crowd FROM a WHERE ascore >= 0.1 AND acls <> 'R')
SELECT image_id, CASE acls WHEN 'A' THEN 0 ELSE 1 END AS label, crowd AS ignored, count(*) AS n FROM r WHERE least(x2, 30 + image_id % 20) > greatest(x1, 0) AND least(y2, 40) > greatest(y1, 0) AND 30 + image_id % 20 >= 35 GROUP BY 1, 2, 3""")
def dictionary_instances(spark, d):
    """Images, annotations and categories put together; small images, unknown categories and unusable boxes go."""
    a = _boxes(spark, d, "a", 0)
    images = a.select(F.col("frame").alias("image_id")).distinct().withColumns({"width": 30 + F.col("image_id") % 20, "height": F.lit(40)})
    w, h = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1")
    ann = a.select(F.col("frame").alias("image_id"), F.col("acls").alias("category_id"), (F.col("ax1") - 30).alias("x"), (F.col("ay1") - 30).alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), (F.col("ascore") < 0.1).alias("ignore"), (F.col("frame") % 7 == 0).alias("iscrowd"))
    categories = spark.sql("SELECT * FROM VALUES ('A', 0), ('N', 1) AS c(category_id, label)")
    found = annotations.dictionary_instances(images, ann, F.broadcast(categories))
    kept = annotations.with_annotations(images, found, "image_id", 35).select("image_id")
    return found.join(kept, "image_id", "left_semi").groupBy("image_id", "label", "ignored").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT us // {HOUR} AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS conf FROM ev WHERE event_id IN (SELECT max(event_id) FROM ev GROUP BY us // {HOUR}, user_id) GROUP BY 1")
def cue_log(spark, d):
    """Hours as moments of a log of maps, written as JSON and replayed."""
    folder = files.scratch(spark, "log")
    ev = events(spark, d).withColumn("t", F.floor(F.col("us") / HOUR).cast("double"))
    one = joins.latest(ev.select("t", "user_id", "event_id", "event_type", "value"), ["t", "user_id"], ["event_id"])
    person = F.struct(F.col("user_id").cast("string"), F.struct(F.col("event_type").alias("cue"), F.col("value").alias("conf")))
    one.groupBy("t").agg(F.map_from_entries(F.collect_list(person)).alias("students")).write.json(folder)
    rows = annotations.cue_log_rows(spark.read.schema(annotations.CUE_LOG).json(folder)).where("alert_allowed AND NOT alerted")
    return rows.groupBy(F.col("t").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("cue") == "error").alias("errors"), F.round(F.sum("conf"), 4).alias("conf"))
