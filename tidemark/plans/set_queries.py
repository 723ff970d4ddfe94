"""Queries on records, sets, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cues
from ..functions import geometry as G
from ..operators import joins, records, sampling
from .base import cued_sql, query, records_sql, rounded, table
from .base import records as annotations
from .queries import _PAIRS, EV, _boxes, events

_REC = records_sql()
_CUED = f"{_REC}, {cued_sql()}"
_MD5 = "md5('{}|' || CAST({} AS VARCHAR))"


@query(f"WITH {_REC} SELECT count(*) FILTER (occluded AND face_kpts = 2) AS strict, count(*) FILTER (occluded AND face_kpts <= 2) AS wide FROM rec")
def hidden_faces(spark, d):
    return annotations(spark, d).agg(F.count_if(records.hidden_faces(True)).alias("strict"), F.count_if(records.hidden_faces(False)).alias("wide"))


@query("SELECT doc_id, 'other' AS activity, false AS occluded, lang FROM documents WHERE lang IS NOT NULL AND lang <> '' AND text IS NOT NULL AND text <> ''")
def default_records(spark, d):
    """Documents with a language and a text as records with default labels."""
    docs = records.complete(table(spark, d, "documents"), ["lang", "text"])
    return records.keeping(records.with_default_label(docs), ["doc_id", "activity", "occluded", "lang", "none"])


@query(f"WITH {_REC} SELECT id, frame, occluded, face_kpts, phone_visible, talking FROM rec WHERE NOT occluded")
def blind_records(spark, d):
    r = annotations(spark, d).where("NOT occluded").withColumn("face_kpts", F.col("face_kpts").cast("long"))
    return records.blinded(r, list(records.DEFAULT_LABEL)[:6])


@query("SELECT d.doc_id, e.vec_id IS NULL AS missing, round(coalesce(e.embedding[1], 0), 6) AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def vectors_or_zeros(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    out = records.with_vector(table(spark, d, "documents").select("doc_id"), e, ["doc_id"], "embedding", 64)
    return out.select("doc_id", "missing", F.round(F.col("embedding")[0], 6).alias("first"))


_LAYOUTS = {"short": {"base": (0, 16), "pose": (16, 20)}, "long": {"base": (0, 16), "pose": (16, 20), "head": (20, 64)}, "other": {"base": (0, 16), "pose": (20, 24)}}


@query("SELECT vec_id, round(list_sum(list_concat(embedding[17:20], embedding[21:64])), 4) AS total, 48 AS width FROM embeddings")
def feature_blocks(spark, d):
    """Two blocks of each vector, read by a layout."""
    v = records.project_blocks(F.col("embedding"), _LAYOUTS, "long", "long", ["head", "pose"])
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(v).alias("width"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages")
def path_names(spark, d):
    return table(spark, d, "pages").select("page_id", records.basename(F.col("url")).alias("name"), records.stem(F.col("url")).alias("stem"))


@query("SELECT p.page_id, b.item_id FROM pages p JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = regexp_extract(p.url, '(\\d+)[^/]*$', 1)")
def basename_join(spark, d):
    """Pages and items whose number ends the page's address."""
    number = F.regexp_extract(records.basename(F.col("url")), r"(\d+)[^/]*$", 1)
    return table(spark, d, "pages").select("page_id", number.alias("key")).join(table(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("key")), "key").select("page_id", "item_id")


@query(f"WITH {EV}, f AS (SELECT event_id, 't' || lpad(CAST(k AS VARCHAR), 6, '0') || '_' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '_f1' AS name FROM ev WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'x' || CAST(k AS VARCHAR) FROM ev WHERE event_id % 3 = 0) SELECT event_id, CASE WHEN name LIKE 't%' THEN round(CAST(substr(name, 2, 6) AS BIGINT) + CAST(substr(name, 9, 3) AS BIGINT) / 1000.0, 3) END AS seconds FROM f")
def frame_times(spark, d):
    k, i = F.col("k"), F.col("event_id")
    name = F.when(i % 3 != 0, F.concat(F.lit("t"), F.lpad(k.cast("string"), 6, "0"), F.lit("_"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("_f1"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return events(spark, d).select("event_id", F.round(records.frame_seconds(name), 3).alias("seconds"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN n.k IS NULL THEN 'dropped' WHEN o.k IS NULL THEN 'added' WHEN o.s <> n.s THEN 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k) WHERE status IS NOT NULL GROUP BY 1""")
def version_changes(spark, d):
    """What two versions of a manifest differ in."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").where(k % 7 != 0)
    n = table(spark, d, "orders").where(k % 5 != 0).withColumn("o_orderstatus", F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return records.compare_versions(o, n, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT user_id % 5 AS bucket, count(*) AS n, round(avg(CAST((event_type = 'error') = (k < 30) AS INT)), 6) AS a_right, round(avg(CAST((event_type = 'error') = (value > 50) AS INT)), 6) AS b_right FROM ev GROUP BY 1")
def aligned_rows(spark, d):
    """Two systems' answers to the same rows, side by side."""
    ev = events(spark, d).withColumn("y", F.col("event_type") == "error")
    one, two = ev.select("event_id", "user_id", "y", (F.col("k") < 30).alias("v")), ev.select("event_id", "user_id", "y", (F.col("value") > 50).alias("v"))
    both = records.aligned(one, two, ["event_id", "user_id"], "y", "v")
    right = lambda c: F.round(F.avg((F.col("y") == F.col(c)).cast("double")), 6).alias(f"{c}_right")
    return both.groupBy((F.col("user_id") % 5).alias("bucket")).agg(F.count("*").alias("n"), right("a"), right("b"))


@query("SELECT l_orderkey, count(*) AS n, array_to_string(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey), ',') AS parts FROM lineitem GROUP BY 1 HAVING count(*) >= 4 ORDER BY 1 LIMIT 50")
def grouped_frames(spark, d):
    g = records.grouped_frames(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"], 4, 50)
    return g.select("l_orderkey", "n", F.array_join(F.transform("members", lambda m: m["l_partkey"].cast("string")), ",").alias("parts"))


@query(f"WITH {_PAIRS}, m AS (SELECT frame, bid, acls = bcls AS agree FROM ab WHERE i / CAST(sa + sb - i AS DOUBLE) > 0.5 QUALIFY row_number() OVER (PARTITION BY frame, bid ORDER BY i / CAST(sa + sb - i AS DOUBLE) DESC, aid) = 1) SELECT b.frame, b.bid, m.bid IS NOT NULL AS matched, coalesce(agree, false) AS agree FROM b LEFT JOIN m ON m.frame = b.frame AND m.bid = b.bid")
def nearest_matches(spark, d):
    """The box that overlaps each reference box most, and whether its class agrees."""
    a, b = _boxes(spark, d, "a", 0), _boxes(spark, d, "b", 9)
    return records.nearest_match(a, b, "frame", "aid", "bid", G.iou(G.box("a"), G.box("b")), "acls", "bcls")


@query("WITH u AS (SELECT user_id, row_number() OVER (ORDER BY substr(md5(CAST(user_id AS VARCHAR)), 1, 3), user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, count(*) AS n FROM events JOIN u USING (user_id) WHERE i % 4 = 1 GROUP BY 1")
def modulo_shard(spark, d):
    return records.modulo_shard(table(spark, d, "events"), "user_id", 4, 1).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT printf('shard_%03d', i // 40) AS shard, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), doc_id) - 1 AS i FROM documents) GROUP BY 1")
def shard_layout(spark, d):
    return records.shard_names(table(spark, d, "documents").select("doc_id"), "doc_id", 40).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def joined_shards(spark, d):
    """Disjoint shards put together again."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    parts = [docs.where(F.col("doc_id") % 3 == i) for i in range(3)]
    return records.disjoint_union(parts, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("WITH x AS (SELECT 'missing file' AS problem, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'malformed', count(*) FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es') UNION ALL SELECT 'term qqzzqq', 1 - CAST(bool_or(contains(lower(text), 'qqzzqq')) AS INT) FROM documents UNION ALL SELECT 'term the', 1 - CAST(bool_or(contains(lower(text), 'the')) AS INT) FROM documents) SELECT problem, CAST(n AS BIGINT) AS n FROM x WHERE n > 0")
def corpus_problems(spark, d):
    docs = table(spark, d, "documents").withColumn("bad", F.when(F.col("lang").isNull() | ~F.col("lang").isin("en", "de", "fr", "es"), F.coalesce("lang", F.lit("none"))))
    return records.validate_corpus(docs, "bad", "doc_id", table(spark, d, "labels").select("doc_id"), F.col("text"), ["qqzzqq", "the"])


@query("SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(CAST(v > 200 AS INT)), 6) AS bright FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1")
def channel_stats(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(records.channel_stats(e, ["label"], "v"), "mean", "std", "p25", "p50", "p75", "lo", "hi", "bright")


@query(f"WITH {_CUED}, s AS (SELECT frame, count(*) AS n, count(*) FILTER (face_kpts = 0) AS warming, count(*) FILTER (face_kpts <> 0 AND v1 IN ('looking_away', 'head_down', 'turned_to_peer', 'phone_use')) AS off_task, count(*) FILTER (face_kpts <> 0 AND v1 = 'phone_use') AS phones FROM cued GROUP BY 1) SELECT *, round(off_task / CAST(greatest(n - warming, 1) AS DOUBLE), 6) AS share FROM s")
def frame_summaries(spark, d):
    r = annotations(spark, d).withColumn("cue", cues.cue("v1"))
    out = records.frame_summary(r, "frame", "cue", F.col("face_kpts") == 0, cues.OFF_TASK)
    return rounded(out.withColumn("phones", F.coalesce(F.element_at("by_cue", F.lit("phone_use")), F.lit(0)).cast("long")).drop("by_cue"), "share")


@query("WITH x AS (SELECT event_type, (value + 1) / 1000 AS s FROM events) SELECT event_type, count(*) AS n, round(1 / avg(s), 4) AS fps_mean, round(1 / quantile_cont(s, 0.5), 4) AS fps_p50, round(avg(s) * 1000, 4) AS ms_mean, round(quantile_cont(s, 0.5) * 1000, 4) AS ms_p50, round(quantile_cont(s, 0.9) * 1000, 4) AS ms_p90, round(quantile_cont(s, 0.95) * 1000, 4) AS ms_p95, round(quantile_cont(s, 0.99) * 1000, 4) AS ms_p99, round(max(s) * 1000, 4) AS ms_max, round(avg(CAST(s > 0.04 AS INT)), 4) AS drop_25, round(avg(CAST(s > 0.1 AS INT)), 4) AS drop_10 FROM x GROUP BY 1")
def latency_report(spark, d):
    x = table(spark, d, "events").select("event_type", ((F.col("value") + 1) / 1000).alias("s"))
    out = records.latency_report(x, ["event_type"], "s")
    return rounded(out, *[c for c in out.columns if c not in ("event_type", "n")], digits=4)


@query("""WITH x AS (SELECT l_orderkey, list_distinct(list(l_returnflag || l_linestatus)) AS t, list_distinct(list(l_returnflag || CASE WHEN l_partkey % 3 = 0 THEN 'O' ELSE l_linestatus END)) AS p FROM lineitem GROUP BY 1), tags AS (SELECT DISTINCT unnest(list_concat(t, p)) AS tag FROM x
), s AS (SELECT tag, (SELECT count(*) FROM x WHERE list_contains(t, tag)) AS n, (SELECT count(*) FROM x WHERE list_contains(p, tag)) AS called, (SELECT count(*) FROM x WHERE list_contains(t, tag) AND list_contains(p, tag)) AS tp FROM tags), r AS (SELECT tag, n, tp / (called + 1e-9) AS p, tp / (n + 1e-9) AS r FROM s)
SELECT tag, n, round(p, 6) AS precision, round(r, 6) AS recall FROM r UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), round(avg(p), 6), round(avg(r), 6) FROM r""")
def tag_scores(spark, d):
    status = F.when(F.col("l_partkey") % 3 == 0, "O").otherwise(F.col("l_linestatus"))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("t"), F.collect_set(F.concat(F.col("l_returnflag"), status)).alias("p"))
    return rounded(records.tag_scores(x, "p", "t"), "precision", "recall")


@query(f"WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(0, 'doc_id')}, doc_id) AS r FROM documents), n AS (SELECT floor(count(*) FILTER (lang NOT IN ('en', 'de') OR lang IS NULL) * 0.5 / 0.5) AS t FROM documents), m AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {_MD5.format(0, 'doc_id')}, doc_id) AS r FROM documents WHERE lang IN ('en', 'de')) SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL UNION ALL SELECT doc_id, lang FROM m, n WHERE r <= t")
def majority_caps(spark, d):
    """Two common languages together are at most half."""
    return sampling.majority_cap(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["en", "de"], ["doc_id"], 0.5)


_FLOORED = " UNION ".join(f"SELECT doc_id FROM x QUALIFY row_number() OVER (PARTITION BY {f} ORDER BY {_MD5.format('0' + f, 'doc_id')}, doc_id) <= 4" for f in ("lang", "source"))


@query(f"""WITH x AS (SELECT doc_id, lang, source, CASE WHEN n_chars % 5 > 0 THEN (n_chars % 97) / 97.0 END AS conf FROM documents), f AS ({_FLOORED}), m AS (SELECT greatest(60 - 15 - (SELECT count(*) FROM f), 0) AS m
), fill AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_MD5.format(0, 'doc_id')}, doc_id) AS r FROM x WHERE doc_id NOT IN (SELECT doc_id FROM f)), m WHERE r <= m), rep AS (SELECT doc_id FROM f UNION ALL SELECT doc_id FROM fill
), hard AS (SELECT doc_id FROM x WHERE doc_id NOT IN (SELECT doc_id FROM rep) ORDER BY conf ASC NULLS LAST, {_MD5.format(0, 'doc_id')}, doc_id LIMIT 15)
SELECT doc_id, 'representative' AS "group" FROM rep UNION ALL SELECT doc_id, 'hard' FROM hard""")
def golden_sample(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") % 5 > 0, (F.col("n_chars") % 97) / 97.0).alias("conf"))
    return sampling.golden_sample(x, ["lang", "source"], "doc_id", "conf", 60, 4, 0.25).select("doc_id", "group")


@query(f"""WITH x AS (SELECT event_id, event_type, user_id % 3 AS g FROM events), f AS (SELECT event_id FROM x WHERE event_type IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format(0, 'event_id')}, event_id) <= 5
), l AS (SELECT *, row_number() OVER (PARTITION BY event_type, g ORDER BY {_MD5.format(0, 'event_id')}, event_id) AS turn FROM x WHERE event_id NOT IN (SELECT event_id FROM f)), o AS (SELECT event_id, row_number() OVER (ORDER BY turn, md5('0s|' || event_type || '|' || CAST(g AS VARCHAR)), event_type, g) AS r FROM l)
SELECT event_id FROM f UNION ALL SELECT event_id FROM o WHERE r <= 70 - (SELECT count(*) FROM f)""")
def rare_first(spark, d):
    x = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("g"))
    return sampling.rare_first(x, F.col("event_type").isin("error", "signup"), "event_type", ["event_type", "g"], "event_id", 70, 5).select("event_id")


@query(f"""WITH f AS (SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format(0, 'event_id')}, event_id) <= 7), r AS (SELECT event_id, row_number() OVER (ORDER BY {_MD5.format(0, 'event_id')}, event_id) AS r FROM events WHERE event_id NOT IN (SELECT event_id FROM f))
SELECT event_id FROM f UNION ALL SELECT event_id FROM r WHERE r <= 44 - (SELECT count(*) FROM f)""")
def even_draw(spark, d):
    """A draw of 44 events, as even over six classes (one of them empty) as they allow."""
    return sampling.even_draw(table(spark, d, "events").select("event_id", "event_type"), "event_type", 6, "event_id", 44).select("event_id")


_PARTS = {"train": 0.7, "val": 0.15, "test": 0.15}


@query(f"""WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i, sum(count(*)) OVER () AS total FROM events GROUP BY 1
), s(i, user_id, split, a, b, c) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT) UNION ALL
  SELECT x.i, x.user_id, w, CASE WHEN w = 'train' THEN a + n ELSE a END, CASE WHEN w = 'val' THEN b + n ELSE b END, CASE WHEN w = 'test' THEN c + n ELSE c END
  FROM (SELECT g.i, g.user_id, g.n, s.a, s.b, s.c, CASE WHEN 0.7 - s.a / total >= 0.15 - s.b / total AND 0.7 - s.a / total >= 0.15 - s.c / total THEN 'train' WHEN 0.15 - s.b / total >= 0.15 - s.c / total THEN 'val' ELSE 'test' END AS w FROM s JOIN g ON g.i = s.i + 1) x)
SELECT split, count(*) AS users, CAST(sum(n) AS BIGINT) AS n FROM s JOIN g USING (user_id) GROUP BY 1""")
def greedy_split(spark, d):
    """Whole users in three parts, the largest first."""
    out = sampling.greedy_split(table(spark, d, "events").select("user_id", "event_id"), "user_id", _PARTS)
    return out.groupBy("split").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query(f"WITH g AS (SELECT user_id, row_number() OVER (ORDER BY {_MD5.format(0, 'user_id')}, user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, r <= greatest(1, CAST(round_even(n * 0.3, 0) AS BIGINT)) AS held, (SELECT count(*) FROM events e WHERE e.user_id = g.user_id) AS n FROM g")
def drawn_split(spark, d):
    return sampling.drawn_split(table(spark, d, "events"), "user_id", 0.3).groupBy("user_id", "held").agg(F.count("*").alias("n"))


@query(f"WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT user_id, n, sum(n) OVER (ORDER BY {_MD5.format(0, 'user_id')}, user_id) - n AS before, sum(n) OVER () AS total FROM g) SELECT user_id, n, before < total * 0.3 AS calibration FROM s")
def calibration_split(spark, d):
    return sampling.calibration_split(table(spark, d, "events"), "user_id", 0.3).groupBy("user_id", "calibration").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(DISTINCT event_type) AS sides FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def leaked_groups(spark, d):
    """Users on more than one side, event types standing for sides."""
    return sampling.leaks(table(spark, d, "events"), "user_id", "event_type")


@query(f"WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format(0, 'event_id')}, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events), h AS (SELECT *, least(n, 300) AS m FROM r WHERE r < 300) SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS rows FROM (SELECT event_type, event_id, unnest(range(r, 300, m)) AS turn FROM h) GROUP BY 1")
def cyclic_sample(spark, d):
    """Three hundred events of each type, those of rare types again and again."""
    out = sampling.cyclic(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], 300)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("rows"))


@query(f"WITH q(event_type, q) AS (VALUES ('view', 9), ('click', 5), ('error', 2)), p AS (SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format(0, 'event_id')}, event_id) - 1) // q AS batch FROM events JOIN q USING (event_type)), f AS (SELECT batch FROM p GROUP BY 1 HAVING count(*) = 16) SELECT batch, event_type, count(*) AS n, min(event_id) AS first FROM p JOIN f USING (batch) GROUP BY 1, 2")
def source_batches(spark, d):
    """Batches of 16 events of three types, 4 to 2.5 to 1."""
    out = sampling.source_batches(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], {"view": 4, "click": 2.5, "error": 1}, 16)
    return out.groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"WITH k AS (SELECT doc_id, {_MD5.format(0, 'doc_id')} || '|' || CAST(doc_id AS VARCHAR) AS k FROM labels), r AS (SELECT doc_id, row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) - 1 AS i, count(*) OVER () AS n FROM k) SELECT doc_id, count(*) AS times FROM (SELECT doc_id, unnest(range(i, 1000, n)) AS turn FROM r WHERE i < 1000) GROUP BY 1")
def sized_sample(spark, d):
    """A thousand labels, again from the beginning where there are fewer."""
    return sampling.drawn_cyclic(table(spark, d, "labels").select("doc_id"), ["doc_id"], 1000).groupBy("doc_id").agg(F.count("*").alias("times"))


@query("WITH e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT (SELECT count(*) FROM (SELECT * FROM e UNION SELECT * FROM p)) AS either, (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM p INTERSECT SELECT * FROM s)) AS every, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM s)) AS only_errors, (SELECT count(*) FROM events WHERE event_type IN ('error', 'purchase', 'signup')) AS rows")
def user_sets(spark, d):
    """Set algebra of the users of some event types."""
    e = table(spark, d, "events").select("event_type", "user_id")
    of = {t: joins.keys_of(e.where(F.col("event_type") == t), ["user_id"]) for t in ("error", "purchase", "signup")}
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(joins.union_of(of["error"], of["purchase"]), "either"), n(joins.intersection_of(*of.values()), "every"), n(joins.difference_of(of["error"], of["signup"]), "only_errors"), n(e.where(F.col("event_type").isin(*of)), "rows")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))
    return out


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_per_group(spark, d):
    return joins.best_row(table(spark, d, "events").where("event_type = 'purchase'"), ["user_id"], [F.col("value"), -F.col("event_id")]).select("user_id", "event_id", "value")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_per_category(spark, d):
    """The three dearest parts of each brand, merged from two halves that keep three each."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    halves = [joins.top_rows(p.where(F.col("p_partkey") % 2 == i), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3) for i in (0, 1)]
    return joins.top_rows(halves[0].unionByName(halves[1]), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars ASC NULLS LAST, doc_id LIMIT 25")
def lowest_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.asc_nulls_last("n_chars"), "doc_id").limit(25)


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 3")
def most_common(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("WITH u AS (SELECT conv_id, turn, 0 AS rank, text FROM conversations UNION ALL SELECT conv_id, turn, 1, upper(text) FROM conversations WHERE turn % 2 = 0) SELECT conv_id, turn, text FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank, text) = 1")
def merged_results(spark, d):
    """Results of two workers, one row for each id, the first worker's."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lit(0).alias("rank"), "text")
    other = c.where(F.col("turn") % 2 == 0).withColumns({"rank": F.lit(1), "text": F.upper("text")})
    return joins.best_row(c.unionByName(other), ["conv_id", "turn"], [F.col("rank"), F.col("text")], smallest=True).select("conv_id", "turn", "text")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 ORDER BY l_orderkey LIMIT 40")
def first_of_frames(spark, d):
    """The first line of each order, forty orders."""
    one = joins.best_row(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], [F.col("l_linenumber")], smallest=True)
    return one.orderBy("l_orderkey").limit(40).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT s.s_suppkey, CASE WHEN r.r_name IN ('ASIA', 'EUROPE') THEN 'train' ELSE 'test' END AS split FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
def split_lookup(spark, d):
    """Suppliers with the split of their region."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    look = n.select("n_nationkey", F.when(F.col("r_name").isin("ASIA", "EUROPE"), "train").otherwise("test").alias("split"))
    return table(spark, d, "supplier").join(F.broadcast(look), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "split")


@query("SELECT count(*) AS mapped, (SELECT count(*) FROM orders WHERE o_custkey % 13 = 0) AS dropped FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_custkey % 13 <> 0")
def mapped_and_dropped(spark, d):
    """Orders that a lookup without every thirteenth customer maps, and those that it drops."""
    look = table(spark, d, "customer").where(F.col("c_custkey") % 13 != 0).select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    return joins.mapped(table(spark, d, "orders"), look, ["o_custkey"], "hit")
