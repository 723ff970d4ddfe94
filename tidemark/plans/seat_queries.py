"""Queries on places, appearance and seat numbers."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import clusters
from ..sources import files
from ..streaming import seats, stateful
from .base import HOUR, query, rounded, table
from .queries import EV, events


@query(f"""WITH RECURSIVE {EV}, p AS (SELECT user_id, event_id, value AS x, CAST(k AS DOUBLE) AS y, 0.5 * median(16 + event_id % 8) OVER (PARTITION BY user_id) AS eps FROM ev
), nb AS (SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM p a JOIN p b ON a.user_id = b.user_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= a.eps * a.eps
), core AS (SELECT user_id, a FROM nb GROUP BY 1, 2 HAVING count(*) >= 5
), reach(user_id, a, r) AS (SELECT user_id, a, a FROM core UNION SELECT reach.user_id, reach.a, nb.b FROM reach JOIN nb ON nb.user_id = reach.user_id AND nb.a = reach.r JOIN core c ON c.user_id = nb.user_id AND c.a = nb.b
), lab AS (SELECT user_id, a, dense_rank() OVER (PARTITION BY user_id ORDER BY c) - 1 AS seat FROM (SELECT user_id, a, min(r) AS c FROM reach GROUP BY 1, 2)
), edge AS (SELECT nb.user_id, nb.a, min(seat) AS seat FROM nb JOIN lab ON lab.user_id = nb.user_id AND lab.a = nb.b WHERE (nb.user_id, nb.a) NOT IN (SELECT user_id, a FROM core) GROUP BY 1, 2
), known AS (SELECT * FROM lab UNION ALL SELECT * FROM edge
), mean AS (SELECT p.user_id, seat, avg(x) AS mx, avg(y) AS my FROM known JOIN p ON p.user_id = known.user_id AND p.event_id = known.a GROUP BY 1, 2
), lone AS (SELECT p.user_id, p.event_id, arg_min(seat, (sqrt(power(x - mx, 2) + power(y - my, 2)), seat)) AS seat FROM p JOIN mean USING (user_id) WHERE (p.user_id, p.event_id) NOT IN (SELECT user_id, a FROM known) AND sqrt(power(x - mx, 2) + power(y - my, 2)) < 2 * eps GROUP BY 1, 2
)
SELECT p.user_id, p.event_id, CAST(coalesce(k.seat, l.seat, -1) AS INTEGER) AS seat FROM p LEFT JOIN known k ON k.user_id = p.user_id AND k.a = p.event_id LEFT JOIN lone l ON l.user_id = p.user_id AND l.event_id = p.event_id""")
def density_seats(spark, d):
    """Each user's events as places: dense ones are seats."""
    ev = events(spark, d).select("user_id", "event_id", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (16 + F.col("event_id") % 8).alias("span"))
    eps = ev.groupBy("user_id").agg((0.5 * F.median("span")).alias("eps"))
    return clusters.density_clusters(ev.join(eps, "user_id"), ["user_id"], "event_id", "x", "y", "eps")


def _looks(spark, d):
    """Embeddings as rows of thirty to a frame, three rooms, the label as what the row shows."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 3).alias("room"), (F.floor(F.col("vec_id") / 30) * 20).alias("frame"), F.slice("embedding", 1, 16).alias("look"), "label")


_LOOKS = "lk AS (SELECT vec_id, vec_id % 3 AS room, vec_id // 30 * 20 AS frame, embedding[1:16] AS look, label FROM embeddings)"
_FAR = "list_sum(list_transform(range(1, 17), lambda i: abs(CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)))) / 16"


@query(f"WITH {_LOOKS} SELECT a.room, a.vec_id, count(*) AS n, round(min({_FAR.format(a='a.look', b='b.look')}), 6) AS least FROM lk a JOIN lk b ON a.room = b.room AND a.frame - b.frame BETWEEN 19 AND 62 GROUP BY 1, 2")
def appearance_costs(spark, d):
    """Of each row the rows one to three frames before, and the smallest difference of appearance."""
    pairs = C.lagged_pairs(_looks(spark, d), ["room"], "frame", "vec_id", "look")
    return pairs.groupBy("room", F.col("ident").alias("vec_id")).agg(F.count("*").alias("n"), F.round(F.min("cost"), 6).alias("least"))


@query()
def appearance_chains(spark, d):
    """Rows chained by appearance from frame to frame; tested against a plain loop."""
    return C.chains(_looks(spark, d), "room", "frame", "vec_id", "look", 0.12)


def _broken(spark, d):
    """Chains by label, cut in pieces of frames; every seventh row is of a chain beside them."""
    beside = F.when(F.col("vec_id") % 7 == 0, 50).otherwise(0)
    return _looks(spark, d).withColumn("chain", F.col("label").cast("long") * 100 + beside + F.floor(F.col("vec_id") / 150))


_BROKEN = f"{_LOOKS}, br AS (SELECT *, CAST(label * 100 + CASE WHEN vec_id % 7 = 0 THEN 50 ELSE 0 END + vec_id // 150 AS BIGINT) AS chain FROM lk)"


@query(f"""WITH {_BROKEN}, r AS (SELECT room, chain, frame, min(look) AS f FROM br GROUP BY 1, 2, 3), h AS (SELECT room, chain, min(frame) AS begin, arg_min(f, frame) AS own, count(*) AS size FROM r GROUP BY 1, 2
), g AS (SELECT * FROM h QUALIFY begin > min(begin) OVER (PARTITION BY room)), p AS (SELECT g.room, g.chain AS fragment, begin, own, size, r.chain, r.frame, r.f FROM g JOIN r ON r.room = g.room AND r.chain <> g.chain
), s AS (SELECT room, fragment, chain, any_value(begin) AS begin, any_value(own) AS own, any_value(size) AS size, min(frame) AS chain_begin, max(frame) FILTER (frame < begin) AS before, arg_max(f, frame) FILTER (frame < begin) AS bf, min(frame) FILTER (frame >= begin) AS after, arg_min(f, frame) FILTER (frame >= begin) AS af FROM p GROUP BY 1, 2, 3
), c AS (SELECT a.room, a.chain AS fragment, b.chain, count(*) AS shared FROM r a JOIN r b ON a.room = b.room AND a.frame = b.frame AND a.chain <> b.chain GROUP BY 1, 2, 3)
SELECT s.room, s.fragment, begin, size, s.chain, chain_begin, coalesce(shared, 0) AS shared, before, round({_FAR.format(a='own', b='bf')}, 6) AS before_cost, after, round({_FAR.format(a='own', b='af')}, 6) AS after_cost FROM s LEFT JOIN c ON c.room = s.room AND c.fragment = s.fragment AND c.chain = s.chain""")
def fragment_overlaps(spark, d):
    """Each broken chain against the others of its room: shared frames, and appearance at the frames next to its begin."""
    return rounded(C.fragment_pairs(_broken(spark, d), ["room"], "frame", "chain", "look"), "before_cost", "after_cost")


def _anchored(spark, d):
    """Every fifth row tells its label."""
    return _broken(spark, d).withColumn("name", F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("v"), F.col("label").cast("string"))))


@query()
def merged_fragments(spark, d):
    """What broken chains are merged into; tested against a plain loop."""
    rows = _anchored(spark, d)
    anchors = rows.where("name IS NOT NULL").groupBy("room", "chain", "name").agg(F.count("*").alias("n"))
    return C.merge_chains(rows, anchors, "room", "frame", "chain", "look")


@query(f"""WITH {_LOOKS}, v AS (SELECT room, vec_id % 11 AS chain, CASE WHEN vec_id % 5 = 0 THEN 'v' || label END AS name FROM lk), n AS (SELECT room, chain, name, count(*) AS n FROM v WHERE name IS NOT NULL GROUP BY 1, 2, 3
), b AS (SELECT room, chain, arg_min(name, (-n, name)) AS given FROM n GROUP BY 1, 2), t AS (SELECT v.*, given FROM v LEFT JOIN b USING (room, chain))
SELECT room, count(DISTINCT chain) AS n_chains, count(name) AS anchors, count(*) FILTER (name = given) AS correct, (SELECT count(*) FROM (SELECT room, chain FROM n GROUP BY 1, 2 HAVING count(*) > 1) m WHERE m.room = t.room) AS mixed, count(DISTINCT given) AS distinct_names, round(count(*) FILTER (name = given) / CAST(greatest(count(name), 1) AS DOUBLE), 6) AS accuracy FROM t GROUP BY room""")
def chain_purity(spark, d):
    """How well the votes of some rows name the chain of all."""
    v = _looks(spark, d).select("room", (F.col("vec_id") % 11).alias("chain"), F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("v"), F.col("label").cast("string"))).alias("name"))
    return rounded(C.purity(v, C.chain_names(v, ["room"], "chain", "name"), ["room"], "chain", "name"), "accuracy")


def _seated(rows):
    """Frames of six hours of each user: a track for the tens of k, mostly at a place of its own."""
    track = F.floor(F.col("k") / 20)
    x = 100.0 * F.when(F.col("event_id") % 9 == 0, 4 - track).otherwise(track) + F.col("value") % 30
    box = F.array(x, F.lit(0.0), x + 60, F.lit(90.0))
    return rows.select("user_id", F.floor(F.col("us") / (6 * HOUR)).alias("slot"), F.struct(track.alias("track"), F.col("event_id"), box.alias("box")).alias("row"))


def _frames(rows):
    """One row a frame: of each track the first event's box."""
    one = _seated(rows).groupBy("user_id", "slot", F.col("row.track").alias("track")).agg(F.min("row").alias("row"))
    return one.groupBy("user_id", "slot").agg(F.sort_array(F.collect_list(F.struct("track", F.col("row.box").alias("box")))).alias("tracks")).select("user_id", (F.col("slot") * 0.5).alias("t"), "tracks")


def _told(df):
    return df.select("user_id", "t", F.array_join(F.transform("seats", lambda s: F.format_string("%d:%d", s["track"], s["seat"])), " ").alias("seats"), F.array_join(F.transform("events", lambda e: F.concat(e["track"].cast("string"), F.lit(" "), e["how"], F.lit(" "), e["seat"].cast("string"))), ", ").alias("events"), F.array_join(F.col("cleared").cast("array<string>"), " ").alias("cleared"))


@query()
def seat_registry(spark, d):
    """Seat numbers of each user's tracks; tested by cases and against the stream."""
    return _told(seats.seat_numbers(_frames(events(spark, d)), "user_id", "t", "tracks", seats.SeatRules(settle_s=0.4, keep_s=4.0)))


@query()
def stream_seat_registry(spark, d):
    """The same from a stream of the frames in four micro-batches."""
    folder = files.scratch(spark, "frames")
    frames = files.written(_frames(events(spark, d)).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))), "frames")
    low, high = frames.agg(F.min("t"), F.max("t")).first()

    def bring(i):
        cut = [low + (high - low) * j / 4 for j in (i, i + 1)]
        frames.where((F.col("t") >= cut[0]) & ((F.col("t") < cut[1]) | F.lit(i == 3))).write.mode("append").parquet(folder)

    bring(0)
    told = seats.stream_seat_numbers(stateful.parquet_stream(spark, folder).withWatermark("ts", "1 second"), "user_id", "t", "tracks", 100_000.0, seats.SeatRules(settle_s=0.4, keep_s=4.0))
    return _told(stateful.run_to_end(told, [functools.partial(bring, i) for i in (1, 2, 3)]))
