"""What grew faster than the tables, or in one task: bootstrap draws, state of seats, trackers, pairs of a frame."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import matching, resample
from tidemark.streaming import seats, stateful


def test_draws_stream_past_clusters(spark):
    """Draws are as many as clusters times replicates: no table of them is held for grouping."""
    rows = [(f"c{i}", i % 7, i % 5 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, top long, bottom long")
    out = resample.bootstrap_metrics(df, "c", ["top", "bottom"], {"share": F.col("top") / F.col("bottom")}, 9)
    got = out.first()
    assert not re.search(r"keys=\[rep#\d+L?, i#", out._jdf.queryExecution().executedPlan().toString())
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order, each = sorted(rows, key=lambda r: (md5(r[0])[:3], r[0])), []
    for rep in range(9):
        drawn = [order[int(md5(f"0|{rep * 60 + i}")[:8], 16) % 60] for i in range(60)]
        each.append(sum(r[1] for r in drawn) / sum(r[2] for r in drawn))
    assert abs(got["boot_mean"] - sum(each) / 9) < 1e-12 and abs(got["point"] - sum(r[1] for r in rows) / sum(r[2] for r in rows)) < 1e-12


class Handle:
    """A session's state that counts the calls, each of which goes through a socket."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_seats_ask_state_once(spark):
    """However many seats there are, a session's micro-batch reads and writes its state once, and its timer follows it."""
    handle, row = Handle(), Row("s", "t", seats.TOLD)
    p = seats.SeatProcessor("s", "t", seats.SeatRules(), 60.0)
    p.init(handle)
    told = lambda n: "[%s]" % ",".join('{"track":%d,"box":[%d,0,%d,90]}' % (k, 100 * k, 100 * k + 60) for k in range(n))
    handle.now = 0
    first = list(p.handleInputRows((1,), iter([row(1, 6.0, told(30)), row(1, 5.0, told(30))]), handle))
    assert [r["t"] for r in first] == [5.0, 6.0] and len(first[0]["events"]) == 30 and handle.calls == 3 and handle.timers == [66_001]
    second = list(p.handleInputRows((1,), iter([row(1, 50.0, told(30))]), handle))
    assert handle.calls == 5 and second[0]["events"] == [] and {s["track"]: s["seat"] for s in second[0]["seats"]} == {k: k + 1 for k in range(30)}
    handle.now = 70_000  # the timer goes off, the session is alive
    list(p.handleExpiredTimer((1,), handle, None))
    assert handle.value and handle.timers == [66_001, 110_001]
    handle.now = 110_001
    list(p.handleExpiredTimer((1,), handle, None))
    assert handle.value is None


def test_run_in_parts(spark, tmp_path):
    """Each part is one micro-batch, of however many files."""
    path = str(tmp_path)
    put = lambda i: spark.range(i * 100, i * 100 + 100, 1, 3).write.mode("append").parquet(path)
    put(0)
    seen = stateful.parquet_stream(spark, path).withColumn("batch", F.current_timestamp())
    out = stateful.run_to_end(seen, [lambda: put(1), lambda: put(2)]).groupBy("batch").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    assert sorted((r["a"], r["n"]) for r in out.collect()) == [(0, 100), (100, 100), (200, 100)]


def test_tracks_by_loops(spark):
    """Many videos, features and frames not looked at, against the plain rule; rows go through the tasks as columns."""
    rng, rows, want = random.Random(5), [], {}
    size = lambda v: max(0.0, v[2] - v[0]) * max(0.0, v[3] - v[1])
    for video in range(25):
        tracks, n = {}, 0
        for t in range(14):
            dets = None
            if rng.random() < 0.9:
                dets = []
                for i in range(rng.randrange(6)):
                    x, y = rng.randrange(0, 60), rng.randrange(0, 60)
                    dets.append((100 * t + i, [float(x), float(y), float(x + rng.randrange(20, 60)), float(y + rng.randrange(20, 60))], None if rng.random() < 0.5 else [rng.random(), rng.random()]))
            rows.append((video, t, dets))
            took = {}
            if dets is not None:
                free = dict(enumerate(dets))
                for k, v in tracks.items():
                    fits = []
                    for i, (_, b, f) in free.items():
                        both = max(0.0, min(v["box"][2], b[2]) - max(v["box"][0], b[0])) * max(0.0, min(v["box"][3], b[3]) - max(v["box"][1], b[1]))
                        o = both / (size(v["box"]) + size(b) - both + 1e-6)
                        like = 0.0 if f is None or v["f"] is None else float(np.array(v["f"]) @ np.array(f) / (np.linalg.norm(v["f"]) * np.linalg.norm(f)))
                        if o >= 0.175:
                            fits.append((0.65 * o + 0.35 * max(0.0, like), -i))
                    if fits and max(fits)[0] >= 0.25:
                        took[k] = free.pop(-max(fits)[1])
                for k, v in tracks.items():
                    v["age"] = 0 if k in took else v["age"] + 1
                    if k in took:
                        f = took[k][2]
                        v["hits"], v["box"] = v["hits"] + 1, took[k][1]
                        v["f"] = v["f"] if f is None else np.array(f) if v["f"] is None else 0.8 * v["f"] + 0.2 * np.array(f)
                for d in free.values():
                    n += 1
                    tracks[n] = {"box": d[1], "f": None if d[2] is None else np.array(d[2]), "age": 1, "hits": 1}
                    took[n] = d
                tracks = {k: v for k, v in tracks.items() if v["age"] <= 2}
            want[video, t] = [(k, took[k][0] if k in took else None) for k, v in tracks.items() if v["hits"] >= 2]
    df = spark.createDataFrame(rows, "v long, t int, dets array<struct<det: long, box: array<double>, feature: array<double>>>")
    out = matching.tracks(df.repartition(3), "v", "t", "", [], max_age=2, min_hits=2)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["v"], r["t"]): [tuple(x) for x in r["tracks"]] for r in out.collect()} == want and sum(map(len, want.values())) > 300


def test_pairs_are_not_sorted(spark):
    """Units and boxes are ranked before they are paired; what is made of the pairs of a frame needs no sort of them."""
    from tidemark.plans import match_queries

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    plan = match_queries.matching_costs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" in plan and "Sort [" not in plan[: plan.index("SortMergeJoin")]
    units = spark.createDataFrame([(1, 1), (1, 2), (2, 4)], "f long, u int")
    boxes = spark.createDataFrame([(1, 7, 5.0), (1, 8, 1.0), (1, 9, 3.0), (2, 3, 1.0)], "f long, b int, x double")
    pairs = matching.costs(matching.spatial_pairs(units, boxes, "f", "u", "b", F.col("x")).withColumn("s", F.col("u") * F.col("b")), "f", "s", "spatial", None, (1.0, 0.5, 0.0))
    got = {(r["f"], r["u"], r["b"]): (r["cost"], r["margin"]) for r in matching.margins(pairs, spark.createDataFrame([(1, 1, 8), (1, 2, 9), (2, 4, 3)], "f long, u int, b int"), "f", "u", "b").collect()}
    sims = np.array([[7.0, 8.0, 9.0], [14.0, 16.0, 18.0]])
    # ranks from left to right: box 8, 9, 7
    cost = -((sims - sims.mean()) / (sims.std() + 1e-8) + 0.5 * (1 - np.abs(np.array([[0 - 2, 0, 0 - 1], [1 - 2, 1, 0]])) / 2))
    assert set(got) == {(1, 1, 8), (1, 2, 9), (2, 4, 3)} and got[2, 4, 3][1] is None
    assert abs(got[1, 1, 8][0] - cost[0, 1]) < 1e-9 and abs(got[1, 1, 8][1] - (min(cost[0, 0], cost[0, 2]) - cost[0, 1])) < 1e-9
    assert abs(got[1, 2, 9][0] - cost[1, 2]) < 1e-9 and abs(got[1, 2, 9][1] - (min(cost[1, 0], cost[1, 1]) - cost[1, 2])) < 1e-9
