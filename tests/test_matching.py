"""Assignments against all permutations; seats, tracks and smoothing against plain loops; texts."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import matching as M
from tidemark.operators import records, sampling
from tidemark.streaming import stateful


def test_least_cost():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 2), (3, 3), (5, 5), (3, 5), (5, 2), (1, 4)):
        for _ in range(20):
            c = rng.integers(-5, 6, (n, m)).astype(float)
            found = M.least_cost(c)
            wide = c if n <= m else c.T
            best = min(sum(wide[i, p] for i, p in enumerate(ps)) for ps in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
            assert len(found) == min(n, m) == len({i for i, _ in found}) == len({j for _, j in found})
            assert abs(sum(c[i, j] for i, j in found) - best) < 1e-9
    assert M.with_dustbins(np.array([[1.0, 9.0], [9.0, 9.0]]), 3.0) == [(0, 0)]


def test_transport():
    plan = M.transport_plan(np.array([[0.0, 1.0, 2.0], [1.0, 0.0, 1.0], [2.0, 1.0, 0.0]]))
    assert np.allclose(plan.sum(0), 1 / 3, atol=1e-6) and np.allclose(plan.sum(1), 1 / 3, atol=1e-6) and (plan.argmax(1) == [0, 1, 2]).all()


def test_assigned(spark):
    rows = [(f, u, b, float((u * 7 + b * 5 + f) % 11)) for f in range(6) for u in range(3) for b in range(1 + f % 4)]
    df = spark.createDataFrame(rows, "frame long, unit int, box int, cost double")
    for method, reject in (("cost", None), ("cost", 4.0), ("transport", None)):
        out = M.assigned(df, "frame", "unit", "box", method, reject).collect()
        for f in range(6):
            mine = [(r["unit"], r["box"]) for r in out if r["frame"] == f]
            assert len({u for u, _ in mine}) == len({b for _, b in mine}) == len(mine) <= min(3, 1 + f % 4)
            if method == "cost" and reject is None:
                c = {(u, b): v for g, u, b, v in rows if g == f}
                n = 1 + f % 4
                best = min(sum(c[u, b] for u, b in zip(us, bs, strict=True)) for us in itertools.combinations(range(3), min(3, n)) for bs in itertools.permutations(range(n), min(3, n)))
                assert abs(sum(c[x] for x in mine) - best) < 1e-9


def test_seats(spark):
    rng = random.Random(2)
    rows = [(k, t, 800.0 * (t % 2) + rng.uniform(-2, 2), rng.uniform(-2, 2), 40.0) for k in range(2) for t in range(100)]
    rows += [(7, t, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(10, 90)) for t in range(60)]
    got = {(r["k"], r["t"]): r["seat"] for r in M.seats(spark.createDataFrame(rows, "k int, t int, x double, y double, s double"), "k", ["t"], "x", "y", "s").collect()}
    for k in (0, 1, 7):
        mine = [r for r in rows if r[0] == k]
        eps, found = 0.75 * max(60.0, float(np.median([r[4] for r in mine]))), []
        for _, t, x, y, _ in mine:
            far = [np.hypot(x - s[0], y - s[1]) for s in found]
            best = int(np.argmin(far)) if far else -1
            if best >= 0 and far[best] <= eps:
                s = found[best]
                found[best] = [(s[0] * s[2] + x) / (s[2] + 1), (s[1] * s[2] + y) / (s[2] + 1), s[2] + 1]
            else:
                found.append([x, y, 1])
                best = len(found) - 1
            assert got[k, t] == best
    assert len({v for (k, _), v in got.items() if k == 0}) == 2


def test_tracks(spark):
    """Two boxes that move slowly keep their tracks; one that is gone for longer than max_age gets a new one."""
    frames = []
    for t in range(12):
        dets = [(1, [10.0 + t, 10.0, 30.0 + t, 40.0], [1.0, 0.0])]
        if t < 4 or t >= 8:
            dets.append((2, [100.0, 10.0, 120.0, 40.0], [0.0, 1.0]))
        frames.append(("v", t, None if t == 2 else dets))
    df = spark.createDataFrame(frames, "v string, t int, dets array<struct<det: long, box: array<double>, feature: array<double>>>")
    got = {r["t"]: [(x["track"], x["det"]) for x in r["tracks"]] for r in M.tracks(df, "v", "t", "", [], max_age=3, min_hits=2).collect()}
    assert got[0] == [] and got[1] == [(1, 1), (2, 2)] and got[2] == [(1, None), (2, None)] and got[3] == [(1, 1), (2, 2)]
    assert got[5] == [(1, 1), (2, None)] and got[7] == [(1, 1)] and got[9] == [(1, 1), (3, 2)]


def test_smooth_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, i % 2, i * 10 + (1000 if i > 60 else 0), rng.choice("aabc")) for i in range(120)]
    path = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "id long, k long, t long, v string").coalesce(1).write.mode("append").parquet(path)
    got = {r["id"]: r["shown"] for r in stateful.run_to_end(stateful.smooth_labels(stateful.parquet_stream(spark, path, 1), "k", ["t", "id"], "v", "id", 5, 1, 500)).collect()}
    past, shown, last = {}, {}, {}
    for i, k, t, v in rows:
        if k in last and t - last[k] > 500:
            past.pop(k), shown.pop(k)
        last[k] = t
        past[k] = [*past.get(k, []), v][-5:]
        n = {x: past[k].count(x) for x in past[k]}
        best = next(x for x in n if (n[x], x == shown.get(k)) == max((n[y], y == shown.get(k)) for y in n))
        if k in shown and best != shown[k] and n[best] - n.get(shown[k], 0) < 1:
            best = shown[k]
        shown[k] = best
        assert got[i] == best


def test_texts(spark):
    rows = [("He sits.", "He sits."), ("Perhaps he sits, possibly. He reads.", "Perhaps he sits. He reads."), ("", "")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(texts.without_guesses(F.col("t"))).collect()]
    assert got == [b for _, b in rows]
    units = spark.createDataFrame([("Student 3: typing intently, focused. student 12:  a b c d e f, calm.",), ("none",)], "t string").select(M.units_of(F.col("t"))).collect()
    assert [tuple(u) for u in units[0][0]] == [(3, "typing intently", "focused", True), (12, "a b c d e f", "calm", False)] and units[1][0] == []


def test_records(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {tuple(r) for r in records.compare_versions(old, new, ["k"], ["v"]).collect()} == {(1, "dropped"), (2, "changed"), (4, "added")}
    for bad in (new, old.where("k < 3")):
        try:
            records.aligned(old.withColumn("y", F.lit(1)), bad.withColumn("y", F.lit(1)), ["k"], "y", "v").collect()
            raise AssertionError
        except Exception as e:
            assert "do not match" in str(e)
    assert not records.compatible({"a": {"x": (0, 2)}, "b": {"x": (1, 3)}}, "a", "b", ["x"])
    names = spark.createDataFrame([("d/t000033_856_f1.jpg",), ("x.jpg",), (".hidden",)], "p string").select(records.stem(F.col("p")), records.frame_seconds(records.basename(F.col("p")))).collect()
    assert [tuple(r) for r in names] == [("t000033_856_f1", 33.856), ("x", None), (".hidden", None)]


def test_splits(spark):
    rows = [(f"g{i % 13}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int")
    split = sampling.greedy_split(df, "g", {"a": 0.7, "b": 0.3})
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 500 and sampling.leaks(split, "g").isEmpty() and abs(sizes["a"] - 350) < 60
    assert sampling.drawn_split(df.where("g = 'g1'"), "g", 0.5).where("held").isEmpty()
    assert sampling.batch_quotas({"x": 2, "y": 1}, 16) == {"x": 11, "y": 5}
    assert sampling.drawn_cyclic(df, ["i"], -1).count() == 500
