"""Greedy operators against plain loops, and the small cases of episodes."""

import random

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import episodes as E
from tidemark.operators import folds, joins, sampling


def test_stride(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice("ab")) for k in range(5) for t in sorted(rng.sample(range(200), 40))]
    want = set()
    for k in range(5):
        last = prev = None
        for _, t, s in [r for r in rows if r[0] == k]:
            if last is None or s != prev or t - last >= 10:
                want.add((k, t, s))
                last = t
            prev = s
    got = folds.keep_by_stride(spark.createDataFrame(rows, "k int, t int, s string"), ["k"], "t", "s", 10)
    assert {tuple(r) for r in got.collect()} == want


def test_hash_anchor(spark):
    rng = random.Random(2)
    rows = [(0, i, None if rng.random() < 0.1 else rng.getrandbits(8)) for i in range(60)]
    want, last = [], None
    for _, i, h in rows:
        if h is None or last is None or bin(h ^ last).count("1") >= 4:
            want.append(i)
            last = h if h is not None else last
    got = folds.keep_by_hash(spark.createDataFrame(rows, "k int, o int, h long"), ["k"], "o", "h", 4)
    assert sorted(r["o"] for r in got.collect()) == want


def test_suppression(spark):
    rng = random.Random(3)
    rows = []
    for f in range(4):
        for i in range(15):
            x, y = rng.randrange(20), rng.randrange(20)
            rows.append((f, i, rng.randrange(5) / 5, x, y, x + 5 + rng.randrange(10), y + 5 + rng.randrange(10)))

    def iou(a, b):
        i = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return i / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i)

    want = set()
    for f in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
            if all(iou(k, r) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(f, r[1]) for r in kept}
    df = spark.createDataFrame(rows, "f int, i int, s double, a int, b int, c int, d int")
    assert {tuple(r) for r in folds.suppress(df, ["f"], "s", "i", "a", "b", "c", "d", 0.3).collect()} == want


def test_greedy_matching(spark):
    rng = random.Random(4)
    pairs = [(k, g, p, rng.randrange(1, 4) / 4) for k in range(6) for g in range(5) for p in range(5) if rng.random() < 0.6]
    for small in (False, True):
        want = set()
        for k in range(6):
            used_g, used_p = set(), set()
            for _, g, p, o in sorted((x for x in pairs if x[0] == k), key=lambda x: (-x[3], x[2], x[1]) if small else (-x[3], -x[1], -x[2])):
                if g not in used_g and p not in used_p:
                    used_g.add(g)
                    used_p.add(p)
                    want.add((k, g, p, o))
        df = spark.createDataFrame(pairs, "k int, g_id long, p_id long, tiou double")
        assert {tuple(r) for r in E.greedy_matches(df, ["k"], small).collect()} == want


def naive_episodes(rows, gap, least):
    out, start, last = [], None, None
    for t, on in rows:
        if on:
            start = t if start is None else start
            last = t
        elif start is not None and t - last > gap:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    return [(a, b) for a, b in out if b - a >= least]


def test_episodes_small_cases(spark):
    cases = {
        "simple": [0] * 5 + [1] * 6 + [0] * 10,
        "flicker": [0] * 5 + [1] * 2 + [0] * 5,
        "bridged": [0] * 5 + [1] * 4 + [0] + [1] * 4 + [0] * 8,
    }
    rng = random.Random(5)
    cases |= {f"r{i}": [rng.random() < 0.4 for _ in range(60)] for i in range(20)}
    rows = [(k, t, t, bool(on)) for k, v in cases.items() for t, on in enumerate(v)]
    got = E.episodes(spark.createDataFrame(rows, "k string, t long, i long, on boolean"), ["k"], "t", "i", F.col("on"), 2, 3)
    found = sorted((r["k"], r["t_start"], r["t_end"]) for r in got.collect())
    assert found == sorted((k, a, b) for k, v in cases.items() for a, b in naive_episodes(list(enumerate(v)), 2, 3))
    assert ("simple", 5, 10) in found and not [x for x in found if x[0] == "flicker"] and ("bridged", 5, 13) in found


def test_edit_score(spark):
    rows = [("a", i, x, y) for i, (x, y) in enumerate(zip([0, 0, 1, 2], [0, 1, 1, 1], strict=True))]
    out = E.edit_score(spark.createDataFrame(rows, "k string, t int, x long, y long"), ["k"], ["t"], "x", "y").first()
    assert abs(out["edit"] - 100 * (1 - 1 / 3)) < 1e-9


def test_labels(spark):
    df = spark.createDataFrame([(" Looking Down ",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(L.coerce_enum(F.col("v"), ["looking_down", "other"])).collect()] == ["looking_down", "other", "other"]
    probs = spark.createDataFrame([([0.5, 0.3, 0.2],), ([0.1, 0.1, 0.1],)], "p array<double>")
    assert [r[0] for r in probs.select(L.best_over_bars(F.col("p"), [0.45, 0.2, 0.3])).collect()] == [1, None]


def test_as_of_and_splits(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 50, 2), (2, 5, 3)], "k int, t long, id long")
    right = spark.createDataFrame([(1, 10, 7, 1.5), (1, 20, 8, 2.5)], "k int, t long, id long, v double")
    got = {r["id"]: (r["age"], r["v"]) for r in joins.as_of_join(left, right, ["k"], "t", "id", ["v"], 25).collect()}
    assert got == {1: (0, 1.5), 2: (None, None), 3: (None, None)}
    split = sampling.group_split(spark.range(300).withColumn("g", F.col("id") % 30), "g", {"a": 0.5, "b": 0.5})
    assert sampling.leaks(split, "g").isEmpty()
    turns = sampling.cyclic(spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(20)], "id int, c string"), "c", ["id"], 7)
    assert {(r["c"], r["turn"]) for r in turns.collect()} == {(c, t) for c in "xy" for t in range(7)}
