"""Side opinions, newest rows, calibration models and benchmark rules against plain loops."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import calibrate, metrics
from tidemark.operators import detection_rules as R
from tidemark.streaming import live, stateful


def test_opinions_over_batches(spark, tmp_path):
    """Late and absent opinions: each frame comes out once, with the newest opinion that the stream still had in time."""
    kind = "k long, s double, id long"
    put = lambda name, rows: spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    frames = [(k, float(s), 100 * k + s) for k in (1, 2, 3) for s in range(100, 160, 3)]
    told = [(1, 102.0, 1), (1, 102.0, 2), (1, 120.0, 3), (2, 131.0, 4), (None, 105.0, 5), (1, 400.0, 6)]
    for lo, hi in ((0, 130), (130, 500)):
        put("f", [r for r in frames if lo <= r[1] < hi] + ([(9, 400.0, 9)] if hi == 500 else []))
        put("o", [r for r in told if lo <= r[1] < hi])
    put("f", [(9, 500.0, 10)])
    put("o", [(1, 110.0, 99), (9, 500.0, 7)])  # far too late
    read = lambda n: stateful.parquet_stream(spark, str(tmp_path / n), 1).withWatermark("ts", "5 seconds")
    out = live.side_opinions(read("f"), read("o").withColumnRenamed("id", "opinion"), "k", "ts", "id", ["opinion"], "opinion", "12 SECONDS")
    got = [(r["k"], r["id"], r["age_us"], r["opinion"]) for r in stateful.run_to_end(out).collect()]
    want = []
    for k, s, i in frames:
        near = [(t, o) for a, t, o in told if a == k and s - 12 <= t <= s]
        want.append((k, i, round((s - max(near)[0]) * 1e6), max(near)[1]) if near else (k, i, None, None))
    assert Counter(r for r in got if r[0] != 9) == Counter(want) and sum(r[3] is not None for r in want) > 6


def test_newest_twice(spark, tmp_path):
    rows = [(i, i % 3, (i * 7) % 20) for i in range(60)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for p in range(3):
        spark.createDataFrame(rows[20 * p : 20 * p + 20], "id long, cam long, t long").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # a second query from the start commits the same batches again: nothing changes
        live.take_newest(stateful.parquet_stream(spark, src, 1), "cam", ["t", "id"], out).trigger(availableNow=True).start().awaitTermination()
        taken = live.newest_rows(spark, out, "id long, cam long, t long")
        got = {r["cam"]: (r["n_read"], r["n_taken"], r["n_dropped"]) for r in live.drop_counts(taken, "cam").collect()}
        assert got == {c: (20, 3, 17) for c in range(3)}
        want = {max((r for r in rows[20 * p : 20 * p + 20] if r[1] == c), key=lambda r: (r[2], r[0]))[0] for p in range(3) for c in range(3)}
        assert {r["id"] for r in taken.collect()} == want


def pooled(points):
    """Blocks of (score, sum, n) by pooling neighbours."""
    held = []
    for s, top, n in sorted(points):
        block = [s, s, top, n]
        while held and held[-1][2] * block[3] >= block[2] * held[-1][3]:
            before = held.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        held.append(block)
    return held


def test_isotonic(spark):
    rng = random.Random(4)
    for n, parts in ((400, "8"), (400, "3"), (1, "4")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = [(round(rng.random(), 2), rng.random() < 0.5) for _ in range(n)]
            rows = [(s, y if n == 1 else rng.random() < (0.9 - 0.8 * s if s < 0.3 else s)) for s, y in rows]
            sums = defaultdict(lambda: [0, 0])
            for s, y in rows:
                sums[s][0] += y
                sums[s][1] += 1
            want = pooled([(s, *v) for s, v in sums.items()])
            df = spark.createDataFrame([*rows, (None, True), (0.5, None)], "s double, y boolean")
            blocks = calibrate.isotonic(df, "s", "y")
            got = sorted((r["low"], r["high"], r["n"], round(r["value"], 12)) for r in blocks.collect())
            assert got == [(a, b, k, round(t / k, 12)) for a, b, t, k in want]
            asked = [-1.0, 0.0, 0.005, 0.333, 0.5, 0.999, 2.0, None] + [r[0] for r in rows[:20]]
            fit = calibrate.isotonic_score(spark.createDataFrame([(x,) for x in asked], "s double"), "s", blocks, "f")
            xs, ys = [v for b in want for v in b[:2]], [b[2] / b[3] for b in want for _ in range(2)]
            for r in fit.collect():
                assert r["f"] is None if r["s"] is None else abs(r["f"] - np.interp(r["s"], xs, ys)) < 1e-9
            assert fit.count() == len(asked)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def _nll(z, y):
    z = z - z.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())


def test_temperature_and_vector_scaling(spark):
    rng = np.random.default_rng(5)
    raw = rng.dirichlet([1, 1, 1], 300)
    y = np.array([rng.choice(3, p=(p**0.5) / (p**0.5).sum()) for p in raw])
    df = spark.createDataFrame([(p.tolist(), int(c)) for p, c in zip(raw, y, strict=True)] + [(None, 1)], "p array<double>, y int")
    z = np.log(np.clip(raw, 1e-12, 1))
    t = calibrate.golden_temperature(df, "p", "y")
    grid = min(np.exp(np.linspace(math.log(0.05), math.log(10), 40_001)), key=lambda t: _nll(z / t, y))
    assert abs(t - grid) < 1e-3
    w, b = calibrate.vector_scaling(df, "p", "y", 3)
    theta = np.concatenate([np.ones(3), np.zeros(3)])
    eye = np.eye(3)[y]
    for _ in range(60_000):  # plain gradient descent
        s = z * theta[:3] + theta[3:]
        p = np.exp(s - s.max(1, keepdims=True))
        off = p / p.sum(1, keepdims=True) - eye
        step = np.concatenate([(off * z).mean(0), off.mean(0)])
        theta -= 0.3 * step
        if np.abs(step).max() < 1e-9:
            break
    assert np.abs(np.array(w) - theta[:3]).max() < 1e-4 and np.abs(np.array(b) - np.mean(b) - theta[3:] + theta[3:].mean()).max() < 1e-4
    scaled = df.where("p IS NOT NULL").select(calibrate.vector_scaled(F.col("p"), w, b).alias("p"), "y")
    assert abs(metrics.probability_losses(scaled, "p", "y").first()["nll"] - _nll(z * theta[:3] + theta[3:], y)) < 1e-8


def test_logistic(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2)) * (1, 3)
    y = rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.4 * x[:, 1] + 0.3)))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, True)], "a double, b double, y boolean")
    got = np.array(calibrate.logistic(df, ["a", "b"], "y", 1.0))
    wide, w = np.c_[x, np.ones(400)], np.zeros(3)
    for _ in range(20_000):
        w -= 0.002 * (wide.T @ (1 / (1 + np.exp(-wide @ w)) - y) + np.array([1, 1, 0]) * w)
    assert np.abs(got - w).max() < 1e-6
    # labels that a line separates: the penalty keeps the weights finite, the intercept has none
    apart = spark.createDataFrame([(float(i), i > 5) for i in range(10)], "a double, y boolean")
    assert all(map(math.isfinite, calibrate.logistic(apart, ["a"], "y")))


def test_running_sums_of_one_value(spark):
    rows = [(i % 2, 0.5 if i % 10 else 0.1, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, s double, id long")
    got = {r["id"]: r["n"] for r in metrics.running_sums(df, ["g"], "s", ["id"], {"n": F.lit(1)}).collect()}
    want = {}
    for g in (0, 1):
        for n, (_, i) in enumerate(sorted((s, i) for k, s, i in rows if k == g), 1):
            want[i] = n
    assert got == want


def over(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i, i / (size(a) + size(b) - i) if i else 0.0


def size(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(40), rng.randrange(40)
        out.append((i // 12, i, x, y, x + rng.randrange(4, 30), y + rng.randrange(4, 30), rng.randrange(10) / 10, rng.random() < 0.25))
    return out


def test_greedy_rules(spark):
    d, t = boxes(7, 96), boxes(8, 96)
    dets = spark.createDataFrame([r[:7] for r in d], "frame long, det long, ax1 long, ay1 long, ax2 long, ay2 long, score double")
    truth = spark.createDataFrame([(*r[:6], r[7]) for r in t], "frame long, gt long, bx1 long, by1 long, bx2 long, by2 long, ignore boolean")
    sized = {r["det"]: (r["tp"], r["ignored"]) for r in R.sized_positives(dets, truth, ["frame"], G.box("a"), G.box("b"), 0.5, (60.0, 500.0)).collect()}
    crowd = {r["det"]: r["mark"] for r in R.crowd_matches(dets, truth, ["frame"], G.box("a"), G.box("b"), 0.3).collect()}
    for frame in range(8):
        used, taken = set(), set()
        mine = [r for r in t if r[0] == frame]
        for r in sorted((r for r in d if r[0] == frame), key=lambda r: (-r[6], r[1])):
            best, found = -1, None
            for g in mine:
                w, h = g[4] - g[2], g[5] - g[3]
                o = over(r[2:6], g[2:6])[1]
                if g[1] not in used and o >= min(0.5, w * h / ((w + 10) * (h + 10))) and o > best:
                    best, found = o, g
            if found:
                used.add(found[1])
                away = found[7] or not 60 <= size(found[2:6]) < 500
                assert sized[r[1]] == (not away, away)
            else:
                assert sized[r[1]] == (False, not 60 <= size(r[2:6]) < 500)
            free = [(over(r[2:6], g[2:6])[1], -g[1]) for g in mine if not g[7] and g[1] not in taken and over(r[2:6], g[2:6])[1] >= 0.3]
            if free:
                taken.add(-max(free)[1])
            covered = any(g[7] and over(r[2:6], g[2:6])[0] / size(r[2:6]) >= 0.3 for g in mine)
            assert crowd[r[1]] == (1 if free else -1 if covered else 0)
    assert {1, 0, -1} == set(crowd.values()) and any(a for a, _ in sized.values())


def test_crowd_jaccard(spark):
    d, t = [r for r in boxes(9, 96) if r[1] % 3 == 0], [r for r in boxes(10, 96) if r[1] % 3 == 1]
    row = lambda r: (r[0], r[1], [float(v) for v in r[2:6]], r[6], r[7])
    kind = "image long, id long, box array<double>, score double, ignore boolean"
    got = {r["threshold"]: r for r in R.crowd_jaccard(spark.createDataFrame(map(row, d), kind), spark.createDataFrame(map(row, t), kind), "image", "box", [0.0, 0.4, 0.8], 0.2).collect()}
    for level, r in got.items():
        ratios, k_all, some = 0.0, 0, 0
        for image in range(8):
            own, real = [x[2:6] for x in d if x[0] == image and x[6] > level], [x[2:6] for x in t if x[0] == image and not x[7]]
            away = [x[2:6] for x in t if x[0] == image and x[7]]
            small, large = (own, real) if len(own) <= len(real) else (real, own)
            best = max((sorted((over(a, b)[1] >= 0.2, over(a, b)[1] if over(a, b)[1] >= 0.2 else 0, i, j) for (i, a), (j, b) in zip(enumerate(small), p, strict=True)) for p in permutations(list(enumerate(large)), len(small))), key=lambda m: (sum(x[0] for x in m), sum(x[1] for x in m)), default=[])
            pairs = [(i, j) if small is own else (j, i) for hit, _, i, j in best if hit]
            covered = lambda b, away=away: any(over(b, a)[0] / size(b) > 0.2 for a in away)
            n = len(own) - sum(covered(b) for i, b in enumerate(own) if i not in {p[0] for p in pairs})
            m = len(real) - sum(covered(b) for j, b in enumerate(real) if j not in {p[1] for p in pairs})
            ratios += len(pairs) / (m + n - len(pairs) + 1e-6)
            some += bool(m or n)
            k_all += len(pairs)
        assert r["matched"] == k_all and abs(r["jaccard"] - ratios / some) < 1e-9
    assert got[0.0]["matched"] > 0


def test_identity(spark):
    rng = random.Random(11)
    pairs = [(v, rng.randrange(4), rng.randrange(5), f) for v in range(6) for f in range(40)]
    df = spark.createDataFrame(pairs, "video long, gt long, track long, frame long")
    got = {r["video"]: r for r in R.identity_scores(df, df, df.union(df), "video", "gt", "track").collect()}
    for v in range(6):
        n = Counter((g, t) for w, g, t, _ in pairs if w == v)
        best = max(sum(n[g, t] for g, t in enumerate(p)) for p in permutations(range(5), 4))
        assert got[v]["idtp"] == best and abs(got[v]["idf1"] - 2 * best / 120) < 1e-12


def test_retrieval_in_blocks(spark):
    from tidemark.operators.detection import retrieval

    rng = random.Random(14)
    rows = [(i, rng.randrange(6), [float(rng.randrange(3)) for _ in range(3)]) for i in range(60)] + [(60, 99, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "row long, who long, v array<float>")
    want, n = defaultdict(float), 0
    for i, who, v in rows:
        if i % 4 == 0 and who != 99:
            order = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, _, w in rows if j != i)
            at = [k for k, (_, j) in enumerate(order, 1) if rows[j][1] == who]
            if at:
                n += 1
                want["mean_ap"] += sum((m + 1) / k for m, k in enumerate(at)) / len(at)
                want["cmc_1"] += at[0] <= 1
                want["cmc_5"] += at[0] <= 5
    for block in (7, 2048):
        got = retrieval(df.where("row % 4 = 0"), df, "who", "row", "v", [1, 5], block).first()
        assert got["n"] == n and all(abs(got[k] - v / n) < 1e-9 for k, v in want.items())
