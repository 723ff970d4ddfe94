"""Density clusters, components, chains, fragments and seat numbers against plain loops."""

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import chains, clusters, graphs
from tidemark.plans import seat_queries
from tidemark.streaming import seats

D = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 3)]
    parent = {n: n for n in [*range(310), *range(400, 461), 500]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(n,) for n in range(310)], "node long")
    got = {r["node"]: r["comp"] for r in graphs.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    named = graphs.components(spark.createDataFrame([("z",)], "node string"), spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"))
    assert {tuple(r) for r in named.collect()} == {("z", "z"), ("a", "a"), ("b", "a"), ("c", "a")}


def clustered(points, eps, least, stray):
    """Seats of points [(ident, x, y)] of one key."""
    points = sorted(points)
    near = {i: [j for j, a, b in points if (x - a) ** 2 + (y - b) ** 2 <= eps * eps] for i, x, y in points}
    core = {i for i in near if len(near[i]) >= least}
    seat, n = {}, 0
    for i, _, _ in points:
        if i not in core or i in seat:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in seat:
                seat[j] = n
                todo += near[j] if j in core else []
        n += 1
    where = {i: (x, y) for i, x, y in points}
    mean = {s: np.mean([where[i] for i in seat if seat[i] == s], axis=0) for s in range(n)}
    out = {}
    for i, x, y in points:
        d = sorted((float(np.hypot(*(mean[s] - (x, y)))), s) for s in mean)
        out[i] = seat.get(i, d[0][1] if d and d[0][0] < stray * eps else -1)
    return out


def test_density_clusters(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for room in range(4):
        centres = [(rng.uniform(0, 300), rng.uniform(0, 200)) for _ in range(6)]
        for i in range(150):
            x, y = rng.choice(centres)
            spread = rng.choice([3, 12, 60])
            rows.append((room, len(rows), rng.gauss(x, spread), rng.gauss(y, spread), 14.0))
    rows += [(9, 10_000 + i, 5.0, 5.0, 2.0) for i in range(40)] + [(9, 10_100 + i, 6.0 + i, 5.0, 2.0) for i in range(30)]  # one full spot, and a line
    rows += [(9, 10_200, None, 1.0, 2.0), (8, 10_300, 1.0, 1.0, 0.0), (None, 10_400, 1.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "room long, id long, x double, y double, eps double")
    monkeypatch.setattr(clusters, "SHARE", 7)  # a full cell goes to several tasks
    want = {}
    for room in range(4):
        want |= clustered([r[1:4] for r in rows if r[0] == room], 14.0, 5, 2.0)
    want |= clustered([r[1:4] for r in rows if r[0] == 9 and r[2] is not None], 2.0, 5, 2.0)
    got = {r["id"]: r["seat"] for r in clusters.density_clusters(df, ["room"], "id", "x", "y", "eps").collect()}
    assert got == want | {10_200: -1, 10_300: -1, 10_400: -1}
    assert len({s for s in got.values()}) > 4
    assert clusters.density_clusters(df.limit(0), ["room"], "id", "x", "y", "eps").count() == 0


def test_touching_cells_need_points(spark):
    """Two dense groups just within and just beyond eps, which corners can't tell apart."""
    for gap, n in ((9.999, 1), (10.001, 2)):
        rows = [(1, i, 0.0, 0.001 * i) for i in range(6)] + [(1, 10 + i, gap, 0.001 * i) for i in range(6)]
        df = spark.createDataFrame([(*r, 10.0) for r in rows], "k long, id long, x double, y double, eps double")
        assert len({r["seat"] for r in clusters.density_clusters(df, ["k"], "id", "x", "y", "eps").collect()}) == n


def test_points_are_not_sent_to_every_cell_around(spark):
    """A point goes to the blocks that it can reach, not to each of the 25 cells: a few records a point are shuffled in all."""
    df = spark.range(4000).selectExpr("id % 10 AS k", "id", "(id * 7919) % 4001 / 4.0 AS x", "(id * 104729) % 3989 / 4.0 AS y", "14.0D AS eps")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    sc.setJobGroup("density", "density")
    got = {r["id"]: r["seat"] for r in clusters.density_clusters(df, ["k"], "id", "x", "y", "eps").collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("density") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sent = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert len(got) == 4000 and 4000 * 5 < sent < 4000 * 25


def chained(rows, gate):
    """Chains of one key's rows (frame, ident, feature), every assignment of a frame tried."""
    frames = defaultdict(list)
    for f, i, v in rows:
        frames[f].append((i, np.asarray(v, float)))
    open_, out, n = [], {}, 0
    for f in sorted(frames):
        found = sorted(frames[f], key=lambda r: r[0])
        near = [c for c in open_ if 19 <= f - c["last"] <= 62]
        best, least = None, float("inf")
        for perm in permutations([*near, *[None] * len(found)], len(found)):
            total = sum(gate if c is None else float(np.abs(v - c["f"]).mean()) for c, (_, v) in zip(perm, found, strict=True))
            if total < least - 1e-12:
                best, least = perm, total
        for c, (i, v) in zip(best, found, strict=True):
            if c is not None and np.abs(v - c["f"]).mean() < gate:
                c["f"], c["last"] = 0.85 * c["f"] + 0.15 * v, f
            else:
                c = {"f": v, "last": f, "n": n}
                open_.append(c)
                n += 1
            out[i] = c["n"]
    return out


def test_chains(spark):
    rng = random.Random(3)
    rows, faces = [], {k: [[rng.uniform(0, 9) for _ in range(4)] for _ in range(3)] for k in "ab"}
    for k in "ab":
        for f in range(0, 260, 20):
            for who in range(3):
                if rng.random() < 0.75:
                    rows.append((k, f, len(rows), [v + rng.gauss(0, 0.4) for v in faces[k][who]]))
    df = spark.createDataFrame(rows, "room string, frame long, id long, look array<double>")
    got = {r["id"]: r["chain"] for r in chains.chains(df, "room", "frame", "id", "look", 1.2).collect()}
    assert got == {i: c for k in "ab" for i, c in chained([r[1:] for r in rows if r[0] == k], 1.2).items()}
    assert 3 <= len({c for i, c in got.items() if rows[i][0] == "a"}) < 20


def test_fragments(spark):
    """Chain 5 overlaps chain 1 in time and never joins it, though it looks the same; 7 overlaps all and is forced."""
    flat = lambda v: [float(v)] * 3
    rows = [("r", f, 1, flat(1)) for f in range(0, 200, 20)] + [("r", f, 2, flat(5)) for f in range(0, 100, 20)]
    rows += [("r", f, 5, flat(1)) for f in range(100, 200, 20)] + [("r", f, 6, flat(5)) for f in range(200, 300, 20)]
    rows += [("r", f, 7, flat(1)) for f in range(20, 300, 20)] + [("s", 0, 1, flat(1))]
    df = spark.createDataFrame(rows, "room string, frame long, chain long, look array<double>")
    pairs = chains.fragment_pairs(df, ["room"], "frame", "chain", "look")
    names = spark.createDataFrame([("r", 2, "two", 2), ("r", 7, "two", 3), ("r", 1, "one", 1)], "room string, chain long, name string, n long")
    got = {tuple(r) for r in chains.merge_fragments(pairs, names, "room").collect()}
    assert got == {("r", 5, 2, False), ("r", 6, 1, False), ("r", 7, 2, True)}
    unnamed = {r["fragment"]: (r["parent"], r["forced"]) for r in chains.merge_fragments(pairs, names.where("chain = 1"), "room").collect()}
    assert unnamed[7] == (1, True)  # the nearest in appearance instead


def merged(rows):
    """Fragments of one key's rows (frame, chain, feature), by plain loops over frames."""
    at = defaultdict(dict)
    for f, c, v in rows:
        at[c][f] = np.asarray(v, float)
    first = min(f for f, _, _ in rows)
    begin, members, out = {c: min(v) for c, v in at.items()}, {c: [c] for c in at}, set()

    def far(c, k):
        own, f0 = at[c][begin[c]], begin[c]
        before = [(f, m) for m in members[k] for f in at[m] if f < f0]
        after = [(f, m) for m in members[k] for f in at[m] if f >= f0]
        near = ([max(before, key=lambda x: x[0])] if before else []) + ([min(after, key=lambda x: x[0])] if after else [])
        return min(float(np.abs(own - at[m][f]).mean()) for f, m in near)

    for c in sorted((c for c in at if begin[c] > first), key=lambda c: (begin[c], c)):
        size = sum(len(at[m]) for m in members[c])
        free = [k for k in members if k != c and sum(len(at[a].keys() & at[b].keys()) for a in members[c] for b in members[k]) <= max(2, 0.01 * size)]
        if free:
            k = min(free, key=lambda k: (far(c, k), k))
            members[k] += members.pop(c)
            out.add((c, k, False))
    for c in sorted(c for c in at if begin[c] > first and c in members):
        k = min((k for k in members if begin[k] == first), key=lambda k: (far(c, k), k))
        members[k] += members.pop(c)
        out.add((c, k, True))
    return out


def test_fragments_by_loops(spark):
    rng = random.Random(13)
    rows = []
    for room in range(5):
        for c in range(9):
            a = 0 if c < 3 else rng.randrange(1, 30)
            rows += [(room, 20 * f, 10 * room + c, [rng.gauss(c % 3, 0.3) for _ in range(3)]) for f in range(a, a + rng.randrange(3, 14)) if f == a or rng.random() < 0.8]
    df = spark.createDataFrame(rows, "room long, frame long, chain long, look array<double>")
    pairs = chains.fragment_pairs(df, ["room"], "frame", "chain", "look")
    none = spark.createDataFrame([], "room long, chain long, name string, n long")
    got = {tuple(r)[1:] for r in chains.merge_fragments(pairs, none, "room").collect()}
    want = set().union(*(merged([r[1:] for r in rows if r[0] == room]) for room in range(5)))
    assert got == want and {f for *_, f in want} == {True, False}


def test_names_and_purity(spark):
    votes = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", 1, "b"), ("r", 2, None), ("r", 3, "c"), ("r", 3, "b"), ("r", 4, None)], "room string, chain long, name string")
    names = chains.chain_names(votes, ["room"], "chain", "name")
    assert {r["chain"]: r["name"] for r in names.collect()} == {1: "a", 2: "video_unk_000", 3: "b", 4: "video_unk_001"}
    p = chains.purity(votes, names, ["room"], "chain", "name").first()
    assert (p["n_chains"], p["anchors"], p["correct"], p["mixed"], p["distinct_names"]) == (4, 5, 3, 2, 2) and abs(p["accuracy"] - 0.6) < 1e-12


BOX = {"a": [0, 0, 60, 90], "b": [200, 0, 260, 90], "c": [400, 0, 460, 90]}


def seated(spark, frames, rules=None):
    rows = [(1, float(t), [{"track": k, "box": [float(v) for v in b]} for k, b in boxes.items()]) for t, boxes in frames]
    df = spark.createDataFrame(rows, "s long, t double, tracks array<struct<track:bigint,box:array<double>>>")
    out = {}
    for r in seats.seat_numbers(df, "s", "t", "tracks", rules).collect():
        out[r["t"]] = ({s["track"]: s["seat"] for s in r["seats"]}, [(e["track"], e["seat"], e["how"]) for e in r["events"]], list(r["cleared"]), [(m["source"], m["target"]) for m in r["moved"]])
    return out


def test_seat_cases(spark):
    stay = lambda a, b, boxes: [(t, boxes) for t in range(a, b)]
    # a track comes back under another number: resumed soon, restarted after long
    got = seated(spark, [*stay(0, 5, {1: BOX["a"], 2: BOX["b"]}), *stay(5, 8, {1: BOX["a"]}), *stay(8, 30, {1: BOX["a"], 7: BOX["b"]}), *stay(30, 50, {7: BOX["b"]}), (50, {7: BOX["b"], 9: BOX["a"]})])
    assert got[8.0][:2] == ({1: 1, 7: 2}, [(7, 2, "resumed")]) and got[50.0] == ({7: 2, 9: 1}, [(9, 1, "restarted")], [1], [])
    # seen for less than two seconds: forgotten, and the number is the next one handed out
    got = seated(spark, [*stay(0, 5, {1: BOX["a"]}), (5, {1: BOX["a"], 2: BOX["b"]}), *stay(6, 9, {1: BOX["a"]}), (9, {1: BOX["a"], 3: BOX["c"]})])
    assert got[5.0][0] == {1: 1, 2: 2} and got[9.0][:2] == ({1: 1, 3: 2}, [(3, 2, "new")])
    # a live track jumps to another place
    got = seated(spark, [*stay(0, 5, {1: BOX["a"]}), (5, {1: BOX["c"]})])
    assert got[5.0][:2] == ({1: 2}, [(1, 1, "jumped"), (1, 2, "new")])
    # a second track on the same place opens a seat and is folded into the old one when that is free
    near = [6, 0, 66, 90]
    got = seated(spark, [*stay(0, 5, {1: BOX["a"]}), *stay(5, 7, {1: BOX["a"], 2: near}), (7, {2: near}), (8, {2: near})])
    assert got[5.0][0] == {1: 1, 2: 2} and got[7.0][:3] == ({2: 1}, [(2, 1, "folded")], [2])
    # two settled seats on one place: the one in use for longer keeps its number
    drift = [*stay(0, 3, {1: BOX["a"]}), *[(t, {1: BOX["a"], 2: [180 - 10 * (t - 3), 0, 240 - 10 * (t - 3), 90]}) for t in range(3, 40)]]
    drift = [(t, {k: ([max(b[0], 5), 0, max(b[2], 65), 90] if k == 2 else b) for k, b in boxes.items()}) for t, boxes in drift]
    got = seated(spark, [*drift, (40, {2: [5, 0, 65, 90]})], seats.SeatRules(follow=0.9))
    assert got[39.0][0] == {1: 1, 2: 2} and got[40.0] == ({2: 1}, [(2, 1, "merged")], [], [(2, 1)])
    # frames without tracks
    assert seated(spark, [(0, {}), (1, {1: BOX["a"]})])[1.0][0] == {1: 1}


def test_seats_as_stream(spark):
    rows = lambda df: sorted(map(str, df.collect()))
    batch, stream = seat_queries.seat_registry(spark, D), seat_queries.stream_seat_registry(spark, D)
    assert rows(batch) == rows(stream)
    kinds = {e.split()[1] for r in batch.collect() for e in r["events"].split(", ") if e}
    assert {"new", "resumed", "restarted", "jumped"} <= kinds


def test_seat_state_ends(spark, tmp_path):
    """After the idle time nothing is left of a session: its next frames begin at seat 1, by timer or by the gap."""
    from tidemark.streaming import stateful

    kind = "s long, t double, tracks array<struct<track:bigint,box:array<double>>>"
    put = lambda rows: spark.createDataFrame([(s, float(t), [{"track": k, "box": [float(v) for v in BOX[b]]}]) for s, t, k, b in rows], kind).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    put([(1, 5, 1, "a"), (1, 6, 2, "b"), (2, 6, 1, "a")])
    put([(2, 500, 1, "a")])
    put([(2, 501, 1, "a"), (2, 502, 1, "a")])
    put([(1, 600, 5, "c")])
    got = stateful.run_to_end(seats.stream_seat_numbers(stateful.parquet_stream(spark, str(tmp_path), 1).withWatermark("ts", "1 second"), "s", "t", "tracks", 60.0))
    told = {(r["s"], r["t"]): {x["track"]: x["seat"] for x in r["seats"]} for r in got.collect()}
    assert told[1, 600.0] == {5: 1} and told[2, 500.0] == {1: 1}
    assert sorted(told) == [(1, 5.0), (1, 6.0), (1, 600.0), (2, 6.0), (2, 500.0), (2, 501.0), (2, 502.0)]
