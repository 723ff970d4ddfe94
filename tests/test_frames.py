"""Whole frames in one task: results, and how often rows are shuffled."""

from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import detection_rules as R
from tidemark.operators import frames


def shuffles(df):
    """Exchanges of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def _tables(spark):
    dets = [(1, "A", 10, 0.9, 0, 0, 10, 10), (1, "A", 11, 0.8, 0, 0, 10, 9), (1, "B", 12, 0.7, 40, 40, 50, 50), (2, "A", 13, 0.6, 0, 0, 5, 5)]
    truth = [(1, "A", 20, 0, 0, 10, 10, False, False), (1, "X", 21, 30, 30, 60, 60, True, True), (None, "A", 22, 0, 0, 5, 5, False, False)]
    a = spark.createDataFrame(dets, "frame long, cls string, det long, score double, ax1 int, ay1 int, ax2 int, ay2 int")
    b = spark.createDataFrame(truth, "frame long, cls string, gt long, bx1 int, by1 int, bx2 int, by2 int, is_group boolean, ignore boolean")
    return a, b


def test_grouped_positives_in_one_shuffle(spark):
    a, b = _tables(spark)
    closure = R.class_closure(spark.createDataFrame([("A", "X"), ("B", "X")], "child string, parent string"))
    found = R.grouped_positives(a, b, ["frame", "cls"], G.box("a"), G.box("b"), annotated=True, deal=["frame"], above=("cls", closure))
    assert shuffles(found) <= 2  # the rows by frame, and the few classes
    got = {(r["frame"], r["cls"], r["det"], r["tp"]) for r in found.collect()}
    # 11 finds its truth taken; as X the crowd takes 12; frame 2 has no truth
    assert got == {(1, "A", 10, True), (1, "A", 11, False), (1, "X", 10, True), (1, "X", 11, False), (1, "X", 12, True)}


def test_groups_over_batches(spark):
    df = spark.range(1000).select(F.floor(F.col("id") / 7).alias("g"), "id").coalesce(1)

    def run(batches):
        small = (b.slice(i, 5) for b in batches for i in range(0, b.num_rows, 5))
        for t in frames.whole_groups(small, ["g"]):
            yield from t.group_by("g").aggregate([("id", "count")]).to_batches()

    assert sorted(r[1] for r in df.mapInArrow(run, "g long, n long").collect())[1:] == [7] * 142


def test_fragments_share_no_pairs(spark):
    """The pairs of chains are not shuffled, and merging them needs none."""
    from tidemark.operators import chains

    rows = [(0, f, c, [float(c), float(f)]) for c, at in {1: (0, 1, 2, 3), 2: (4, 5), 3: (1, 2), 4: (7, 8)}.items() for f in at]
    df = spark.createDataFrame(rows, "room int, frame long, chain long, look array<double>")
    pairs = chains.fragment_pairs(df, ["room"], "frame", "chain", "look")
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    names = spark.createDataFrame([(0, 1, "a", 2), (0, 3, "a", 1)], "room int, chain long, name string, n long")
    one = {tuple(r) for r in chains.merge_fragments(pairs, names, "room").collect()}
    assert {tuple(r) for r in chains.merge_chains(df, names, "room", "frame", "chain", "look").collect()} == one
    got = {(r["fragment"], r["chain"]): (r["shared"], r["before"], r["after"]) for r in pairs.collect()}
    assert got[3, 1] == (2, 0, 1) and got[2, 4] == (0, None, 7) and len(got) == 9


def test_points_null_and_unsure(spark):
    p = lambda x, y, c: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(c).alias("c"))
    person = tuple(F.lit(v) for v in (0, 0, 50, 50))
    df = spark.range(1)
    k = G.keypoint_box(F.array(p(10, 10, 0.9), p(20, 10, 0.1), p(30, 20, 0.9)), person, 90, 80, 0.4, [0, 1], [2])
    assert tuple(df.select(k.alias("k")).first()["k"]) == (4, 2, 35, 50, 1, 20)
    none = G.keypoint_box(F.array(p(10, 10, 0.1), p(20, 10, 0.1), p(30, 20, 0.9)), person, 90, 80, 0.4, [0, 1], [2])
    assert df.select(none.alias("k")).first()["k"] is None
