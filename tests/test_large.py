"""What held only on small tables: ties that rounding hides, more groups than a limit, names that outgrow their digits."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import episodes as E
from tidemark.operators import sampling
from tidemark.plans import queries as Q


def test_relabelled_ties(spark):
    rng, rows = random.Random(1), []
    for user in range(300):
        ks = [rng.randrange(20, 45) for _ in range(11)]
        ks.append(400 - sum(ks))  # means of exactly a third each, which doubles miss
        rows += [(user, i, [k / 100, (100 - k) / 200, (100 - k) / 200]) for i, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "user long, t long, ps array<double>").repartition(3)
    assert {r["refined"] for r in E.relabelled(df, ["user"], ["t"], F.lit(False), "ps").collect()} == {0}


def test_many_groups(spark):
    df = spark.range(70_000).select(F.when(F.col("id") > 0, F.col("id") + (1 << 60)).alias("g"), F.lit(1).alias("x"))
    split = sampling.greedy_split(df, "g", {"a": 0.5, "b": 0.5})
    assert [tuple(r) for r in split.groupBy("split").agg(F.count("*"), F.count_distinct("g"), F.count_if(F.col("g").isNull())).orderBy("split").collect()] == [("a", 35_000, 34_999, 1), ("b", 35_000, 35_000, 0)]


def test_many_shards(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(40_100).withColumnRenamed("id", "doc_id").write.parquet(f"{folder}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(duck.execute(Q.SQL["shard_layout"]).fetchall()) == sorted(tuple(r) for r in Q.QUERIES["shard_layout"](spark, folder).collect())


def test_scaling_passes(spark):
    """Each pass is one job of which a task sends sums only, whatever the number of points that it answers for."""
    from tidemark.operators import calibrate

    rows = spark.createDataFrame([([0.0, 2.0, 1.0], 1), ([1.0, 0.0, 0.5], 2), ([3.0, 1.0], 0), ([3.0, 1.0], 7)], "z array<double>, y int").repartition(2)
    got = calibrate._summed(rows, lambda z, y: np.array([calibrate._cross_entropy(z / t, y)[0].sum() for t in (1.0, 2.0)]), 2)
    for t, mean in zip((1.0, 2.0), got, strict=True):
        want = [np.log(np.exp(np.array(z) / t).sum()) - z[y] / t for z, y in (([0.0, 2.0, 1.0], 1), ([1.0, 0.0, 0.5], 2), ([3.0, 1.0], 0))]
        assert abs(mean - np.mean(want)) < 1e-12


def test_retrieval_sends_no_hits(spark):
    """What is kept of the queries does not grow with their hits."""
    import os

    from tidemark.operators.detection import retrieval

    df = spark.range(3000).select(F.col("id").alias("row"), (F.col("id") % 2).alias("who"), F.array(F.col("id").cast("float")).alias("v"))
    out = retrieval(df.where("row % 50 = 0"), df, "who", "row", "v", [1], 16)
    sources = [f.removeprefix("file://") for f in out.inputFiles()]
    assert sources and sum(os.path.getsize(f) for f in sources) < 60 * 500 and out.first()["n"] == 60
