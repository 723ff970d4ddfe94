"""Streams in several micro-batches against plain loops; JSON lines; answers."""

import random

from pyspark.sql import functions as F

from tidemark.functions import answers
from tidemark.sources import jsonl
from tidemark.streaming import stateful


def test_state_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 3, i * 5 - rng.randrange(20), rng.choice("aab")) for i in range(240)]
    path = str(tmp_path / "in")
    for part in range(4):
        df = spark.createDataFrame(rows[part * 60 : part * 60 + 60], "id long, k long, t long, v string")
        df.coalesce(1).write.mode("append").parquet(path)
    got = stateful.run_to_end(stateful.admit_by_rate(stateful.parquet_stream(spark, path, 1), "k", "t", "id", 40))
    want, last = set(), {}
    for i, k, t, _ in rows:
        if k not in last or t < last[k] or t - last[k] >= 40:
            want.add((k, i, t))
            last[k] = t
    assert {tuple(r) for r in got.collect()} == want

    ordered = stateful.parquet_stream(spark, path, 1).withColumn("t", F.col("id") * 5)
    got = stateful.run_to_end(stateful.dwell_alerts(ordered, "k", "t", "id", "v", ["a"], 20))
    want, runs = set(), {}
    for i, k, _, v in rows:
        if k not in runs or runs[k][0] != v:
            runs[k] = [v, i * 5, False]
        if v == "a" and not runs[k][2] and i * 5 - runs[k][1] >= 20:
            runs[k][2] = True
            want.add((k, i, v, i * 5 - runs[k][1]))
    assert want and {tuple(r) for r in got.collect()} == want


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    got = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x long", provenance=True).collect()
    assert sorted(r["x"] for r in got) == [1, 2] and all(r["source_file"].endswith("a.jsonl") for r in got)
    jsonl.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), "id long").count() == 3
    texts = spark.createDataFrame([(1, '{"a": "b", "c": "d"}'), (2, "x"), (3, None)], "i int, s string")
    assert {tuple(r) for r in jsonl.dict_entries(texts, F.col("s"), "i").collect()} == {(1, "a", "b"), (1, "c", "d")}


def test_answers(spark):
    texts = spark.createDataFrame([("Yes, it is. No.",), ("It is not, so.",), ("Nothing",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(answers.says_yes(F.col("t"))).collect()] == [True, False, True, True, None]
    one = spark.createDataFrame([("Abc ", "abd"), ("abc", "xyz"), ("", ""), (None, "a")], "a string, b string")
    got = [r[0] for r in one.select(answers.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 2 / 3) < 1e-9 and got[1:] == [0.0, 1.0, None]
