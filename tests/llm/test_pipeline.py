"""The whole pipeline against plain Python: every stage's decisions on its own input, row by row."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import jaccard, langid, ordinal
from tidemark.llm.jaccard import JaccardJoin
from tidemark.llm.packing import GROUP_TOKENS, pack, with_step_groups
from tidemark.llm.queries import vocabulary_file

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS = {"en": "the of and harbour wall river stone light under over", "de": "der die und hafen mauer fluss stein licht unter über", "fr": "le la et port mur fleuve pierre lumière sous être"}
BAD = "zz! buy!! $$$ click click win win"


def corpus():
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.choice([12, 40, 90])))
        quality = rng.random() > 0.3
        if not quality:
            text += " " + " ".join(rng.choice(BAD.split()) for _ in range(25))
        rows.append((i, text, lang if rng.random() > 0.1 else None, "s", len(text)))
        labels.append((i, int(quality), int(not quality and rng.random() < 0.5)))
    for i in range(12):
        rows.append((200 + i, rows[i][1], "en", "s", 1))  # exact copies
        rows.append((300 + i, rows[20 + i][1] + " end", "en", "s", 1))  # near copies
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, "?? !!", "en", "s", 0), (403, "of the river " * 3000, "en", "s", 0), (404, "river of the " * 3000, "en", "s", 0)]
    return rows, labels


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def kept_near(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if not sets[i] or find(i) == i}


def test_stages_and_pieces(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda p: p[0])

    model = langid.fit(spark, docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    first = stages["language ID"](spark, docs, d)
    want = [(i, t) for i, t, *_ in rows if (got := model.predict(t))[0] != "und" and got[1] >= 0.35]
    assert pairs(first) == sorted(want) and 400 not in dict(want) and len(want) > 100

    first = spark.createDataFrame(first.collect(), docs.schema)
    grades = ordinal.fit(spark, first, spark.read.parquet(f"{d}/labels.parquet"))
    second = stages["quality classifier"](spark, first, d)
    tail = grades.grades(grades.score(pa.array([t for _, t in want])))[:, -1]
    good = [p for p, x in zip(want, tail, strict=True) if x >= ordinal.KEEP_TAIL]
    assert pairs(second) == sorted(good)
    bad = {i for i, q, _ in labels if not q}
    assert len([i for i, _ in good if i in bad]) < 0.2 * len(bad) and len([i for i, _ in good if i < 150 and i not in bad]) > 0.8 * (150 - len(bad))

    last = {}
    for i, t in sorted(good):
        last[t] = i
    single = sorted((i, t) for t, i in last.items())
    third = stages["exact dedup"](spark, spark.createDataFrame(second.collect(), docs.schema), d)
    assert pairs(third) == single

    left = kept_near(single)
    fourth = stages["n-gram Jaccard join"](spark, spark.createDataFrame(third.collect(), docs.schema), d)
    remain = [p for p in single if p[0] in left]
    assert pairs(fourth) == remain and len(remain) < len(single)

    of = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    ids = {i: [*of.encode(t, add_special_tokens=False).ids, 0] for i, t in remain}
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, d).collect()]
    assert {p["doc_id"] for p in pieces} == set(ids)
    for i, own in ids.items():
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["start"] for p in mine] == list(np.cumsum([0, *[p["length"] for p in mine]])[:-1]) and sum(p["length"] for p in mine) == len(own)
        for p in mine:
            part = np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"] and p["doc_tokens"] == len(own)
    by = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert by.get(p["sequence_id"], 0) == p["offset"]
        by[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(by.values()) <= 1024


def test_step_groups(spark):
    """Groups over all tasks: of one tier each, full but for a tier's last, numbered without gaps."""
    rng = random.Random(24)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS["en"].split()) for _ in range(rng.choice([3, 60, 500, 3000])))) for i in range(700)], "doc_id long, text string").repartition(9)
    rows = with_step_groups(spark, pack(docs, vocabulary_file("byte_bpe_50k.json"))).collect()
    tokens, tiers = Counter(), defaultdict(set)
    for r in rows:
        tokens[r["step_group"]] += r["length"]
        tiers[r["step_group"]].add(r["tier"])
    assert sorted(tokens) == list(range(len(tokens))) and all(len(t) == 1 for t in tiers.values())
    last = {min(tiers[g]): g for g in sorted(tokens)}
    assert all(n == GROUP_TOKENS for g, n in tokens.items() if g not in last.values()) and len(tokens) > len(last)
    assert [min(tiers[g]) for g in sorted(tokens)] == sorted((min(t) for t in tiers.values()), reverse=True)
    assert with_step_groups(spark, pack(docs.limit(0), vocabulary_file("byte_bpe_50k.json"))).count() == 0


def test_samples_of_odd_ids(spark):
    """Rows whose ids are null or equal teach as well as others, and never more than the bound come to the driver."""
    rng = random.Random(22)
    text = lambda lang: " ".join(rng.choice(WORDS[lang].split()) for _ in range(15))
    for ids in ([None] * 1200, [5] * 1200):
        rows = [(i, text(lang), lang) for i, lang in zip(ids, ["en", "de", "fr"] * 400, strict=True)]
        df = spark.createDataFrame(rows, "id long, text string, label string")
        model = langid.fit(spark, df, per_language=100)
        asked = [(text(lang), lang) for lang in ["en", "de", "fr"] * 20]
        assert sum(model.predict(t)[0] == lang for t, lang in asked) > 55
    once = spark.createDataFrame([(None, "der hafen", "de")] * 300 + [(1, "the harbour", "en")], "id long, text string, label string")
    assert langid.fit(spark, once).languages == ["de", "en"]

    docs = spark.createDataFrame([(1, f"good {i}") for i in range(2000)] + [(2, BAD), (2, BAD), (None, "x")], "doc_id int, text string")
    rated = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (9, 0, 1)], "doc_id int, quality int, toxic int")
    seen = []
    fit_rows = ordinal.fit_rows
    ordinal.fit_rows = lambda data, shares, **k: seen.append(data) or fit_rows(data, shares, **k)
    try:
        model = ordinal.fit(spark, docs, rated, per_grade=10)
    finally:
        ordinal.fit_rows = fit_rows
    assert len(seen[0]) <= 2 * 10 * ordinal.GRADES
    assert ordinal.predict(spark, model, docs).count() == 2003


@pytest.mark.parametrize("least", [20, 1024])
def test_thin_hot_shingles(spark, monkeypatch, least):
    """A phrase that comes once in every buffer is found by its entries, and its bucket is not one of ordinary shingles."""
    monkeypatch.setattr(jaccard, "THIN_BUCKET", least)
    rng = random.Random(23)
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(6)), "all rights reserved by c18", *(f"v{rng.randrange(10**6)}" for _ in range(6))])) for i in range(90)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, " ".join(f"u{j}" for j in range(60 - i))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    join = JaccardJoin(spark)
    entries, _ = join._entries(docs.select("doc_id", "text"), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    most = entries.where("NOT heavy").groupBy("token").agg(F.count_distinct("key").alias("n")).agg(F.max("n")).first()[0]
    assert (most <= least) if least == 20 else most >= 90
    got = {r["doc_id"]: r["component_id"] for r in JaccardJoin(spark).components(docs).collect()}
    assert got == {i: i - 100 if 100 <= i < 200 else 200 if i >= 200 else i for i, _ in rows}
