"""The fitted and packed operators against plain Python: language ID, quality, packing; long and odd inputs of the others."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, ordinal, packing, textbytes, warc
from tidemark.llm.jaccard import JaccardJoin
from tidemark.llm.packing import ByteBpe, pack
from tidemark.llm.queries import vocabulary_file
from tidemark.llm.wordpiece import token_counts

M32 = (1 << 32) - 1


def plain_ngrams(text):
    """Bins of all 1- to 3-grams of a text whose other characters are spaces, those of spaces alone left out."""
    c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
    is_letter = [x.isalpha() for x in text.lower()]
    found = defaultdict(int)

    def add(x):
        x = (x ^ (x >> 15)) * 0x2C1B3C6D & M32
        found[x >> 18] += 1

    for x in c:
        add(x * 0x165667B1 & M32)
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & M32 for a, b in zip(c, c[1:])]
    for i, x in enumerate(two):
        if is_letter[i] or is_letter[i + 1]:
            add(x)
    for i in range(len(c) - 2):
        if is_letter[i + 1]:
            add((two[i] * 0xC2B2AE3D + c[i + 2] * 0x27D4EB2F) & M32)
    return dict(found) if any(is_letter) else None


def plain_softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_step(z, n, x, gradient, l1, l2, alpha, beta=1.0):
    """One proximal step of one class: gradient is the slope by the score."""
    for b, v in x.items():
        g = gradient * v
        w = plain_weight(z[b], n[b], l1, l2, alpha, beta)
        z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / alpha * w
        n[b] += g * g


def plain_weight(z, n, l1, l2, alpha, beta=1.0):
    return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)


def test_language_by_plain_python(spark):
    rng = random.Random(9)
    words = {"xx": ["aba", "bab", "ab!", "ba"], "yy": ["cdc", "dcd", "cé", "dc"], "zz": ["efe", "fef", "ef", "漢"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(3, 12))), k) for i, k in enumerate(list(words) * 14)] + [(90, None, "xx"), (91, "12 !", "yy"), (92, "aba", None)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = langid.fit(spark, df, epochs=2)
    keys = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id", F.lit("sample")).alias("h")).collect()}
    labelled = [(keys[i], k, plain_ngrams(t)) for i, t, k in rows if k and t and plain_ngrams(t)]
    df_of = defaultdict(int)
    for _, _, c in labelled:
        for b in c:
            df_of[b] += 1
    idf = lambda b: math.log((1 + len(labelled)) / (1 + df_of[b])) + 1

    def vector(c):
        x = {b: (1 + math.log(n)) * idf(b) for b, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    data = [(vector(c), sorted(words).index(k)) for _, k, c in sorted(labelled, key=lambda r: r[0])]
    z, n = [defaultdict(float) for _ in words], [defaultdict(float) for _ in words]
    weight = lambda k, b: plain_weight(z[k][b], n[k][b], 0.02, 0.5, 0.5)
    for _ in range(2):
        for i, (x, y) in enumerate(data):
            if i % 5:
                p = plain_softmax([sum(weight(k, b) * v for b, v in x.items()) for k in range(3)])
                for k in range(3):
                    plain_step(z[k], n[k], x, p[k] - (k == y), 0.02, 0.5, 0.5)
    for k in range(3):
        assert all(abs(model.weights[k, b] - weight(k, b)) < 1e-5 for b in z[k])
        assert np.count_nonzero(model.weights[k]) == sum(weight(k, b) != 0 for b in z[k])
    scores = [([sum(weight(k, b) * v for b, v in x.items()) for k in range(3)], y) for i, (x, y) in enumerate(data) if i % 5 == 0]
    loss = lambda t: -sum(math.log(max(plain_softmax([s / t for s in ss])[y], 1e-12)) for ss, y in scores)
    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.05, 10, 60))) + 1e-6
    out = {r["doc_id"]: r for r in langid.predict(spark, model, df.withColumnRenamed("id", "doc_id").union(df.limit(1))).collect()}
    for i, t, _ in rows:
        c = plain_ngrams(t) if t else None
        if c is None:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
        else:
            x = vector(c)
            p = plain_softmax([sum(weight(k, b) * v for b, v in x.items()) / model.temperature for k in range(3)])
            assert out[i]["lang_pred"] == sorted(words)[p.index(max(p))] and abs(out[i]["score"] - max(p)) < 1e-4


def test_language_odd_rows(spark):
    rows = [(1, "aba cdc", 0.5), (1, "aba cdc", 0.5), (None, "cdc", 0.5), (2, "", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = langid.LanguageModel(["a", "b"], np.zeros((2, langid.BINS), np.float32), np.ones(langid.BINS), 1.0)
    got = sorted(str(tuple(r)) for r in langid.predict(spark, model, docs).collect())
    assert got == sorted(map(str, [(1, "a", 0.5)] * 2 + [(None, "a", 0.5), (2, "und", 0.0)]))  # equal probabilities: the first by name
    assert langid.predict(spark, model, docs.limit(0)).count() == 0
    many = spark.range(langid.MOST_LANGUAGES + 1).select("id", F.lit("a").alias("text"), F.col("id").cast("string").alias("label"))
    with pytest.raises(ValueError):
        langid.fit(spark, many)
    long = "abc déf " * 200_000  # over one piece: counts do not depend on the seam
    whole = plain_ngrams("abc déf " * 50)
    assert set(np.flatnonzero(langid.ngram_counts(long)).tolist()) == set(whole)


def test_quality_by_plain_python():
    """Steps of the cumulative link by plain Python, and the slope against differences of the likelihood."""
    rng = random.Random(3)
    data = [(np.array(sorted(rng.sample(range(40), 6))), np.array([rng.choice([1.0, 0.5]) for _ in range(6)]), rng.choice([0, 1, 2])) for _ in range(60)]
    for at, x, y in data:
        x[:2] += 6.0 * y  # something to learn beyond the L1 penalty
    shares = np.array([0.2, 0.3, 0.5])
    model = ordinal.fit_rows(data, shares, epochs=3)
    sig = lambda v: 1 / (1 + math.exp(-min(max(v, -30), 30)))
    counts = [sum(y == g for *_, y in data) for g in range(3)]
    weight_of = [(shares[g] / (counts[g] / 60)) ** 0.6 * (60 / counts[g] / 3) ** 0.4 for g in range(3)]
    z, n = defaultdict(float), defaultdict(float)
    first, gap, side = -1.0, 0.0, [0.1, 0.1]
    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(60):
            at, x, y = data[i]
            t = [first, first + math.exp(gap)]
            score = sum(plain_weight(z[b], n[b], 15.0, 0.1, 0.2) * v for b, v in zip(at.tolist(), x.tolist()))
            up = sig(t[y] - score) if y < 2 else 1.0
            low = sig(t[y - 1] - score) if y else 0.0
            p = max(up - low, 1e-9)
            du, dl = up * (1 - up) / p, low * (1 - low) / p
            plain_step(z, n, dict(zip(at.tolist(), x.tolist())), weight_of[y] * min(max(du - dl, -1), 1), 15.0, 0.1, 0.2)
            dt = [0.0, 0.0]
            if y < 2:
                dt[y] -= du
            if y:
                dt[y - 1] += dl
            dt = [weight_of[y] * min(max(v, -1), 1) for v in dt]
            steps = [dt[0] + dt[1], dt[1] * math.exp(gap)]
            side = [s + v * v for s, v in zip(side, steps)]
            first -= 0.1 * steps[0] / math.sqrt(side[0])
            gap -= 0.1 * steps[1] / math.sqrt(side[1])
    assert np.allclose(model.thresholds, [first, first + math.exp(gap)], atol=1e-9)
    plain = [plain_weight(z[b], n[b], 15.0, 0.1, 0.2) for b in range(40)]
    assert np.allclose(model.weights[:40], plain, atol=1e-6) and any(plain)
    # the slope is the derivative of the negative log likelihood by the score
    nll = lambda s, y: -math.log((sig(0.7 - s) if y == 1 else 1.0 if y == 2 else sig(-0.4 - s)) - (0.0 if y == 0 else sig(-0.4 - s) if y == 1 else sig(0.7 - s)))
    for y in range(3):
        for s in (-1.0, 0.2, 1.5):
            up = sig([-0.4, 0.7][y] - s) if y < 2 else 1.0
            low = sig([-0.4, 0.7][y - 1] - s) if y else 0.0
            slope = (up * (1 - up) - low * (1 - low)) / (up - low)
            assert abs(slope - (nll(s + 1e-6, y) - nll(s - 1e-6, y)) / 2e-6) < 1e-5
    p = ordinal.OrdinalModel(np.zeros(1), np.array([-0.4, 0.7])).grades(np.array([0.3]))[0]
    assert np.allclose(p, [sig(-0.7), sig(0.4) - sig(-0.7), 1 - sig(0.4)])


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good", 1), (1, "bad", 1), (None, "x", 1), (2, None, 1)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    drawn = ordinal.grade_of(labels).collect()
    assert sorted(r["grade"] for r in drawn) == [0, 1, 2]
    model = ordinal.fit(spark, docs.select("doc_id", "text"), labels)  # both rows of doc 1 are rated by its lowest grade
    out = ordinal.predict(spark, model, docs).collect()
    assert len(out) == 4 and ordinal.predict(spark, model, docs.limit(0)).count() == 0
    assert ordinal.keep_good(spark, model, docs.limit(0)).count() == 0


def test_word_hashes_have_no_structure(spark):
    """Words and their complements over two letters, and pieces of a long text hashed as in a short one."""
    tm = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = tm.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"one {tm} two three four"), (2, f"one {other} two three four"), (3, f"ONE {tm.upper()} two three four")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in JaccardJoin(spark).components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    rng = random.Random(8)
    words = ["".join(rng.choice("abcÄé漢") for _ in range(rng.randrange(1, 40))) for _ in range(120_000)]
    data, offsets = textbytes.string_buffers(pa.array([" ".join(words)]))
    assert offsets[-1] > 2 * textbytes.SLICE_BYTES
    whole = textbytes.word_hashes(data, offsets)[0]
    short = np.concatenate([textbytes.word_hashes(*textbytes.string_buffers(pa.array([" ".join(words[i : i + 1000])])))[0] for i in range(0, len(words), 1000)])
    assert (whole == short).all() and len(set(whole.tolist())) == len({"".join(c.lower() if c.isascii() else c for c in w) for w in words})


def test_jaccard_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(350_000))
    assert len(text) > 2 << 20
    docs = spark.createDataFrame([(5, text), (3, text + " end"), (9, "x " + text[: len(text) // 2])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in JaccardJoin(spark).components(docs).collect()}
    assert got == {5: 3, 3: 3, 9: 9}


def test_packing_long_and_odd_texts(spark):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), ByteBpe(path)
    rng = random.Random(6)
    texts = [" " * 1_000_000, "\n" * 100_000 + "a", "a " * 100_000, " \t\n" * 50_000 + " b", "x" * 200_000, "<|endoftext|>" + " " * 5000 + "<|endoftext|>", "　" * 5000 + "x\x1c\x85 y", None, ""]
    texts += ["".join(rng.choice([" ", "  ", "\n", "a", "bc", "'s", "1", "!", "é", "漢", "<|endoftext|>", "\x1d", "　"]) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t or "", add_special_tokens=False).ids
    rows = [(i % 5 or None, t, 1) for i, t in enumerate([*texts[1:], texts[-1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier int").repartition(3)
    pieces = pack(docs, path).collect()
    ids = [np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, _ in rows]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    # each piece is a part of a row of its doc_id, and the rows of a doc_id are all there
    of = defaultdict(list)
    for (k, _, _), x in zip(rows, ids, strict=True):
        of[k].append(x)
    for k, xs in of.items():
        own = [p for p in pieces if p["doc_id"] == k]
        assert sorted(len(x) for x in xs) == sorted(p["doc_tokens"] for p in own if p["start"] == 0)
        for p in own:
            assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in xs)


def test_packing_tiers_and_groups(spark):
    path = vocabulary_file("byte_bpe_50k.json")
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "word " * rng.choice([1, 3, 20, 60, 130, 300, 700, 1500])) for i in range(3000)], "doc_id long, text string").repartition(2)
    rows = pack(docs, path).collect()
    sequences, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        groups[r["sequence_id"] >> 40, r["tier"], r["step_group"]].add(r["sequence_id"])
    tiers = defaultdict(int)
    for s in sequences.values():
        size = sum(r["length"] for r in s)
        assert {r["tier"] for r in s} == {size} and size & (size - 1) == 0 and size <= 1024  # full: no padding at all
        tiers[size] += 1
    assert tiers[1024] > 100 and len(tiers) > 2
    # below the shortest tier there are at most the powers of two that a task's last tokens need
    assert all(n <= 2 for size, n in tiers.items() if size < packing.SHORTEST)
    cut = sum(r["length"] < r["doc_tokens"] and r["doc_tokens"] <= 1024 for r in rows)
    assert cut < len(rows) / 3  # most documents that fit a window stay whole: cuts only fill last gaps
    # groups of one task and tier: all but the last have the same number of tokens
    for task, tier in {k[:2] for k in groups}:
        own = sorted((k[2], len(v)) for k, v in groups.items() if k[:2] == (task, tier))
        assert all(n == packing.GROUP_TOKENS // tier for _, n in own[:-1])


def test_token_counts_odd_rows(spark):
    path = vocabulary_file("word_bpe_49k.json")
    long = "ab" * 300_000
    rows = [(1, "the the", 5), (1, "the the", 5), (None, "The", 5), (2, None, 5), (3, " \n", 5), (4, long, 5), (5, f"the {long} the", 5), (6, "漢" * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(str(tuple(r)) for r in token_counts(spark, docs, path).collect())
    n = next(r["n_tokens"] for r in token_counts(spark, docs.where("doc_id = 4"), path).collect())
    assert n > 100_000
    want = [(1, 2, 2), (1, 2, 2), (None, 1, 1), (2, 0, 0), (3, 0, 0), (4, 1, n), (5, 3, n + 2)]
    assert [x for x in got if not x.startswith("(6")] == sorted(map(str, want))
    assert token_counts(spark, docs.limit(0), path).count() == 0


def test_warc_repeated_and_null_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "v", "same"), (2, "w", "same"), (None, "x", "alone"), (3, "y", "other"), (3, "z", "third")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, first int")
    got = sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in warc.archive_round_trip(spark, pages).collect())
    want = [(1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "revisit", 1), (None, "response", None), (3, "response", None), (3, "response", None)]
    assert got == sorted(map(str, want))
    assert hashlib.sha1(b"same").hexdigest()
