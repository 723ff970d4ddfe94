"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, ordinal, simhash, warc
from tidemark.llm.bpe import IdDecoder, MergeList, byte_alphabet, round_trip
from tidemark.llm.exact import DigestIndex, exact_dedup, exact_groups, known, salted_join
from tidemark.llm.jaccard import JaccardJoin
from tidemark.llm.lines import line_dedup
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary_file
from tidemark.llm.wordpiece import PieceCounter, symbols_of, token_counts, vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RNG = random.Random(11)
WORDS = ["the", "A", "b", "cc", "Dog", "é", "漢字", "x1", "don't", "<|endoftext|>", "!!", "zz9"]


def corpus() -> list[tuple]:
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 4, 5, 30, 80]))) for _ in range(40)]
    near = [re.sub("Dog", "dog ", t, count=1) for t in base[:15]] + [t + " end" for t in base[15:30]]
    texts = base + base[:10] + near + [None, "", "   \n", "word " * 3000, "y" * 5000]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(spark, docs):
    rows = corpus()
    sets, parent = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

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
    clash = docs.withColumns({"key": F.lit(1), "n": F.lit(2), "token": F.lit("t")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in JaccardJoin(spark).components(clash).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


def test_jaccard_empty_and_null_ids(spark, docs):
    assert JaccardJoin(spark).components(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, JaccardJoin(spark).components(odd).collect()))
    assert len(got) == 4 and sum("component_id=3" in x for x in got) == 3


def test_jaccard_links(spark):
    words = [f"w{i}" for i in range(60)]
    group = [" ".join([*words[: 60 - i], *(f"x{i}" for _ in range(i))]) for i in range(9)]  # one component, not all linked
    texts = [*group, group[0], group[1].upper(), "a b c", "a b c", "d e f g h i", None, ""]
    sets = [shingles(t) for t in texts]
    linked = lambda x, y: bool(x & y) and 100 * len(x & y) >= 80 * len(x | y)
    pairs, rows = JaccardJoin(spark).links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in rows.collect()}
    assert {k: (r["n_shingles"], r["n_links"]) for k, r in rows.items()} == {i: (len(x), sum(linked(x, y) for j, y in enumerate(sets) if i != j)) for i, x in enumerate(sets)}
    want = {tuple(sorted((rows[i]["class"], rows[j]["class"]))) for i, x in enumerate(sets) for j, y in enumerate(sets) if x != y and linked(x, y)}
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got) == sorted(want) and len(got) > 8


def test_near_duplicates_by_row(spark):
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = [t + " end" for t in base]
    rows = [
        (None, base[0]),  # goes: near 1
        (None, base[1]),  # clean, without an id
        (1, near[0]),
        (2, base[2]),
        (7, near[2]),  # goes: near 2
        (7, base[3]),  # the smallest of its own group
        (8, near[3]),  # goes: near 7
        (None, base[4]),  # one of these two goes
        (None, near[4]),
        (9, base[5]),
        (9, base[5]),  # goes: repeated row
        (None, None),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    docs = docs.withColumns({"digest": F.lit(1), "id": F.lit("x"), "short": F.lit(2), "stays": F.lit(True), "n": F.lit(0)})
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    one_of = [x for x in left if x[1] in (base[4], near[4])]
    want = [(None, base[1]), (1, near[0]), (2, base[2]), (7, base[3]), (9, base[5]), (None, None), (None, None)]
    assert out.columns == docs.columns and len(one_of) == 1
    assert sorted(map(str, left)) == sorted(map(str, want + one_of))


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in simhash.compare_edited(spark, docs).collect()}
    rows = {r[0]: r[1] or "" for r in corpus()}
    order = sorted(rows, reverse=True)
    for i, k in enumerate(order):
        t, nxt = rows[k], rows[order[(i + 1) % len(order)]]
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        assert got[k]["n_chars"] == n and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        bits = bin(int(got[k]["fingerprint"], 16) ^ int(got[k]["edited_fingerprint"], 16)).count("1")
        assert abs(got[k]["near_edited"] - (1 - bits / 64)) < 1e-9
    by_text = defaultdict(set)
    for k, t in rows.items():
        by_text[t].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    near = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1") <= 3
    for k in rows:
        want = sum(near(got[k]["fingerprint"], got[j]["fingerprint"]) for j in rows) if k % 50 == 0 else None
        assert got[k]["n_near"] == want
    assert simhash.compare_edited(spark, docs.limit(0)).count() == 0


def plain_fingerprints(spark, texts):
    """Fingerprints by plain Python: only the hash of a term comes from Spark."""
    terms = {}
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        terms[t] = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w + [None] * (5 - len(w))]
    each = sorted({tuple(x) for v in terms.values() for x in v}, key=str)
    rows = spark.createDataFrame(each, "a string, b string, c string, d string, e string").select("*", F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect()
    of = {tuple(r[:5]): r["h"] for r in rows}
    out = {}
    for t, v in terms.items():
        votes = [sum(1 if of[tuple(x)] >> i & 1 else -1 for x in v) for i in range(64)]
        out[t] = sum(1 << i for i in range(64) if votes[i] > 0)
    return out


def test_simhash_repeated_and_null_ids(spark):
    rows = [(None, None), (4, "a b c"), (4, "b x y z w v"), (4, "a b c"), (None, "q r s t u v w"), (100, "K l m n o p q r " * 40), (3, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    got = simhash.compare_edited(spark, docs).collect()
    assert len(got) == len(rows)
    key = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(r["doc_id"], r["text"] or "") for r in sorted(key, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), reverse=True)]
    edits = [t[: len(t) - len(t) // 3] + order[(i + 1) % len(order)][1][: len(t) // 3] for i, (_, t) in enumerate(order)]
    prints = plain_fingerprints(spark, [t for _, t in order] + edits)
    alike = lambda a, b: round(1 - bin(a ^ b).count("1") / 64, 9)
    want = []
    for i, (k, t) in enumerate(order):
        f, e, n = prints[t], prints[edits[i]], prints[order[(i + 1) % len(order)][1]]
        want.append((k, len(t), hashlib.sha256(edits[i].encode()).hexdigest(), f"{f:016x}", f"{e:016x}", alike(f, e), alike(f, n)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got)
    assert [r["n_near"] for r in got if r["doc_id"] == 100] == [1]


def test_simhash_of_corpus(spark, docs):
    rows = {r[0]: r[1] or "" for r in corpus()}
    order = sorted(rows, reverse=True)
    prints = plain_fingerprints(spark, set(rows.values()))
    got = {r["doc_id"]: r for r in simhash.compare_edited(spark, docs).collect()}
    for i, k in enumerate(order):
        f, n = prints[rows[k]], prints[rows[order[(i + 1) % len(order)]]]
        assert got[k]["fingerprint"] == f"{f:016x}" and abs(got[k]["near_next"] - (1 - bin(f ^ n).count("1") / 64)) < 1e-9


def test_block_tables(spark):
    values = [RNG.getrandbits(63) for _ in range(200)]
    values += [v ^ sum(1 << b for b in RNG.sample(range(64), RNG.choice([1, 2, 3, 4]))) for v in values[:100]]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = sorted((r[0], r[1]) for r in simhash.near_fingerprints(df.limit(120), df).collect())
    want = sorted((a, b) for a in set(values[:120]) for b in set(values) if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3)
    assert got == want


def test_exact(spark, docs):
    rows = {r[0]: r[1] or "" for r in corpus()}
    groups = defaultdict(list)
    for k, t in rows.items():
        groups[t].append(k)
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    weak = lambda c: F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 1)
    for digest in (None, weak):
        for keep, pick in (("min", min), ("max", max)):
            got = exact_groups(spark, ids, keep, **({"digest": digest} if digest else {})).collect()
            assert {r["id"]: (r["keep_id"], r["group_size"]) for r in got} == {k: (pick(groups[t]), len(groups[t])) for k, t in rows.items()} and len(got) == len(rows)
    left = exact_dedup(spark, docs.union(docs.limit(5)), "max")
    assert left.columns == docs.columns and sorted(r[0] for r in left.select("doc_id").collect()) == sorted(max(g) for g in groups.values())
    assert exact_groups(spark, ids.limit(0)).count() == 0


def test_exact_clashing_names_and_null_ids(spark):
    rows = [(None, "a", 1, "x", 5, 7), (None, "a", 2, "x", 5, 7), (3, "b", 3, "x", 5, 7), (3, "b", 4, "x", 5, 7), (None, "b", 5, "x", 5, 7), (4, None, 6, "x", 5, 7), (5, "", 7, "x", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __short long, digest string, id long, short long")
    left = exact_dedup(spark, docs)
    assert left.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == ["(3, 'b')", "(4, None)", "(None, 'a')"]
    assert exact_dedup(spark, docs.limit(0)).count() == 0


def test_index_levels(spark, monkeypatch):
    from tidemark.llm import exact

    monkeypatch.setattr(exact, "MEMTABLE_ROWS", 3)
    index = DigestIndex(spark)
    for a in range(9):
        index.add(spark.createDataFrame([(a, "x"), (a + 100, f"t{a}")], "id long, text string"))
    index.add(spark.createDataFrame([(i, f"u{i % 7}") for i in range(200, 240)], "id long, text string").coalesce(1))
    assert index._flushed[-1].select("run").distinct().count() == 14
    probes = spark.createDataFrame([("x",), ("t3",), ("u5",), ("none",)], "text string").select(exact.sha256(F.col("text")).alias("digest"))
    want = {(0, 9), (103, 1), (201, 6)}  # 201 % 7 is 5
    for most in (1024, 0):  # pushed down, joined
        monkeypatch.setattr(exact, "PROBES", most)
        assert {(r["keep_id"], r["n"]) for r in index.lookup(probes).collect()} == want
    level = {r["keep_id"]: r["n"] for r in index.compact().where("n > 1").collect()}
    texts = [f"u{i % 7}" for i in range(200, 240)]
    assert level == {0: 9} | {200 + texts.index(t): texts.count(t) for t in texts}
    assert {(r["keep_id"], r["n"]) for r in index.lookup(probes).collect()} == want
    assert DigestIndex(spark).lookup(probes).count() == 0


def test_known(spark):
    weak = lambda c: F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 1)
    old = spark.createDataFrame([(i, f"t{i % 40}") for i in range(60)] + [(None, "t99"), (70, None)], "id long, text string")
    new = spark.createDataFrame([(1, "t0"), (1, "t39"), (2, "new"), (None, "t20"), (4, ""), (5, "t99")], "id long, text string")
    for digest in (weak, None):
        index = DigestIndex(spark, **({"digest": digest} if digest else {}))
        index.add(old)
        got = sorted(str(tuple(r)) for r in known(index, old, new).collect())
        assert got == sorted(map(str, [(1, 0), (1, 39), (2, None), (None, 20), (4, 70), (5, None)]))


def test_salted_join(spark, monkeypatch):
    from tidemark.llm import exact

    left = spark.createDataFrame([(i, i % 3 if i < 900 else 7) for i in range(1000)], "id long, k long")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    for most in (1 << 18, 1):
        monkeypatch.setattr(exact, "BROADCAST_ROWS", most)
        assert salted_join(left, right.where("k <> 7"), ["k"], "n", F.col("id"), "left").where("n IS NULL").count() == 100
        assert sorted(tuple(r) for r in salted_join(left, right, ["k"], "n", F.col("id")).select("id", "k", "n").collect()) == sorted((i, i % 3 if i < 900 else 7, 300 if i < 900 else 100) for i in range(1000))


def test_lines(spark):
    texts = ["a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "a\na\na\na\na\na", None, "", "a\nb", "b\nc\nd\ne\nq\na\nb\nc\nd\n"]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first, gone = {}, defaultdict(set)
    for d, t in enumerate(texts):
        ls = t.split("\n") if t is not None else []
        for i in range(len(ls) - 2):
            fd, fi = first.setdefault(tuple(ls[i : i + 3]), (d, i))
            if (fd, fi) != (d, i):
                gone[d] |= {j for j in range(i, i + 3) if fd != d or j > fi + 2}
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d])
        assert got[d]["text"] == want and got[d]["n_removed"] == len(gone[d])


def test_lines_repeated_and_null_ids(spark):
    rows = [(0, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\ny\nz\nw"), (None, "p\nq\nr"), (2, "p\nq\nr\ns"), (5, "l\nm\nn"), (5, "l\nm\nn"), (6, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, pos int")
    got = sorted(str((r["doc_id"], r["text"], r["n_removed"])) for r in line_dedup(docs).collect())
    want = [(0, "a\nb\nc", 0), (1, "", 3), (1, "x\ny\nz\nw", 0), (None, "p\nq\nr", 0), (2, "s", 3), (5, "l\nm\nn", 0), (5, "", 3), (6, None, 0)]
    assert got == sorted(map(str, want))
    assert line_dedup(docs.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(5, "http://a", "same"), (2, "http://b c", "same"), (9, None, None), (8, "u", ""), (3, "x", "é" * 4000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark, pages.withColumn("digest", F.lit(1))).collect()}
    assert got[5]["refers_to"] == 2 and got[9]["refers_to"] == 8 and got[2]["record_type"] == "response" and len(got) == 5
    assert got[3]["payload_digest"] == base64.b32encode(hashlib.sha1(("é" * 4000).encode()).digest()).decode() and got[3]["payload_bytes"] == 8000
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive_round_trip(spark, pages, 5).collect()} == {"response"}


def test_warc_malformed():
    records = [warc.record_bytes(i, "u", b"p" * (50 + i), None) for i in range(40)]
    whole = warc.make_archive(records, records)
    assert list(warc.read_archive(whole)) == records
    for broken in (whole[:-3], whole[8:], whole[:4] + b"\xff\xff\xff\x7f" + whole[8:], b"", whole + b"junkjunk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    for record in (b"WARC/2.0\r\n\r\n", records[0][:-1], records[0].replace(b"Content-Length: 1", b"Content-Length: 2"), records[0].replace(b"WARC-Date", b"WARC Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(record)


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in round_trip(docs, path).collect()}
    for k, t, *_ in corpus():
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_merge(symbols, ranks):
    """All occurrences of the pair of lowest rank, from the left, again and again."""
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(symbols):
            pair = tuple(symbols[i : i + 2]) == best
            out.append("".join(best) if pair else symbols[i])
            i += 1 + pair
        symbols = out
    return symbols


def test_bpe_stream_is_stable(monkeypatch):
    from tidemark.llm import bpe

    rng = random.Random(17)
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "ab"), ("a", "a"), ("aa", "aa"), ("c", "c")]
    names = ["a", "b", "c", *["".join(m) for m in merges]]
    ranks = {m: i for i, m in enumerate(merges)}
    for buffer, together in ((1, 2), (3, 8), (1024, 64)):
        monkeypatch.setattr(bpe, "BUFFER", buffer)
        monkeypatch.setattr(bpe, "TOGETHER", together)
        small = MergeList({t: i for i, t in enumerate(names)}, merges)
        words = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 30, 90]))) for _ in range(200)]
        symbols = np.array([names.index(c) for w in words for c in w], np.int64)
        got = defaultdict(list)
        for ids, number in small.stream(symbols, np.cumsum([0, *map(len, words)])):
            for i, w in zip(ids.tolist(), number.tolist(), strict=True):
                got[w].append(names[i])
        assert [got[i] for i in range(len(words))] == [plain_merge(list(w), ranks) for w in words]


def test_bpe_long_and_odd_texts(spark):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("theinabrsß漢 ") for _ in range(50_000)), "".join(rng.choice("theinabrs漢") for _ in range(20_000)), "x" * 100_000, " " * 200_000, "a\x1cb\u3000c", "Σας ΣΑΣ", "e\u0301<|endoftext|>E\u0301", "<|startoftext|>"]
    rows = [(i % 3 or None, t, 1) for i, t in enumerate([*texts, texts[-1], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(str, round_trip(docs, path).collect()))
    want = []
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append(f"Row(doc_id={i}, n_tokens={len(ids)}, ids_sha256='{sha(np.array(ids, '<u4').tobytes())}', decoded_sha256='{sha(theirs.decode(ids, skip_special_tokens=False).encode())}')")
    assert got == sorted(want)
    assert round_trip(docs.limit(0), path).count() == 0


def test_decoder():
    import json

    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), IdDecoder.of(json.load(open(path)))
    text = "é漢😀a<|endoftext|> the ☃"
    ids = np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4")
    assert "".join(ours.push(ids[i : i + 1].tobytes()) for i in range(len(ids))) + ours.close() == text
    cut = theirs.encode("😀", add_special_tokens=False).ids[:1]
    assert ours.push(np.array(cut, "<u4").tobytes()) + ours.close() == theirs.decode(cut, skip_special_tokens=False)


def test_word_pieces(spark, docs):
    path = vocabulary_file("word_bpe_49k.json")
    of = {c: b for b, c in byte_alphabet().items()}
    vocab = {tuple(symbols_of(p, "</w>", of)) for p in vocabulary(path) if p == "</w>" or set(p) <= of.keys()}
    longest = max(map(len, vocab))

    def pieces(w):
        s, n, i = (*w.encode(), 256), 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in vocab), None)
            if j is None:
                return 1
            i, n = j, n + 1
        return n

    for r in token_counts(spark, docs, path).join(docs, "doc_id").collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(map(pieces, w)))
    assert PieceCounter(path).texts([None, ""]) == ([0, 0], [0, 0])


def test_word_pieces_without_marked_twin():
    path = vocabulary_file("word_bpe_49k.json")
    of = {c: b for b, c in byte_alphabet().items()}
    vocab = {tuple(symbols_of(p, "</w>", of)) for p in vocabulary(path) if p == "</w>" or set(p) <= of.keys()}
    longest = max(map(len, vocab))

    def pieces(w):
        s, n, i = (*w.encode(), 256), 0, 0
        while i < len(s):
            i, n = next(j for j in range(min(len(s), i + longest), i, -1) if j != len(s) - 1 and s[i:j] in vocab), n + 1
        return n

    rng = random.Random(7)
    words = ["für", "thre", "漢字仮名交じり文" * 750 + "ê"] + ["".join(rng.choice("aeinrtsléüç") for _ in range(rng.choice([3, 8, 400]))) for _ in range(600)]
    counter = PieceCounter(path)
    assert counter.texts(words)[1] == list(map(pieces, words))
    assert counter.texts([words[2]])[1][0] > 6000
    marked = [p for p in vocab if p[-1] != 256 and (*p, 256) not in vocab]
    got = counter.automaton.count_many(np.array([c for p in marked for c in (*p, 256)]), np.cumsum([0] + [len(p) + 1 for p in marked]))
    assert len(marked) > 6000 and got.min() >= 2


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs, path).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, t, *_ in corpus():
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces[k], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert pack(docs.limit(0), path).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(spark, docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    kept = docs.where(langid.held_out())
    right = langid.predict(spark, model, kept).join(kept.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert [model.predict(t) for t in (None, "", "12 !?")] == [("und", 0.0)] * 3
    none = langid.fit(spark, docs.limit(0).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    assert none.predict("abc") == ("und", 0.0)
    assert langid.keep_identified(spark, model, docs.withColumn("score", F.lit(1))).columns[-1] == "score"


def test_ordinal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rated = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = ordinal.fit(spark, docs, rated.where(~out))
    assert model.thresholds[0] < model.thresholds[1]
    kept = {(r["y"], r["kept"]): r["n"] for r in ordinal.predict(spark, model, docs).join(ordinal.grade_of(rated.where(out)).withColumnRenamed("grade", "y"), "doc_id").groupBy("y", "kept").agg(F.count("*").alias("n")).collect()}
    share = lambda y: kept.get((y, True), 0) / (kept.get((y, True), 0) + kept.get((y, False), 0))
    assert share(2) > 0.97 and share(0) < 0.3 and share(1) < 0.3
    blank = ordinal.fit(spark, docs, rated.limit(0))
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x y")], "doc_id long, text string")
    assert ordinal.predict(spark, blank, odd).where("kept").count() == 3


def test_pipeline_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, an empty table and columns of clashing names through all stages and run()."""
    d = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the same text of some words here and there", "en", "s", 1), (3, None, "en", "s", 0), (3, "", None, "s", 0), (3, "   ", "de", "s", 0)], good.schema)
    docs = good.unionByName(odd).unionByName(good.limit(3)).unionByName(good.limit(3))
    docs = docs.withColumns({"key": F.lit(1), "n": F.lit(1), "digest": F.lit("d"), "id": F.lit(0), "label": F.lit("l")})
    (tmp_path / "d").mkdir()
    docs.write.parquet(str(tmp_path / "d" / "documents.parquet"))
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(str(tmp_path / "d" / "labels.parquet"))
    empty = docs.limit(0)
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= n
        assert stage(spark, empty, d).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, d).count() == 0
    pieces = corpus_pipeline.run(spark, str(tmp_path / "d")).collect()
    plain = spark.read.parquet(f"{d}/documents.parquet")
    assert pieces and {r["doc_id"] for r in pieces} <= {r["doc_id"] for r in plain.select("doc_id").collect()} | {None}
    by = defaultdict(int)
    for r in pieces:
        by[r["doc_id"]] += r["length"]
    assert all(by[r["doc_id"]] == r["doc_tokens"] for r in pieces if r["doc_id"] is not None)


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts) > 0
    groups = JaccardJoin(spark).components(docs)
    assert groups.where("doc_id <> component_id").isEmpty()
