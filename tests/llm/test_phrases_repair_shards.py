"""Phrase mining, conversation repair and sharding against brute force, with nulls, ties, repeated rows, long texts and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases, queries, repair, textbytes
from tidemark.llm.phrases import PhraseMiner
from tidemark.llm.repair import ConversationRepair, audit_between, damage_and_repair, damaged
from tidemark.llm.sharding import Shard, ShardTree, shard_documents

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_conversation_repair", "op13_hash_tree_sharding"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in cols]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


# phrases


def mined(rows, least, best):
    """All phrases counted and scored in plain Python."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= 80 * counts[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, t.decode(), -a, l, r, n[lang], -s) for i, (s, a, t, l, r) in enumerate(sorted(rows)[:best])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def prose(seed, n, words):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        out = []
        while len(out) < words:
            out += rng.choice([["the", "old", "Harbour", "wall"], ["red", "tide"], ["no", "no", "no", "no", "no"], [rng.choice("abcdefgh")], [rng.choice("abc"), rng.choice("xyz")]])
            if rng.random() < 0.1:
                out[-1] += rng.choice(".,;:!?\n\x0b")
        made.append(rng.choice([" ", "  ", " \t"]).join(out))
    return made


def test_phrases(spark):
    rows = [(rng, t) for rng, t in zip(itertools.cycle(["en", "fr", None, "en"]), prose(5, 120, 60))]
    rows += [("en", None), ("en", ""), ("", "é è é è " * 40), ("en", rows[0][1]), ("en", rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, n int, w1 int, word string").repartition(5)
    assert told(PhraseMiner(spark, docs, 30, 2000).best_phrases()) == mined(rows, 30, 2000)
    # few kept and a low first rank: the threshold sinks in rounds, ties at the last place included
    for best, rank in ((3, 2), (12, 5), (1, 1)):
        assert told(PhraseMiner(spark, docs, 12, best, rank).best_phrases()) == mined(rows, 12, best)


def test_phrases_of_long_texts(spark, monkeypatch):
    text = " ".join(prose(6, 30, 400))
    assert len(text) > 30_000
    want = mined([("en", text)], 30, 2000)
    for size in (textbytes.SLICE_BYTES, 1000, 7):
        # a long text is cut between words; phrases go over the cuts
        data, offsets = textbytes.string_buffers(pa.array([text]))
        monkeypatch.setattr(phrases, "SLICE_BYTES", size)
        parts = [b for _, b, _ in phrases._chunks(offsets, data)]
        assert all(phrases.WORD_ENDS[data[int(b[0])]] for b in parts[1:]) and int(parts[-1][-1]) == int(offsets[-1])
        counts = Counter()
        run = phrases._phrases(3, 0, type("All", (), {"has": lambda self, c: c[0] == c[0]})(), None)
        for out in run(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})])):
            for *w, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                counts[tuple(w)] += n
        brute = Counter()
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text.lower()):
            w = re.findall(r"[^\x20\x09]+", piece)
            brute.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert sorted(counts.values()) == sorted(brute.values())
    monkeypatch.undo()
    assert told(PhraseMiner(spark, spark.createDataFrame([("en", text)], "lang string, text string")).best_phrases()) == want
    million = [("en", "alpha beta " * 500_000)]
    assert told(PhraseMiner(spark, spark.createDataFrame(million, "lang string, text string")).best_phrases()) == mined(million, 30, 2000)


def test_phrases_exact_scores(spark):
    big = (1 << 62) + 12_345
    one = spark.createDataFrame([(big, big, big - 1)], "a long, l long, r long")
    got = one.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 2_000_000 * big // (2 * big - 1)


def test_phrases_of_nothing(spark):
    assert PhraseMiner(spark, spark.createDataFrame([], "lang string, text string")).best_phrases().count() == 0
    assert PhraseMiner(spark, spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).best_phrases().count() == 0


# repair

ROLE = {"s": "system", "u": "user", "a": "assistant"}


def walk(rows):
    """The cheapest, ASCII-least (cost, audit) of rows (initial, fault), by trying all states with their whole audits."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "")}

    def insert(best):
        for _ in range(3):
            more = dict(best)
            for s, (c, a) in best.items():
                t = "a" if s == "u" else "u"
                if t not in more or (c + 3, a + "I") < more[t]:
                    more[t] = (c + 3, a + "I")
            best = more
        return best

    for init, fault in rows:
        new = {}

        def offer(s, c, a, new=new):
            if s not in new or (c, a) < new[s]:
                new[s] = (c, a)

        for s, (c, a) in insert(best).items():
            offer(s, c + 4, a + "D")
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                offer("a" if s == "u" else "u", c + 3 + cut, a + "R")
                if (s, init) in follows:
                    offer(follows[s, init], c + cut, a + "K")
        best = new
    best = insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def faults(rows):
    """(initial, fault) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def replay(audit, rows):
    out, state, rows = [], "", iter(rows)
    for e in audit:
        turn = "a" if state == "u" else "u"
        if e == "I":
            out.append(f"{ROLE[turn]}:")
            state = turn
            continue
        role, text = next(rows)
        if e == "R":
            out.append(f"{ROLE[turn]}:{text}")
            state = turn
        elif e == "K":
            out.append(f"{role}:{text}")
            state = role[0]
    assert next(rows, None) is None
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return "\n".join(out)


def hurt(rows):
    """damaged() in plain Python: rows by conv."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # noqa: B018
        word = lambda v: " " if v is None else str(v)
        f = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out[conv] += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for conv, found in out.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, md5("|".join(["none" if conv is None else str(conv), md5(r[1]), md5(r[2])]))))
    return out


def repaired(rows):
    out = {}
    for conv, found in hurt(rows).items():
        pairs = [(r, t) for _, r, t in found]
        marks = faults(pairs)
        cost, audit = walk(marks)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        n = Counter(f for _, f in marks)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(replay(audit, pairs).encode()).hexdigest())
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for i in range(rng.choice([0, 1, 2, 3, 5, 8, 30])):
            turn = rng.choice([i, i, i, i * 2, i - 3, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser"]), rng.choice(["Yes.", "No!", "So", " \t\n", "", None, "x? ", "long " * 300, f"t{rng.random()}."])))
    return rows + rows[:20]


KIND = "conv_id long, turn long, role string, text string"
TOLD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair(spark):
    rows = conversations(8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", audit string, same int").repartition(6)
    got = {r["conv_id"]: tuple(r[c] for c in TOLD) for r in damage_and_repair(spark, df).collect()}
    assert got == repaired(rows)


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", "So", f"{i}!", " "])) for i in range(3000)] + [(1, 0, "user", "Hi."), (9, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, KIND)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # the conversation lies in several pieces
    try:
        done = ConversationRepair(spark, damaged(df))
        assert done.audits.where("conv_id = 7").count() > 2
        got = {r["conv_id"]: tuple(r[c] for c in TOLD) for r in done.digests().collect()}
        want = repaired(rows)
        assert got == {k: v for k, v in want.items() if k in got} and 7 in got
        lines = sorted((r["position"], f"{r['role']}:{r['text']}") for r in done.repaired().where("conv_id = 7").collect())
        assert [p for p, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(t for _, t in lines).encode()).hexdigest() == want[7][-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_audits(spark):
    rng = random.Random(10)
    bits = {"": 0, "truncated": repair.TRUNCATED, "blank": repair.BLANK, "duplicate": repair.DUPLICATE}
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(12))]
        codes = bytes(repair.ROLES.get(i, repair.OTHER) + bits[f] for i, f in rows)
        cuts = sorted(rng.choices(range(len(codes) + 1), k=3))
        pieces = [codes[a:b] for a, b in itertools.pairwise([0, *cuts, len(codes)])]
        sums = []
        for p in pieces:
            each = [repair.forward(p, s) for s in repair.STATES]
            sums.append(([c for costs, _ in each for c in costs], [x for _, places in each for x in places]))
        cost, states = repair.crossings(sums)
        audit = "".join(audit_between(p, a, b) for p, a, b in zip(pieces, states, states[1:], strict=True)) + repair.ENDINGS[states[-1]]
        assert (cost, audit) == walk(rows)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], KIND)
    assert damage_and_repair(spark, none).count() == 0 and ConversationRepair(spark, none).repaired().count() == 0


# shards


def lowest(key, tree, level=""):
    for _ in range(3):
        draw = lambda c: -math.log((int(hashlib.md5(f"{key}|{c[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / c[1]
        level, _, number = min(tree.children()[level], key=lambda c: (draw(c), c[0]))
    return number


def test_shards(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["", "é漢", "same text", f"t{i}", None])) for i in range(300)] + [(None, "x"), (None, None), (5, "other"), (5, "other"), (5, None)]
    rows.append((301, "w " * 10**6))
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, shard int, slot int").repartition(5)
    tree = ShardTree.even(16)
    got = [r.asDict() for r in shard_documents(spark, docs, tree, tree.grown()).collect()]
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in raw)
    slots = defaultdict(list)
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["law"] == "key" and r["shard"] == lowest(key, tree) and r["grown_shard"] == lowest(key, tree.grown())
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(spark, docs.limit(0), tree, tree.grown()).count() == 0


def test_only_changed_subtrees_move():
    tree = ShardTree([Shard(i, i % 3, i // 3 % 2, weight=1.0 + i % 4) for i in range(18)])
    home = {s.number: (s.region, s.rack) for s in tree.shards}
    before = {k: lowest(k, tree) for k in range(4000)}
    share = Counter(before.values())
    total = sum(s.weight for s in tree.shards)
    assert all(abs(share[s.number] / 4000 - s.weight / total) < 0.02 for s in tree.shards)
    heavier = tree.reweighted(4, 6.0)  # region 1, rack 1
    for k, old in before.items():
        new = lowest(k, heavier)
        if new != old:
            assert home[new][0] == 1  # rows go into the region only
            if home[old][0] == 1:
                assert home[new] == (1, 1) and (home[old] != (1, 1) or new == 4)
    lighter = tree.reweighted(4, 0.0)
    for k, old in before.items():
        new = lowest(k, lighter)
        assert new == old or (home[old][0] == 1 and (home[new][0] != 1 or home[old] == (1, 1)))
    step = tree
    for n in range(3):  # one shard more takes rows only into itself, each time
        more = step.grown(region=n % 2, rack=n, weights=(2.0,))
        now = {k: lowest(k, step) for k in range(1500)}
        then = {k: lowest(k, more) for k in range(1500)}
        assert all(then[k] in (now[k], 18 + n) for k in now) and 18 + n in then.values()
        step = more
    with pytest.raises(ValueError):
        ShardTree([Shard(0, 0, 0), Shard(0, 1, 0)])
