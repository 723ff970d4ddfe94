"""Conversations whose turns are put right by the cheapest edits.

A repaired conversation's role initials read (s?(ua)+)?, so a conversation is a walk through four states (start, after system,
after user, after assistant), and each row an edit: Keep, Rerole or Delete, with Inserts before it. Forward vectors hold, for each state, the least
cost and the place of its least audit among the states; backward vectors hold costs. Audits of equally many rows are never
prefixes of each other, so places decide ties exactly. Where both vectors meet in the middle of a run of rows, the cheapest
crossing with the least audit splits the run in two, which are solved alike: memory is one byte a row.

Rows are dealt by ranges of conversation and turn, so a long conversation lies in several tasks. Each task sums up its piece of
it as costs between states; the crossings between pieces follow from these sums, and the pieces are then solved apart. Texts take
part only at the end, in a pass over each conversation's rows in order that holds one batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact import salted_join
from .workspace import Workspace

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Bits of a row's code: the first two are its role.
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER, TRUNCATED, BLANK, DUPLICATE = 3, 4, 8, 16
RETOLD, DELETED, INSERTED, CUT = 3, 4, 3, 3
FAR = 1 << 40

#: Bytes between words.
SPACE = "\t\n\x0b\x0c\r "


def _after(state: int, role: int) -> int | None:
    """The state after a row of that role, None where it may not follow."""
    if role == ROLES["s"]:
        return SYSTEM if state == START else None
    if role == ROLES["u"]:
        return USER if state != USER else None
    return ASSISTANT if role == ROLES["a"] and state == USER else None


def _wanted(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def steps(code: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """The cheapest (cost, edits) by state before and after a row of that code, the least edits among equals."""
    table = []
    for p in STATES:
        found: list[tuple[int, str] | None] = [None] * 4

        def offer(q: int, cost: int, edits: str, found=found) -> None:
            if found[q] is None or (cost, edits) < found[q]:
                found[q] = (cost, edits)

        at, cost, edits = p, 0, ""
        for _ in range(4):
            offer(at, cost + DELETED, edits + "D")
            if not code & (BLANK | DUPLICATE):
                more = CUT if code & TRUNCATED else 0
                offer(_wanted(at), cost + RETOLD + more, edits + "R")
                kept = _after(at, code & 3)
                if kept is not None:
                    offer(kept, cost + more, edits + "K")
            at, cost, edits = _wanted(at), cost + INSERTED, edits + "I"
        table.append(tuple(found))
    return tuple(table)


#: The Inserts that end a conversation in a state, by that state.
ENDINGS = ("", "II", "I", "")


@lru_cache(maxsize=1 << 16)
def _forward(code: int, costs: tuple[int, ...], places: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """(what was taken off all costs, costs, places) after a row of that code."""
    table, best = steps(code), []
    for q in STATES:
        ways = [(costs[p] + table[p][q][0], places[p], table[p][q][1]) for p in STATES if table[p][q] and costs[p] < FAR]
        best.append(min(ways, default=(FAR, 4, "")))
    low = min(b[0] for b in best)
    order = sorted(b[1:] for b in best)
    return low, tuple(b[0] - low if b[0] < FAR else FAR for b in best), tuple(order.index(b[1:]) for b in best)


@lru_cache(maxsize=1 << 16)
def _backward(code: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row of that code, less the smallest."""
    table = steps(code)
    new = [min((table[p][q][0] + costs[q] for q in STATES if table[p][q] and costs[q] < FAR), default=FAR) for p in STATES]
    low = min(new)
    return tuple(c - low if c < FAR else FAR for c in new)


def _alone(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else FAR for s in STATES)


def forward(codes: bytes, start: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(costs, places of the least audits) by last state, from start over all rows."""
    total, costs, places = 0, _alone(start), (0, 0, 0, 0)
    for code in codes:
        low, costs, places = _forward(code, costs, places)
        total += low
    return tuple(c + total if c < FAR else FAR for c in costs), places


def audit_between(codes: bytes, start: int, end: int) -> str:
    """The least of the cheapest audits of these rows from one state to another."""
    if len(codes) < 2:
        return steps(codes[0])[start][end][1] if codes else ""
    left, right = codes[: len(codes) // 2], codes[len(codes) // 2 :]
    costs, places = forward(left, start)
    back = _alone(end)
    for code in reversed(right):
        back = _backward(code, back)
    crossing = min(STATES, key=lambda s: (costs[s] + back[s], places[s]))
    return audit_between(left, start, crossing) + audit_between(right, crossing, end)


def crossings(sums: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """(cost, states at the pieces' borders, the first and the last included) of the least of the cheapest audits, given the costs
    and places of each piece from each state to each."""
    costs, places, came = list(_alone(START)), [0, 0, 0, 0], []
    for cost, place in sums:
        best = [min((costs[p] + cost[4 * p + q], places[p], place[4 * p + q], p) if costs[p] < FAR and cost[4 * p + q] < FAR else (FAR, 4, 4, p) for p in STATES) for q in STATES]
        order = sorted({b[1:3] for b in best})
        costs, places = [b[0] for b in best], [order.index(b[1:3]) for b in best]
        came.append([b[3] for b in best])
    last = min(STATES, key=lambda s: (costs[s] + INSERTED * len(ENDINGS[s]), places[s]))
    states = [last]
    for c in reversed(came):
        states.append(c[states[-1]])
    return costs[last] + INSERTED * len(ENDINGS[last]), states[::-1]


def _runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, from, to) of the runs of equal values."""
    if not len(column):
        return
    held = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]) | (held[1:] != held[:-1])) + 1).tolist(), len(values)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (int(values[a]) if held[a] else None), a, b


_PIECE = "conv_id long, part int, codes binary, low long, high long, turns long, costs array<long>, places array<long>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of (conv_id, turn, code, part) rows in order."""
    now, held, rows = object(), None, []

    def close():
        codes = b"".join(held["codes"])
        turns = [c for s in STATES for c in zip(*forward(codes, s), strict=True)]
        rows.append((now, held["part"], codes, held["low"], held["high"], held["turns"], [c for c, _ in turns], [p for _, p in turns]))

    def batch_of(rows):
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _PIECE.split(", ")])

    for batch in batches:
        turn, codes = batch.column(1), batch.column(2).to_numpy().astype(np.uint8)
        for conv, a, b in _runs(batch.column(0)):
            if conv != now:
                if held:
                    close()
                now, held = conv, {"codes": [], "part": batch.column(3)[a].as_py(), "low": None, "high": None, "turns": 0}
            held["codes"].append(codes[a:b].tobytes())
            known = turn.slice(a, b - a).drop_null().to_numpy()
            if len(known):
                held["turns"] += len(np.unique(known)) - int(held["high"] == known[0])
                held["low"], held["high"] = (int(known[0]) if held["low"] is None else held["low"]), int(known[-1])
        if len(rows) > 4096:
            yield batch_of(rows)
            rows = []
    if held:
        close()
    if rows:
        yield batch_of(rows)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_SOLVED = f"conv_id long, part int, codes binary, start int, end int, last boolean, {_COUNTS}"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _counts(pieces: list[dict], cost: int) -> list[int]:
    turns = high = low = None
    illegal = blank = duplicate = truncated = 0
    before = None
    for p in pieces:
        codes = np.frombuffer(p["codes"], np.uint8)
        blank += int((codes & BLANK > 0).sum())
        duplicate += int((codes & DUPLICATE > 0).sum())
        truncated += int((codes & TRUNCATED > 0).sum())
        roles = codes & 3 if before is None else np.concatenate([[before], codes & 3])
        pairs = np.bincount(roles[:-1].astype(int) * 4 + roles[1:], minlength=16)
        illegal += int(pairs.sum()) - sum(int(pairs[4 * a + b]) for a, b in _LEGAL)
        before = codes[-1] & 3
        if p["low"] is not None:
            turns = p["turns"] + (0 if turns is None else turns - (p["low"] == high))
            low, high = (p["low"] if low is None else low), p["high"]
    return [0 if turns is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of each conversation's pieces, which come one after another; its counts go with its first piece."""
    names = [f.split()[0] for f in _SOLVED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]

    def solved(pieces):
        cost, states = crossings([(p["costs"], p["places"]) for p in pieces])
        counts = _counts(pieces, cost)
        for i, p in enumerate(pieces):
            yield (p["conv_id"], p["part"], p["codes"], states[i], states[i + 1], i == len(pieces) - 1, *(counts if i == 0 else [None] * 6))

    held, rows = [], []
    for batch in batches:
        for p in batch.to_pylist():
            if held and held[0]["conv_id"] != p["conv_id"]:
                rows.extend(solved(held))
                held = []
            held.append(p)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if held:
        rows = list(solved(held))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        found = [audit_between(c, s, e) + (ENDINGS[e] if last else "") for c, s, e, last in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), *batch.columns[6:]], ["conv_id", "part", "audit", *[c.split()[0] for c in _COUNTS.split(", ")]])


class _Reader:
    """Follows a conversation's audit: told of each row, it gives the rows that stand there now."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _insert(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _wanted(self.state)
            yield ("user" if self.state == USER else "assistant"), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = _wanted(self.state)
            yield ("user" if self.state == USER else "assistant"), text
        elif edit == "K":
            self.state = _after(self.state, ROLES[role[0]])
            yield role, text

    end = _insert


def _walk(open_one, batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Lists of results, from (conv_id, kind, role, text, audit, counts) rows in order: of each conversation the pieces of its audit
    (kind 0), then its rows (kind 1). open_one(conv_id, counts, audit) gives an object with add(rows) and close(), both giving results."""
    now, audit, counts, reader, one = object(), [], None, None, None

    def begin():
        text = "".join(audit)
        return _Reader(text), open_one(now, counts, text)

    for batch in batches:
        out = []
        for conv, kind, role, text, piece, *told in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                if conv != now:
                    if audit:
                        reader, one = (reader, one) if one else begin()
                        out.extend(one.add(reader.end()))
                        out.extend(one.close())
                    now, audit, counts, one = conv, [], None, None
                audit.append(piece)
                counts = counts or (told if told[0] is not None else None)
                continue
            if one is None:
                reader, one = begin()
            out.extend(one.add(reader.row(role, text)))
        yield out
    if audit:
        reader, one = (reader, one) if one else begin()
        yield [*one.add(reader.end()), *one.close()]


class _Digest:
    def __init__(self, conv, counts, audit):
        self.told, self.hash, self.first = (conv, *counts, audit), hashlib.sha256(), True

    def add(self, rows):
        for role, text in rows:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
        return ()

    def close(self):
        return ((*self.told, self.hash.hexdigest()),)


class _Rows:
    def __init__(self, conv, counts, audit):
        self.conv, self.n = conv, 0

    def add(self, rows):
        for role, text in rows:
            yield self.conv, self.n, role, text
            self.n += 1

    def close(self):
        return ()


_DIGESTS = f"conv_id long, {_COUNTS}, audit string, repaired_sha256 string"
_REPAIRED = "conv_id long, position long, role string, text string"


def _told(kind, schema: str):
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches):
        for rows in _walk(kind, batches):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return run


class ConversationRepair:
    """The repair of rows(conv_id, turn, role, text).

    A conversation's rows go by turn, nulls first, rows of one turn by a digest of role and text. A null role or text counts as one space, so
    such a row is blank or has no legal role. Rows without conv_id are one conversation. A row's first fault counts: blank (nothing
    but space), duplicate (role and text, by 128 bits, seen earlier in the conversation; of equal rows all but the first), truncated
    (the last character that is no space is none of `.!?`). Keep costs 0, Rerole to user or assistant 3, Delete 4 (blank rows
    and duplicates must go), Insert of an empty user or assistant row 3; a truncated row that stays adds 3. A role counts by its
    first letter, so a row with an empty role can't be kept as it is. Of the cheapest edits those with the ASCII-least audit
    are taken. Other columns are not read; an empty table gives empty ones; turns are whole numbers.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.ws = Workspace(spark, "repair")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role"), part("text"))
        conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
        self.rows = rows.withColumn("same", F.unhex(F.md5(F.concat_ws("|", conv, F.md5("role"), F.md5("text")))))
        self.audits = self.ws.save(self._solve(), "audits")

    def _coded(self) -> DataFrame:
        """(conv_id, turn, same, row, code) without texts."""
        bare = F.rtrim(F.col("text"), F.lit(SPACE))
        role = F.substring("role", 1, 1)
        whose = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(OTHER)
        fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
        coded = self.ws.save(self.rows.select("conv_id", "turn", "same", (whose + fault).alias("code"), F.monotonically_increasing_id().alias("row")), "coded")
        again = coded.groupBy("same").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = self.ws.save(again.select("same", F.col("first.row").alias("first"), "n"), "again")
        later = F.col("first").isNotNull() & (F.col("first") != F.col("row")) & (F.col("code").bitwiseAND(F.lit(BLANK)) == 0)
        code = F.when(later, F.col("code").bitwiseAND(F.lit(3)) + DUPLICATE).otherwise(F.col("code"))
        return salted_join(coded, again, ["same"], "n", F.col("row"), "left").select("conv_id", "turn", "same", "row", code.cast("int").alias("code"))

    def _solve(self) -> DataFrame:
        """(conv_id, part, audit, counts): the pieces of each conversation's audit, counts with the first."""
        keys = ["conv_id", "turn", "same", F.col("code").bitwiseAND(F.lit(DUPLICATE)), "row"]  # the first of equal rows comes before its repeats
        ranged = self._coded().repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys)
        pieces = ranged.select("conv_id", "turn", "code", F.spark_partition_id().alias("part")).mapInArrow(_gather, _PIECE)
        met = pieces.repartition(self.parts, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_meet, _SOLVED)
        return met.repartition(self.parts, "conv_id", "part").mapInArrow(_audits, f"conv_id long, part int, audit string, {_COUNTS}")

    def _in_order(self) -> DataFrame:
        nothing = lambda kind: F.lit(None).cast(kind)
        counts = [f.split() for f in _COUNTS.split(", ")]
        audits = self.audits.select("conv_id", F.lit(0).alias("kind"), F.col("part").cast("long").alias("at"), nothing("binary").alias("same"), nothing("string").alias("role"), nothing("string").alias("text"), "audit", *[c for c, _ in counts])
        rows = self.rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").alias("at"), "same", "role", "text", nothing("string").alias("audit"), *[nothing(k).alias(c) for c, k in counts])
        both = audits.unionByName(rows).repartition(self.parts, "conv_id").sortWithinPartitions("conv_id", "kind", "at", "same")
        return both.select("conv_id", "kind", "role", "text", "audit", *[c for c, _ in counts])

    def digests(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

        gaps: turns missing between the first and the last; illegal: neighbours whose role initials are not su, ua or au;
        repaired_sha256: of the lines `role:text` of the repaired conversation."""
        return self._in_order().mapInArrow(_told(_Digest, _DIGESTS), _DIGESTS)

    def repaired(self) -> DataFrame:
        """(conv_id, position, role, text): the repaired conversations."""
        return self._in_order().mapInArrow(_told(_Rows, _REPAIRED), _REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults, by the checksum of `conv_id:turn` modulo 20: 0 goes, 1 loses its text, 2 its
    `.!?`, 3 comes twice, 4 gets the role user. Nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(word("conv_id"), F.lit(":"), word("turn")), "UTF-8")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    marked = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("__n")).drop("__n")


def damage_and_repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """digests() of the damaged rows for every conv_id of rows; a conversation that loses all rows has zeros, an empty audit and the
    hash of nothing."""
    found = ConversationRepair(spark, damaged(rows)).digests()
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumnRenamed("conv_id", "id")
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    empty: Column = F.lit(hashlib.sha256().hexdigest())
    counts = [zero(f.split()[0]) for f in _COUNTS.split(", ")]
    return joined.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
