"""Packing of tokenised documents into sequences of several context sizes.

Each task packs its own rows, a bounded buffer of documents at a time, so nothing is shuffled. A document's full windows
become sequences of the longest tier by themselves. Its rest is routed to the smallest tier it fits. Rests of the longest
tier open windows, whose gaps are filled from the shorter tiers, best fit first, the last gap by a piece cut to size; then
each shorter tier is packed in the same way into windows of its own size. Tiers are powers of two, so a full window needs
no padding; what is left at the end of a buffer goes on to the next one, at the end of the task into windows of falling
powers of two.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE, byte_alphabet
from .workspace import Workspace

LONGEST = 1024
#: Documents that a task holds at a time.
BUFFER_DOCS = 2048
#: Tiers below this are packed together.
SHORTEST = 64
#: Sequences of one tier that make a step group.
GROUP_TOKENS = 64 * LONGEST
MEMO_CHUNKS = 300_000


class ByteBpe:
    """ids of a tokenizers file's byte-level BPE (its ranks come from the same file), without special tokens added."""

    def __init__(self, path: str):
        import json

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self._core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        """ids of a text without special tokens."""
        if len(text) < LONG_RUN or not _LONG_RUN.search(text):
            return np.array(self._core.encode_ordinary(text), "<u4").tobytes()
        # the split pattern recurses over white space; of a long run all but the last character are one piece (all, at the end)
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += [self._core.encode_ordinary(text[at : run.start()]), self._core._encode_single_piece(text[run.start() : stop])]
            at = stop
        return b"".join(np.array(x, "<u4").tobytes() for x in [*out, self._core.encode_ordinary(text[at:])])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; b"" for null and empty texts. Strings of special tokens become those tokens."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self._cut.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts if p)

    def _plain(self, text: str) -> bytes:
        """_ids(), with the words after single spaces remembered. A long text is cut before white space, where a word ends anyway."""
        out, at = [], 0
        while len(text) - at > 2 * PART_CHARS:
            cut = _WORD_END.search(text, at + PART_CHARS)
            if not cut:
                break
            out.append(self._part(text[at : cut.start() + 1]))
            at = cut.start() + 1
        return b"".join([*out, self._part(text[at:])])

    def _part(self, text: str) -> bytes:
        # before a space that follows no white space the split pattern always has a boundary
        if _RUN.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        memo = self._memo
        out = [self._ids(first)]
        try:
            out.extend(map(memo.__getitem__, rest))
        except KeyError:
            for w in rest:
                if w not in memo:
                    found = self._older.get(w)
                    memo[w] = self._ids(" " + w) if found is None else found
            out[1:] = map(memo.__getitem__, rest)
            if len(memo) > MEMO_CHUNKS // 2:
                self._older, self._memo = memo, {}
        return b"".join(out)


#: Fixed value: the split pattern of the vocabulary's tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after any white space, or characters that count as white space to only one of the two libraries.
_RUN = re.compile("\\s |[\x1c-\x1f]")
#: Runs of white space of at least this many characters are kept from the split pattern.
LONG_RUN = 2048
_LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")
#: Longer texts are encoded in parts of about this many characters.
PART_CHARS = 1 << 16
_WORD_END = re.compile(f"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])")


@dataclass
class Pieces:
    """Columns of placed pieces."""

    rows: list = field(default_factory=list)

    def add(self, doc, start: int, length: int, sequence: int, offset: int, tier: int, group: int) -> None:
        self.rows.append((doc, start, length, sequence, offset, tier, group))


class Packer:
    """add(document number, tokens), flush() at the end; pieces are placed as soon as their window is full.

    Sequence numbers go up from 0. Step groups of this packer: sequences of one tier, in the order they are closed, GROUP_TOKENS each
    (with_step_groups() numbers them over all tasks).
    """

    def __init__(self, longest: int = LONGEST):
        self.longest, self.sequence, self.groups = longest, 0, {}
        self.pieces = Pieces()
        self.rests: list[tuple[int, int, int]] = []  # (length, document, start), sorted by length

    def _close(self, parts: list[tuple[int, int, int]], size: int) -> None:
        """parts: (document, start, length) that fill a window of this size."""
        number = self.groups.get(size, 0)
        self.groups[size] = number + 1
        offset = 0
        for doc, start, length in parts:
            self.pieces.add(doc, start, length, self.sequence, offset, size, number * size // GROUP_TOKENS)
            offset += length
        self.sequence += 1

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens // self.longest
        for k in range(whole):
            self._close([(doc, k * self.longest, self.longest)], self.longest)
        if tokens % self.longest:
            insort(self.rests, (tokens % self.longest, doc, whole * self.longest))

    def _fill(self, parts: list, gap: int) -> int:
        """Best fit: the longest rest that fits, again and again; what is then missing is cut from the shortest rest."""
        while gap and self.rests:
            at = bisect_right(self.rests, gap, key=lambda r: r[0])
            if at:
                length, doc, start = self.rests.pop(at - 1)
                parts.append((doc, start, length))
                gap -= length
            else:
                length, doc, start = self.rests.pop(0)
                parts.append((doc, start, gap))
                insort(self.rests, (length - gap, doc, start + gap))
                gap = 0
        return gap

    def pack(self, last: bool = False) -> None:
        """Close all windows that can be filled; the rests of less than one longest window stay, unless this is the last call."""
        tier = self.longest
        while self.rests and tier >= SHORTEST:
            # rests of this tier, the longest first, each opening a window
            while self.rests and self.rests[-1][0] > tier // 2 and sum_at_least(self.rests, tier):
                length, doc, start = self.rests.pop()
                if length > tier:
                    insort(self.rests, (length - tier, doc, start + tier))
                    length = tier
                parts = [(doc, start, length)]
                self._fill(parts, tier - length)
                self._close(parts, tier)
            if self.rests and self.rests[-1][0] > tier // 2 and not last:
                return
            tier //= 2
            if not last and not sum_at_least(self.rests, tier):
                return
        if last:
            left = sum(r[0] for r in self.rests)
            size = self.longest
            while left:
                while size > left:
                    size //= 2
                parts: list = []
                self._fill(parts, size)
                self._close(parts, size)
                left -= size


def sum_at_least(rests: list[tuple[int, int, int]], size: int) -> bool:
    total = 0
    for r in reversed(rests):
        total += r[0]
        if total >= size:
            return True
    return False


_tokenizers: dict[str, ByteBpe] = {}
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, path: str, longest: int = LONGEST, end_id: int = 0) -> DataFrame:
    """Pieces of each row of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document's ids are its text's (null: none) and then end_id; every id lies in one piece, so even an empty text has one
    piece of one id. A sequence has exactly its tier's number of tokens, a power of two up to longest. Rows are packed as
    they come: repeated rows and null doc_ids too. path: a tokenizers file that every worker can read. sequence_ids carry
    the task's number in their upper bits, so they are unique, and the same again if a lost task runs anew. Texts of any length are
    encoded whole; other columns are not read; an empty table gives an empty one.
    """
    if longest & (longest - 1) or longest < SHORTEST:
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = ByteBpe(path)
        tokenizer = _tokenizers[path]
        task = TaskContext.get().partitionId() << 40
        packer = Packer(longest)
        held: dict[int, tuple[int | None, bytes]] = {}
        number, tail = 0, np.array([end_id], "<u4").tobytes()

        def placed():
            rows, packer.pieces.rows = packer.pieces.rows, []
            cols = [[] for _ in range(9)]
            for doc, start, length, sequence, offset, tier, group in rows:
                doc_id, ids = held[doc]
                for c, v in zip(cols, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, task + sequence, offset, tier, task + group), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            still = {r[1] for r in packer.rests}
            for doc in [d for d in held if d not in still]:
                del held[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py()) + tail
                held[number] = doc_id, ids
                packer.add(number, len(ids) // 4)
                number += 1
                size += len(ids)
                if number % BUFFER_DOCS == 0 or size > 1 << 25:
                    packer.pack()
                    size = 0
                    yield placed()
        packer.pack(last=True)
        yield placed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def with_step_groups(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """pieces of pack() with step_group numbered over all tasks and tiers: each group has GROUP_TOKENS tokens of one tier, only a tier's last group fewer;
    numbers run from 0 without gaps, the longest tier first.

    The pieces are written once. A row for each task and tier (ten tiers at most, and tiers of the powers of two below) tells where the task's
    sequences begin among all of the tier; within a task they are numbered in the order they were closed.
    """
    held = Workspace(spark, "groups").save(pieces.drop("step_group"), "pieces")
    first = held.where("offset = 0").select("sequence_id", "tier", F.shiftright("sequence_id", 40).alias("task"))
    counts = first.groupBy("tier", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tier", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    groups = counts.groupBy("tier").agg(F.ceil(F.sum("n") * F.col("tier") / GROUP_TOKENS).cast("long").alias("g"))
    longer = Window.partitionBy(F.lit(0)).orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, -1)
    tiers = groups.select("tier", F.coalesce(F.sum("g").over(longer), F.lit(0)).alias("base"))
    own = first.withColumn("r", F.row_number().over(Window.partitionBy("tier", "task").orderBy("sequence_id")) - 1)
    placed = own.join(F.broadcast(starts), ["tier", "task"]).join(F.broadcast(tiers), "tier")
    group = F.col("base") + F.floor((F.col("begin") + F.col("r")) * F.col("tier") / GROUP_TOKENS)
    return held.join(placed.select("sequence_id", group.cast("long").alias("step_group")), "sequence_id").select(*pieces.columns)
