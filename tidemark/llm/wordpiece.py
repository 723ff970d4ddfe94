"""Token counts by greedy longest match, through a linear-time automaton.

The vocabulary is a trie. Where no longer match goes on, a failure link leads to the state of the rest after the greedy
tokens have been taken off, and the number of those tokens is stored with the link; so a word is counted in one pass over
its characters, without building a piece.

The end mark alone is no piece. Where the greedy match takes all bytes of a word and leaves only the mark, its last piece is
split again into the longest pieces that don't leave the mark alone; their number is stored with each piece.
"""

from __future__ import annotations

import json
import re
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TEXTS_AT_ONCE, byte_alphabet
from .inttable import IntTable
from .textbytes import batch_parts

#: Words of more bytes than this are counted one by one; the others of a slice all together.
LONG_WORD = 64
#: A worker remembers the counts of at most this many words.
MEMO_WORDS = 400_000
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def vocabulary(path: str) -> set[str]:
    """Pieces of a tokenizers file, as text in the byte-level alphabet with the word-end mark."""
    return set(json.load(open(path, encoding="utf-8"))["model"]["vocab"])


END = 256


def symbols_of(piece: str, mark: str, bytes_of: dict[str, int]) -> list[int]:
    """A vocabulary piece as bytes, with END for a word-end mark after them."""
    last = piece.endswith(mark) and piece != mark
    return [bytes_of[c] for c in (piece[: -len(mark)] if last else piece)] + [END] * last


def _closing(piece: list[int], children: list[dict[int, int]], ends: list[bool]) -> int:
    """Pieces of piece and END, each the longest that doesn't leave END alone; 0 if there is no such split."""
    whole, i, n = [*piece, END], 0, 0
    while i < len(whole):
        at, to = 0, 0
        for j in range(i, len(whole)):
            at = children[at].get(whole[j], -1)
            if at < 0:
                break
            if ends[at] and j + 1 != len(piece):
                to = j + 1
        if not to:
            return 0
        i, n = to, n + 1
    return n


class LongestMatch:
    """Pieces of the greedy longest-match split of words given as symbols (bytes, then END); no match leaves END alone."""

    def __init__(self, pieces: list[list[int]]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for p in pieces:
            at = 0
            for c in p:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = len(children)
                    children.append({})
                    ends.append(False)
                    children[at][c] = nxt
                at = nxt
            ends[at] = at != 0
        # link[v]: where to go on when v has no fitting child; popped[v]: tokens that this takes off. -1: no link
        link, popped = [-1] * len(children), [0] * len(children)
        queue = deque((c, v, 0) for c, v in children[0].items())
        while queue:
            c, v, parent = queue.popleft()
            if ends[v]:
                link[v], popped[v] = 0, 1
            elif parent:
                z, n = link[parent], popped[parent]
                while z > 0 and c not in children[z]:
                    n += popped[z]
                    z = link[z]
                if z >= 0 and c in children[z]:
                    link[v], popped[v] = children[z][c], n
            queue.extend((d, w, v) for d, w in children[v].items())
        self.link, self.popped = np.array(link), np.array(popped)
        # closed[v]: pieces of the piece at v when END follows, for those without a marked twin; 0: not needed or not possible
        self.closed = np.zeros(len(children), np.int64)
        if not (END in children[0] and ends[children[0][END]]):
            for p in pieces:
                at = 0
                for c in p:
                    at = children[at][c]
                if p[-1] != END and END not in children[at]:
                    self.closed[at] = _closing(p, children, ends)
        edges = np.array([(v * 512 + c, w) for v, own in enumerate(children) for c, w in own.items()], np.int64)
        self.child = IntTable(edges[:, 0], edges[:, 1])
        self.edges = edges

    def count_many(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pieces of each word symbols[bounds[i]:bounds[i+1]], 0 where some part matches no piece. All words advance together,
        one symbol a step, each following failure links as needed."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = bounds[:-1][order], sizes[order]
        state, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        failed = np.zeros(len(order), bool)
        live = len(order)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= j:
                live -= 1
            left = np.flatnonzero(~failed[:live])
            while len(left):
                c = symbols[starts[left] + j]
                to = self.child.get(state[left] * 512 + c)
                went = to >= 0
                state[left[went]] = to[went]
                left, c = left[~went], c[~went]
                ahead = self.closed[state[left]]
                closes = (c == END) & (ahead > 0)
                n[left[closes]] += ahead[closes]
                state[left[closes]] = 0
                left = left[~closes]
                stuck = (self.link[state[left]] < 0) | (state[left] == 0)
                failed[left[stuck]] = True
                left = left[~stuck]
                n[left] += self.popped[state[left]]
                state[left] = self.link[state[left]]
        left = np.flatnonzero(~failed & (state > 0))
        while len(left):
            stuck = self.link[state[left]] < 0
            failed[left[stuck]] = True
            left = left[~stuck]
            n[left] += self.popped[state[left]]
            state[left] = self.link[state[left]]
            left = left[state[left] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(failed, 0, n)
        return out


    def count_one(self, symbols: bytes) -> int:
        """Pieces of one word (its bytes; END is added): the same pass, one symbol after another, so its time is linear in the
        word and it needs no memory besides."""
        if not hasattr(self, "_scalar"):
            self._scalar = dict(self.edges.tolist()), self.link.tolist(), self.popped.tolist(), self.closed.tolist()
        child, link, popped, closed = self._scalar
        state = n = 0
        for c in chain(symbols, (END,)):
            to = child.get(state * 512 + c)
            while to is None:
                if c == END and closed[state]:
                    n += closed[state]
                    to = 0
                elif link[state] < 0 or not state:
                    return 0
                else:
                    n += popped[state]
                    state = link[state]
                    to = child.get(state * 512 + c)
            state = to
        while state > 0:
            if link[state] < 0:
                return 0
            n += popped[state]
            state = link[state]
        return n


class PieceCounter:
    """Pieces by word (A-Z lower-cased, between ASCII white space); a word that no split fits (none, if every byte is a piece with and without the mark) counts as one."""

    def __init__(self, path: str, mark: str = "</w>"):
        bytes_of = {c: b for b, c in byte_alphabet().items()}
        self.automaton = LongestMatch([symbols_of(p, mark, bytes_of) for p in sorted(vocabulary(path)) if p == mark or set(p) <= bytes_of.keys()])
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _learn(self, words: list[str]) -> dict[str, int]:
        long = {w: max(self.automaton.count_one(w.encode("utf-8", "surrogatepass")), 1) for w in words if len(w) > LONG_WORD}
        if long:
            words = [w for w in words if w not in long]
        flat = np.frombuffer("\n".join([*words, ""]).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        stops = np.flatnonzero(flat == 10)
        flat[stops] = END
        got = self.automaton.count_many(flat, np.concatenate(([0], stops + 1)))
        return dict(zip(words, np.maximum(got, 1).tolist(), strict=True)) | long

    def texts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text; 0 and 0 for null and empty ones."""
        split = [words_of(t) if t else [] for t in texts]
        wanted: set[str] = set()
        for words in split:
            wanted.update(words)
        new = wanted.difference(self.memo)
        again = {w for w in new if w in self.older}
        self.memo.update((w, self.older[w]) for w in again)
        learned = self._learn(list(new - again))
        memo = self.memo
        memo.update(learned)
        out = [len(words) for words in split], [sum(map(memo.__getitem__, words)) for words in split]
        for w in learned:
            if len(w) > LONG_WORD:
                del memo[w]
        if len(memo) > MEMO_WORDS // 2:
            self.older, self.memo = memo, {}
        return out


def words_of(text: str) -> list[str]:
    if text.isascii() and not _CONTROLS.search(text):
        return text.lower().split()
    return [w for w in _SPACE.split(text.translate(_ASCII_LOWER)) if w]


_SPACE = re.compile("[\t-\r ]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
_counters: dict[str, PieceCounter] = {}


def token_counts(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of docs(doc_id, text); path: a vocabulary file that every worker can read.

    Null, empty and blank texts have 0 words and 0 tokens. Rows are counted one by one: repeated rows come out repeated, a null
    doc_id stays null, other columns are not read. Words of any length take time in proportion. An empty table gives an empty one.
    """

    def run(batches):
        if path not in _counters:
            _counters[path] = PieceCounter(path)
        counter = _counters[path]
        for batch in batches:
            for part in batch_parts(batch, 1, TEXTS_AT_ONCE):
                words, tokens = counter.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
