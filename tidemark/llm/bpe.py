"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Merges apply in order of rank. When a text is cut off, what is unknown to the right can change the tokens of only the last
few symbols: the merge list's sufficient lookahead, computed once from the ranks. So every piece is encoded through a
buffer of a fixed size, and tokens further from its end than the lookahead are emitted at once. Decoding takes ids a block at
a time: bytes that end inside a character wait for the rest of it. A text is read in parts, so that memory beside the text
itself does not grow with it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa

from .inttable import IntTable
from .textbytes import batch_parts

#: Fixed value: the characters of the Unicode property White_Space, for a pattern's class.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A worker remembers the ids of at most this many words.
MEMO_WORDS = 400_000
#: Words of more characters are not remembered.
LONG_WORD = 64
#: Symbols that a window of the transducer holds beside the lookahead.
BUFFER = 1024
#: Windows of at most this many symbols are merged together, longer ones one by one.
TOGETHER = 64
#: Texts are read in parts of about this many characters, and new words learned for about so many at a time.
PART_CHARS, GROUP_CHARS = 1 << 16, 1 << 20


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeList:
    """Ranked merges over a vocabulary, with an optional mark at the end of each word; symbols and tokens are given by their ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.lookahead = self.sufficient_lookahead(merges)
        self.ranks = {(vocab[a] << 32) | vocab[b]: (r << 32) | vocab[a + b] for r, (a, b) in reversed(list(enumerate(merges)))}
        self.table = IntTable(np.fromiter(self.ranks.keys(), np.int64), np.fromiter(self.ranks.values(), np.int64))
        self.lengths = np.ones(max(vocab.values(), default=0) + 1, np.int64)
        for t, i in vocab.items():
            self.lengths[i] = len(t.removesuffix(end)) if end else len(t)
        # a window holds a whole token beside the lookahead, so each gives one at least
        self.window = max(BUFFER, int(self.lengths.max())) + self.lookahead

    @staticmethod
    def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
        """Symbols before the end of a prefix whose tokens a continuation may still change.

        A change moves left only when a merge takes the token before the changed place: by the length of its left part,
        and only if its right part begins with the left part of the merge that moved the change before. Ranks rise along
        such a chain, so one pass in rank order finds the longest. An end mark counts as one symbol more at most.
        """
        furthest: dict[str, int] = {}
        most = 0
        for left, right in merges:
            before = max((furthest.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
            here = before + len(left)
            furthest[left] = max(furthest.get(left, 0), here)
            most = max(most, here)
        return most + 1

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of one sequence of symbols: the pair of lowest rank first, of equal ones the leftmost."""
        n, ranks = len(ids), self.ranks
        ids, after, before = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [(ranks[k], i) for i, k in enumerate((a << 32) | b for a, b in zip(ids, ids[1:], strict=False)) if k in ranks]
        # by rank and place only; equal ranks have equal ids
        heapify(queue)
        while queue:
            found, i = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get((ids[i] << 32) | ids[j]) != found:
                continue
            ids[i], ids[j] = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (more := ranks.get((ids[i] << 32) | ids[k])) is not None:
                    heappush(queue, (more, i))
            if (h := before[i]) >= 0 and (more := ranks.get((ids[h] << 32) | ids[i])) is not None:
                heappush(queue, (more, h))
        return [i for i in ids if i >= 0]

    def merge_many(self, ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short sequences at once: ids of their symbols and the number of each one's sequence (ascending) -> the
        same of their tokens."""
        done_ids, done_words, never = [], [], np.int64(1 << 60)
        while len(ids) > 1:
            found = self.table.get((ids[:-1] << 32) | ids[1:])
            rank = np.where((found >= 0) & (words[:-1] == words[1:]), found >> 32, never)
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            sizes = np.diff(np.append(first, len(words)))
            best = np.minimum.reduceat(np.append(rank, never), first)
            take = (rank < never) & (rank == np.repeat(best, sizes)[:-1])
            # of overlapping places of one pair every second counts, from the left
            if (take[1:] & take[:-1]).any():
                place = np.arange(len(take))
                start = np.maximum.accumulate(np.where(take & ~np.concatenate(([False], take[:-1])), place, 0))
                take &= ((place - start) & 1) == 0
            where = np.flatnonzero(take)
            ids = ids.copy()
            ids[where] = found[where] & 0xFFFFFFFF
            stay = np.ones(len(ids), bool)
            stay[where + 1] = False
            going_on = np.repeat(best < never, sizes)
            done_ids.append(ids[stay & ~going_on])
            done_words.append(words[stay & ~going_on])
            stay &= going_on
            ids, words = ids[stay], words[stay]
        ids, words = np.concatenate([*done_ids, ids]), np.concatenate([*done_words, words])
        order = np.argsort(words, kind="stable")
        return ids[order], words[order]

    def stream(self, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens of the words symbols[bounds[i]:bounds[i+1]] as (ids, word numbers), emitted once stable.

        All words advance together, each through a window of about BUFFER + lookahead symbols. Of a window that doesn't reach
        its word's end, the tokens that end before the lookahead are final; the next window begins behind them. Of one word,
        tokens come in order.
        """
        at, stop = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
        live = np.flatnonzero(at < stop)
        while len(live):
            end = np.minimum(at[live] + self.window, stop[live])
            size = end - at[live]
            short = size <= TOGETHER
            place = np.repeat(at[live][short] - np.cumsum(size[short]) + size[short], size[short]) + np.arange(int(size[short].sum()))
            parts = [self.merge_many(symbols[place], np.repeat(live[short], size[short]))] if len(place) else []
            for w, a, b in zip(live[~short], at[live[~short]], end[~short], strict=True):
                own = np.array(self.merge(symbols[a:b].tolist()), np.int64)
                if b < stop[w]:
                    own = own[np.cumsum(self.lengths[own]) <= b - a - self.lookahead]
                    at[w] += self.lengths[own].sum()
                parts.append((own, np.full(len(own), w)))
            yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            live = live[end < stop[live]]


class WordBpe:
    """A tokenizer of a tokenizers file: NFC, one space for white space, lower case, split into words, byte-level BPE.

    A null text counts as empty. Strings of special tokens in the text become those tokens. The ids of short words are
    remembered.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        end = model["end_of_word_suffix"] or ""
        self.list = MergeList(model["vocab"], merges, end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        import regex

        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word = regex.compile(pattern)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        alphabet = byte_alphabet()
        self._inner = np.array([model["vocab"][alphabet[b]] for b in range(256)], np.int64)
        self._last = np.array([model["vocab"][alphabet[b] + end] for b in range(256)], np.int64)
        self.decoder = IdDecoder.of(spec)

    def _symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the pieces (which have no line ends) and the pieces' bounds in them."""
        flat = np.frombuffer("\n".join([*pieces, ""]).encode("utf-8", "surrogatepass"), np.uint8)
        stops = np.flatnonzero(flat == 10)
        ids = self._inner[flat]
        ids[stops - 1] = self._last[flat[stops - 1]]
        return ids[flat != 10], np.concatenate(([0], stops - np.arange(len(stops))))

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words of at most LONG_WORD characters; all their pieces go through the transducer together."""
        split = [[w] if w.isalpha() else self._word.findall(w) for w in words]
        pieces = list({p for ps in split for p in ps})
        if pieces:
            parts = list(self.list.stream(*self._symbols(pieces)))
            ids, number = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(number, kind="stable")
            data, stops = ids[order].astype("<u4").tobytes(), (np.cumsum(np.bincount(number, minlength=len(pieces))) * 4).tolist()
            of = {p: data[a:b] for p, a, b in zip(pieces, [0, *stops], stops, strict=False)}
            self._memo.update((w, of[ps[0]] if len(ps) == 1 else b"".join(map(of.__getitem__, ps))) for w, ps in zip(words, split, strict=True))
        self._memo.update((w, b"") for w, ps in zip(words, split, strict=True) if not ps)

    def _long(self, word: str) -> Iterator[bytes]:
        """ids of a long word, given out as they become stable."""
        for m in self._word.finditer(word):
            for ids, _ in self.list.stream(*self._symbols([m[0]])):
                yield ids.astype("<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            # lower-casing goes by single characters: no final sigma
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        # split() also cuts at four control characters that are no white space to the tokenizer
        return text.split() if not _CONTROLS.search(text) else [w for w in _SPACE.split(text) if w]

    def _parts(self, text: str) -> Iterator[str]:
        """Special tokens, and what stands between them in parts of about PART_CHARS, cut before white space."""
        for part in self._cut.split(text) if self._cut and "<|" in text else [text]:
            at = 0
            while len(part) - at > 2 * PART_CHARS and (cut := _SPACE.search(part, at + PART_CHARS)):
                yield part[at : cut.start()]
                at = cut.start()
            yield part[at:]

    def blocks(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """(text number, little-endian unsigned 32-bit ids) of each text, a block at a time; none for null and empty texts.

        Parts are read until they have GROUP_CHARS, then their new words are learned together.
        """
        group, size = [], 0
        for i, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                group.append((i, part if part in self.special else self._split(part)))
                size += len(part)
                if size >= GROUP_CHARS:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list) -> Iterator[tuple[int, bytes]]:
        memo = self._memo
        new = set().union(*[words for _, words in group if isinstance(words, list)]).difference(memo)
        for w in [w for w in new if w in self._older]:
            memo[w] = self._older[w]
            new.remove(w)
        self._learn([w for w in new if len(w) <= LONG_WORD])
        long = any(len(w) > LONG_WORD for w in new)
        for i, words in group:
            if isinstance(words, str):
                yield i, np.array([self.special[words]], "<u4").tobytes()
            elif not long:
                yield i, b"".join(map(memo.__getitem__, words))
            else:
                for w in words:
                    yield from [(i, memo[w])] if w in memo else ((i, x) for x in self._long(w))
        if len(memo) > MEMO_WORDS // 2:
            self._older, self._memo = memo, {}

    def encode(self, text: str | None) -> bytes:
        return b"".join(b for _, b in self.blocks([text]))


class IdDecoder:
    """ids to text, a block at a time. The state: whether a token came before, and the bytes of a character that is not whole yet.

    pieces: the bytes of each token by id. separator: bytes between tokens.
    """

    def __init__(self, pieces: list[bytes], separator: bytes):
        self.pieces, self.separator = pieces, separator
        self.reset()

    @classmethod
    def of(cls, spec: dict) -> IdDecoder:
        """The decoder that a tokenizers file names: byte-level tokens are joined as bytes; without one, tokens as they are, with spaces."""
        named = (spec["decoder"] or {}).get("type")
        if named not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {named}")
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"] | special
        pieces = [b""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            pieces[i] = bytes(back[c] for c in t) if named and t not in special else t.encode()
        return cls(pieces, b"" if named else b" ")

    def reset(self) -> None:
        self._started, self._state = False, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: bytes) -> str:
        if not ids:
            return ""
        data = self.separator.join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        before, self._started = self.separator if self._started else b"", True
        return self._state.decode(before + data)

    def close(self) -> str:
        """What is left at the end; the decoder is then ready for the next text."""
        left = self._state.decode(b"", True)
        self.reset()
        return left


_CONTROLS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(f"[{WHITE_SPACE}]+")


_tokenizers: dict[str, WordBpe] = {}
_NOTHING = hashlib.sha256().hexdigest()
#: Texts of one output batch.
TEXTS_AT_ONCE = 256


def round_trip(docs, path: str):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs(doc_id, text); path: a tokenizers file that every
    worker can read. Null and empty texts have no tokens and decode to the empty text; rows come out one by one, repeated or
    with a null doc_id; other columns are not read. An empty table gives an empty one."""

    def run(batches):
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, WordBpe(path))
        decoder = tokenizer.decoder
        for batch in batches:
            for part in batch_parts(batch, 1, TEXTS_AT_ONCE):
                n, ids, decoded = np.zeros(part.num_rows, np.int64), [_NOTHING] * part.num_rows, [_NOTHING] * part.num_rows
                # blocks come in the order of the texts
                for i, blocks in groupby(tokenizer.blocks(t.as_py() for t in part.column(1)), itemgetter(0)):
                    of_ids, of_text = hashlib.sha256(), hashlib.sha256()
                    for _, block in blocks:
                        n[i] += len(block) // 4
                        of_ids.update(block)
                        of_text.update(decoder.push(block).encode())
                    of_text.update(decoder.close().encode())
                    ids[i], decoded[i] = of_ids.hexdigest(), of_text.hexdigest()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
