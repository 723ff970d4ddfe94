"""Collocations: the best scored phrases of two to four words of each language, by best-first growth.

Words are counted as strings. Each word that comes LEAST times or more then goes by a 64-bit hash of language and word, which is
checked to be different for all words (else another seed is taken), so a phrase is a tuple of such hashes and its count exact.

All pairs of frequent words are counted. A pair p of count f whose first word has count u can't be the beginning of a phrase with a
score over 2000000 f / (u + f), as the rest of the phrase comes at least as often as the phrase; a triple's bound is the smaller of
those with its first word and its first two. The frontier of a language holds all phrases whose bound reaches a threshold, set
by the rank of a pair's score. For these the longer phrases to their right and left are counted, whose counts give scores
and tell which shorter phrases they absorb. So every phrase with a score of the threshold or more is found and known to stay or not. A
language is settled once enough phrases stay, ties included, or all is expanded; for the others the threshold sinks.

Tasks get the frontier as bitmaps of a fixed size, which let through a few other phrases at most; these are counted as fully and do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact import small
from .textbytes import SLICE_BYTES, U, hash_words, mix, slices, string_buffers
from .workspace import Workspace

#: Phrases below this count are none.
LEAST = 30
#: Phrases kept for a language.
BEST = 2000
SCALE = 2_000_000
#: The first threshold is the score of the pair at this rank; the rank of the next ones grows by so much.
RANK, GROWTH = 4 * BEST, 8
#: A language's phrases are ranked in so many shares first.
SHARES = 64
#: A bitmap has 2**BITS bits (4 MB).
BITS = 25
#: Counts are merged in a task when so many have come together.
BUFFER = 1 << 20

#: Bytes that end a piece of text, and all that end a word.
PIECE_ENDS, WORD_ENDS = np.zeros(256, bool), np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_ENDS[[9, 32]] = True
WORD_ENDS |= PIECE_ENDS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _chunks(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(first row, bounds in data, goes on) of parts of about SLICE_BYTES. A longer row is cut between words; goes on: the part
    continues the row before it. Only a single word that is longer makes a part longer."""
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 2 * SLICE_BYTES or b > a + 1:
            yield a, offsets[a : b + 1], False
            continue
        at = lo
        while at < hi:
            to = min(hi, at + SLICE_BYTES)
            while to < hi and not WORD_ENDS[data[to]]:
                found = np.flatnonzero(WORD_ENDS[data[to : to + SLICE_BYTES]])
                to = to + int(found[0]) if len(found) else min(hi, to + SLICE_BYTES)
            yield a, np.array([at, to]), at > lo
            at = to


def _places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(start, end, row, number of the piece) of each word of data between bounds, and how many pieces there are."""
    lo, n = int(bounds[0]), int(bounds[-1] - bounds[0])
    if not n:
        return *(np.zeros(0, np.int64),) * 4, len(bounds) - 1
    own, at = data[lo : lo + n], bounds - lo
    inside = ~WORD_ENDS[own]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, s, "right") - 1
    ends = np.flatnonzero(PIECE_ENDS[own])
    return s + lo, e + lo, row, np.searchsorted(ends, s) + row, len(ends) + len(bounds) - 1


def _language_hashes(langs: list[str], seed: int) -> np.ndarray:
    raw = [x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in raw])
    return mix(hash_words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends, seed) + U(0x51ED270B))


def _hashes(langs: pa.Array, words: pa.Array, seed: int) -> np.ndarray:
    """The hash of each language and word."""
    coded = langs.dictionary_encode()
    data, offsets = string_buffers(words)
    of_lang = _language_hashes(coded.dictionary.to_pylist(), seed)[coded.indices.to_numpy()]
    return mix(hash_words(data, offsets[:-1], offsets[1:], seed) + of_lang)


def _vocabulary(seed: int):
    """(lang, word, h, n) of the words of (lang, text) batches, summed within a task as far as BUFFER allows."""

    def total(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

    def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        for at in range(0, t.num_rows, 1 << 16):
            lang, word, n = (c.combine_chunks() for c in t.slice(at, 1 << 16).columns)
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(_hashes(lang, word, seed).view(np.int64)), n], ["lang", "word", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            langs = batch.column(0)
            data, offsets = string_buffers(batch.column(1))
            for a, bounds, _ in _chunks(offsets, data):
                s, e, row, _, _ = _places(data, bounds)
                if not len(s):
                    continue
                lo, hi = int(bounds[0]), int(bounds[-1])
                inside = ~WORD_ENDS[data[lo:hi]]
                ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
                words = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[lo:hi][inside]])).dictionary_encode()
                coded = langs.slice(a, len(bounds) - 1).dictionary_encode()
                of = coded.indices.to_numpy().astype(np.int64)[row]
                keys, n = np.unique(of * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
                held.append(pa.table({"lang": coded.dictionary.take(pa.array(keys // len(words.dictionary))), "word": words.dictionary.take(pa.array(keys % len(words.dictionary))), "n": n}))
                size += len(n)
                if size > BUFFER:
                    held = [total(held)]
                    size = held[0].num_rows
                    if size > BUFFER // 2:
                        yield from told(held[0])
                        held, size = [], 0
        if held:
            yield from told(total(held))

    return run


def _key(columns: list[np.ndarray]) -> np.ndarray:
    g = mix(columns[0] + U(len(columns)))
    for c in columns[1:]:
        g = mix(g + c)
    return g


class Bitmap:
    """A set of phrases as bits, on all executors; it may take other phrases for members, but never misses one."""

    def __init__(self, spark: SparkSession, phrases: DataFrame, columns: list[str]):
        def bits(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array((_key([c.to_numpy().view(U) for c in b.columns]) >> U(64 - BITS)).astype(np.int64))], ["bit"])

        found = phrases.select(*columns).mapInArrow(bits, "bit long").groupBy(F.shiftright("bit", 6).alias("at"))
        # at most 2**BITS / 64 rows
        found = found.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("mask")).toArrow()
        words = np.zeros(1 << (BITS - 6), U)
        words[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(U)
        self._shared = spark.sparkContext.broadcast(words)

    def __reduce__(self):
        return _Bits, (self._shared,)

    def free(self) -> None:
        self._shared.destroy()


class _Bits:
    """The bitmap in a task."""

    def __init__(self, shared):
        self._shared = shared

    def has(self, columns: list[np.ndarray]) -> np.ndarray:
        k = _key(columns) >> U(64 - BITS)
        return (self._shared.value[k >> U(6)] >> (k & U(63))) & U(1) == U(1)


def _merged(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal phrases added up (a clash of two keys may leave some apart)."""
    key = _key(columns)
    order = np.argsort(key)
    columns, n, key = [c[order] for c in columns], n[order], key[order]
    new = np.ones(len(n), bool)
    new[1:] = key[1:] != key[:-1]
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at)


def _phrases(size: int, seed: int, words: Bitmap, wanted: Callable | None):
    """(w1, ..., n) of the phrases of so many words, all frequent; wanted(columns) tells which count."""

    def told(columns, n):
        for at in range(0, len(n), 1 << 16):
            arrays = [pa.array(c[at : at + (1 << 16)].view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n[at : at + (1 << 16)])], [*_names(size), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        tail = np.zeros(0, U), np.zeros(0, bool), np.zeros(0, np.int64)
        base = 0
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            data, offsets = string_buffers(batch.column(1))
            of_lang = _language_hashes(coded.dictionary.to_pylist(), seed)[coded.indices.to_numpy()]
            for a, bounds, goes_on in _chunks(offsets, data):
                s, e, row, piece, pieces = _places(data, bounds)
                lo = int(bounds[0])
                h = mix(hash_words(data[lo : int(bounds[-1])], s - lo, e - lo, seed) + of_lang[a + row])
                # the last words of a row go before its next part, whose first piece goes on with the same number
                base -= int(goes_on)
                piece = piece + base
                base += pieces
                known = words.has([h])
                if goes_on:
                    h, known, piece = (np.concatenate(x) for x in zip(tail, (h, known, piece), strict=True))
                    begin = len(tail[0])
                else:
                    begin = 0
                tail = h[len(h) - size + 1 :] if len(h) >= size else h, known[len(h) - size + 1 :] if len(h) >= size else known, piece[len(h) - size + 1 :] if len(h) >= size else piece
                last = np.arange(max(begin, size - 1), len(h))
                ok = piece[last - size + 1] == piece[last]
                for i in range(size):
                    ok &= known[last - i]
                last = last[ok]
                columns = [h[last - size + 1 + i] for i in range(size)]
                if wanted is not None and len(last):
                    keep = wanted(columns)
                    columns = [c[keep] for c in columns]
                if not len(columns[0]):
                    continue
                held.append((columns, np.ones(len(columns[0]), np.int64)))
                total += len(columns[0])
                if total > BUFFER:
                    held = [_merged([np.concatenate(c) for c in zip(*(x[0] for x in held), strict=True)], np.concatenate([x[1] for x in held]))]
                    total = len(held[0][1])
                    if total > BUFFER // 2:
                        yield from told(*held[0])
                        held, total = [], 0
        if held:
            yield from told(*_merged([np.concatenate(c) for c in zip(*(x[0] for x in held), strict=True)], np.concatenate([x[1] for x in held])))

    return run


def _names(size: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + size)]


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)), exact for any long counts."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * whole(a), whole(l) + whole(r))


class PhraseMiner:
    """The best phrases of docs(lang, text).

    A-Z are lower-cased; pieces are split at `.,;:!?` and the characters 0A to 0D, words at space and tab. A null text is empty, a null lang
    counts as `und`; an empty lang is one of its own. Each row counts, repeated ones as well; texts of any length are read
    whole; other columns are not read. An empty table gives an empty result.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, least: int = LEAST, best: int = BEST, rank: int = RANK):
        self.spark, self.ws, self.least, self.best, self.rank = spark, Workspace(spark, "phrases"), least, best, rank
        self.docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self._bitmaps: list[Bitmap] = []
        self.seed = 0
        while True:
            counted = self.docs.mapInArrow(_vocabulary(self.seed), "lang string, word string, h long, n long")
            self.words = self.ws.save(counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
            if self.words.groupBy("h").count().where("count > 1").isEmpty():
                break
            self.seed += 1  # two words share a hash
        self.totals = self.ws.save(self.words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
        self.frequent = self.ws.save(self.words.where(F.col("n") >= least), "frequent")
        self._words = self._bitmap(self.frequent, ["h"])

    def _bitmap(self, phrases: DataFrame, columns: list[str]) -> Bitmap:
        self._bitmaps.append(Bitmap(self.spark, phrases, columns))
        return self._bitmaps[-1]

    def _counts(self, size: int, name: str, wanted: Callable | None = None) -> DataFrame:
        """(w1, ..., n) of phrases of so many words that come often enough."""
        schema = ", ".join(f"{c} long" for c in [*_names(size), "n"])
        counted = self.docs.mapInArrow(_phrases(size, self.seed, self._words, wanted), schema)
        return self.ws.save(counted.groupBy(*_names(size)).agg(F.sum("n").alias("n")).where(F.col("n") >= self.least), name)

    def _pairs(self) -> DataFrame:
        """(w1, w2, n, lang, u1, u2, score, bound): all frequent pairs."""
        counted = self._counts(2, "pairs")
        word = lambda i, *more: small(self.frequent.select(F.col("h").alias(f"w{i}"), F.col("n").alias(f"u{i}"), *more))
        pairs = counted.join(word(1, "lang"), "w1").join(word(2), "w2")
        n, u1, u2 = F.col("n"), F.col("u1"), F.col("u2")
        return self.ws.save(pairs.withColumns({"score": _score(n, u1, u2), "bound": _score(n, u1, n)}), "pairs")

    def _grown(self, pairs: DataFrame, tau: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, absorbed): all candidates (lang, phrase, k, a, l, r, score) of the languages of tau(lang, tau) with a score of
        tau or more, and the phrases that a longer one absorbs."""
        tau = small(tau)
        front = self.ws.save(pairs.join(tau, "lang").where("bound >= tau").select("w1", "w2"), "frontier")
        f2 = self._bitmap(front, ["w1", "w2"])
        triples = self._counts(3, "triples", lambda c: f2.has(c[:2]) | f2.has(c[1:]))
        head = pairs.select("w1", "w2", F.col("n").alias("n12"), "lang", "u1", "u2")
        rest = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("n23"), F.col("u2").alias("u3"))
        n = F.col("n")
        triples = triples.join(small(head), ["w1", "w2"]).join(small(rest), ["w2", "w3"])
        bound = F.least(_score(n, F.col("u1"), n), _score(n, F.col("n12"), n))
        triples = self.ws.save(triples.join(tau, "lang").withColumn("bound", bound), "triples")
        front3 = self.ws.save(triples.where("bound >= tau").select(*_names(3)), "frontier")
        f3 = self._bitmap(front3, _names(3))
        fours = self._counts(4, "fours", lambda c: f3.has(c[:3]) | f3.has(c[1:]))
        head = triples.select(*_names(3), "lang", "tau", "u1", "n12", "n23", F.col("n").alias("n123"))
        fours = fours.join(small(head), _names(3))
        tail = pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("n").alias("n34"), F.col("u2").alias("u4"))
        fours = fours.join(small(tail), ["w3", "w4"])
        known = triples.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("n").alias("n234"))
        fours = self.ws.save(fours.join(small(known), _names(3, 2), "left"), "fours")
        # a rest of three words that was not counted, where the other cuts leave the phrase in the race
        bound = F.least(_score(n, F.col("u1"), n), _score(n, F.col("n12"), F.col("n34")), _score(n, F.col("n123"), F.col("u4")))
        open_ = fours.where(F.col("n234").isNull() & (bound >= F.col("tau")))
        need = self.ws.save(open_.select(*[F.col(c).alias(d) for c, d in zip(_names(3, 2), _names(3), strict=True)]).distinct(), "rests")
        if not need.isEmpty():
            rests = self._bitmap(need, _names(3))
            more = self._counts(3, "rests", lambda c: rests.has(c)).toDF(*_names(3, 2), "more")
            fours = fours.join(small(more), _names(3, 2), "left").withColumn("n234", F.coalesce("n234", "more"))
        return self._candidates(pairs.join(tau, "lang"), triples, fours.where("n234 IS NOT NULL")), self._absorbed(pairs, triples, fours)

    def _candidates(self, pairs: DataFrame, triples: DataFrame, fours: DataFrame) -> DataFrame:
        def scored(t: DataFrame, size: int, cuts: list[tuple[str, str]]) -> DataFrame:
            ways = F.array(*[F.struct(_score(F.col("n"), F.col(a), F.col(b)).alias("score"), F.lit(k + 1).alias("k"), F.col(a).alias("l"), F.col(b).alias("r")) for k, (a, b) in enumerate(cuts)])
            found = t.withColumn("cut", F.array_min(ways)).where("cut.score >= tau")
            return found.select("lang", F.array(*_names(size)).alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")

        out = scored(pairs, 2, [("u1", "u2")])
        out = out.unionByName(scored(triples, 3, [("u1", "n23"), ("n12", "u3")]))
        return out.unionByName(scored(fours, 4, [("u1", "n234"), ("n12", "n34"), ("n123", "u4")]))

    def _absorbed(self, pairs: DataFrame, triples: DataFrame, fours: DataFrame) -> DataFrame:
        """The phrases with a phrase of one word more around them that comes at least 0.8 times as often. A longer one that does
        so holds one of one word more that does as well."""

        def within(longer: DataFrame, size: int, shorter: DataFrame) -> DataFrame:
            parts = longer.select(F.col("n").alias("m"), F.explode(F.array(F.array(*_names(size)), F.array(*_names(size, 2)))).alias("phrase"))
            most = parts.groupBy("phrase").agg(F.max("m").alias("m"))
            own = shorter.select(F.array(*_names(size)).alias("phrase"), "n")
            whole = lambda c, k: F.col(c).cast("decimal(19,0)") * k
            return own.join(most, "phrase").where(whole("m", 100) >= whole("n", 80)).select("phrase")

        return within(triples, 2, pairs).unionByName(within(fours, 3, triples))

    def _thresholds(self, pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
        """(lang, tau): the score at that rank among the pairs of a language, 0 where it has fewer."""
        each = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))  # at most SCALE / 2 + 1 rows a language
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
        tau = each.withColumn("upto", upto).where(F.col("upto") >= rank).groupBy("lang").agg(F.max("score").alias("tau"))
        return langs.join(tau, "lang", "left").select("lang", F.coalesce("tau", F.lit(0)).alias("tau"))

    def best_phrases(self) -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score): of each language the first phrases by score, then count, both descending, then
        the phrase; of a phrase's cuts the one with the lowest score counts, the first among equals."""
        pairs = self._pairs()
        langs, rank, found = pairs.select("lang").distinct(), self.rank, []
        while True:
            tau = self.ws.save(self._thresholds(pairs, langs, rank), "thresholds")
            candidates, absorbed = self._grown(pairs, tau)
            stay = self.ws.save(candidates.join(absorbed.distinct(), "phrase", "left_anti"), "stay")
            settled = tau.join(stay.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").select("lang", (F.col("tau").isin(0) | (F.coalesce("n", F.lit(0)) >= self.best)).alias("done"))
            settled = self.ws.save(settled, "settled")
            found.append(self._first(self._spelled(stay.join(small(settled.where("done").select("lang")), "lang"))))
            langs = settled.where("NOT done").select("lang")
            if langs.isEmpty():
                break
            rank *= GROWTH
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        out = self.ws.save(out, "best").join(small(self.totals), "lang")
        for b in self._bitmaps:
            b.free()
        return out.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")

    def _first(self, spelled: DataFrame) -> DataFrame:
        """The best phrases of each language with their rank: first of each share of its phrases, so that no task gets all of them."""
        order = [F.desc("score"), F.desc("a"), "text"]
        place = lambda t, name, by: t.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= self.best)
        return place(place(spelled.withColumn("share", F.pmod(F.hash("text"), F.lit(SHARES))), "rank", ["lang", "share"]), "rank", ["lang"]).drop("share")

    def _spelled(self, phrases: DataFrame) -> DataFrame:
        """phrases with the column text, their words joined by spaces."""
        for i in range(4):
            word = self.frequent.select(F.col("h").alias("h_"), F.col("word").alias(f"t{i}"))
            phrases = phrases.join(small(word), F.get("phrase", F.lit(i)) == F.col("h_"), "left").drop("h_")
        return phrases.withColumn("text", F.concat_ws(" ", *[f"t{i}" for i in range(4)])).drop(*[f"t{i}" for i in range(4)])
