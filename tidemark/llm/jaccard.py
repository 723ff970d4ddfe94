"""Exact Jaccard self-join of word-shingle sets by vertical partitioning.

One global order of all shingles is fixed: first the ordinary ones by hash, then the heavy ones (those that recur in
many documents) by frequency. Only documents that share a shingle among their first few in this order can be similar
enough, so these prefixes form the buckets in which candidate pairs are sought. The order is cut into fragments; for
each candidate pair the overlap of each fragment is counted on its own and the counts are summed.

Documents of equal sets form one class and are never paired. In a bucket all members are first compared with one pivot;
then each class with the partners it shares most buckets with; at last all members that are still in different components
are compared with each other. So large groups of near copies cost a few comparisons a member, and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .textbytes import SHINGLE, released, shingle_sets
from .workspace import Workspace

#: A shingle counts as heavy from so many documents on.
HEAVY_DF = 32
#: The heavy table that is broadcast has at most this many rows (8 bytes each): the most frequent ones.
HEAVY_ROWS = 1 << 20
#: A table of document ids is broadcast up to this many rows (8 bytes each); beyond that Spark shuffles.
BROADCAST_ROWS = 1 << 20
#: Buckets of more rows than this get STAR_ROUNDS more rounds with a new pivot, before their members are paired.
LARGE_BUCKET = 64
STAR_ROUNDS = 1
#: Before all remaining pairs, so many closest partners of each class are compared, in so many rounds.
PARTNERS = 8
CLOSEST_ROUNDS = 1
#: Bins of a set's sketch: counts of its shingles by hash, one byte each. Minima of two sketches bound the overlap from above.
SKETCH_BINS = 256
#: The parities of these counts, 64 to a column: bins whose parity differs bound the symmetric difference from below.
PARITIES = [f"q{i}" for i in range(SKETCH_BINS // 64)]
#: Fragments of the ordinary shingles; the heavy ones are one more.
FRAGMENT_BITS = 2
#: A profiling task counts recurring shingles over about this many at a time (32 MB).
PROFILE_SHINGLES = 1 << 22
#: Ordinary shingles with more different sets than this in their bucket are heavy after all.
THIN_BUCKET = 1024


def _class_key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Counts by the upper bits of the hash, empty (no bound) for a set too large for one byte a bin; and their parities."""
    counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=SKETCH_BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"", np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _bounded(percent: int):
    """Of pairs (a, b, na, nb, sa, sb) those whose sketches allow enough overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if x and y:
                    most = int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum(dtype=np.int64))
                    keep[i] = most * (100 + percent) >= percent * (na[i] + nb[i])
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


class _Recurring:
    """Counts of tokens that come up more than once among the last PROFILE_SHINGLES ones, in one buffer that is sorted in place."""

    def __init__(self):
        self.buffer, self.held, self.seen = np.empty(PROFILE_SHINGLES, np.uint64), 0, set()

    def add(self, key: int, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take a set's tokens (equal sets once); gives the counts whenever the buffer is full."""
        if key in self.seen:
            return
        self.seen.add(key)
        while len(tokens):
            part = tokens[: PROFILE_SHINGLES - self.held]
            self.buffer[self.held : self.held + len(part)] = part
            self.held += len(part)
            tokens = tokens[len(part) :]
            if self.held == PROFILE_SHINGLES:
                yield self.counts()

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        own = self.buffer[: self.held]
        own.sort()
        same = np.zeros(len(own) + 1, bool)
        np.equal(own[1:], own[:-1], out=same[1:-1]) if len(own) else None
        starts, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        self.held = 0
        self.seen.clear()
        return own[starts].view(np.int64), ends - starts + 1


def _profile(k: int, digests: bool = False):
    """Of rows (doc_id, text) or, with digests, (doc_id, text, digest): one row each, and the recurring shingles."""
    names = ["kind", "doc_id", "n", "key", "sketch", *PARITIES, *["digest"] * digests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring = _Recurring()

        def heavy(tokens, counts):
            n = len(tokens)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(counts), pa.array(tokens), pa.nulls(n, pa.binary()), *[pa.nulls(n, pa.int64()) for _ in names[5:]]], names=names)

        for batch in batches:
            sizes, keys, sketches = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            parities = np.zeros((len(PARITIES), batch.num_rows), np.int64)
            for row, hashes in shingle_sets(batch.column(1), k):
                sketches[row], parities[:, row] = _sketch(hashes)
                sizes[row], keys[row] = len(hashes), _class_key(hashes)
                for counted in recurring.add(int(keys[row]), hashes):
                    yield heavy(*counted)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), pa.array(sizes), pa.array(keys), pa.array(sketches, pa.binary()), *map(pa.array, parities), *batch.columns[2:]], names=names)
        yield heavy(*recurring.counts())

    return run


def _ranks(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each token its rank among the heavy ones (1 = least frequent), 0 for an ordinary one."""
    if not len(heavy):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    return np.where(heavy[at] == tokens, rank[at], 0)


def _prefixes(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = shared.value
        seen: set[int] = set()
        for batch in batches:
            tokens, keys, metas, heavies = [], [], [], []
            for _, hashes in shingle_sets(batch.column(1), k):
                n = len(hashes)
                if not n or (key := _class_key(hashes)) in seen:
                    continue
                if len(seen) > 1 << 16:
                    seen.clear()
                seen.add(key)
                ranks = _ranks(hashes, heavy, rank)
                length = n - -(-percent * n // 100) + 1
                order = np.lexsort((hashes, ranks))[:length]
                tokens.append(hashes[order].view(np.int64))
                heavies.append(ranks[order] > 0)
                keys.append(np.full(length, key, np.int64))
                metas.append((np.int64(n) << 32) | np.arange(length, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, metas, heavies)], names=["token", "key", "meta", "heavy"])

    return run


def _fragments(k: int, shared):
    bits = FRAGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = shared.value
        for batch in batches:
            keys, frags, values, lengths = [], [], [], [0]
            for _, hashes in shingle_sets(batch.column(1), k):
                if not len(hashes):
                    continue
                key = _class_key(hashes)
                common = _ranks(hashes, heavy, rank) > 0
                piece = np.where(common, np.int64(1 << bits), (hashes >> np.uint64(64 - bits)).astype(np.int64))
                for f in np.unique(piece):
                    own = hashes[piece == f].view(np.int64)
                    keys.append(key)
                    frags.append(int(f))
                    values.append(own)
                    lengths.append(lengths[-1] + len(own))
            if keys:
                flat = pa.array(np.concatenate(values))
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(frags, pa.int32()), lists], names=["key", "fragment", "tokens"])

    return run


def _size(meta: str) -> Column:
    return F.shiftright(F.col(meta), 32)


def _possible(a: str, b: str, percent: int) -> Column:
    """By sizes and positions in the order, the two sets can be similar enough."""
    left = lambda m: _size(m) - F.col(m).bitwiseAND(F.lit(0xFFFFFFFF))
    most = F.least(left(a), left(b))
    return (F.least(_size(a), _size(b)) * 100 >= F.greatest(_size(a), _size(b)) * percent) & (most * (100 + percent) >= (_size(a) + _size(b)) * percent)


def _ordered(a: str, am: str, b: str, bm: str) -> list[Column]:
    swap = F.col(a) > F.col(b)
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return [pick(b, a).alias("a"), pick(a, b).alias("b"), F.shiftright(pick(bm, am), 32).alias("na"), F.shiftright(pick(am, bm), 32).alias("nb")]


class JaccardJoin:
    """Classes of equal shingle sets and all links between them that matter for components.

    percent: two sets link when 100 * intersection >= percent * union. k: words a shingle.
    """

    def __init__(self, spark: SparkSession, k: int = SHINGLE, percent: int = 80):
        self.spark, self.k, self.percent = spark, k, percent
        self.ws = Workspace(spark, "jaccard")

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id) for each row of docs.

        component_id is the smallest non-null id reachable by links, the row itself included; rows whose text is null or
        without words have n_shingles 0 and link with nothing. A null id stays null unless its component holds another.
        Repeated rows come out as often as they went in. An empty table gives an empty one.
        """
        # the words are wanted as they are; only the two columns are read, so others can't clash
        members, named = self._named(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
        # the smallest id of each component, then of each class
        lowest = named.where("NOT alone").groupBy("comp").agg(F.min("rep").alias("lowest"))
        final = named.join(lowest, "comp", "left").select("key", "n", F.when(F.col("alone"), F.col("rep")).otherwise(F.col("lowest")).alias("component"))
        return members.join(final, ["key", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

    def choices(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, n_shingles, stays) for each row of docs(doc_id, text, digest), digest a long that tells texts apart.

        Of each component the rows with one (doc_id, digest) stay: the smallest, null ids last. Components are those of the
        rows' texts, so repeated and null ids tie nothing together. Rows without words stay.
        """
        members, named = self._named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "digest"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
        of_class = named.join(members.where("n > 0").groupBy("key", "n").agg(first), ["key", "n"])
        chosen = of_class.groupBy("comp").agg(F.min("first").alias("first"))
        final = of_class.drop("first").join(chosen, "comp").select("key", "n", "first")
        stays = (F.col("n") == 0) | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest")))
        return members.join(final, ["key", "n"], "left").select("doc_id", "digest", F.col("n").alias("n_shingles"), stays.alias("stays"))

    def links(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """All links: (a, b) pairs of linked classes with a < b, each once; and (doc_id, n_shingles, class, n_links) for each row of docs.

        A class holds the rows of one shingle set; class is null for rows without words. n_links: the other rows that a row
        links with, those of its own class and those of linked classes. Unlike components(), links inside one component are
        all compared, so a group of m different near copies costs up to m * (m - 1) / 2 comparisons and as many pairs.
        """
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        members, docs, heavy, classes, buckets = self._prepared(docs)
        apart = self.spark.createDataFrame([], "node long, comp long")
        pairs = self.ws.save(self._across(self._open(buckets, classes, apart)).select("a", "b", "na", "nb"), "pairs")
        links = self._verified(docs, classes, pairs, heavy)
        sizes = members.where("n > 0").groupBy("key").agg(F.count("*").alias("size"))
        ends = links.union(links.selectExpr("b", "a")).toDF("key", "other")
        reached = ends.join(sizes.toDF("other", "others"), "other").groupBy("key").agg(F.sum("others").alias("others"))
        counts = sizes.join(reached, "key", "left").select("key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        own = members.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"))
        return links, own.join(counts, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def _named(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (doc_id, n, key and, if docs has it, digest) and classes (key, n, rep, comp, alone) of docs(doc_id, text[, digest])."""
        ws = self.ws
        members, docs, heavy, classes, buckets = self._prepared(docs)
        first = ws.save(buckets.where((F.col("key") != F.col("pivot")) & _possible("meta", "pivot_meta", self.percent)).select(*_ordered("key", "meta", "pivot", "pivot_meta")).distinct(), "pairs")
        links = self._verified(docs, classes, first, heavy)
        comps = ws.save(connected_components(ws, links), "comps")
        compared = first
        for turn in range(STAR_ROUNDS + CLOSEST_ROUNDS + 1):
            placed = self._open(buckets, classes, comps)
            if turn < STAR_ROUNDS:
                large = placed.groupBy("token").count().where(F.col("count") > LARGE_BUCKET).select("token")
                pairs = self._star(placed, large, turn)
            elif turn < STAR_ROUNDS + CLOSEST_ROUNDS:
                pairs = self._closest(self._across(placed).join(compared.select("a", "b"), ["a", "b"], "left_anti"))
            else:
                pairs = self._across(placed)
            pairs = ws.save(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"), "pairs")
            ws.drop(placed)
            more = self._verified(docs, classes, pairs, heavy)
            if not more.isEmpty():
                links = links.union(more)
                comps = ws.save(connected_components(ws, links), "comps")
            compared = compared.union(pairs)
        return members, classes.join(comps.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "rep", F.coalesce("comp", "key").alias("comp"), F.col("comp").isNull().alias("alone"))

    def _prepared(self, docs: DataFrame):
        """Members, docs(doc_id, text), heavy shingles, classes and buckets of docs(doc_id, text[, digest])."""
        ws = self.ws
        digests = docs.columns[2:]
        profile = ws.save(docs.mapInArrow(released(_profile(self.k, bool(digests))), "kind int, doc_id long, n long, key long, sketch binary, " + ", ".join(f"{q} long" for q in [*PARITIES, *digests])), "profile")
        docs = docs.select("doc_id", "text")
        members = profile.where("kind = 0").select("doc_id", "n", "key", *digests)
        counted = self._heavy(profile.where("kind = 1"))
        classes = ws.save(profile.where("kind = 0 AND n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), *[F.first(q).alias(q) for q in PARITIES]), "classes")
        entries, heavy = self._entries(docs, counted)
        return members, docs, heavy, classes, self._buckets(entries)

    def _heavy(self, counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, counts) of the most frequent ones."""
        top = counted.groupBy("key").agg(F.sum("n").alias("df")).where(F.col("df") >= HEAVY_DF).orderBy(F.desc("df"), "key").limit(HEAVY_ROWS).toPandas()
        return top["key"].to_numpy(np.int64).view(np.uint64), top["df"].to_numpy(np.int64)

    def _entries(self, docs: DataFrame, counted: tuple[np.ndarray, np.ndarray]):
        """(token, key, meta, heavy) of all prefixes, and the heavy shingles that they go by.

        A shingle that comes once in every buffer is not among the recurring ones, however many documents have it. If it is rare
        enough to stand in no prefix it does no harm; else its entries show it: it is counted among the heavy ones, and the prefixes are made
        anew, until no ordinary shingle has a large bucket (or the heavy table is twice as large as at first).
        """
        tokens, counts = counted
        while True:
            order = np.lexsort((tokens, -counts))
            rank = np.empty(len(tokens), np.int64)
            rank[order] = np.arange(len(tokens), 0, -1)  # 1: the least frequent
            at = np.argsort(tokens)
            heavy = self.spark.sparkContext.broadcast((tokens[at], rank[at]))
            entries = self.ws.save(docs.mapInArrow(released(_prefixes(self.k, self.percent, heavy)), "token long, key long, meta long, heavy boolean"), "entries")
            light = entries.where("NOT heavy")
            full = self.ws.save(light.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > THIN_BUCKET).select("token"), "full")
            room = 2 * HEAVY_ROWS - len(tokens)
            if full.isEmpty() or room <= 0:
                return entries, heavy
            # copies of one set in several tasks are one member
            members = light.join(full, "token").select("token", "key").distinct()
            thin = members.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > THIN_BUCKET).orderBy(F.desc("n"), "token").limit(room).toPandas()
            if thin.empty:
                return entries, heavy
            tokens = np.concatenate([tokens, thin["token"].to_numpy(np.int64).view(np.uint64)])
            counts = np.concatenate([counts, thin["n"].to_numpy(np.int64)])
            self.ws.drop(entries)
            heavy.destroy()

    def _buckets(self, entries: DataFrame) -> DataFrame:
        """(token, key, meta, pivot, pivot_meta) of all prefix entries whose shingle more than one class has there."""
        # an ordinary shingle has few entries, so its bucket fits a window; of a heavy one only the pivot is aggregated
        by = Window.partitionBy("token")
        light = entries.where("NOT heavy").select("token", F.struct("key", "meta").alias("e")).withColumns({"p": F.min("e").over(by), "q": F.max("e").over(by)}).where("p.key <> q.key")
        many = entries.where("heavy").select("token", "key", "meta")
        pivots = many.groupBy("token").agg(F.min(F.struct("key", "meta")).alias("p"), F.max("key").alias("q")).where("p.key <> q")
        hot = many.join(pivots, "token").select("token", "key", "meta", F.col("p.key").alias("pivot"), F.col("p.meta").alias("pivot_meta"))
        return self.ws.save(light.select("token", "e.key", "e.meta", F.col("p.key").alias("pivot"), F.col("p.meta").alias("pivot_meta")).union(hot), "buckets")

    def _open(self, buckets: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
        """(token, key, meta, comp and the parities) of the buckets whose members are in more than one component."""
        at = classes.join(comps.withColumnRenamed("node", "key"), "key", "left").select("key", "n", F.coalesce("comp", "key").alias("comp"), *PARITIES)
        own = buckets.select("token", "key", "meta").distinct().withColumn("n", _size("meta")).join(at, ["key", "n"])
        own = self.ws.save(own.select("token", "key", "meta", "comp", *PARITIES), "placed")
        split = own.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
        left = self.ws.save(own.join(split, "token"), "open")
        self.ws.drop(own)
        return left

    def _star(self, placed: DataFrame, large: DataFrame, turn: int) -> DataFrame:
        """Pairs of each large bucket: a member of its most frequent component with every row outside that component."""
        rows = self.ws.save(placed.drop(*PARITIES).join(large, "token"), "large")
        draw = F.xxhash64("key", "token", F.lit(turn))
        each = rows.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min(F.struct(draw.alias("draw"), "key", "meta")).alias("p"))
        top = each.groupBy("token").agg(F.max(F.struct("c", "comp", "p")).alias("t")).select("token", F.col("t.comp").alias("top"), F.col("t.p.key").alias("pivot"), F.col("t.p.meta").alias("pivot_meta"))
        pairs = rows.join(top, "token").where((F.col("comp") != F.col("top")) & _possible("meta", "pivot_meta", self.percent))
        return pairs.select(*_ordered("key", "meta", "pivot", "pivot_meta")).distinct()

    def _closest(self, pairs: DataFrame) -> DataFrame:
        """Of all pairs those with the most shared prefix entries on either side: they link most often, and once they have, most
        others are inside one component. The rest comes in the last round."""
        best = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("shared"), "a", "b"))
        return pairs.withColumns({"ra": best("a"), "rb": best("b")}).where((F.col("ra") <= PARTNERS) | (F.col("rb") <= PARTNERS))

    def _across(self, left: DataFrame) -> DataFrame:
        """Pairs of one bucket that are in different components, whose parities allow enough overlap, with the number of buckets that they share."""
        other = left.select("token", *[F.col(c).alias(f"{c}2") for c in ("key", "meta", "comp", *PARITIES)])
        both, p = _size("meta") + _size("meta2"), self.percent
        differ = sum((F.bit_count(F.col(q).bitwiseXOR(F.col(f"{q}2"))) for q in PARITIES), F.lit(0))
        near = (both - differ) * (100 + p) >= both * 2 * p  # the overlap is at most (both - differ) / 2
        pairs = left.join(other, "token").where((F.col("key") < F.col("key2")) & (F.col("comp") != F.col("comp2")) & _possible("meta", "meta2", p) & near)
        return pairs.select(F.col("key").alias("a"), F.col("key2").alias("b"), _size("meta").alias("na"), _size("meta2").alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))

    def _verified(self, docs: DataFrame, classes: DataFrame, pairs: DataFrame, heavy) -> DataFrame:
        """Of the pairs (a, b, na, nb) those that link: overlaps by fragment, summed."""
        ws = self.ws
        sketch = lambda side: classes.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        sketched = pairs.join(sketch("a"), ["a", "na"]).join(sketch("b"), ["b", "nb"]).select("a", "b", "na", "nb", "sa", "sb")
        pairs = ws.save(sketched.mapInArrow(_bounded(self.percent), "a long, b long, na long, nb long"), "bounded")
        wanted = pairs.selectExpr("inline(array(struct(a AS key, na AS n), struct(b AS key, nb AS n)))").distinct()
        ids = ws.save(wanted.join(classes, ["key", "n"]).select(F.coalesce("rep", F.lit(-(1 << 63))).alias("id")), "wanted")
        n = ids.count()
        if not n:
            return ws.save(pairs.select("a", "b").limit(0), "links")
        rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id", "left_semi").select("id", "text")
        sets = ws.save(rows.mapInArrow(released(_fragments(self.k, heavy)), "key long, fragment int, tokens array<long>"), "sets")
        one = pairs.join(sets.select(F.col("key").alias("a"), "fragment", F.col("tokens").alias("ta")), "a")
        both = one.join(sets.select(F.col("key").alias("b"), "fragment", F.col("tokens").alias("tb")), ["b", "fragment"])
        partial = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ta", "tb")).cast("long").alias("part"))
        # each fragment's count once, even if rows (and so sets) are repeated
        counts = [F.max(F.when(F.col("fragment") == f, F.col("part"))).alias(f"f{f}") for f in range((1 << FRAGMENT_BITS) + 1)]
        summed = partial.groupBy("a", "b", "na", "nb").agg(*counts)
        summed = summed.withColumn("overlap", sum((F.coalesce(f"f{f}", F.lit(0)) for f in range((1 << FRAGMENT_BITS) + 1)), F.lit(0)))
        p = self.percent
        links = ws.save(summed.where(F.expr(f"overlap * 100 >= {p} * (na + nb - overlap)")).select("a", "b"), "links")
        ws.drop(sets)
        return links
