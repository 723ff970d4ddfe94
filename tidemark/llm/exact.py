"""Exact duplicates through a log-structured merge index of text digests.

Rows go to bounded memtables of MEMTABLE_ROWS. Each is flushed as one run, sorted by digest, into Parquet files whose Bloom
filters and statistics are on the digest. Compaction merges the runs into one sorted level and keeps, for every digest, the
identifier that stays (the smallest, or the largest if asked for) and the number of rows. lookup() finds the entries of given
digests: few are pushed down to the files, where filters and statistics rule out row groups; many are joined. Rows that hit
another row's entry are compared with that row's bytes.

When a whole table is deduplicated every row's digest is in the index, so filters can rule out nothing there; they serve rows
that are held against an index made before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Byte verification sends at most about this many rows of one digest to a task.
ROWS_PER_SALT = 256
#: Rows of a memtable, and so of a run.
MEMTABLE_ROWS = 1 << 16
#: So many flushed batches are merged into the compacted level at once.
FANOUT = 4
#: A lookup of up to this many distinct digests is pushed down to the files of the index.
PROBES = 1024
#: A table of repeated digests or dropped ids is broadcast up to this many rows; beyond that Spark shuffles both sides.
BROADCAST_ROWS = 1 << 18


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), inner or left, where right has unique keys and, in count, about how many left rows each has.

    Of a key with more than ROWS_PER_SALT rows, right is repeated and left spread by a hash, so no task gets all its rows. The
    table of such keys has a ROWS_PER_SALT-th of the rows of left at most; its size is checked before it is broadcast.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salts = F.ceil(F.col(count) / ROWS_PER_SALT).cast("int")
    hot = right.where(F.col(count) > ROWS_PER_SALT).select(*keys, salts.alias("__salts"))
    dealt = left.join(small(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


class DigestIndex:
    """add() flushes a batch of rows as runs, compact() merges all runs, lookup() finds entries.

    keep: "min" or "max", which identifier of equal digests stays. digest: from a text column to its digest; a weak one
    is legal, since hits are verified by their bytes.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", digest=sha256):
        if keep not in ("min", "max"):
            raise ValueError(keep)
        self.ws, self.keep, self.digest = Workspace(spark, "digests"), keep, digest
        self._flushed: list[DataFrame] = []
        self._level: DataFrame | None = None

    def _pick(self, c: str) -> Column:
        return (F.min if self.keep == "min" else F.max)(c)

    def add(self, rows: DataFrame) -> None:
        """Flush the (id, text) rows (a null text is empty) as runs (run, digest, keep_id, n) of MEMTABLE_ROWS rows, each sorted by digest."""
        run = F.floor(F.monotonically_increasing_id() / MEMTABLE_ROWS)
        runs = rows.select(self.digest(F.coalesce("text", F.lit(""))).alias("digest"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")).withColumn("run", run)
        self._flushed.append(self._save(runs.sortWithinPartitions("run", "digest"), "runs", maxRecordsPerFile=MEMTABLE_ROWS))
        if len(self._flushed) >= FANOUT:
            self.compact()

    def _save(self, entries: DataFrame, name: str, **options) -> DataFrame:
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(MEMTABLE_ROWS)}
        return self.ws.save(entries, name, **bloom, **options)

    def _merged(self, tables: list[DataFrame]) -> DataFrame:
        union = tables[0].select("digest", "keep_id", "n")
        for t in tables[1:]:
            union = union.unionByName(t.select("digest", "keep_id", "n"))
        return union.groupBy("digest").agg(self._pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def compact(self) -> DataFrame | None:
        """(digest, keep_id, n) of all rows added so far, one sorted level; None if there were none."""
        old = [*self._flushed, *([self._level] if self._level is not None else [])]
        if self._flushed:
            self._level, self._flushed = self._save(self._merged(old).sortWithinPartitions("digest"), "level"), []
            for x in old:
                self.ws.drop(x)
        return self._level

    def lookup(self, probes: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of the digests of probes(digest) that the index has, over all runs and the level."""
        tables = [*self._flushed, *([self._level] if self._level is not None else [])]
        if not tables:
            return probes.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n")).limit(0)
        wanted = probes.select("digest").distinct()
        few = [r["digest"] for r in wanted.limit(PROBES + 1).collect()]
        if len(few) <= PROBES:
            return self._merged([t.where(F.col("digest").isin(few)) for t in tables])
        return self._merged([t.join(wanted, "digest", "left_semi") for t in tables])


def exact_groups(spark: SparkSession, docs: DataFrame, keep: str = "min", digest=sha256) -> DataFrame:
    """(id, digest, keep_id, group_size) for each row of docs(id, text); texts are equal when their bytes are.

    Of equal texts one row stays: that with the smallest (keep="min") or largest (keep="max") id; of repeated rows with
    that same id, one. Null and empty texts are equal. A null id stays only where all ids of its group are null. Other
    columns are not read. An empty table gives an empty result.
    """
    index = DigestIndex(spark, keep, digest)
    ws = index.ws
    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    index.add(rows)
    level = index.compact()
    own = rows.withColumn("digest", digest(F.col("text")))
    repeated = ws.save(level.where("n > 1").withColumn("salts", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int")), "repeated")
    # only rows of repeated digests send their texts on
    twins = salted_join(own, repeated, ["digest"], "n", F.col("id"))
    # a row's text goes to the row that stays, salted where many go to one
    hits = twins.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    stays = twins.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "keep_id", "salts").agg(F.min("text").alias("kept_text"))
    copies = stays.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    verified = ws.save(hits.join(copies, ["digest", "salt"]).select("id", "digest", "keep_id", "n", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other")), "verified")
    single = level.where("n = 1").select(F.col("keep_id").alias("id"), "digest", "keep_id", F.col("n").alias("group_size"))
    found = lambda v: single.unionByName(v.select("id", "digest", "keep_id", F.col("n").alias("group_size")))
    wrong = verified.where("NOT same").select("digest").distinct()
    if wrong.isEmpty():
        return found(verified)
    # digests that two texts share: these few groups are told apart by their texts
    wrong = small(ws.save(wrong, "wrong"))
    clash = own.join(wrong, "digest").select("id", "digest", "text")
    by_text = ws.save(clash.groupBy("digest", "text").agg(index._pick("id").alias("keep_id"), F.count("*").alias("group_size")), "apart")
    apart = clash.join(small(by_text), ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
    return found(verified.join(wrong, "digest", "left_anti")).unionByName(apart)


def known(index: DigestIndex, indexed: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, known_id) for each row of rows(id, text): an indexed row with the same text, null if there is none.

    indexed(id, text) has the rows that were added to the index. Rows hit by lookup() are held against the bytes of the entry's
    row; should that row have another text of the same digest, all indexed rows of the digest are searched. Null and empty
    texts are equal; a null indexed id is never given.
    """
    whole = lambda d: d.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", index.digest(F.col("text")))
    new, old = whole(rows), whole(indexed).where("id IS NOT NULL")
    entries = small(index.ws.save(index.lookup(new).select("digest"), "entries"))
    texts = old.join(entries, "digest", "left_semi").groupBy("digest", "text").agg(index._pick("id").alias("known_id"))
    return new.join(small(index.ws.save(texts, "texts")), ["digest", "text"], "left").select("id", "known_id")


def exact_dedup(spark: SparkSession, docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of equal texts, the one exact_groups keeps; all columns stay, whatever
    they are called.

    Of repeated rows with the doc_id and text that stay, one stays (any one, if other columns differ). Null and empty texts are
    equal; an empty table gives an empty one.
    """
    groups = exact_groups(spark, docs.select(F.col("doc_id").alias("id"), "text"), keep)
    ws = Workspace(spark, "exact")
    mark = unused(docs, "digest")
    short = F.xxhash64("digest").alias("short")
    many = ws.save(groups.where("group_size > 1").select("id", short, F.col("id").eqNullSafe(F.col("keep_id")).alias("stays")), "groups")
    gone = many.where("NOT stays").select("id", "short").distinct()
    twice = many.where("stays").groupBy("id", "short").count().where("count > 1").select("id", "short")
    marked = docs.withColumn(mark, F.xxhash64(sha256(F.coalesce("text", F.lit("")))))
    return keep_rows(marked, "doc_id", mark, small(gone), twice).drop(mark)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_rows(rows: DataFrame, id_col: str, mark: str, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """rows without those whose id and mark are in gone(id, short), and one row of each in twice(id, short)."""
    # names of their own, so that no column of rows can be meant
    gone, twice = (t.toDF(*names) for t, names in ((gone, (unused(rows, "id_"), unused(rows, "short_"))), (twice, (unused(rows, "id_"), unused(rows, "short_")))))
    hit = lambda t: rows[id_col].eqNullSafe(F.col(t.columns[0])) & (rows[mark] == F.col(t.columns[1]))
    left = rows.join(gone, hit(gone), "left_anti")
    if not twice.isEmpty():
        one = left.join(twice, hit(twice), "left_semi").dropDuplicates([id_col, mark])
        left = left.join(twice, hit(twice), "left_anti").unionByName(one)
    return left
