"""SimHash fingerprints by DataFrame functions only, and a Hamming search through permuted block tables.

Every term is hashed to 64 bits; each occurrence votes +1 or -1 on each bit, and the sign of the sum is the bit of the
fingerprint. Terms are the five-word shingles (all words of a shorter text are its one term). Votes of two bits at a
time are counted in the halves of one long, so a document needs 32 sums, combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, with_row_keys

BITS = 64
LANES = 32
LANE_MASK = (1 << 32) + 1
#: The Hamming radius of the search and the number of blocks; each of C(BLOCKS, RADIUS) tables leaves RADIUS blocks out.
#: Radius 3 finds nearly exact copies: 2 % of pairs at a Jaccard similarity of 0.8, 33 % at 0.95 (README has more).
RADIUS, BLOCKS = 3, 6


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def fingerprints(rows: DataFrame) -> DataFrame:
    """(key, fingerprint long) of rows(key, text), one row for each key (keys are unique and not null).

    The fingerprint depends on the text alone. A null text counts as empty; all texts without words have one fixed
    fingerprint. A tie of votes gives bit 0.
    """
    tokens = rows.select("key", words(F.coalesce("text", F.lit(""))).alias("w"))
    terms = F.greatest(F.size("w") - 4, F.lit(1))  # a text of under five words has one term; missing words are null there
    names = [f"w{i}" for i in range(5)]
    shifted = tokens.select("key", *[F.slice("w", i + 1, terms).alias(c) for i, c in enumerate(names)])
    hashed = shifted.select("key", F.inline_outer(F.arrays_zip(*names))).select("key", F.xxhash64(*names).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANE_MASK))).alias(f"s{i}") for i in range(LANES)]
    votes = hashed.groupBy("key").agg(F.count("*").alias("n"), *lanes)

    def bit(i: int) -> Column:
        ones = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) if i < LANES else F.shiftrightunsigned(f"s{i - LANES}", 32)
        return F.when(ones * 2 > F.col("n"), F.lit(1 << i if i < BITS - 1 else -(1 << 63))).otherwise(F.lit(0).cast("long"))

    return votes.select("key", reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(BITS))).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints."""
    return (F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))).cast("double")


def _block_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the kept bits of each table: two fingerprints within the radius agree on one of them at least."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(masks[i] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]


def near_fingerprints(queries: DataFrame, all_of: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, other, distance) of all distinct fingerprints of queries and all_of within the radius, each pair once.

    Both tables have a long column fingerprint; repeated values and nulls are dropped first. A pair is found in every
    table on whose kept blocks it agrees, and emitted by the first of them only.
    """
    masks = _block_tables(radius, blocks)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("block")) for t, m in enumerate(masks)])
    spread = lambda d: d.where("fingerprint IS NOT NULL").select("fingerprint").distinct().select("fingerprint", F.inline(tables))
    q, a = spread(queries), spread(all_of).withColumnRenamed("fingerprint", "other")
    differ = F.col("fingerprint").bitwiseXOR(F.col("other"))
    first = reduce(lambda rest, tm: F.when(differ.bitwiseAND(F.lit(tm[1])) == 0, tm[0]).otherwise(rest), reversed(list(enumerate(masks))), F.lit(-1))
    return q.join(a, ["t", "block"]).where((F.bit_count(differ) <= radius) & (first == F.col("t"))).select("fingerprint", "other", F.bit_count(differ).alias("distance"))


def following(ws: Workspace, rows: DataFrame, partitions: int) -> DataFrame:
    """(key, n, next_key) of rows(key, n): the key after each in descending order; the last is followed by the first.

    Keys are unique and not null. Rows are dealt by ranges of keys; only one boundary row for each range meets in one task.
    """
    ranged = ws.save(rows.repartitionByRange(partitions, F.desc("key")).withColumn("part", F.spark_partition_id()), "ranged")
    inner = ranged.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    ends = ranged.groupBy("part").agg(F.max("key").alias("first"))
    whole = Window.partitionBy(F.lit(0))
    bounds = ends.select("part", F.lead("first").over(whole.orderBy("part")).alias("following"), F.max("first").over(whole).alias("top"))
    return inner.join(F.broadcast(bounds), "part").select("key", "n", F.coalesce("next_key", "following", "top").alias("next_key"))


def edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(key, text) of each document with the last floor(n / 3) characters replaced by the first as many of the next one."""
    order = order.hint("merge")  # it grows with the documents, so it is never broadcast
    own = docs.join(order, "key").select("key", F.expr("substring(text, 1, cast(n - n div 3 as int))").alias("head"))
    after = docs.withColumnRenamed("key", "next_key").join(order, "next_key").select("key", F.expr("substring(text, 1, cast(n div 3 as int))").alias("tail"))
    return own.join(after, "key").select("key", F.concat("head", "tail").alias("text"))


def compare_edited(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and n_near: for every doc_id divisible by 50 the number of documents within the radius (itself included).

    The next document is the one of the next smaller doc_id; a null doc_id comes after all others, rows of one doc_id follow each
    other in a fixed order. Each row comes out once, repeated rows too. A null text counts as empty. Other columns are not
    read. An empty table gives an empty one; a single document is its own next one.
    """
    ws = Workspace(spark, "simhash")
    docs = with_row_keys(ws, docs).select("key", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ws.save(following(ws, docs.select("key", F.length("text").cast("long").alias("n")), parts), "order")
    prints = ws.save(fingerprints(docs), "prints")
    changed = edited(docs, order)
    digests = changed.select("key", F.sha2(F.encode("text", "UTF-8"), 256).alias("edited_sha256"))
    others = fingerprints(changed).withColumnRenamed("fingerprint", "f2")
    after = order.select("key", F.col("next_key")).join(prints.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("f3")), "next_key").select("key", "f3")
    counts = ws.save(prints.groupBy("fingerprint").agg(F.count("*").alias("n_docs")), "counts")
    doc_id = F.col("key") if dict(docs.dtypes)["key"] == "bigint" else F.col("key.id")
    asked = prints.where(doc_id % 50 == 0)
    near = near_fingerprints(asked, counts, radius).join(counts.withColumnRenamed("fingerprint", "other"), "other").groupBy("fingerprint").agg(F.sum("n_docs").alias("n_near"))
    found = asked.join(near, "fingerprint").select("key", "n_near")
    joined = prints.join(order.select("key", "n"), "key").join(digests, "key").join(others, "key").join(after, "key").join(found, "key", "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return joined.select(
        doc_id.alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        text("fingerprint").alias("fingerprint"),
        text("f2").alias("edited_fingerprint"),
        likeness("fingerprint", "f2").alias("near_edited"),
        likeness("fingerprint", "f3").alias("near_next"),
        "n_near",
    )
