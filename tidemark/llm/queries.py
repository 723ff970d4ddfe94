"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, ordinal
from .bpe import round_trip
from .exact import exact_groups
from .jaccard import JaccardJoin
from .lines import line_dedup
from .packing import pack, with_step_groups
from .phrases import PhraseMiner
from .repair import damage_and_repair
from .sharding import ShardTree, shard_documents
from .simhash import compare_edited
from .warc import archive_round_trip
from .wordpiece import token_counts


def vocabulary_file(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(spark, docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    return langid.predict(spark, model, docs).withColumn("held_out", langid.held_out())


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(spark).components(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(spark, docs, table(spark, sf_dir, "labels"))
    return ordinal.predict(spark, model, docs)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    groups = exact_groups(spark, docs, keep="max")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_step_groups(spark, pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json")))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PhraseMiner(spark, table(spark, sf_dir, "documents")).best_phrases()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(spark, table(spark, sf_dir, "conversations"))


def op13_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = ShardTree.even(16)
    return shard_documents(spark, table(spark, sf_dir, "documents"), tree, tree.grown())


_OPERATORS = (
    op1_language_id,
    op2_ngram_jaccard,
    op3_simhash,
    op4_warc_zstd,
    op5_token_counts,
    op6_line_dedup,
    op7_quality_ordinal,
    op8_exact_dedup,
    op9_packing,
    op10_bpe_round_trip,
    op11_phrase_mining,
    op12_conversation_repair,
    op13_hash_tree_sharding,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: CTE with the checksum's table, and the checksum of a text.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _repair_step() -> str:
    """The four states' cheapest (cost, audit) after one row x, from those in acc."""
    way = lambda state, cost, edit: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': 'Z'}"
    cut = "CASE WHEN x.fault = 'truncated' THEN 3 ELSE 0 END"
    when = lambda c, w: f"CASE WHEN {c} THEN {w} ELSE {far} END"
    free = "x.fault NOT IN ('blank', 'duplicate')"
    ways = {
        "r[1]": [way("r[1]", 4, "D")],
        "r[2]": [way("r[2]", 4, "D"), when(f"{free} AND x.init = 's'", way("r[1]", cut, "K"))],
        "r[3]": [way("r[3]", 4, "D")],
        "r[4]": [way("r[4]", 4, "D"), when(free, way("r[3]", f"3 + {cut}", "R")), when(f"{free} AND x.init = 'a'", way("r[3]", cut, "K"))],
    }
    for p in ("r[1]", "r[2]", "r[4]"):
        ways["r[3]"] += [when(free, way(p, f"3 + {cut}", "R")), when(f"{free} AND x.init = 'u'", way(p, cut, "K"))]
    return "[" + ", ".join(f"list_min([{', '.join(w)}])" for w in ways.values()) + "]"


def _inserted(acc: str, then: str) -> str:
    """then, with r the states of acc and those that Inserts reach from them."""
    add = lambda s: f"{{'c': {s}.c + 3, 'a': {s}.a || 'I'}}"
    user = f"list_transform([{acc}], lambda q: [q[1], q[2], list_min([q[3], {add('q[1]')}, {add('q[2]')}, {add('q[4]')}]), q[4]])[1]"
    both = f"list_transform([{user}], lambda q: [q[1], q[2], q[3], list_min([q[4], {add('q[3]')}])])[1]"
    return f"list_transform([{both}], lambda r: {then})[1]"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REPAIR_SQL = f"""
WITH {_CRC_TABLE}, f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f WHERE f <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat_ws('|', coalesce(CAST(conv_id AS VARCHAR), 'none'), md5(role), md5(text))), copy) AS i, rtrim(text, {_SPACES}) AS bare FROM d
), x AS (
  SELECT *, substr(role, 1, 1) AS init, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text, 'init': init, 'fault': fault}} ORDER BY i) AS l FROM x GROUP BY conv_id
), e AS (
  SELECT *, list_reduce(l, lambda acc, x: {_inserted('acc', _repair_step())}, [{{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': 'Z'}}, {{'c': CAST(1000000000 AS BIGINT), 'a': 'Z'}}, {{'c': CAST(1000000000 AS BIGINT), 'a': 'Z'}}]) AS s FROM c
), b AS (
  SELECT *, {_inserted('s', 'list_min([r[1], r[4]])')} AS best FROM e
), m AS (
  SELECT *, list_reduce(regexp_extract_all(best.a, '.'), lambda acc, x: CASE WHEN x = 'D' THEN {{'s': acc.s, 'i': acc.i + 1, 'o': acc.o}}
    WHEN x = 'K' THEN {{'s': CASE l[acc.i + 1].init WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE 's' END, 'i': acc.i + 1, 'o': list_append(acc.o, l[acc.i + 1].role || ':' || l[acc.i + 1].text)}}
    ELSE {{'s': CASE WHEN acc.s = 'u' THEN 'a' ELSE 'u' END, 'i': acc.i + CASE WHEN x = 'R' THEN 1 ELSE 0 END, 'o': list_append(acc.o, CASE WHEN acc.s = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN x = 'R' THEN l[acc.i + 1].text ELSE '' END)}} END,
    {{'s': '', 'i': CAST(0 AS BIGINT), 'o': CAST([] AS VARCHAR[])}}) AS told FROM b
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(told.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _descent(tree: ShardTree) -> str:
    """The shard of doc_id (as key), level by level."""
    nodes = tree.children()
    rows = ", ".join(f"('{p}', '{c}', CAST({w} AS DOUBLE), {n})" for p, found in nodes.items() for c, w, n in found)
    draw = "-ln((CAST('0x' || substr(md5(key || '|' || name), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight"
    level = lambda source: f"SELECT key, arg_min(name, ({draw}, name)) AS node, arg_min(number, ({draw}, name)) AS shard FROM {source} JOIN nodes ON parent = node GROUP BY key"
    return f"(WITH nodes(parent, name, weight, number) AS (VALUES {rows}), a AS ({level('(SELECT key, CAST(NULL AS VARCHAR) AS node FROM keys)').replace('parent = node', chr(39) * 2 + ' = parent')}), b AS ({level('a')}), c AS ({level('b')}) SELECT key, shard FROM c)"


SQL = {
    "op11_phrase_mining": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM p
), g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
), f AS (SELECT lang, k, w[i:i+k-1] AS g, count(*) AS f FROM g GROUP BY 1, 2, 3
), c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 30
), cut AS (
  SELECT c.lang, c.g, a, j, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j+1:c.k]
), s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), part AS (SELECT DISTINCT lang, a AS m, g[i:i+n-1] AS g FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < k)
), gone AS (SELECT DISTINCT c.lang, c.g FROM c JOIN part USING (lang, g) WHERE 100 * m >= 80 * a
), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1
), o AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, score FROM s ANTI JOIN gone USING (lang, g)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
""",
    "op12_conversation_repair": _REPAIR_SQL,
    "op13_hash_tree_sharding": f"""
WITH {_CRC_TABLE}, d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc("coalesce(text, '')")} AS crc32 FROM documents, crc
), keys AS (SELECT DISTINCT key FROM d)
SELECT doc_id, size, crc32 AS text_crc32, 'key' AS law, CAST(o.shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY o.shard ORDER BY doc_id NULLS FIRST, crc32, size) - 1 AS slot, CAST(g.shard AS INTEGER) AS grown_shard
FROM d JOIN {_descent(ShardTree.even(16))} o USING (key) JOIN {_descent(ShardTree.even(16).grown())} g USING (key)
""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
""",
    "op4_warc_zstd": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (
  SELECT *, sha1(html) AS hex, encode(html) AS raw FROM p
)
SELECT page_id, octet_length(raw) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, i - 1 AS pos, ls[i:i+2] AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)
), f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp FROM w WINDOW o AS (PARTITION BY k ORDER BY doc_id, pos)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS line FROM f WHERE doc_id <> fd OR pos <> fp
), g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l) x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.line = x.i
  WHERE gone.line IS NULL GROUP BY x.doc_id
)
SELECT l.doc_id, CASE WHEN l.ls IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(len(l.ls), 0) AS n_lines, coalesce(g.n, 0) AS n_removed
FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id LEFT JOIN g ON g.doc_id = l.doc_id
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
