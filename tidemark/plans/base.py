"""Registry of queries with their SQL, and the stand-ins for the given tables that several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cues

HOUR = 3_600_000_000
DAY = 24 * HOUR
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: fixed values: the closed vocabulary of annotation records
VOCABULARY = {
    "activity": ["listening", "using_laptop", "head_down_sleeping", "looking_away", "reading", "using_phone", "talking_to_peer", "writing_notes", "eating_drinking", "raising_hand", "other"],
    "gaze_direction": ["laptop", "teacher_or_board", "own_desk", "down", "away_or_window", "phone", "peer", "unknown"],
    "attention_target": ["device", "instruction", "own_work", "distracted", "peer", "unknown"],
    "engagement_level": ["engaged", "partially_engaged", "disengaged", "unknown"],
    "posture": ["upright", "leaning_forward", "leaning_back", "head_down", "turned_away", "slumped", "unknown"],
    "hand_state": ["unknown", "on_face", "on_desk_idle", "on_phone", "gesturing", "writing", "raised"],
}
#: which value of the vocabulary a line item stands for
_PICK = {
    "activity": "l_partkey * 7 + l_linenumber",
    "gaze_direction": "l_suppkey * 5 + l_linenumber",
    "attention_target": "l_partkey + l_suppkey",
    "engagement_level": "l_orderkey",
    "posture": "l_orderkey * 3 + l_linenumber * 2",
    "hand_state": "l_suppkey + l_linenumber * 3",
}
FIELDS = list(VOCABULARY)


def records(spark: SparkSession, d: str, shift: str = "0") -> DataFrame:
    """Line items as annotation records: id, frame, the fields, flags and face_kpts. shift is added to every pick."""
    values = {f: F.get(F.array(*map(F.lit, v)), F.expr(f"cast(pmod({_PICK[f]} + ({shift}), {len(v)}) AS int)")) for f, v in VOCABULARY.items()}
    values["activity"] = F.when(F.col("l_linenumber") != 7, values["activity"])
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("frame"),
        *[c.alias(f) for f, c in values.items()],
        (F.col("l_returnflag") == "R").alias("occluded"),
        (F.col("l_quantity") % 4).cast("int").alias("face_kpts"),
        (F.col("l_discount") > 0.09).alias("phone_visible"),
        (F.col("l_tax") > 0.07).alias("talking"),
    )


def records_sql(name: str = "rec", shift: str = "0") -> str:
    pick = lambda f: f"[{', '.join(map(repr, VOCABULARY[f]))}][1 + CAST((({_PICK[f]} + ({shift})) % {len(VOCABULARY[f])}) AS INTEGER)]"
    picks = {f: pick(f) for f in FIELDS}
    picks["activity"] = f"CASE WHEN l_linenumber <> 7 THEN {picks['activity']} END"
    return f"""{name} AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS frame, {', '.join(f'{c} AS {f}' for f, c in picks.items())},
  l_returnflag = 'R' AS occluded, CAST(l_quantity AS BIGINT) % 4 AS face_kpts, l_discount > 0.09 AS phone_visible, l_tax > 0.07 AS talking FROM lineitem)"""


_SQL_COMMON = {
    "phone_use": "activity = 'using_phone' OR phone_visible OR gaze_direction = 'phone' OR hand_state = 'on_phone'",
    "head_down": "activity = 'head_down_sleeping' OR posture IN ('head_down', 'slumped')",
}
_SQL_HIDDEN = "(occluded AND face_kpts <= 2)"
_SQL_NOTHING = "gaze_direction = 'unknown' AND engagement_level = 'unknown' AND activity = 'other'"
SQL_RULES = {
    "v1": {
        "uncertain": f"{_SQL_HIDDEN} OR ({_SQL_NOTHING} AND attention_target = 'unknown')",
        **_SQL_COMMON,
        "turned_to_peer": "activity = 'talking_to_peer' OR talking OR gaze_direction = 'peer' OR attention_target = 'peer'",
        "looking_away": "gaze_direction = 'away_or_window' OR activity = 'looking_away' OR attention_target = 'distracted'",
        "screen_oriented": "activity IN ('using_laptop', 'listening', 'reading', 'writing_notes') OR (gaze_direction IN ('laptop', 'teacher_or_board', 'own_desk', 'down') AND attention_target IN ('device', 'instruction', 'own_work'))",
    },
    "v2": {
        "uncertain": f"{_SQL_HIDDEN} OR ({_SQL_NOTHING})",
        **_SQL_COMMON,
        "turned_to_peer": "activity = 'talking_to_peer' OR talking OR gaze_direction = 'peer'",
        "looking_away": "gaze_direction = 'away_or_window' OR activity = 'looking_away'",
        "screen_oriented": "activity IN ('using_laptop', 'listening', 'reading', 'writing_notes') OR gaze_direction IN ('laptop', 'teacher_or_board', 'own_desk', 'down')",
    },
}
SQL_RULES["cue9"] = {
    **SQL_RULES["v1"],
    "head_down": _SQL_COMMON["head_down"] + " OR gaze_direction = 'down'",
    "writing_notes": "activity = 'writing_notes'",
    "using_laptop": "activity = 'using_laptop' AND attention_target IN ('device', 'instruction', 'own_work')",
    "reading": "gaze_direction IN ('laptop', 'own_desk') OR activity = 'reading'",
    "listening": "gaze_direction = 'teacher_or_board' OR activity = 'listening'",
}
del SQL_RULES["cue9"]["screen_oriented"]


def cued_sql(source: str = "rec", name: str = "cued", extra: str = "") -> str:
    """CTE with the defaults filled in, the first cue and the candidates of each rule version (v1, v1s, v2, v2s, cue9, cue9s)."""
    first = lambda v: "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in SQL_RULES[v].items()) + " ELSE 'uncertain' END"
    hits = lambda v: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in SQL_RULES[v].items()) + "], lambda x: x IS NOT NULL)"
    every = lambda v: f"CASE WHEN {SQL_RULES[v]['uncertain']} OR len({hits(v)}) = 0 THEN ['uncertain'] ELSE {hits(v)} END"
    return f"{name} AS (SELECT *, {', '.join(f'{first(v)} AS {v}, {every(v)} AS {v}s' for v in SQL_RULES)} FROM (SELECT * REPLACE (coalesce(activity, 'other') AS activity) FROM {source}))"


def lookup_sql(name: str = "tax") -> str:
    """CTE (taxonomy, space, source, class) of all taxonomies."""
    rows = [(t, s, m, c) for t, (s, g) in cues.TAXONOMIES.items() for c, ms in g.items() for m in ms]
    return f"{name}(taxonomy, space, source, class) AS (VALUES {', '.join(map(str, rows))})"
