"""Cue rules over annotation records, and taxonomies that regroup cues.

Rules are ordered (name, condition) pairs for labels.first_match and labels.all_matches; the first, uncertain, is the gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labels

#: fixed values: values of a missing field
DEFAULTS = {"activity": "other", "gaze_direction": "unknown", "attention_target": "unknown", "engagement_level": "unknown", "posture": "unknown", "hand_state": "unknown"}
#: fixed values: classes by id
CUE6 = ["screen_oriented", "looking_away", "head_down", "turned_to_peer", "phone_use", "uncertain"]
CUE9 = ["writing_notes", "using_laptop", "reading", "listening", "looking_away", "head_down", "turned_to_peer", "phone_use", "uncertain"]
SPACES = {"cue6": CUE6, "cue9": CUE9}
#: fixed values: scores of the overlay by cue
TASK_SCORE = {"screen_oriented": 1.0, "looking_away": 0.3, "turned_to_peer": 0.3, "head_down": 0.15, "phone_use": 0.1, "uncertain": 0.5, "writing_notes": 1.0, "using_laptop": 1.0, "reading": 1.0, "listening": 1.0}
#: fixed values: cues off and on task; uncertain is neither
OFF_TASK = ["looking_away", "head_down", "turned_to_peer", "phone_use"]
ON_TASK = ["screen_oriented", "writing_notes", "using_laptop", "reading", "listening"]
#: fixed values: values that speak for work
TASK_ACTIVITIES = ["using_laptop", "listening", "reading", "writing_notes"]
TASK_GAZES = ["laptop", "teacher_or_board", "own_desk", "down"]
TASK_TARGETS = ["device", "instruction", "own_work"]


def _same(space: str) -> dict[str, list[str]]:
    return {c: [c] for c in SPACES[space]}


#: fixed values: (label space, members of each class in the order of the class ids)
TAXONOMIES: dict[str, tuple[str, dict[str, list[str]]]] = {
    "cue6": ("cue6", _same("cue6")),
    "onoff": ("cue6", {"on_task": ["screen_oriented"], "off_task": ["looking_away", "head_down", "turned_to_peer", "phone_use", "uncertain"]}),
    "onoff_reliable": ("cue6", {"on_task": ["screen_oriented"], "off_task": ["head_down", "phone_use", "uncertain"]}),
    "coarse3_reliable": ("cue6", {"screen_oriented": ["screen_oriented"], "down_or_hidden": ["head_down", "uncertain"], "phone_use": ["phone_use"]}),
    "cue7": ("cue9", {"writing_notes": ["writing_notes"], "using_laptop": ["using_laptop", "reading", "listening"], **{c: [c] for c in CUE9[4:]}}),
    "cue8": ("cue9", {"writing_notes": ["writing_notes"], "using_laptop": ["using_laptop"], "engaged": ["reading", "listening"], **{c: [c] for c in CUE9[4:]}}),
    "cue9": ("cue9", _same("cue9")),
}


def _field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))


def rules(version: str = "v1") -> list[tuple[str, Column]]:
    """Rules of a version, v1, v2 (which does not read attention_target) or cue9, over the columns of a record.

    A missing field has its default; missing flags are false, missing face_kpts are 3.
    """
    if version not in ("v1", "v2", "cue9"):
        raise KeyError(version)
    activity, gaze, target, engagement, posture, hand = map(_field, DEFAULTS)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reads_target = version != "v2"
    #: fixed values: the values that each rule reads
    hidden = flag("occluded") & (F.coalesce("face_kpts", F.lit(3)) <= 2)
    nothing = (gaze == "unknown") & (engagement == "unknown") & (activity == "other")
    peer = (activity == "talking_to_peer") | flag("talking") | (gaze == "peer")
    away = (gaze == "away_or_window") | (activity == "looking_away")
    down = (activity == "head_down_sleeping") | posture.isin("head_down", "slumped")
    if reads_target:
        nothing, peer, away = nothing & (target == "unknown"), peer | (target == "peer"), away | (target == "distracted")
    phone = (activity == "using_phone") | flag("phone_visible") | (gaze == "phone") | (hand == "on_phone")
    task_gaze = gaze.isin(TASK_GAZES) & target.isin(TASK_TARGETS) if reads_target else gaze.isin(TASK_GAZES)
    #: fixed values: the rules of work, in order of precedence
    work = {
        "v1": [("screen_oriented", activity.isin(TASK_ACTIVITIES) | task_gaze)],
        "cue9": [
            ("writing_notes", activity == "writing_notes"),
            ("using_laptop", (activity == "using_laptop") & target.isin(TASK_TARGETS)),
            ("reading", gaze.isin("laptop", "own_desk") | (activity == "reading")),
            ("listening", (gaze == "teacher_or_board") | (activity == "listening")),
        ],
    }
    down = down | (gaze == "down") if version == "cue9" else down
    first = [("uncertain", hidden | nothing), ("phone_use", phone), ("head_down", down), ("turned_to_peer", peer), ("looking_away", away)]
    return first + work["cue9" if version == "cue9" else "v1"]


def cue(version: str = "v1") -> Column:
    """Name of the first rule that holds; uncertain if none does."""
    return labels.first_match(rules(version), "uncertain")


def candidates(version: str = "v1") -> Column:
    """Names of all rules that hold; uncertain alone if its gate does or none other."""
    return labels.all_matches(rules(version), "uncertain", "uncertain")


def taxonomy(spark: SparkSession, name: str) -> DataFrame:
    """(source_id, source, class_id, class) of each class of the taxonomy's label space; nulls where the taxonomy leaves it out.

    A member that the space does not have, or that two classes have, is an error.
    """
    space, groups = TAXONOMIES[name]
    members = [m for g in groups.values() for m in g]
    if not set(members) <= set(SPACES[space]) or len(set(members)) < len(members):
        raise ValueError(f"taxonomy {name} does not fit its label space")
    at = {m: (i, c) for i, (c, g) in enumerate(groups.items()) for m in g}
    return spark.createDataFrame([(i, c, *at.get(c, (None, None))) for i, c in enumerate(SPACES[space])], "source_id int, source string, class_id int, class string")


def taxonomies(spark: SparkSession) -> DataFrame:
    """All taxonomies' rows with the columns taxonomy and space."""
    out = None
    for name, (space, _) in TAXONOMIES.items():
        one = taxonomy(spark, name).withColumns({"taxonomy": F.lit(name), "space": F.lit(space)})
        out = one if out is None else out.unionByName(one)
    return out


def off_task_classes(members: DataFrame) -> DataFrame:
    """(taxonomy, class, impure) of the classes with an off-task member and none on task; impure: uncertain is in it too."""
    of = members.where("class IS NOT NULL").groupBy("taxonomy", "class")
    flags = of.agg(F.bool_or(F.col("source").isin(OFF_TASK)).alias("off"), F.bool_or(F.col("source").isin(ON_TASK)).alias("on"), F.bool_or(F.col("source") == "uncertain").alias("impure"))
    return flags.where("off AND NOT on").select("taxonomy", "class", "impure")


def alert_dwells(members: DataFrame, dwell: dict[str, float]) -> DataFrame:
    """(taxonomy, class, dwell): the longest dwell of its members for each class all of whose members have one and none is on task."""
    of_cue = F.element_at(F.create_map(*[F.lit(x) for kv in dwell.items() for x in kv]), F.col("source"))
    found = members.where("class IS NOT NULL").groupBy("taxonomy", "class").agg(F.bool_and(of_cue.isNotNull() & ~F.col("source").isin(ON_TASK)).alias("all"), F.max(of_cue).alias("dwell"))
    return found.where("all").select("taxonomy", "class", "dwell")


def collapse(found: Column, name: str) -> Column:
    """Distinct classes of an array of cues, in order; null if the taxonomy leaves all of them out."""
    at = {m: c for c, g in TAXONOMIES[name][1].items() for m in g}
    to = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
    kept = F.array_distinct(F.array_compact(F.transform(found, lambda c: F.element_at(to, c))))
    return F.when(F.size(kept) > 0, kept)


def legacy_id(old: Column) -> Column:
    """Ids of seven classes (5 idle, 6 uncertain) as ids of six; what is outside is clipped first."""
    return F.least(F.greatest(old, F.lit(0)), F.lit(5))


def keyword_label(text: Column, words: dict[str, list[str]]) -> Column:
    """The class with the most of its keywords in the text, of equal ones the first; null if there are none."""
    lower = F.lower(text)
    hits = [F.struct(sum((F.contains(lower, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(words.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["c"])


def task_score(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TASK_SCORE.items() for x in kv]), name)


def pose_off_task(found: Column, yaw: Column, pitch: Column, most: float = 0.33) -> Column:
    """No face, turned aside, or bent down."""
    return ~F.coalesce(found, F.lit(False)) | (F.abs(yaw) > most) | (pitch > most)


def decision(probs: Column, names: list[str], display: float, alert: float, bars: list[float] | None = None) -> Column:
    """struct(cue, confidence, displayed_cue, abstained, alert_allowed, rescued) of an array of class probabilities.

    Without bars the top class is shown if it reaches display, and may alert if it reaches alert. With bars the class that exceeds
    its bar by most is shown, and may alert if it reaches alert. displayed_cue is abstain where nothing is shown.
    """
    top = F.array_max(probs)
    raw = F.array_position(probs, top).cast("int") - 1
    of = F.array(*map(F.lit, names))
    shown = labels.best_over_bars(probs, bars) if bars else F.when(top >= display, raw)
    allowed = F.get(probs, shown) >= alert if bars else top >= alert
    return F.struct(
        F.get(of, raw).alias("cue"),
        top.alias("confidence"),
        F.coalesce(F.get(of, shown), F.lit("abstain")).alias("displayed_cue"),
        shown.isNull().alias("abstained"),
        F.coalesce(allowed, F.lit(False)).alias("alert_allowed"),
        F.coalesce(shown != raw, F.lit(False)).alias("rescued"),
    )
