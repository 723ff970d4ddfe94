"""Queries on annotation records: cue rules, taxonomies, decisions, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cues
from ..operators import agreement, joins, metrics, timeline
from .base import DAY, FIELDS, HOUR, cued_sql, lookup_sql, query, records, records_sql, rounded, table
from .queries import EV, RUNS, events

_REC = records_sql()
_CUED = f"{_REC}, {cued_sql()}"


@query(f"WITH {_CUED} SELECT v1, v2, cue9, count(*) AS n FROM cued GROUP BY 1, 2, 3")
def cue_rules(spark, d):
    r = records(spark, d)
    return r.groupBy(cues.cue("v1").alias("v1"), cues.cue("v2").alias("v2"), cues.cue("cue9").alias("cue9")).agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"(WITH {_CUED} SELECT '{v}' AS version, array_to_string({v}s, '+') AS combination, count(*) AS n FROM cued GROUP BY 2)" for v in ("v1", "v2", "cue9")))
def cue_candidates(spark, d):
    r = records(spark, d)
    each = r.select(F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.array_join(cues.candidates(v), "+").alias("combination")) for v in ("v1", "v2", "cue9")])))
    return each.groupBy("version", "combination").agg(F.count("*").alias("n"))


_SPACED = "s AS (SELECT 'cue6' AS space, v1 AS source FROM cued UNION ALL SELECT 'cue9', cue9 FROM cued)"


def _by_taxonomy(spark, d):
    r = records(spark, d)
    counts = r.select(F.inline(F.array(F.struct(F.lit("cue6").alias("space"), cues.cue("v1").alias("source")), F.struct(F.lit("cue9").alias("space"), cues.cue("cue9").alias("source"))))).groupBy("space", "source").agg(F.count("*").alias("n"))
    return counts, cues.taxonomies(spark)


@query(f"WITH {_CUED}, {_SPACED}, {lookup_sql()}, names AS (SELECT DISTINCT taxonomy, space FROM tax) SELECT taxonomy, class, count(*) AS n FROM s JOIN names USING (space) LEFT JOIN tax USING (taxonomy, space, source) GROUP BY 1, 2")
def taxonomy_counts(spark, d):
    """Records by class of every taxonomy; null for those that a taxonomy leaves out."""
    counts, members = _by_taxonomy(spark, d)
    return counts.join(F.broadcast(members), ["space", "source"]).groupBy("taxonomy", "class").agg(F.sum("n").alias("n"))


_OFF = "('looking_away', 'head_down', 'turned_to_peer', 'phone_use')"
_ON = "('screen_oriented', 'writing_notes', 'using_laptop', 'reading', 'listening')"


@query(f"""WITH {_CUED}, {_SPACED}, {lookup_sql()}, off AS (
  SELECT taxonomy, class, bool_or(source = 'uncertain') AS impure FROM tax GROUP BY 1, 2 HAVING bool_or(source IN {_OFF}) AND NOT bool_or(source IN {_ON})
) SELECT taxonomy, round(count(off.class) / CAST(count(*) AS DOUBLE), 6) AS share, bool_or(coalesce(impure, false)) AS impure FROM s JOIN tax USING (space, source) LEFT JOIN off USING (taxonomy, class) GROUP BY 1""")
def off_task_shares(spark, d):
    """Share of off-task classes by taxonomy, over the records that it does not leave out."""
    counts, members = _by_taxonomy(spark, d)
    off = cues.off_task_classes(members).withColumn("off", F.lit(1))
    kept = counts.join(F.broadcast(members.where("class IS NOT NULL")), ["space", "source"]).join(F.broadcast(off), ["taxonomy", "class"], "left")
    share = F.sum(F.col("n") * F.coalesce("off", F.lit(0))) / F.sum("n")
    return kept.groupBy("taxonomy").agg(F.round(share, 6).alias("share"), F.bool_or(F.coalesce("impure", F.lit(False))).alias("impure"))


#: which cue an event type stands for
_CUE_OF = {"view": "screen_oriented", "click": "looking_away", "error": "head_down", "purchase": "phone_use", "signup": "turned_to_peer"}
_DWELL = {"head_down": 3.0, "phone_use": 1.0, "looking_away": 2.0, "turned_to_peer": 2.5}
_CUE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CUE_OF.items()) + " END"
_DWELL_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in _DWELL.items()) + ") w(source, dwell)"


def _cue_events(spark, d):
    return events(spark, d).withColumn("cue", F.element_at(F.create_map(*[F.lit(x) for kv in _CUE_OF.items() for x in kv]), F.col("event_type")))


@query(f"""WITH {RUNS}, runs AS (SELECT {_CUE_SQL} AS source, (max(us) - min(us)) / {float(HOUR)} AS hours FROM r GROUP BY user_id, run, event_type
), {lookup_sql()}, al AS (SELECT taxonomy, class, max(w.dwell) AS dwell FROM tax LEFT JOIN {_DWELL_SQL} USING (source) GROUP BY 1, 2 HAVING bool_and(w.dwell IS NOT NULL AND source NOT IN {_ON})
) SELECT taxonomy, class, al.dwell, count(*) AS n FROM runs JOIN tax USING (source) JOIN al USING (taxonomy, class) WHERE space = 'cue6' AND hours >= al.dwell GROUP BY 1, 2, 3""")
def alert_dwell_runs(spark, d):
    """Runs of cues that last as long as a taxonomy's class must to alert."""
    members = cues.taxonomies(spark).where("space = 'cue6'")
    dwells = cues.alert_dwells(members, _DWELL)
    runs = timeline.runs(_cue_events(spark, d), ["user_id"], ["us", "event_id"], "cue").select(F.col("cue").alias("source"), ((F.col("t_end") - F.col("t_start")) / float(HOUR)).alias("hours"))
    found = runs.join(F.broadcast(members.select("source", "taxonomy", "class")), "source").join(F.broadcast(dwells), ["taxonomy", "class"]).where("hours >= dwell")
    return found.groupBy("taxonomy", "class", "dwell").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT k % 9 - 1 AS old, CASE WHEN k % 9 - 1 < 0 THEN 0 WHEN k % 9 - 1 >= 5 THEN 5 ELSE k % 9 - 1 END AS new, count(*) AS n FROM ev GROUP BY 1, 2")
def legacy_ids(spark, d):
    old = F.col("k") % 9 - 1
    return events(spark, d).groupBy(old.alias("old"), cues.legacy_id(old).alias("new")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CUED}, {lookup_sql()}, m AS (SELECT taxonomy, map(list(source), list(class)) AS m FROM tax WHERE taxonomy IN ('onoff_reliable', 'coarse3_reliable') GROUP BY 1
), c AS (SELECT taxonomy, list_filter(list_transform(v1s, lambda s: m[s]), lambda x: x IS NOT NULL) AS cl FROM cued, m
), u AS (SELECT taxonomy, list_filter(cl, lambda x, i: list_position(cl, x) = i) AS cl FROM c)
SELECT taxonomy, CASE WHEN len(cl) > 0 THEN array_to_string(cl, '+') END AS classes, count(*) AS n FROM u GROUP BY 1, 2""")
def collapsed_candidates(spark, d):
    """Candidate sets through two taxonomies; null where no candidate is left."""
    c = cues.candidates("v1")
    each = records(spark, d).select(F.inline(F.array(*[F.struct(F.lit(t).alias("taxonomy"), F.array_join(cues.collapse(c, t), "+").alias("classes")) for t in ("onoff_reliable", "coarse3_reliable")])))
    return each.groupBy("taxonomy", "classes").agg(F.count("*").alias("n"))


_WORDS = {"talk": ["say", "th", "en "], "code": ["def ", "{", "http"], "number": ["1", "2", "3"]}


@query("WITH h AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) + f") AS {c}" for c, ws in _WORDS.items()) + " FROM documents) SELECT CASE WHEN talk > 0 AND talk >= code AND talk >= number THEN 'talk' WHEN code > 0 AND code >= number THEN 'code' WHEN number > 0 THEN 'number' END AS label, count(*) AS n FROM h GROUP BY 1")
def keyword_labels(spark, d):
    return table(spark, d, "documents").groupBy(cues.keyword_label(F.col("text"), _WORDS).alias("label")).agg(F.count("*").alias("n"))


_SCORE_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in cues.TASK_SCORE.items()) + ") sc(cue, score)"


@query(f"WITH {_CUED} SELECT frame, round(avg(a.score), 6) AS cue6_score, round(avg(b.score), 6) AS cue9_score FROM cued JOIN {_SCORE_SQL.replace('sc(', 'a(')} ON a.cue = v1 JOIN {_SCORE_SQL.replace('sc(', 'b(')} ON b.cue = cue9 GROUP BY 1")
def task_scores(spark, d):
    r = records(spark, d)
    return r.groupBy("frame").agg(F.round(F.avg(cues.task_score(cues.cue("v1"))), 6).alias("cue6_score"), F.round(F.avg(cues.task_score(cues.cue("cue9"))), 6).alias("cue9_score"))


@query(f"WITH {EV} SELECT k % 10 <> 0 AS found, NOT (k % 10 <> 0) OR abs(k / 50.0 - 1) > 0.33 OR value / 100 - 0.5 > 0.33 AS off_task, count(*) AS n FROM ev GROUP BY 1, 2")
def pose_proxy(spark, d):
    found = F.col("k") % 10 != 0
    off = cues.pose_off_task(found, F.col("k") / 50.0 - 1, F.col("value") / 100 - 0.5)
    return events(spark, d).groupBy(found.alias("found"), off.alias("off_task")).agg(F.count("*").alias("n"))


#: three probabilities of each event, whole hundredths
_P = "a AS (SELECT event_id, k AS p0, (100 - k) * (event_id % 7) // 10 AS p1 FROM ev), p AS (SELECT event_id, [p0 / 100.0, p1 / 100.0, (100 - p0 - p1) / 100.0] AS ps FROM a)"
_NAMES = ["head_down", "phone_use", "uncertain"]
_BARS = [0.5, 0.2, 0.6]


def _probs(spark, d):
    p1 = F.floor((100 - F.col("k")) * (F.col("event_id") % 7) / 10)
    return events(spark, d).select("event_id", "event_type", "user_id", "us", F.array(F.col("k") / 100.0, p1 / 100.0, (100 - F.col("k") - p1) / 100.0).alias("ps"))


_BAR_SQL = "[" + ", ".join(f"{{'d': round(ps[{i + 1}] - {b}, 9), 'p': ps[{i + 1}], 'i': {-i}}}" for i, b in enumerate(_BARS)) + "]"


@query(f"""WITH {EV}, {_P}, q AS (SELECT ps, list_max(ps) AS conf, list_position(ps, list_max(ps)) AS raw, list_max(list_filter({_BAR_SQL}, lambda s: s.d >= 0)) AS best FROM p
), z AS (SELECT 'plain' AS kind, raw, conf, CASE WHEN conf >= 0.6 THEN raw END AS shown, conf >= 0.75 AS allowed FROM q UNION ALL SELECT 'bars', raw, conf, 1 - best.i, coalesce(ps[1 - best.i] >= 0.75, false) FROM q)
SELECT kind, {_NAMES}[raw] AS cue, coalesce({_NAMES}[shown], 'abstain') AS displayed_cue, shown IS NULL AS abstained, allowed AS alert_allowed, coalesce(shown <> raw, false) AS rescued, count(*) AS n, round(avg(conf), 6) AS confidence FROM z GROUP BY 1, 2, 3, 4, 5, 6""")
def display_decisions(spark, d):
    """What is shown and may alert, with one threshold and with a bar for each cue."""
    made = lambda kind, bars: F.struct(F.lit(kind).alias("kind"), cues.decision(F.col("ps"), _NAMES, 0.6, 0.75, bars).alias("r"))
    each = _probs(spark, d).select(F.inline(F.array(made("plain", None), made("bars", _BARS)))).select("kind", "r.*")
    return each.groupBy("kind", "cue", "displayed_cue", "abstained", "alert_allowed", "rescued").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


_STREAK = """{name} AS (SELECT *, CASE WHEN {inside} THEN us - last_value(CASE WHEN {inside} AND NOT coalesce({before}, false) THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id) ELSE 0 END AS {col}
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS {col}_prev FROM {src}))"""


def _streak_sql(name, src, col, types):
    return _STREAK.format(name=name, src=src, col=col, inside=f"event_type IN {types}", before=f"{col}_prev IN {types}")


@query(f"WITH {EV}, {_streak_sql('s', 'ev', 'streak', ('click', 'error'))} SELECT event_id, streak FROM s")
def streaks(spark, d):
    """How long each event's user has been in a set of types without a break; 0 outside it."""
    return timeline.with_streak(events(spark, d), ["user_id"], ["us", "event_id"], F.col("event_type").isin("click", "error"), "streak").select("event_id", "streak")


_W = "(PARTITION BY user_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
_TEN = _W.format(10 * DAY - 1)


@query(f"""WITH {EV}, {_streak_sql('a', 'ev', 'off', ('error', 'click', 'signup'))}, {_streak_sql('b', 'a', 'down', ('error', 'error'))}, {_streak_sql('c', 'b', 'side', ('click', 'signup'))}, w AS (
  SELECT *, us - min(us) OVER (PARTITION BY user_id) AS history, count(*) OVER t AS n, count(*) FILTER (event_type NOT IN ('view', 'click', 'error', 'purchase', 'signup')) OVER t AS unc, count(*) FILTER (event_type = 'view') OVER t AS onn FROM c WINDOW t AS {_TEN})
SELECT event_id, CASE WHEN history < {3 * DAY} THEN 'unknown' WHEN event_type = 'purchase' THEN 'phone_use_alert' WHEN down >= {2 * DAY} OR off >= {2 * DAY} THEN 'off_task_cue' WHEN side >= {DAY} THEN 'possible_distraction'
  WHEN unc / n > 0.5 THEN 'unknown' WHEN n > unc AND onn / (n - unc) >= 0.25 THEN 'on_task' ELSE 'possible_distraction' END AS state FROM w""")
def rule_states(spark, d):
    """State of each user's timeline at each event, by rules over streaks and a trailing window."""
    ev = _cue_events(spark, d)
    return timeline.with_rule_state(ev, ["user_id"], "us", "event_id", "cue", window=10 * DAY, majority=0.25, aside=DAY, down=2 * DAY, history=3 * DAY).select("event_id", "state")


def _two_annotators(spark, d):
    """Records with a_ and b_ columns: b differs where the line's part is divisible by 5."""
    b = records(spark, d, "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END")
    pre = lambda r, p: r.select("id", *[F.col(f).alias(f"{p}_{f}") for f in FIELDS], (F.col("id") % (17 if p == "a" else 13) == 0).alias(f"{p}_rejected"))
    return pre(records(spark, d), "a").join(pre(b, "b"), "id")


_PAIR = f"""{_REC}, {records_sql('other', 'CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END')}, two AS (SELECT a.id, a.id % 17 = 0 AS ra, b.id % 13 = 0 AS rb, {', '.join(f'a.{f} AS a_{f}, b.{f} AS b_{f}' for f in FIELDS)} FROM rec a JOIN other b USING (id)
), long AS ({' UNION ALL '.join(f"SELECT id, ra, rb, '{f}' AS field, a_{f} AS a, b_{f} AS b FROM two" for f in FIELDS)})"""


@query(f"""WITH {_PAIR}, x AS (SELECT field, a, b FROM long WHERE NOT ra AND NOT rb UNION ALL SELECT 'status', CAST(ra AS VARCHAR), CAST(rb AS VARCHAR) FROM two
), n AS (SELECT field, a, b, count(*) AS n FROM x GROUP BY 1, 2, 3), t AS (SELECT field, CAST(sum(n) AS DOUBLE) AS n, sum(CASE WHEN a IS NOT DISTINCT FROM b THEN n ELSE 0 END) AS s FROM n GROUP BY 1
), e AS (SELECT field, sum(x.n * y.n) AS e FROM (SELECT field, a AS v, sum(n) AS n FROM n GROUP BY 1, 2) x JOIN (SELECT field, b AS v, sum(n) AS n FROM n GROUP BY 1, 2) y USING (field, v) GROUP BY 1
), k AS (SELECT field, CAST(n AS BIGINT) AS n, s / n AS agreement, CASE WHEN e / (n * n) = 1 THEN 1 ELSE (s / n - e / (n * n)) / (1 - e / (n * n)) END AS kappa FROM t JOIN e USING (field))
SELECT field, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM k UNION ALL SELECT 'mean', max(n), NULL, round(avg(kappa), 6) FROM k WHERE field <> 'status'""")
def annotator_agreement(spark, d):
    """Kappa by field of two annotators' common records, of their reject decisions, and the mean."""
    return rounded(agreement.field_kappas(_two_annotators(spark, d), FIELDS, F.col("a_rejected"), F.col("b_rejected")), "agreement", "kappa")


@query(f"WITH {_PAIR}, s AS (SELECT ra, field, count(*) AS n, avg(CAST(a IS NOT DISTINCT FROM b AS INT)) AS accuracy FROM long GROUP BY 1, 2) SELECT ra AS a_rejected, field, n, round(accuracy, 6) AS accuracy FROM s UNION ALL SELECT ra, 'all', CAST(sum(n) AS BIGINT), round(avg(accuracy), 6) FROM s GROUP BY 1")
def field_accuracy(spark, d):
    return rounded(agreement.field_accuracy(_two_annotators(spark, d), FIELDS, "a_rejected"), "accuracy")


@query(f"WITH {_REC} SELECT frame % 4 AS variant, count(*) AS n, round(avg(({' + '.join(f'''CASE WHEN {f} IS NULL OR {f} IN ('unknown', 'other') THEN 0.0 ELSE 1.0 END''' for f in FIELDS)}) / {len(FIELDS)}), 6) AS concrete_rate, round(avg(face_kpts), 6) AS mean_confidence FROM rec GROUP BY 1")
def concrete_rates(spark, d):
    r = records(spark, d).withColumn("variant", F.col("frame") % 4)
    return rounded(agreement.concrete_rates(r, "variant", FIELDS, ["unknown", "other"], "face_kpts"), "concrete_rate", "mean_confidence")


@query(f"WITH {_REC}, long AS ({' UNION ALL '.join(f'''SELECT frame, '{f}' AS field, {f} AS v FROM rec''' for f in FIELDS)}), g AS (SELECT frame, field, count(*) AS n, count(v) AS c, count(DISTINCT v) AS k FROM long GROUP BY 1, 2 HAVING count(*) > 1) SELECT field, count(*) AS n, round(avg(CAST(c = 0 OR (c = n AND k = 1) AS INT)), 6) AS share FROM g GROUP BY 1")
def unanimous_fields(spark, d):
    return rounded(agreement.unanimous(records(spark, d), "frame", FIELDS), "share")


@query(f"WITH {_REC}, c AS (SELECT gaze_direction, attention_target, count(*) AS n FROM rec GROUP BY 1, 2), t AS (SELECT gaze_direction, CAST(sum(n) AS BIGINT) AS n, max(n) AS hits, min_by(attention_target, struct_pack(a := -n, b := attention_target)) AS modal FROM c GROUP BY 1) SELECT gaze_direction, n, modal, round(hits / n, 6) AS modal_share, round((SELECT sum(hits) / sum(n) FROM t), 6) AS total_share FROM t")
def target_predictability(spark, d):
    return rounded(agreement.predictability(records(spark, d), "gaze_direction", "attention_target"), "modal_share", "total_share")


@query(f"""WITH {_REC}, h AS (SELECT list_sort(list_filter([CASE WHEN gaze_direction = 'away_or_window' THEN 'gaze' END, CASE WHEN activity = 'looking_away' THEN 'activity' END, CASE WHEN attention_target = 'distracted' THEN 'target' END], lambda x: x IS NOT NULL)) AS h FROM rec
), f AS (SELECT h FROM h WHERE len(h) > 0), e AS (SELECT array_to_string(h, '+') AS combination FROM f UNION ALL SELECT 'any:' || unnest(h) FROM f)
SELECT combination, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM f) AS DOUBLE), 6) AS share FROM e GROUP BY 1""")
def rule_drivers(spark, d):
    """Which conditions make the looking-away rule hold, alone and together."""
    parts = {"gaze": F.col("gaze_direction") == "away_or_window", "activity": F.col("activity") == "looking_away", "target": F.col("attention_target") == "distracted"}
    return rounded(agreement.drivers(records(spark, d), parts), "share")


_ALONE = "attention_target = 'distracted' AND gaze_direction <> 'away_or_window' AND activity <> 'looking_away'"


@query(f"WITH {_CUED}, s AS (SELECT * FROM cued WHERE {_ALONE}), l AS ({' UNION ALL '.join(f'''SELECT '{c}' AS \"column\", {c} AS value FROM s''' for c in ('gaze_direction', 'activity', 'v1'))}) SELECT \"column\", value, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE), 6) AS share FROM l GROUP BY 1, 2")
def subpopulation(spark, d):
    """What the records are that look away by their target alone."""
    r = records(spark, d).withColumn("v1", cues.cue("v1")).na.fill("other", ["activity"]).where(_ALONE)
    return rounded(agreement.composition(r, ["gaze_direction", "activity", "v1"]), "share")


def _stats_sql(v):
    from .base import SQL_RULES

    return f"""SELECT '{v}' AS version, count(*) AS n, round(avg(CAST(len({v}s) > 1 AS INT)), 6) AS multi_fire_rate, count(*) FILTER ({v} = 'head_down') AS n_beside, count(*) FILTER ({v} = 'head_down' AND list_contains({v}s, 'looking_away')) AS n_ambiguous,
  count(*) FILTER ({v} = 'looking_away') AS n_labelled, count(*) FILTER ({v} = 'looking_away' AND gaze_direction = 'away_or_window') AS n_pure, count(*) FILTER ({SQL_RULES[v]['looking_away']}) AS true_by_rule FROM cued"""


@query(f"WITH {_CUED}, s AS ({' UNION ALL '.join(map(_stats_sql, ('v1', 'v2')))}) SELECT *, round(n_ambiguous / greatest(n_beside, 1), 6) AS ambiguous_rate, round(n_pure / greatest(n_labelled, 1), 6) AS purity, round(true_by_rule / greatest(n_labelled, 1), 6) AS undercrediting FROM s")
def ruleset_statistics(spark, d):
    r, out = records(spark, d), None
    for v in ("v1", "v2"):
        one = agreement.ruleset_stats(r, cues.cue(v), cues.candidates(v), dict(cues.rules(v))["looking_away"], F.col("gaze_direction") == "away_or_window", "looking_away", "head_down").withColumn("version", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "multi_fire_rate", "ambiguous_rate", "purity", "undercrediting")


@query("SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AND l.quality <> CAST(d.n_chars > 800 AS INT) AS disagree FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic = 0")
def second_opinion(spark, d):
    """Documents with a second label where there is one, whether it disagrees; those that it rejects go."""
    first = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("own"))
    return joins.second_opinion(first, table(spark, d, "labels"), ["doc_id"], F.col("own") != F.col("quality"), F.col("toxic") != 0).select("doc_id", "quality", "toxic", "disagree")


@query(f"""WITH {_REC}, h AS (SELECT * REPLACE (CASE WHEN id % 3 <> 0 THEN face_kpts END AS face_kpts) FROM rec), b AS (SELECT * REPLACE (coalesce(face_kpts, 3) AS face_kpts) FROM h), f AS (SELECT h.* REPLACE (coalesce(h.face_kpts, r.face_kpts) AS face_kpts) FROM h JOIN rec r USING (id))
, {cued_sql('b', 'before')}, {cued_sql('f', 'after')} SELECT x.v1 AS before, y.v1 AS after, count(*) AS n FROM before x JOIN after y USING (id) WHERE x.v1 <> y.v1 GROUP BY 1, 2""")
def measured_fields(spark, d):
    """Labels that change when a measured field is copied to records without it."""
    r = records(spark, d)
    human = r.withColumn("face_kpts", F.when(F.col("id") % 3 != 0, F.col("face_kpts")))
    filled = joins.fill_from(human, r, ["id"], ["face_kpts"])
    moved = human.select("id", cues.cue("v1").alias("before")).join(filled.select("id", cues.cue("v1").alias("after")), "id").where("before <> after")
    return moved.groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"WITH {_CUED}, x AS (SELECT list_position(['screen_oriented', 'looking_away', 'head_down', 'turned_to_peer', 'phone_use', 'uncertain'], v1) - 1 AS y FROM cued), c AS (SELECT unnest(range(6)) AS cls), h AS (SELECT cls, count(y) AS n FROM c LEFT JOIN x ON y = cls GROUP BY 1), w AS (SELECT cls, n, 1 / sqrt(greatest(n, 1)) AS w FROM h) SELECT cls, n, round(w * 6 / sum(w) OVER (), 6) AS weight FROM w")
def class_weights(spark, d):
    y = F.array_position(F.array(*map(F.lit, cues.CUE6)), cues.cue("v1")) - 1
    return metrics.class_weights(records(spark, d).select(y.alias("y")), "y", 6).withColumn("weight", F.round("weight", 6))
