"""Queries on matching of units and boxes, seats, and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import texts
from ..operators import matching
from .base import query, rounded, table
from .queries import _boxes, _sql_boxes, events

#: three units and boxes of each frame: its first lines by id, each unit truly at the box of its own line
_THREE = f"three AS (SELECT frame, ax1, ay1, ax2, ay2, ascore, row_number() OVER (PARTITION BY frame ORDER BY aid) AS unit FROM ({_sql_boxes('a', 0)}) QUALIFY unit <= 4), ok AS (SELECT frame FROM three GROUP BY 1 HAVING count(*) >= 2), tr AS (SELECT *, unit AS box FROM three WHERE frame IN (SELECT frame FROM ok))"


def _truth(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("frame")
    a = _boxes(spark, d, "a", 0).withColumn("unit", F.row_number().over(w.orderBy("aid"))).where("unit <= 4").withColumn("box", F.col("unit"))
    return a.withColumn("n", F.count("*").over(w)).where("n >= 2").select("frame", "unit", "box", "ax1", "ay1", "ax2", "ay2", "ascore")


def _left_to_right(t):
    return matching.by_order(t, t, "frame", "unit", "box", [F.col("ax1") + F.col("ax2"), F.col("box")])


@query(f"WITH {_THREE}, b AS (SELECT frame, box, row_number() OVER (PARTITION BY frame ORDER BY ax1 + ax2, box) AS unit FROM tr) SELECT frame, unit, box FROM b")
def left_to_right(spark, d):
    """Units matched to boxes from left to right."""
    return _left_to_right(_truth(spark, d)).select("frame", "unit", "box")


def _pairs(spark, d):
    t = _truth(spark, d)
    similar = ((F.col("unit") * 37 + F.col("box") * 11 + F.col("frame")) % 100) / 100.0
    both = matching.spatial_pairs(t.select("frame", "unit"), t.select("frame", "box", "ax1", "ax2", "ascore"), "frame", "unit", "box", F.col("ax1") + F.col("ax2"))
    scored = both.withColumn("similar", similar)
    return matching.costs(scored, "frame", "similar", "spatial", "ascore", (1.0, 0.5, 0.25)).select("frame", "unit", "box", "spatial", "cost")


_COST = f"""{_THREE}, pr AS (SELECT t.frame, t.unit, b.box, b.ascore, b.ax1 + b.ax2 AS cx, ((t.unit * 37 + b.box * 11 + t.frame) % 100) / 100.0 AS sim, dense_rank() OVER (PARTITION BY t.frame ORDER BY t.unit) AS u, dense_rank() OVER (PARTITION BY t.frame ORDER BY b.ax1 + b.ax2, b.box) AS k FROM tr t JOIN tr b USING (frame)
), sp AS (SELECT *, 1 - abs(u - k) / CAST(greatest(max(k) OVER (PARTITION BY frame) - 1, 1) AS DOUBLE) AS spatial FROM pr), co AS (SELECT frame, unit, box, spatial, -((sim - avg(sim) OVER f) / (stddev_pop(sim) OVER f + 1e-8) + 0.5 * spatial + 0.25 * ascore) AS cost FROM sp WINDOW f AS (PARTITION BY frame))"""


@query(f"WITH {_COST} SELECT frame, unit, box, round(spatial, 6) AS spatial, round(cost, 5) AS cost FROM co")
def matching_costs(spark, d):
    return rounded(rounded(_pairs(spark, d), "spatial"), "cost", digits=5)


@query(f"WITH {_COST}, ch AS (SELECT frame, box, row_number() OVER (PARTITION BY frame ORDER BY ax1 + ax2, box) AS unit FROM tr) SELECT frame, unit, box, round(co.cost, 5) AS cost, round((SELECT min(o.cost) FROM co o WHERE o.frame = ch.frame AND o.unit = ch.unit AND o.box <> ch.box) - co.cost, 5) AS margin FROM ch JOIN co USING (frame, unit, box)")
def matching_margins(spark, d):
    """How much better each match is than the unit's next best box."""
    return rounded(matching.margins(_pairs(spark, d), _left_to_right(_truth(spark, d)), "frame", "unit", "box"), "cost", "margin", digits=5)


@query()
def least_cost_matching(spark, d):
    """Assignments of least total cost with a price for staying free; tested against all permutations."""
    return matching.assigned(_pairs(spark, d), "frame", "unit", "box", "cost", -0.2)


@query()
def transport_matching(spark, d):
    """Assignments by an entropic transport plan; tested against all permutations of the plan."""
    return matching.assigned(_pairs(spark, d), "frame", "unit", "box", "transport")


_OVER = "greatest(least(p.ax2, q.ax2) - greatest(p.ax1, q.ax1), 0) * greatest(least(p.ay2, q.ay2) - greatest(p.ay1, q.ay1), 0)"


@query(f"""WITH {_THREE}, ch AS (SELECT frame, box, row_number() OVER (PARTITION BY frame ORDER BY ax1 + ax2, box) AS unit FROM tr), j AS (SELECT t.frame, t.box = c.box AS correct, {_OVER} / CAST((p.ax2 - p.ax1) * (p.ay2 - p.ay1) + (q.ax2 - q.ax1) * (q.ay2 - q.ay1) - {_OVER} AS DOUBLE) >= 0.5 AS region
  FROM tr t JOIN ch c USING (frame, unit) JOIN tr p ON p.frame = t.frame AND p.box = t.box JOIN tr q ON q.frame = t.frame AND q.box = c.box), f AS (SELECT frame, count(*) AS n, count(*) FILTER (correct) AS c, count(*) FILTER (region) AS r FROM j GROUP BY 1
), b AS (SELECT *, unnest(['overall', CASE WHEN n = 2 THEN 'n=2' WHEN n = 3 THEN 'n=3' ELSE 'n>=4' END]) AS bucket FROM f)
SELECT bucket, count(*) AS frames, CAST(sum(n) AS BIGINT) AS units, round(sum(c) / sum(n), 6) AS accuracy, round((sum(n) - sum(c)) / sum(n), 6) AS wrong_rate, round(sum(r) / sum(n), 6) AS region_rate FROM b GROUP BY 1""")
def matching_report(spark, d):
    """How often the order from left to right gives each unit its box, by the frame's number of units."""
    t = _truth(spark, d)
    p = t.select("frame", "box", *[F.col(f"a{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    q = t.select("frame", F.col("box").alias("true_box"), *[F.col(f"a{c}").alias(f"q{c}") for c in ("x1", "y1", "x2", "y2")])
    near = p.join(q, "frame").where(G.iou(G.box("p"), G.box("q")) >= 0.5).select("frame", "box", "true_box")
    out = matching.matching_report(t, _left_to_right(t), "frame", "unit", "box", near)
    return rounded(out, "accuracy", "wrong_rate", "region_rate")


@query()
def seat_assignment(spark, d):
    """Events as places: each joins the nearest seat of its user or opens one; tested against a plain loop."""
    ev = events(spark, d).withColumns({"x": F.col("value") * 3, "y": F.col("k").cast("double"), "span": F.lit(40.0)})
    return matching.seats(ev, "user_id", ["us", "event_id"], "x", "y", "span").select("user_id", "event_id", "seat")


@query()
def box_tracks(spark, d):
    """Boxes of ten frames at a time as detections of a tracker; tested against a plain loop."""
    a = _boxes(spark, d, "a", 0).withColumns({"video": F.floor(F.col("frame") / 10), "at": F.col("frame") % 10})
    box = F.array(*[F.col(f"a{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])
    dets = a.groupBy("video", "at").agg(F.sort_array(F.collect_list(F.struct(F.col("aid").alias("det"), box.alias("box"), F.lit(None).cast("array<double>").alias("feature")))).alias("dets"))
    return matching.tracks(dets, "video", "at", "score", ["box"], min_hits=2, max_age=3).select("video", "at", F.size("tracks").alias("n"), F.array_join(F.transform("tracks", lambda t: t["track"].cast("string")), ",").alias("tracks"))


@query("WITH c AS (SELECT l_orderkey, string_agg('Student ' || CAST(l_linenumber AS VARCHAR) || ': ' || lower(l_returnflag) || ' ' || l_linestatus || CASE WHEN l_partkey % 3 > 0 THEN ', tax ' || CAST(l_partkey AS VARCHAR) ELSE '' END || '.', ' ' ORDER BY l_linenumber, l_partkey) AS t FROM lineitem GROUP BY 1) SELECT l_linenumber AS unit, lower(l_returnflag) || ' ' || l_linestatus AS action, l_partkey % 3 > 0 AS valid, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def caption_units(spark, d):
    """Units read out of captions that were made from an order's lines."""
    l = table(spark, d, "lineitem")  # noqa: E741
    one = F.concat(F.lit("Student "), F.col("l_linenumber").cast("string"), F.lit(": "), F.lower("l_returnflag"), F.lit(" "), F.col("l_linestatus"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit(", tax "), F.col("l_partkey").cast("string"))).otherwise(""), F.lit("."))
    caption = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("s")))), lambda x: x["s"]), " ").alias("t"))
    units = caption.select(F.inline(matching.units_of(F.col("t"))))
    return units.groupBy("unit", "action", "valid").agg(F.count("*").alias("n"))


_WORDS = "list_filter(string_split(regexp_replace(coalesce(text, ''), '[^\\x21-\\x7E]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _said(i: int, j: int):
    """Words i to j of a text, ASCII only (word boundaries of other letters are a matter of the regex engine)."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7E]+", " "), " "), lambda x: x != "")
    return F.array_join(F.slice(words, i, j - i + 1), " ")


def _said_sql(i: int, j: int) -> str:
    return f"array_to_string(({_WORDS})[{i}:{j}], ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(texts_: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, texts_)) + "]"


#: parts between the words of a turn, by turn modulo their number
_DRESS = [(" A male student wearing a black floral hijab , and he ", " with a beard ."), (" The bearded man in an turban or a moustache saw HIM ", " , her mustache and head  scarf ."), (" She, a Female Student with a niqab ", " and a beard, his book")]


def _neutral_sql() -> str:
    t = f"({_said_sql(1, 3)} || CASE turn % 3 " + " ".join(f"WHEN {i} THEN {_quoted(a)} || {_said_sql(4, 7)} || {_quoted(b)}" for i, (a, b) in enumerate(_DRESS)) + " END)"
    for pattern, to in texts.NEUTRAL:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        t = f"regexp_replace({t}, {_quoted(pattern.removeprefix('(?i)'))}, {_quoted(to.replace('$1', chr(92) + '1'))}, '{flags}')"
    return f"SELECT conv_id, turn, trim({t}) AS caption FROM conversations"


@query(_neutral_sql())
def neutral_captions(spark, d):
    """Words of each turn with descriptions of people between them, taken out again."""
    t = F.col("turn") % 3
    part = lambda i: F.when(t == 0, _DRESS[0][i]).when(t == 1, _DRESS[1][i]).otherwise(_DRESS[2][i])
    made = F.concat(_said(1, 3), part(0), _said(4, 7), part(1))
    return table(spark, d, "conversations").select("conv_id", "turn", texts.neutralised(made).alias("caption"))


_GUESSED = [", possibly tired,", ", and it seems to rain.", " is not there,", " in the light, which appears dim,", " as I expected."]


def _certain_sql() -> str:
    guess = f"{_listed(_GUESSED)}[1 + (conv_id + turn) % {len(_GUESSED)}]"
    made = f"{_said_sql(1, 4)} || {guess} || ' ' || {_said_sql(5, 9)} || '. With ' || {_said_sql(1, 2)} || ', perhaps ' || {_said_sql(3, 4)} || ', it ends. Fine.'"
    doubtful = f"len(list_filter({_listed(texts.GUESSES)}, lambda g: contains(s, g))) > 0"
    rest = f"trim(regexp_replace(s, {_quoted(texts.DOUBTFUL_CLAUSE)}, '', 'g'))"
    return rf"""WITH c AS (SELECT conv_id, turn, string_split(regexp_replace({made}, '\.\s+', '.' || chr(1), 'g'), chr(1)) AS l FROM conversations
), r AS (SELECT conv_id, turn, list_transform(l, lambda s: CASE WHEN NOT {doubtful} THEN trim(s) ELSE list_transform([{rest}], lambda r: CASE WHEN ends_with(r, '.') THEN r ELSE r || '.' END)[1] END) AS l, list_transform(l, lambda s: {doubtful}) AS g FROM c)
SELECT conv_id, turn, trim(array_to_string(list_filter(l, lambda s, i: NOT g[i] OR (trim(s) <> '.' AND NOT list_contains({_listed(texts.PREPOSITIONS)}, lower(regexp_extract(trim(s), '^\S+'))))), ' ')) AS caption FROM r"""


@query(_certain_sql())
def certain_captions(spark, d):
    """Words of each turn as sentences with guesses in them, without the clauses that guess."""
    guess = F.element_at(F.array(*map(F.lit, _GUESSED)), (1 + (F.col("conv_id") + F.col("turn")) % len(_GUESSED)).cast("int"))
    made = F.concat(_said(1, 4), guess, F.lit(" "), _said(5, 9), F.lit(". With "), _said(1, 2), F.lit(", perhaps "), _said(3, 4), F.lit(", it ends. Fine."))
    return table(spark, d, "conversations").select("conv_id", "turn", texts.without_guesses(made).alias("caption"))


_ANSWERS = ["The two ", "red/blue; (ten) ", "3.5 m. an ", "none, a dog's "]


def _normal_sql() -> str:
    t = f"{_listed(_ANSWERS)}[1 + turn % 4] || {_said_sql(1, 6)} || '.'"
    t = f"replace(replace(lower({t}), ',', ''), '?', '')"
    t = f"trim(regexp_replace(trim(replace({t}, {_quoted(chr(39) + 's')}, {_quoted(' ' + chr(39) + 's')})), '[\\n\\t]', ' ', 'g'))"
    marks = "w"
    for m in texts.MARKS:
        loose = f"contains(w, {_quoted(m + ' ')}) OR contains(w, {_quoted(' ' + m)})"
        marks = f"replace({marks}, {_quoted(m)}, CASE WHEN {loose} THEN '' ELSE ' ' END)"
    digits = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in texts.NUMBERS.items()) + " ELSE x END"
    return rf"""WITH a AS (SELECT conv_id, turn, {t} AS w FROM conversations
), m AS (SELECT conv_id, turn, {marks} AS t FROM a), n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '\.+([^0-9.]|$)', '\1', 'g'), '\.+(\.[0-9])', '\1', 'g') AS t FROM m)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(string_split_regex(lower(t), '\s+'), lambda x: x <> ''), lambda x: {digits}), lambda x: NOT list_contains({_listed(texts.ARTICLES)}, x)), ' ') AS answer FROM n"""


@query(_normal_sql())
def normal_answers(spark, d):
    """Words of each turn as an answer, in its normal form."""
    head = F.element_at(F.array(*map(F.lit, _ANSWERS)), (1 + F.col("turn") % 4).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", texts.normal_answer(F.concat(head, _said(1, 6), F.lit("."))).alias("answer"))


@query("WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), c AS (SELECT item_id, w[1:3] AS p, array_to_string(w[1:3], '. ') || '.' AS c FROM w) SELECT item_id, c AS caption, CAST(position(lower(p[len(p)]) IN lower(c)) - 1 AS BIGINT) AS last_from FROM c")
def caption_spans(spark, d):
    """Captions of the first three words of each item, and where the last of them first is."""
    words = F.slice(F.split("text", " "), 1, 3)
    s = texts.caption_spans(words)
    return table(spark, d, "benchmark").select("item_id", s["caption"].alias("caption"), F.element_at(s["spans"], -1)["a"].cast("long").alias("last_from"))


_REVIEW = "CASE turn % 4 WHEN 0 THEN CAST(length(text) % 10 AS VARCHAR) || ' 7.5' || chr(10) || text WHEN 1 THEN length(text) % 10 || ', ' || turn || chr(10) WHEN 2 THEN text ELSE 'good ' || length(text) END"


@query(rf"""WITH r AS (SELECT conv_id, turn, {_REVIEW} AS r, upper(trim(substr(text, 1 + CAST(length(text) % 7 AS INTEGER), 1))) AS a FROM conversations), p AS (SELECT *, list_filter(string_split_regex(replace(string_split(r, chr(10))[1], ',', ' '), '\s+'), lambda x: x <> '') AS p FROM r), q AS (SELECT *, len(p) = 2 AND TRY_CAST(p[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL AS ok FROM p)
SELECT conv_id, turn, CASE WHEN ok THEN TRY_CAST(p[1] AS DOUBLE) END AS first, CASE WHEN ok THEN TRY_CAST(p[2] AS DOUBLE) END AS second, CAST(list_position(['A', 'B', 'C', 'D', 'E'], a) - 1 AS INTEGER) AS choice FROM q""")
def review_answers(spark, d):
    """Scores read from the first line of reviews with the turn's text, and a letter of it as a choice."""
    n, t, text = F.length("text"), F.col("turn") % 4, F.col("text")
    score = (n % 10).cast("string")
    review = F.when(t == 0, F.concat(score, F.lit(" 7.5\n"), text)).when(t == 1, F.concat(score, F.lit(", "), F.col("turn").cast("string"), F.lit("\n"))).when(t == 2, text).otherwise(F.concat(F.lit("good "), n.cast("string")))
    s = texts.review_scores(review)
    return table(spark, d, "conversations").select("conv_id", "turn", s["first"].alias("first"), s["second"].alias("second"), texts.choice_index(F.substring("text", 1 + n % 7, 1), list("ABCDE")).alias("choice"))
