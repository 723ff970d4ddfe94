"""Small operations on records and vectors: projections with checks, defaults, comparison of versions, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: fields of an answer by default
DEFAULT_LABEL = {"activity": "other", "gaze_direction": "unknown", "attention_target": "unknown", "engagement_level": "unknown", "posture": "unknown", "hand_state": "unknown", "phone_visible": False, "laptop_visible": False, "talking": False, "occluded": False}


def with_default_label(df: DataFrame) -> DataFrame:
    """df with the default record's fields that it does not have."""
    return df.withColumns({f: F.lit(v) for f, v in DEFAULT_LABEL.items() if f not in df.columns})


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without these columns, whether it has them or not."""
    return df.drop(*columns)


def keeping(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the list that df has, in the list's order."""
    return df.select(*[c for c in columns if c in df.columns])


def blinded(df: DataFrame, labels: list[str]) -> DataFrame:
    """df without labels, captions and confidences, which give the label away."""
    return df.drop(*labels, "caption", "model_confidence")


def complete(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows where none of the needed columns is null, empty or an empty array."""
    kinds = dict(df.dtypes)
    filled = lambda c: F.size(c) > 0 if kinds[c].startswith("array") else F.col(c).cast("string") != ""
    out = df
    for c in needed:
        out = out.where(F.coalesce(filled(c), F.lit(False)))
    return out


def hidden_faces(strict: bool, points: str = "face_kpts", occluded: str = "occluded") -> Column:
    """Occluded with exactly two face points (strict), or with at most two."""
    return F.coalesce(F.col(occluded) & ((F.col(points) == 2) if strict else (F.col(points) <= 2)), F.lit(False))


def with_vector(df: DataFrame, cache: DataFrame, key: list[str], vector: str, width: int) -> DataFrame:
    """df with the cached vector of its key, zeros of that width where there is none; missing tells which."""
    both = df.join(cache.select(*key, vector), key, "left")
    return both.withColumn("missing", F.col(vector).isNull()).withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), width)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def frame_seconds(name: Column) -> Column:
    """Seconds of a frame name t<seconds>_<milliseconds>_...; null for other names."""
    found = lambda i: F.nullif(F.regexp_extract(name, r"^t(\d+)_(\d+)(?:_|$)", i), F.lit(""))
    return found(1).cast("long") + found(2).cast("long") / 1000.0


#: blocks of a feature vector: layout -> block -> [from, to)
Layouts = dict[str, dict[str, tuple[int, int]]]


def compatible(layouts: Layouts, want: str, stored: str, blocks: list[str]) -> bool:
    """Every block lies at the same place in both layouts."""
    return all(b in layouts.get(stored, {}) and layouts.get(want, {}).get(b) == layouts[stored][b] for b in blocks)


def project_blocks(vector: Column, layouts: Layouts, want: str, stored: str, blocks: list[str]) -> Column:
    """The blocks' values in ascending order of place; layouts that disagree on one are an error."""
    if not compatible(layouts, want, stored, blocks):
        raise ValueError(f"{want} can't be read from {stored}")
    spans = sorted(layouts[stored][b] for b in blocks)
    return F.concat(*[F.slice(vector, lo + 1, hi - lo) for lo, hi in spans])


def compare_versions(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, status) of the keys that one version lacks (dropped, added) or whose values differ (changed); equal ones are left out."""
    o = old.select(*key, F.struct(*values).alias("__o"))
    n = new.select(*key, F.struct(*values).alias("__n"))
    both = o.join(n, key, "full")
    status = F.when(F.col("__n").isNull(), "dropped").when(F.col("__o").isNull(), "added").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return both.select(*key, status.alias("status")).where("status IS NOT NULL")


def aligned(a: DataFrame, b: DataFrame, key: list[str], truth: str, value: str) -> DataFrame:
    """(key, truth, a, b) of two systems' rows; a key of one side alone, or another truth, is an error as soon as the row is read."""
    left, right = a.select(*key, F.col(truth).alias("__ta"), F.col(value).alias("a"), F.lit(True).alias("__a")), b.select(*key, F.col(truth).alias("__tb"), F.col(value).alias("b"), F.lit(True).alias("__b"))
    both = left.join(right, key, "full")
    fine = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__ta").eqNullSafe(F.col("__tb"))
    return both.select(*key, F.when(fine, F.col("__ta")).otherwise(F.raise_error(F.lit("rows of the two systems do not match")).cast(dict(a.dtypes)[truth])).alias(truth), "a", "b")


def grouped_frames(df: DataFrame, frame: str, order: str, members: list[str], least: int, most: int | None = None) -> DataFrame:
    """(frame, n, members) of the frames with at least so many rows: their members in order. With most, the first so many frames by
    name."""
    g = df.groupBy(frame).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, *members))).alias("members")).where(F.col("n") >= least)
    return g if most is None else g.orderBy(frame).limit(most)


def nearest_match(rows: DataFrame, reference: DataFrame, frame: str, row: str, ref_id: str, iou: Column, cue: str, ref_cue: str, least: float = 0.5) -> DataFrame:
    """(frame, ref_id, matched, agree) for each reference row: whether a row of its frame overlaps it by more than least, and whether
    the one that overlaps most (of equal ones that with the smallest number row) has the same cue."""
    both = reference.join(rows, frame).withColumn("__iou", iou).where(F.col("__iou") > least)
    best = both.groupBy(frame, ref_id).agg(F.max_by(F.col(cue) == F.col(ref_cue), F.struct("__iou", -F.col(row))).alias("agree"))
    return reference.select(frame, ref_id).join(best, [frame, ref_id], "left").select(frame, ref_id, F.col("agree").isNotNull().alias("matched"), F.coalesce("agree", F.lit(False)).alias("agree"))


def modulo_shard(df: DataFrame, group: str, shards: int, shard: int) -> DataFrame:
    """The groups whose place among all groups, in order, is shard modulo shards; a group is never cut."""
    from .resample import numbered

    places = numbered(df.select(group).distinct(), group).where(F.col("i") % shards == shard).select(group)
    return df.join(places, group, "left_semi")


def shard_names(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds shard (shard_000, ...): so many rows each, by their numbers (see resample.numbered)."""
    from .resample import numbered

    return numbered(df, key).withColumn("shard", F.format_string("shard_%03d", F.floor(F.col("i") / size))).drop("i")


def disjoint_union(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts; a key in more than one row is an error as soon as it is read."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.count("*").over(Window.partitionBy(key))
    return out.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.lit("a key is in more than one part")).cast(dict(out.dtypes)[key])))


def validate_corpus(df: DataFrame, malformed: str, path: str, existing: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """(problem, n): malformed lines, files that are missing, and required terms that no text has."""
    bad = df.agg(F.count(malformed).alias("n")).select(F.lit("malformed").alias("problem"), "n")
    missing = df.where(F.col(path).isNotNull()).join(existing, path, "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing file").alias("problem"), "n")
    seen = df.agg(*[F.count_if(F.contains(F.lower(text), F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(terms)])
    absent = seen.select(F.inline(F.array(*[F.struct(F.lit(f"term {t}").alias("problem"), (F.col(f"t{i}") == 0).cast("long").alias("n")) for i, t in enumerate(terms)])))
    return bad.unionByName(missing).unionByName(absent).where("n > 0")


def channel_stats(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """(by, mean, std, p25, p50, p75, lo, hi, bright) of arrays of values: population deviation, exact quartiles, the share over 200."""
    each = df.select(*by, F.explode(values).alias("v"))
    p = lambda q: F.percentile("v", F.lit(q))
    return each.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg((F.col("v") > 200).cast("double")).alias("bright"))


def frame_summary(df: DataFrame, frame: str, cue: str, warming: Column, off_task: list[str]) -> DataFrame:
    """(frame, n, warming, off_task, share, by_cue) of the people in a frame; those still warming up count in n alone. share is 0 where
    nobody is decided."""
    decided = ~F.coalesce(warming, F.lit(False))
    off = F.coalesce(decided & F.col(cue).isin(off_task), F.lit(False))
    counts = df.where(decided).groupBy(frame, cue).agg(F.count("*").alias("c")).groupBy(frame).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(cue, "c")))).alias("by_cue"))
    s = df.groupBy(frame).agg(F.count("*").alias("n"), F.count_if(~decided).alias("warming"), F.count_if(off).alias("off_task"))
    return s.join(counts, frame, "left").withColumn("share", F.col("off_task") / F.greatest(F.col("n") - F.col("warming"), F.lit(1)))


def latency_report(df: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """(by, n, fps_mean, fps_p50, ms_mean, ms_p50, ms_p90, ms_p95, ms_p99, ms_max, drop_25, drop_10) of frame times; drop: the share too
    slow for 25 or 10 frames a second."""
    p = lambda q: F.percentile(seconds, F.lit(q)) * 1000
    late = lambda fps: F.avg((F.col(seconds) > 1.0 / fps).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), (1 / F.avg(seconds)).alias("fps_mean"), (1 / F.percentile(seconds, F.lit(0.5))).alias("fps_p50"), (F.avg(seconds) * 1000).alias("ms_mean"), p(0.5).alias("ms_p50"), p(0.9).alias("ms_p90"), p(0.95).alias("ms_p95"), p(0.99).alias("ms_p99"), (F.max(seconds) * 1000).alias("ms_max"), late(25).alias("drop_25"), late(10).alias("drop_10"))


def tag_scores(df: DataFrame, predicted: str, true: str, eps: float = 1e-9) -> DataFrame:
    """(tag, n, precision, recall) of arrays of tags, and their means (tag null); eps is added to both denominators. Tags in the
    predictions alone count with recall 0."""
    p = df.select(F.monotonically_increasing_id().alias("i"), F.array_distinct(predicted).alias("p"), F.array_distinct(true).alias("t"))
    hits = p.select(F.explode(F.array_intersect("p", "t")).alias("tag")).groupBy("tag").agg(F.count("*").alias("tp"))
    called = p.select(F.explode("p").alias("tag")).groupBy("tag").agg(F.count("*").alias("called"))
    truth = p.select(F.explode("t").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    s = truth.join(called, "tag", "full").join(hits, "tag", "left").na.fill(0, ["tp", "called", "n"])
    one = s.select("tag", "n", (F.col("tp") / (F.col("called") + eps)).alias("precision"), (F.col("tp") / (F.col("n") + eps)).alias("recall"))
    return one.unionByName(one.agg(F.lit(None).cast("string").alias("tag"), F.sum("n").alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")))
