"""Detections and truths frame by frame: whole frames come to one task, many of them in one batch of flat columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box

#: Pairs that are looked at together.
PAIRS = 1 << 20


def starts(columns: list[pa.Array]) -> np.ndarray:
    """Where the values of sorted columns differ from those of the row before; nulls are equal."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        c = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by key; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = int(np.flatnonzero(starts([batch.column(k) for k in key]))[-1])
        same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in key)
        if at == 0 and same:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at)] if at else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def near(of_d: np.ndarray, of_t: np.ndarray, over: Callable, least: Callable | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, o) of the detections i and truths j of one frame, of_d and of_t their frames in order, with over(i, j) = o at least least."""
    many = int(max(of_d[-1:].max(initial=-1), of_t[-1:].max(initial=-1))) + 1
    n = np.bincount(of_t, minlength=many)
    begin, each = (np.cumsum(n) - n)[of_d], n[of_d]
    upto = np.cumsum(each)
    found, a = [], 0
    while a < len(of_d):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(a, b), each[a:b])
        j = np.repeat(begin[a:b] - (upto[a:b] - each[a:b]), each[a:b]) + np.arange(upto[a] - each[a], upto[b - 1])
        o = over(i, j)
        ok = o >= (least(j) if callable(least) else least)
        found.append((i[ok], j[ok], o[ok]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def first_of(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Positions of each group's first row by order."""
    by = np.lexsort((*order[::-1], group))
    return by[np.r_[True, group[by][1:] != group[by][:-1]]] if len(by) else by


def area(b: np.ndarray) -> np.ndarray:
    return np.fmax(b[:, 2] - b[:, 0], 0) * np.fmax(b[:, 3] - b[:, 1], 0)


def intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, h = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    return np.fmax(w, 0) * np.fmax(h, 0)


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return np.where(u > 0, i / np.where(u > 0, u, 1), 0.0)


def iof(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return intersection(a, b) / np.fmax(area(a), 1e-6)


def greedy(det: np.ndarray, score: np.ndarray, of_d: np.ndarray, i: np.ndarray, j: np.ndarray, order: np.ndarray, gt: np.ndarray, ignored: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A mark for each detection: 1 where it takes a truth, -1 where it only meets an ignored one, 0 else. By score (ties by det) each takes the
    first of its offers (i, j) by order (ties by gt[j]) whose truth is free; one with again[j] may be taken again and again."""
    by = np.lexsort((det, -score, of_d))
    place = np.empty(len(det), np.int64)
    n = np.bincount(of_d) if len(of_d) else np.zeros(0, int)
    place[by] = np.arange(len(det)) - (np.cumsum(n) - n)[of_d[by]]
    turn = np.lexsort((gt[j], order, i, place[i]))
    i, j = i[turn], j[turn]
    cut = np.searchsorted(place[i], np.arange((place[i].max() if len(i) else -1) + 2))
    used, mark = np.zeros(len(gt), bool), np.zeros(len(det), np.int32)
    for a, b in zip(cut, cut[1:], strict=False):
        free = a + np.flatnonzero(~used[j[a:b]])
        one = free[np.r_[True, i[free][1:] != i[free][:-1]]] if len(free) else free
        mark[i[one]] = np.where(ignored[j[one]], -1, 1)
        used[j[one[~again[j[one]]]]] = True
    return mark


def per_frame(dets: DataFrame, truth: DataFrame, key: list[str], box_d: Box, box_t: Box, flags: dict[str, Column], made: str, fold: Callable, keep: list[str] | None = None, deal: list[str] | None = None, above: tuple[str, DataFrame] | None = None) -> DataFrame:
    """(key, det, score, *keep, *made) of dets(key, det, score, ...), whose det is a whole number and unique in its key like the gt of truth(key, gt, ...).

    fold(d, t) of many keys at once: d and t have `of` (the number of the key, in order), id, box, d has score and t the flags; it gives the positions
    of the detections to be told and the columns made. Rows are shuffled once, by deal (columns of key), a frame's rows are in memory.
    above: a column of key and its closure(cls, above), by which a row counts for the classes above its own too.
    """
    kinds, deal, keep = dict(dets.dtypes), deal or key, keep or []
    side = lambda t, det, ident, score, box, own, other: t.select(*key, F.lit(det).alias("__det"), F.col(ident).cast("bigint").alias("__id"), score.cast("double").alias("__score"), *[v.cast("double").alias(f"__{i}") for i, v in enumerate(box)], *own, *other)
    whole = truth.dropna(subset=key)
    kind_of = {n: "boolean" if whole.select(c).dtypes[0][1] == "boolean" else "double" for n, c in flags.items()}
    flag = lambda make: [F.coalesce(make(n).cast(kind_of[n]), F.lit(0).cast(kind_of[n])).alias(f"__f_{n}") for n in flags]
    one = side(dets, True, "det", F.col("score"), box_d, flag(lambda n: F.lit(0)), keep)
    two = side(whole, False, "gt", F.lit(0.0), box_t, flag(lambda n: flags[n]), [F.lit(None).cast(kinds[c]).alias(c) for c in keep])
    rows = one.unionAll(two).repartition(*deal)
    if above:
        cls, closure = above
        up = closure.groupBy(F.col("cls").alias("__cls")).agg(F.collect_list("above").alias("__above"))
        rows = rows.join(up, F.col(cls) == F.col("__cls"), "left").withColumn("__above", F.coalesce("__above", F.array(cls))).drop("__cls")
        rows = rows.sortWithinPartitions(*deal).withColumn(cls, F.explode("__above")).drop("__above")
    else:
        rows = rows.sortWithinPartitions(*deal)
    names, told_flags = [c.split()[0] for c in made.split(", ")], list(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, deal):
            table = table.combine_chunks()
            group = np.zeros(table.num_rows, np.int64)
            for k in key:
                code = pc.fill_null(table.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
            by = np.argsort(group, kind="stable")
            is_det = table.column("__det").to_numpy()[by]
            got = lambda c, at: table.column(c).to_numpy()[at]  # noqa: B023, E731
            d_at, t_at = by[is_det], by[~is_det]
            d, t = ({"of": group[at], "id": got("__id", at), "box": np.stack([got(f"__{i}", at) for i in range(4)], 1)} for at in (d_at, t_at))
            d["score"] = got("__score", d_at)
            t |= {n: got(f"__f_{n}", t_at) for n in told_flags}
            told, columns = fold(d, t)
            out = table.take(pa.array(d_at[told]))
            yield from pa.Table.from_arrays([*[out.column(c) for c in (*key, "__id", "__score", *keep)], *map(pa.array, columns)], names=[*key, "det", "score", *keep, *names]).to_batches()

    shape = [*[f"{c} {kinds[c]}" for c in key], "det bigint", "score double", *[f"{c} {kinds[c]}" for c in keep], made]
    return rows.mapInArrow(run, ", ".join(shape))
