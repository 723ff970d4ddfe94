"""Operators on streaming DataFrames: windows, alerts by dwell, admission by rate.

State is held per key. Of one micro-batch a key's rows are sorted in memory, so the size of a micro-batch (maxFilesPerTrigger)
bounds them; nothing else is kept but the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import scratch


def parquet_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The Parquet files of a path or glob as a stream, with the schema they have now; so many files a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_to_end(stream: DataFrame, parts: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """All that the stream yields from the input there is now, appended to Parquet in the shared folder and read again. Each of parts brings more
    input after that and is one micro-batch, which goes on from the state of those before."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append")
    parts = list(parts)
    for bring in parts:
        writer.trigger(once=True).start().awaitTermination()
        bring()
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """(start, *by, n) of each tumbling window that the watermark has closed; rows later than that are dropped."""
    each = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return each.select(F.col("w.start").alias("start"), *by, "n")


def sliding_counts(stream: DataFrame, time: str, by: list[str], width: str, slide: str, late: str) -> DataFrame:
    """(start, *by, n) of each window of that width, one beginning every slide."""
    each = stream.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return each.select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, time: str, key: str, idle: str, late: str, once: list[str] | None = None) -> DataFrame:
    """(key, start, end, n) of each key's sessions: a pause of idle ends one. With once, rows of equal columns within the watermark
    count a single time, so a row that is handed out again is not seen twice."""
    rows = stream.withWatermark(time, late)
    if once:
        rows = rows.dropDuplicatesWithinWatermark(once)
    each = rows.groupBy(F.session_window(time, idle).alias("w"), key).agg(F.count("*").alias("n"))
    return each.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _sorted(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order)


def fold_by_key(stream: DataFrame, key: str, order: list[str], columns: list[str], made: str, state: str, step: Callable, idle: int | None = None) -> DataFrame:
    """Rows (key, *columns, *made) of each key's rows in order: step(state or None, values of columns) gives (state, values of made).

    state is a DDL of its fields. With idle, a key's state is dropped when its rows pause for longer than that (order[0] holds whole
    microseconds): in the next row, as step gets None, and by an event-time timeout once the stream's watermark has passed, so that
    keys that never come back keep nothing. Rows without key or time are no one's and are left out.
    """
    kinds = dict(stream.dtypes)
    out = [key, *columns, *[c.split()[0] for c in made.split(", ")]]
    watched = idle is not None and any(f.metadata.get("spark.watermarkDelayMs") for f in stream.schema.fields)

    def run(keys, frames, group: GroupState):
        if group.hasTimedOut:
            group.remove()
            return
        held = group.get if group.exists else None
        last, own = (held[0], held[1:]) if held else (None, None)
        rows = []
        need = list(dict.fromkeys([*order, *columns]))
        for row in _sorted(frames, order)[need].itertuples(index=False):
            values = dict(zip(need, row, strict=True))
            t = values[order[0]]
            if idle is not None and last is not None and t - last > idle:
                own = None
            own, told = step(own, tuple(values[c] for c in columns))
            last = int(t)
            rows.append((keys[0], *[values[c] for c in columns], *told))
        group.update((last, *own))
        if watched:
            group.setTimeoutTimestamp(max((last + idle) // 1000, group.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=out)

    rows = stream.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    shape = ", ".join([*[f"{c} {kinds[c]}" for c in (key, *columns)], made])
    kind = GroupStateTimeout.EventTimeTimeout if watched else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, shape, f"__last long, {state}", "append", kind)


def smooth_boxes(stream: DataFrame, key: str, order: list[str], box: list[str], ident: str, alpha: float = 0.35, reset: float = 120.0, idle: int | None = None) -> DataFrame:
    """(key, ident, *box, smooth): each box mixed with the one shown before, alpha its own weight; a side that jumps by more than reset
    starts anew."""

    def step(shown, row):
        new = [float(v) for v in row[1:]]
        old = shown[0] if shown else None
        if old is None or max(abs(p - c) for p, c in zip(old, new, strict=True)) > reset:
            out = new
        else:
            out = [alpha * c + (1 - alpha) * p for p, c in zip(old, new, strict=True)]
        return (out,), (out,)

    return fold_by_key(stream, key, order, [ident, *box], "smooth array<double>", "shown array<double>", step, idle)


def smooth_labels(stream: DataFrame, key: str, order: list[str], label: str, ident: str, window: int = 3, margin: int = 0, idle: int | None = None) -> DataFrame:
    """(key, ident, label, shown): the most frequent of the last labels (of equal ones the one shown, then the first in the window); it
    replaces the label shown only with margin more votes than that has."""

    def step(state, row):
        past, shown = (list(state[0]), state[1]) if state else ([], None)
        past = [*past, row[1]][-window:]
        votes = {v: past.count(v) for v in past}
        best = max(votes, key=lambda v: (votes[v], v == shown))
        if shown is not None and best != shown and votes[best] - votes.get(shown, 0) < margin:
            best = shown
        return (past, best), (best,)

    return fold_by_key(stream, key, order, [ident, label], "shown string", "past array<string>, shown string", step, idle)


def with_history(stream: DataFrame, key: str, order: list[str], value: str, ident: str, size: int, least: int, idle: int | None = None) -> DataFrame:
    """(key, ident, value, history, warming): the last size values with this one, and whether there are fewer than least of them."""

    def step(state, row):
        past = [*(state[0] if state else []), float(row[1])][-size:]
        return (past,), (past, len(past) < least)

    return fold_by_key(stream, key, order, [ident, value], "history array<double>, warming boolean", "past array<double>", step, idle)


def predict_every(stream: DataFrame, key: str, order: list[str], frame: str, value: str, ident: str, stride: int, idle: int | None = None) -> DataFrame:
    """(key, ident, frame, value, predicted, held): a key's first row is predicted, then each one stride frames after the last such row;
    the others hold its value."""

    def step(state, row):
        if state is None or row[1] - state[0] >= stride:
            return (int(row[1]), float(row[2])), (True, float(row[2]))
        return tuple(state), (False, float(state[1]))

    return fold_by_key(stream, key, order, [ident, frame, value], "predicted boolean, held double", "at long, held double", step, idle)


def dwell_alerts(stream: DataFrame, key: str, time: str, tie: str, label: str, alerted: list[str], least: int, allowed: str | None = None, idle: int | None = None) -> DataFrame:
    """(key, tie, label, dwell): the first row of each run of one of the alerted labels whose dwell is at least so long and, with a
    column allowed, where that is true (or null).

    Rows whose key, time or label is null are left out. Each key's rows must arrive in order from batch to batch. With idle, a pause longer than
    that ends a run, and the key's state goes (see fold_by_key).
    """
    may = F.coalesce(F.col(allowed), F.lit(True)) if allowed else F.lit(True)

    def step(state, row):
        t, _, v, may = row
        last, since, told = state if state else (None, 0, False)
        if v != last:
            last, since, told = v, int(t), False
        alert = bool(not told and may and v in alerted and t - since >= least)
        return (last, since, told or alert), (int(t) - since, alert)

    rows = stream.where(F.col(label).isNotNull()).withColumn("may_alert", may)
    found = fold_by_key(rows, key, [time, tie], [time, tie, label, "may_alert"], "dwell long, alert boolean", "last string, since long, told boolean", step, idle)
    return found.where("alert").select(key, tie, label, "dwell")


def admit_by_rate(stream: DataFrame, key: str, time: str, arrival: str, period: int, idle: int | None = None) -> DataFrame:
    """(key, arrival, time) of the rows admitted: a key's first, one earlier than the last admitted, or at least period after it. Rows without key or
    time are left out. With idle, a key's state goes after so long a pause (of arrival, in whole microseconds), and its next row is a first one."""

    def step(state, row):
        last, t = state[0] if state else None, int(row[1])
        admitted = last is None or t < last or t - last >= period
        return (t if admitted else last,), (admitted,)

    found = fold_by_key(stream.where(F.col(time).isNotNull()), key, [arrival], [arrival, time], "admitted boolean", "admitted_at long", step, idle)
    return found.where("admitted").select(key, arrival, time)
