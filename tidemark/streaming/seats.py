"""Seat numbers that stay with places while track numbers change: as a fold over a table and as a stream with state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.matching import in_order


@dataclass(frozen=True)
class SeatRules:
    """least_iou, reach: a box fits a seat by its overlap or, failing that, by the distance of the centres as a share of the shorter of the
    boxes' longer sides. keep_s: after a longer pause a seat starts anew. settle_s: a seat seen for less is forgotten when left. fold_s: so long
    after it opened a seat may turn out to be another one. same_iou: an empty seat over a taken one is the same place. follow: share of the new
    box in the seat's."""

    least_iou: float = 0.3
    reach: float = 0.5
    keep_s: float = 10.0
    settle_s: float = 2.0
    fold_s: float = 5.0
    same_iou: float = 0.5
    follow: float = 0.1


def overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    size = lambda v: max(v[2] - v[0], 0.0) * max(v[3] - v[1], 0.0)
    return both / (size(a) + size(b) - both + 1e-6)


def fit(box, place, rules: SeatRules) -> float | None:
    """How well a box fits a seat's: 1 and the overlap, or less than that by distance; None if it does not."""
    o = overlap(box, place)
    if o >= rules.least_iou:
        return 1 + o
    longer = lambda v: max(v[2] - v[0], v[3] - v[1])
    unit = max(1.0, min(longer(box), longer(place)))
    dx, dy = ((box[i] + box[i + 2] - place[i] - place[i + 2]) / 2 for i in (0, 1))
    far = (dx * dx + dy * dy) ** 0.5 / unit
    return 1 - far / rules.reach if far <= rules.reach else None


def no_seats() -> dict:
    """seats: number -> box (None before its first frame), seen, first, on (seconds taken), opened (None once settled); live: track -> seat."""
    return {"seats": {}, "live": {}, "free": [], "next": 1, "last": None}


class _Frame:
    """One frame's changes to a registry."""

    def __init__(self, state: dict, t: float, boxes: dict, rules: SeatRules):
        self.state, self.t, self.boxes, self.rules = state, t, boxes, rules
        self.seats, self.live = state["seats"], state["live"]
        self.events, self.cleared, self.moved = [], [], []

    def tell(self, track, seat, how):
        self.events.append({"track": track, "seat": seat, "how": how})

    def forget(self, seat):
        del self.seats[seat]
        self.state["free"] = sorted({*self.state["free"], seat})

    def places(self, but=()):
        """Seats that nobody has and that have been seen."""
        taken = {*self.live.values(), *but}
        return [s for s, v in self.seats.items() if s not in taken and v["box"] is not None]

    def leave(self):
        """Tracks that have jumped away from their seat, and those that are gone."""
        for track, seat in list(self.live.items()):
            held = self.seats[seat]
            here = track in self.boxes
            if here and (held["box"] is None or fit(self.boxes[track], held["box"], self.rules) is not None):
                continue
            del self.live[track]
            held["opened"] = None
            if here:
                self.tell(track, seat, "jumped")
            elif held["seen"] - held["first"] < self.rules.settle_s:
                self.forget(seat)

    def merge(self):
        """Empty seats on the spot of a taken one: the one longer in use keeps its number."""
        for seat in self.places():
            whose = {s: k for k, s in self.live.items()}
            settled = [s for s in sorted(whose) if self.seats[s]["box"] is not None and self.seats[s]["opened"] is None]
            same = next((s for s in settled if overlap(self.seats[seat]["box"], self.seats[s]["box"]) >= self.rules.same_iou), None)
            if same is None:
                continue
            old, now = self.seats[seat], self.seats[same]
            if old["on"] > now["on"]:
                old["box"], old["on"] = now["box"], old["on"] + now["on"]
                self.live[whose[same]] = seat
                self.forget(same)
                self.moved.append({"source": same, "target": seat})
                self.tell(whose[same], seat, "merged")
            else:
                self.forget(seat)
                self.cleared.append(seat)

    def take(self):
        """New tracks take the empty seats they fit best, then new numbers, the lowest free one first."""
        new = [k for k in self.boxes if k not in self.live]
        ways = [(f, -s, k) for k in new for s in self.places() if (f := fit(self.boxes[k], self.seats[s]["box"], self.rules)) is not None]
        used = set()
        for _, low, track in sorted(ways, reverse=True):
            if track in self.live or -low in used:
                continue
            used.add(-low)
            self.live[track] = -low
            late = self.t - self.seats[-low]["seen"] > self.rules.keep_s
            if late:
                self.cleared.append(-low)
            self.tell(track, -low, "restarted" if late else "resumed")
        for track in new:
            if track not in self.live:
                seat = self.state["free"].pop(0) if self.state["free"] else self.state["next"]
                self.state["next"] = max(self.state["next"], seat + 1)
                self.live[track] = seat
                self.seats[seat] = {"box": None, "seen": self.t, "first": self.t, "on": 0.0, "opened": self.t}
                self.tell(track, seat, "new")

    def fold(self):
        """A track on a seat just opened goes to the empty seat that it is in truth."""
        for track in self.boxes:
            young = self.live[track]
            if self.seats[young]["opened"] is None:
                continue
            fits = [(f, -i, s) for i, s in enumerate(self.places()) if self.seats[s]["opened"] is None and self.t - self.seats[s]["seen"] <= self.rules.fold_s and (f := fit(self.boxes[track], self.seats[s]["box"], self.rules)) is not None]
            if fits:
                self.live[track] = max(fits)[2]
                self.forget(young)
                self.cleared.append(young)
                self.tell(track, self.live[track], "folded")

    def settle(self):
        passed = 0.0 if self.state["last"] is None else max(0.0, self.t - self.state["last"])
        self.state["last"] = self.t
        for track, box in self.boxes.items():
            v = self.seats[self.live[track]]
            v["box"] = list(box) if v["box"] is None else [o + self.rules.follow * (b - o) for o, b in zip(v["box"], box, strict=True)]
            v["seen"], v["on"] = self.t, v["on"] + passed
        for v in self.seats.values():
            if v["opened"] is not None and self.t - v["opened"] > self.rules.fold_s:
                v["opened"] = None

    def run(self) -> tuple[list, list, list, list]:
        for part in (self.leave, self.merge, self.take, self.fold, self.settle):
            part()
        return [{"track": k, "seat": s} for k, s in sorted(self.live.items())], self.events, self.cleared, self.moved


#: Tracks as JSON. (A stream's rows come as named tuples, whose names can't begin with an underscore.)
TOLD = "told_tracks"
_MADE = "seats array<struct<track:bigint,seat:int>>, events array<struct<track:bigint,seat:int,how:string>>, cleared array<int>, moved array<struct<source:int,target:int>>"
_NAMES = [c.split()[0] for c in _MADE.split(", ")]


def _unpacked(registry: str) -> dict:
    """A registry from JSON, whose names are strings."""
    state = json.loads(registry)
    return state | {k: {int(n): v for n, v in state[k].items()} for k in ("seats", "live")}


def _frame(state: dict, t: float, tracks: str | None, rules: SeatRules) -> tuple:
    """One frame of tracks as JSON."""
    boxes = {int(x["track"]): [float(v) for v in x["box"]] for x in json.loads(tracks)} if tracks else {}
    return _Frame(state, float(t), boxes, rules).run()


def _told(df: DataFrame, tracks: str) -> DataFrame:
    """df with tracks as JSON: arrays can't pass through the empty batches of a stream with state."""
    return df.withColumn(TOLD, F.to_json(F.transform(tracks, lambda x: F.struct(x["track"].alias("track"), x["box"].alias("box")))))


def seat_numbers(df: DataFrame, key: str, time: str, tracks: str, rules: SeatRules | None = None) -> DataFrame:
    """(key, time, seats, events, cleared, moved) of each frame of df(key, time in seconds, tracks array<struct<track, box>>).

    A track keeps its seat while its box fits the seat's place. A new track takes the free seat it fits best, however long that was
    empty (resumed; restarted after a pause longer than keep_s: its history is cleared), else a new number, the lowest withdrawn
    one first. A seat left too soon is withdrawn; an empty seat on the place of a taken one is merged with it (moved tells where the
    history goes), a seat just opened is folded into the empty one that its track fits. Null tracks are a frame without any.
    """
    told = rules or SeatRules()
    step = lambda state, row: _frame(state, row[0], row[1], told)
    return in_order(_told(df, tracks), key, [time], [time, TOLD], _MADE, no_seats, step).drop(TOLD)


class SeatProcessor(StatefulProcessor):
    """seat_numbers() of a session whose frames arrive bit by bit. A session's registry is one value of the state, read and written once a micro-batch
    (each call goes through a socket); a timer ends the session after a pause of idle_s in event time, and nothing is kept of it. The timer is
    set once: if it goes off while the session is alive, it is set anew."""

    def __init__(self, key: str, time: str, rules: SeatRules, idle_s: float):
        self.key, self.time, self.rules, self.idle_s = key, time, rules, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "registry string")

    def _due(self, state: dict) -> int:
        return int((state["last"] + self.idle_s) * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.session.get()
        state, out = (_unpacked(found[0]) if found else no_seats()), []
        for row in sorted(rows, key=lambda r: r[self.time]):
            if state["last"] is not None and row[self.time] - state["last"] > self.idle_s:
                state = no_seats()  # the same session number, but another session
            told = _frame(state, row[self.time], row[TOLD], self.rules)
            out.append(Row(**{self.key: key[0], self.time: row[self.time], **dict(zip(_NAMES, told, strict=True))}))
        if not found:
            self.handle.registerTimer(max(self._due(state), timerValues.getCurrentWatermarkInMs() + 1))
        self.session.update((json.dumps(state),))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self._due(_unpacked(self.session.get()[0]))
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.session.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_seat_numbers(stream: DataFrame, key: str, time: str, tracks: str, idle_s: float, rules: SeatRules | None = None) -> DataFrame:
    """seat_numbers() on a stream of frames (key, time in seconds, tracks) with a watermark: each session's frames of a micro-batch go in order of
    time, after those of earlier batches. The state lives in RocksDB; it ends idle_s after a session's last frame."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(stream.dtypes)
    schema = ", ".join([f"{key} {kinds[key]}", f"{time} double", _MADE])
    rows = _told(stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()), tracks).drop(tracks)
    return rows.groupBy(key).transformWithState(SeatProcessor(key, time, rules or SeatRules(), idle_s), schema, "append", "EventTime")


