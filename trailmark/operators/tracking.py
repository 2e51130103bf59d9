"""Visits from detections: who is where, since when, and when a visit counts.

One camera's state is small: its open visits and the places where things are parked. The same step runs in a batch, over
partitions sorted by camera and time with only the current camera's state in memory, and in a stream, where Spark keeps
each camera's state between micro-batches. A frame has a few boxes, so they are plain tuples: arrays of one or two boxes
cost many times their arithmetic.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x1, y1, x2, y2.
Edges = tuple[float, float, float, float]

#: The speed of what stands still.
STANDS = (0.0, 0.0)

OUTPUT = "camera_id string, visit long, kind string, label string, started double, at double, top_score double, median_score double, hits long, x1 double, y1 double, x2 double, y2 double"


@dataclass(frozen=True)
class Settings:
    match: float = 0.3
    same_place: float = 0.6
    still: float = 0.8
    least_hits: int = 3
    least_score: float = 0.3
    least_movement: float = 0.15
    movers: tuple[str, ...] = ("vehicle",)
    moving_seconds: float = 0.6
    missed_seconds: float = 4.0
    parked_seconds: float = 20.0
    forget_seconds: float = 1800.0
    update_seconds: float = 1.0
    scores_kept: int = 100
    border: float = 0.01
    balanced: float = 0.3
    #: A visit of this length ends and goes on as another one; None: visits may be of any length.
    longest_seconds: float | None = None
    #: The labels whose visits are told; None: all.
    labels: tuple[str, ...] | None = None
    #: Before each frame, open visits not seen for so long are told as due for a look, where they are expected; None: none.
    due_seconds: float | None = None


@dataclass
class Visit:
    number: int
    label: str
    started: float
    seen: float
    edges: Edges
    origin: Edges
    anchor: Edges
    still_since: float
    parked: bool
    speed: tuple[float, float] = STANDS
    hits: int = 0
    scores: list[float] = field(default_factory=list)
    #: The scores that are numbers, in order.
    ranked: list[float] = field(default_factory=list)
    counts: bool = False
    moved: bool = False
    moving_since: float | None = None
    told: float = 0.0

    @property
    def box(self) -> np.ndarray:
        return np.array(self.edges)

    def scored(self, score: float, most: int) -> None:
        """Takes in a score and forgets the oldest of more than so many."""
        self.scores.append(score)
        if score == score:
            insort(self.ranked, score)
        if 0 < most < len(self.scores):
            old = self.scores.pop(0)
            if old == old:
                del self.ranked[bisect_left(self.ranked, old)]

    def median(self) -> float:
        """The median of the scores; no number if one of them is none."""
        n = len(self.scores)
        if len(self.ranked) < n:
            return float("nan")
        return self.ranked[n // 2] if n % 2 else (self.ranked[n // 2 - 1] + self.ranked[n // 2]) / 2

    def ahead(self, seconds: float) -> Edges:
        """Where the box is expected so much later."""
        (x1, y1, x2, y2), dx, dy = self.edges, self.speed[0] * seconds, self.speed[1] * seconds
        return x1 + dx, y1 + dy, x2 + dx, y2 + dy


def overlap(a: Sequence[float], b: Sequence[float]) -> float:
    """IoU of two boxes; 0 if an edge is no number."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    area_a = (0.0 if ax2 < ax1 else ax2 - ax1) * (0.0 if ay2 < ay1 else ay2 - ay1)
    area_b = (0.0 if bx2 < bx1 else bx2 - bx1) * (0.0 if by2 < by1 else by2 - by1)
    wide = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
    high = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
    both = (0.0 if wide < 0 else wide) * (0.0 if high < 0 else high)
    union = area_a + area_b - both
    return both / union if union > 0 else 0.0


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b."""
    return np.array([[overlap(x, y) for y in b.tolist()] for x in a.tolist()]).reshape(len(a), len(b))


def really_moved(origin: Sequence[float], now: Sequence[float], s: Settings) -> bool:
    """The rule of functions.geometry.has_moved for two boxes."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = origin, now
    left, top, right, low = bx1 - ax1, by1 - ay1, bx2 - ax2, by2 - ay2
    near, far = s.border, 1 - s.border
    wide_seen = near <= ax1 <= far and near <= bx1 <= far and near <= ax2 <= far and near <= bx2 <= far
    dx = dy = 0.0
    if wide_seen and left * right > 0:
        dx = min(abs(left), abs(right))
    if top * low > 0 and near <= ay1 <= far and near <= by1 <= far and near <= ay2 <= far and near <= by2 <= far:
        dy = min(abs(top), abs(low))
    w0, h0 = 0.0 if ax2 < ax1 else ax2 - ax1, 0.0 if ay2 < ay1 else ay2 - ay1
    if hypot(dx, dy) > s.least_movement * hypot(w0, h0):
        return True
    if not (wide_seen and -left * right > 0 and min(abs(left), abs(right)) >= s.balanced * max(abs(left), abs(right))):
        return False
    w1, h1 = 0.0 if bx2 < bx1 else bx2 - bx1, 0.0 if by2 < by1 else by2 - by1
    ratio = max(w1 * h1, 1e-7) / max(w0 * h0, 1e-7)
    before = max(w0, 1e-7) / max(h0, 1e-7)
    # A box of no width beside its height can't be compared in shape.
    return bool(before and abs(max(w1, 1e-7) / max(h1, 1e-7) / before - 1) <= 0.25 and not 0.55 <= ratio <= 1.8)


class Camera:
    """The state of one camera and what one frame does to it."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.s, self.visits, self.places, self.last = settings, [], [], 0
        #: places: [label, box, last seen] of parked things.

    def tell(self, v: Visit, kind: str, at: float) -> tuple:
        return (v.number, kind, v.label, v.started, at, max(0.0, v.ranked[-1]) if v.ranked else 0.0, v.median() if v.scores else 0.0, v.hits, *v.edges)

    def ends(self, v: Visit, at: float) -> list[tuple]:
        """The end of a visit, if its start was told."""
        wanted = self.s.labels is None or v.label in self.s.labels
        return [self.tell(v, "ended", at)] if v.counts and wanted else []

    def lapse(self, at: float) -> list[tuple]:
        """Ends visits that nothing was seen of for longer than allowed."""
        kept = [v for v in self.visits if at - v.seen <= self.s.missed_seconds]
        if len(kept) == len(self.visits):
            return []
        gone = [v for v in self.visits if at - v.seen > self.s.missed_seconds]
        self.visits = kept
        return [t for v in gone if not v.parked for t in self.ends(v, v.seen)]

    def to_look_at(self, at: float) -> list[tuple]:
        """Open visits that are due for a look, with the boxes where they are expected, within the picture."""
        if self.s.due_seconds is None:
            return []
        inside = lambda x: 1.0 if x > 1.0 else x if x > 0.0 or x != x else 0.0
        due = [v for v in self.visits if at - v.seen >= self.s.due_seconds]
        return [(*self.tell(v, "due", at)[:-4], *map(inside, v.ahead(min(at - v.seen, 2.0)))) for v in due]

    def has_confirmed(self) -> bool:
        """Whether something is there that counts and isn't parked: it explains motion."""
        return any(v.counts and not v.parked for v in self.visits)

    def due(self) -> float | None:
        """The time after which the next open visit lapses if nothing more is seen."""
        return min((v.seen for v in self.visits), default=None)

    def finish(self) -> list[tuple]:
        out = [t for v in self.visits if not v.parked for t in self.ends(v, v.seen)]
        self.visits = []
        return out

    def frame(self, at: float, labels: list[str], scores: list[float], found: np.ndarray | list[Edges]) -> list[tuple]:
        out = self.to_look_at(at) + self.lapse(at)
        boxes = list(map(tuple, found.tolist())) if isinstance(found, np.ndarray) else found
        left = list(range(len(labels)))
        if self.visits and left:
            pairs = []
            for i, v in enumerate(self.visits):
                if v.label not in labels:
                    continue
                expected = v.ahead(min(at - v.seen, 2.0)) if v.speed != STANDS else v.edges
                for d, box in enumerate(boxes):
                    if labels[d] == v.label:
                        fit = overlap(v.edges, box)
                        if expected is not v.edges and (then := overlap(expected, box)) >= fit:
                            fit = then
                        if fit >= self.s.match:
                            pairs.append((-fit, i, d))
            taken: set[int] = set()
            for _, i, d in sorted(pairs):  # ties go by visit, then detection
                if i not in taken and d in left:
                    taken.add(i)
                    left.remove(d)
                    out += self.observe(self.visits[i], at, scores[d], boxes[d])
        for d in left:
            if labels[d] != "motion":
                self.last += 1
                v = Visit(self.last, labels[d], at, at, boxes[d], boxes[d], boxes[d], at, self.place_of(labels[d], boxes[d], at) is not None)
                out += self.observe(v, at, scores[d], boxes[d])
                self.visits.append(v)
        return out

    def place_of(self, label: str, box: Edges, at: float) -> list | None:
        """The remembered place that a box of this label is at; it is fresh again."""
        self.places = [p for p in self.places if at - p[2] <= self.s.forget_seconds]
        for p in self.places:
            if p[0] == label and overlap(p[1], box) >= self.s.same_place:
                p[2] = at
                return p
        return None

    def observe(self, v: Visit, at: float, score: float, box: Edges) -> list[tuple]:
        s = self.s
        wanted = s.labels is None or v.label in s.labels
        if v.hits and at > v.seen:
            x1, y1, x2, y2 = v.edges
            step = ((box[0] - x1) + (box[2] - x2)) / 2 / (at - v.seen), ((box[1] - y1) + (box[3] - y2)) / 2 / (at - v.seen)
            v.speed = (v.speed[0] + step[0]) / 2, (v.speed[1] + step[1]) / 2
        if overlap(v.anchor, box) < s.still:
            if v.parked:  # it leaves: another visit, which has to move away from where it stood
                v.origin, v.started, v.hits, v.scores, v.ranked = v.anchor, at, 0, [], []
                v.parked = v.counts = v.moved = False
                v.moving_since = None
            v.anchor, v.still_since = box, at
        v.edges, v.seen, v.hits = box, at, v.hits + 1
        v.scored(score, s.scores_kept)
        if v.parked:
            if (place := self.place_of(v.label, box, at)) is None:
                self.places.append([v.label, box, at])
            else:
                place[1] = box
            return []
        if v.counts and s.parked_seconds > 0 and at - v.still_since >= s.parked_seconds:
            v.parked = True
            self.places.append([v.label, box, at])
            return self.ends(v, at)
        if not v.moved:
            self.watch_movement(v, at, box)
        if not v.counts:
            if v.hits < s.least_hits or v.median() < s.least_score or not v.moved:
                return []
            v.counts, v.told = True, at
            return [self.tell(v, "started", at)] if wanted else []
        if at - v.told < s.update_seconds or not wanted:
            return []
        v.told = at
        if s.longest_seconds is None or at - v.started < s.longest_seconds:
            return [self.tell(v, "updated", at)]
        part = self.ends(v, at)
        v.started = at  # the rest of it is another visit of the same number
        return [*part, self.tell(v, "started", at)]

    def watch_movement(self, v: Visit, at: float, box: Edges) -> None:
        if v.label not in self.s.movers or self.s.least_movement <= 0:
            v.moved = True
        elif box == v.origin or not really_moved(v.origin, box, self.s):
            v.moving_since = None
        else:
            v.moving_since = at if v.moving_since is None else v.moving_since
            v.moved = at - v.moving_since >= self.s.moving_seconds
            if v.moved and v.moving_since - v.started >= self.s.parked_seconds:
                v.started = v.moving_since  # it had waited: the visit begins as it drives off


BOX = ["x1", "y1", "x2", "y2"]


def _frames(rows: pd.DataFrame) -> Iterator[tuple[str, float, list[str], list[float], list[Edges]]]:
    """(camera, at, labels, scores, boxes) of rows sorted by camera and time."""
    camera, at = rows["camera_id"].to_numpy(), rows["at"].to_numpy(float)
    labels, scores, boxes = rows["label"].tolist(), rows["score"].tolist(), list(zip(*(rows[c].to_numpy(float).tolist() for c in BOX), strict=True))
    cuts = [0, *(np.flatnonzero((camera[1:] != camera[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), len(rows)]
    camera, at = camera.tolist(), at.tolist()
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield camera[lo], at[lo], labels[lo:hi], scores[lo:hi], boxes[lo:hi]


def _rows(told: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame(told, columns=names).astype({"visit": "int64", "hits": "int64"})


def visits(detections: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Started, updated and ended visits from detections (camera_id, at in seconds, label, score and box)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, camera, held = None, Camera(settings), None

        def told(rows: pd.DataFrame) -> list[tuple]:
            nonlocal key, camera
            out: list[tuple] = []
            for k, *frame in _frames(rows):
                if k != key:
                    out += [(key, *t) for t in camera.finish()]
                    key, camera = k, Camera(settings)
                out += [(k, *t) for t in camera.frame(*frame)]
            return out

        for batch in batches:
            # Rows come sorted; the last frame of a batch waits for the next batch, which may hold more of it.
            rows = batch if held is None else pd.concat([held, batch])
            last = (rows["camera_id"] == rows["camera_id"].iloc[-1]) & (rows["at"] == rows["at"].iloc[-1])
            rows, held = rows[~last], rows[last]
            yield _rows(told(rows))
        if held is not None:
            yield _rows(told(held) + [(key, *t) for t in camera.finish()])

    # A row costs more than its bytes tell: as many tasks as the session has for a shuffle, not few large ones by size.
    tasks = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return detections.select("camera_id", "at", "label", "score", *BOX).repartition(tasks, "camera_id").sortWithinPartitions("camera_id", "at", "label", F.desc("score"), *BOX).mapInPandas(run, OUTPUT)


def visits_stream(detections: DataFrame, settings: Settings = Settings(), late: str | None = None) -> DataFrame:
    """The same for a stream whose frames arrive in order.

    `late` is how far the stream may lag behind (a watermark, such as "5 seconds"). With it, event time ends the visits of a
    camera that falls silent as soon as the watermark of all cameras has passed; rows older than the watermark, which starts at
    1970-01-01, are left out.
    Without it, a camera's visits stay open until its next frame.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        camera = pickle.loads(state.get[0]) if state.exists else Camera(settings)
        if state.hasTimedOut:
            told = [(key[0], *t) for t in camera.lapse(state.getCurrentWatermarkMs() / 1000)]
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "label", "score", *BOX], ascending=[True, True, False, *[True] * 4])
            told = [(key[0], *t) for _, *frame in _frames(rows) for t in camera.frame(*frame)]
        state.update((pickle.dumps(camera),))
        if late is not None and (seen := camera.due()) is not None:
            ms = int((seen + settings.missed_seconds) * 1000) + 1
            state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))
        yield _rows(told)

    if late is None:
        return detections.groupBy("camera_id").applyInPandasWithState(run, OUTPUT, "state binary", "append", "NoTimeout")
    timed = detections.withColumn("frame_time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("frame_time", late)
    return timed.groupBy("camera_id").applyInPandasWithState(run, OUTPUT, "state binary", "append", "EventTimeTimeout")
