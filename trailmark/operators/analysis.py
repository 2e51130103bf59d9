"""When a camera's frames are worth a detector's look, and when a recording covers an event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOK = "camera_id string, id long, at_ms long, looks boolean, fruitless int"
CLIP = "camera_id string, id long, decided_ms long, covered boolean, n_segments int, start_ms long"


class Throttle:
    """How a camera with motion that leads to nothing (wind, rain) is looked at: after so many looks in a row that found
    nothing, only once in every_ms. forget_ms without motion ends that, and so does a find or a box that is due for a look."""

    def __init__(self, after: int = 15, every_ms: int = 1_000, forget_ms: int = 10_000, held: tuple | None = None) -> None:
        self.limits = (after, every_ms, forget_ms)
        self.fruitless, self.looked, self.moved = held or (0, None, None)

    @property
    def held(self) -> tuple:
        return (self.fruitless, self.looked, self.moved)

    def frame(self, at: int, moving: bool, due: bool, found: bool) -> tuple[bool, int]:
        """Whether the detector looks at a frame, and the fruitless looks so far. found: whether it finds anything if it does."""
        after, every, forget = self.limits
        if moving:
            self.moved = at
        elif self.moved is None or at - self.moved > forget:
            self.fruitless = 0
        idle = not due and self.fruitless >= after and self.looked is not None and at - self.looked < every
        looks = (moving or due) and not idle
        if looks:
            self.looked = at
            self.fruitless = 0 if found or due else self.fruitless + 1
        return looks, self.fruitless


def sound_frames(frames: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return frames.select("camera_id", "id", "at_ms", flag("moving"), flag("due"), flag("found")).where("camera_id is not null and at_ms is not null")


def looks_table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in LOOK.split(", ")])


def looks(frames: DataFrame, **limits: int) -> DataFrame:
    """camera_id, id, at_ms, looks, fruitless for every frame (camera_id, id, at_ms, moving, due, found) with a camera and a time;
    null flags are false. limits: those of Throttle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, throttle = None, Throttle(**limits)
        for part in batches:
            out = []
            for k, i, at, *flags in zip(*(part[c] for c in ("camera_id", "id", "at_ms", "moving", "due", "found")), strict=True):
                if k != camera:
                    camera, throttle = k, Throttle(**limits)
                out.append((k, i, at, *throttle.frame(at, *flags)))
            yield looks_table(out)

    return sound_frames(frames).repartition("camera_id").sortWithinPartitions("camera_id", "at_ms", "id").mapInPandas(run, LOOK)


def deadline_ms(segment_seconds: int) -> int:
    """How long a clip waits for its recording: three segments and half a minute."""
    return (3 * segment_seconds + 30) * 1_000


def clip_jobs(events: DataFrame, segments: DataFrame, segment_seconds: int = 10, ahead_ms: int = 600_000) -> DataFrame:
    """What the clip of each event is cut from. events: id, camera_id, from_ms, to_ms, asked_ms; segments: camera_id,
    start_ms, end_ms, known_ms.

    A job is decided as soon as a segment that overlaps its window and reaches its end is known, at its deadline at the latest;
    it takes the overlapping segments known by then. decided_ms, covered, n_segments, and start_ms, where the clip begins.
    Pairs meet by camera and slot of time.
    """
    slots = lambda lo, hi: F.sequence(F.floor(F.col(lo) / ahead_ms), F.floor(F.col(hi) / ahead_ms))
    e = events.select("id", "camera_id", "from_ms", "to_ms", "asked_ms", (F.col("asked_ms") + deadline_ms(segment_seconds)).alias("until"))
    cut = e.where("to_ms > from_ms").withColumn("slot", F.explode(slots("from_ms", "to_ms")))
    s = segments.select(F.col("camera_id").alias("s_camera"), "start_ms", "end_ms", "known_ms").where("end_ms > start_ms").withColumn("s_slot", F.explode(slots("start_ms", "end_ms")))
    meets = (F.col("camera_id") == F.col("s_camera")) & (F.col("slot") == F.col("s_slot")) & (F.col("end_ms") > F.col("from_ms")) & (F.col("start_ms") < F.col("to_ms")) & (F.col("start_ms") >= F.col("from_ms") - ahead_ms)
    first = F.greatest(F.floor(F.col("from_ms") / ahead_ms), F.floor(F.col("start_ms") / ahead_ms))
    pairs = cut.join(s, meets).where(F.col("slot") == first).where("known_ms <= until")
    reach = pairs.groupBy("id").agg(F.min(F.when(F.col("end_ms") >= F.col("to_ms"), F.greatest("known_ms", "asked_ms"))).alias("reached"))
    known = pairs.join(reach, "id").where(F.col("known_ms") <= F.least(F.coalesce("reached", "until"), F.col("until")))
    taken = known.groupBy("id").agg(F.any_value("reached").alias("reached"), F.count("*").cast("int").alias("n_segments"), F.min("start_ms").alias("first_ms"))
    out = e.join(taken, "id", "left")
    return out.select("camera_id", "id", F.least(F.coalesce("reached", "until"), F.col("until")).alias("decided_ms"), F.coalesce(F.col("reached") <= F.col("until"), F.lit(False)).alias("covered"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.greatest("from_ms", F.coalesce("first_ms", "from_ms")).alias("start_ms"))
