"""Cameras as keys with state: motion events, looks and clips in streams, by the same steps as in tables.

A camera's rows have to come in order of time over micro-batches; within one they are sorted. State lies in RocksDB, with a
value, a list or a map for what is kept of a camera, and survives a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import analysis, motion

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """State of transformWithState is only kept there."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(values: tuple) -> tuple:
    """Values as the state store takes them, without numpy's types."""
    return tuple(v.item() if hasattr(v, "item") else v for v in values)


class _Folding(StatefulProcessor):
    """A camera whose whole state is one value."""

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", self.schema)

    def held(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def close(self) -> None:
        pass


class MotionProcessor(_Folding):
    schema = "since long, seen long, area double, best long, start long, last long, picture long, until long, n long"

    def __init__(self, limits: dict) -> None:
        self.limits = limits

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watch, out = motion.Watch(**self.limits, held=self.held()), []
        frames = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        for frame in zip(frames["at_ms"].tolist(), frames["moving"].tolist(), frames["area"].tolist(), frames["objects"].tolist(), strict=True):
            out += [(key[0], *e) for e in watch.frame(*frame)]
        self.state.update(_plain(watch.held))
        yield motion.events_table(out)


def motion_events_stream(frames: DataFrame, **limits: int | None) -> DataFrame:
    """motion.motion_events() for a stream: events come when they end; what is open stays open until a frame ends it."""
    use_rocksdb(frames.sparkSession)
    return motion.sound_frames(frames).groupBy("camera_id").transformWithStateInPandas(MotionProcessor(limits), motion.EVENT, "Append", "none")


class LookProcessor(_Folding):
    schema = "fruitless int, looked long, moved long"

    def __init__(self, limits: dict) -> None:
        self.limits = limits

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        throttle = analysis.Throttle(**self.limits, held=self.held())
        frames = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        columns = [frames[c].tolist() for c in ("id", "at_ms", "moving", "due", "found")]
        out = [(key[0], i, at, *throttle.frame(at, *flags)) for i, at, *flags in zip(*columns, strict=True)]
        self.state.update(_plain(throttle.held))
        yield analysis.looks_table(out)


def looks_stream(frames: DataFrame, **limits: int) -> DataFrame:
    """analysis.looks() for a stream."""
    use_rocksdb(frames.sparkSession)
    return analysis.sound_frames(frames).groupBy("camera_id").transformWithStateInPandas(LookProcessor(limits), analysis.LOOK, "Append", "none")


class ClipProcessor(StatefulProcessor):
    """Recent segments of a camera as a list, its open jobs as a map, and a timer for each job's deadline."""

    def __init__(self, wait_ms: int, ahead_ms: int, keep_ms: int) -> None:
        self.wait, self.ahead, self.keep = wait_ms, ahead_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.segments = handle.getListState("segments", "start long, end long, known long")
        self.jobs = handle.getMapState("jobs", "id long", "from long, to long, asked long")

    def decided(self, key: str, job: int, window: tuple, segments: list[tuple], at: int, covered: bool) -> tuple:
        lo, hi, _ = window
        taken = [s for s in segments if self.meets(s, lo, hi) and s[2] <= at]
        return (key, job, at, covered, len(taken), max(lo, min((s[0] for s in taken), default=lo)))

    def meets(self, s: tuple, lo: int, hi: int) -> bool:
        return lo < hi and s[0] < s[1] and s[1] > lo and s[0] < hi and s[0] >= lo - self.ahead

    def overdue(self, key: str, jobs: dict, segments: list[tuple], now: int) -> list[tuple]:
        """Jobs whose deadline is before now, with what was known by then."""
        late = [(j, w) for j, w in jobs.items() if w[2] + self.wait < now]
        for j, _ in late:
            del jobs[j]
        return [self.decided(key, j, w, segments, w[2] + self.wait, False) for j, w in late]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        segments = [tuple(s) for s in self.segments.get()]
        jobs = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        before, out = set(jobs), []
        given = pd.concat(list(rows)).sort_values(["at_ms", "is_job", "id"])
        for at, is_job, i, lo, hi in zip(*(given[c].tolist() for c in ("at_ms", "is_job", "id", "lo_ms", "hi_ms")), strict=True):
            out += self.overdue(key[0], jobs, segments, at)
            if is_job:
                window = (lo, hi, at)
                if any(self.meets(s, lo, hi) and s[1] >= hi for s in segments):
                    out.append(self.decided(key[0], i, window, segments, at, True))
                else:
                    jobs[i] = window
            else:
                s = (lo, hi, at)
                segments = [x for x in segments if x[2] >= at - self.keep] + [s]
                done = [(j, w) for j, w in jobs.items() if self.meets(s, w[0], w[1]) and hi >= w[1]]
                for j, w in done:
                    del jobs[j]
                    out.append(self.decided(key[0], j, w, segments, at, True))
        self.segments.put([_plain(s) for s in segments]) if segments else self.segments.clear()
        for j in before - set(jobs):
            self.jobs.removeKey((j,))
        for j in set(jobs) - before:
            self.jobs.updateValue((j,), _plain(jobs[j]))
            self.handle.registerTimer(jobs[j][2] + self.wait + 1)
        yield self.table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        before = set(jobs)
        out = self.overdue(key[0], jobs, [tuple(s) for s in self.segments.get()], expiredTimerInfo.getExpiryTimeInMs())
        for j in before - set(jobs):
            self.jobs.removeKey((j,))
        yield self.table(out)

    @staticmethod
    def table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in analysis.CLIP.split(", ")]).astype({"n_segments": "int32"})

    def close(self) -> None:
        pass


def clip_jobs_stream(events: DataFrame, segments: DataFrame, segment_seconds: int = 10, ahead_ms: int = 600_000, late: str = "10 seconds", keep_ms: int = 3_600_000) -> DataFrame:
    """analysis.clip_jobs() for two streams. A job without a covering segment is decided by a timer, once the watermark (late
    behind the newest row) has passed its deadline. Segments are remembered for keep_ms."""
    use_rocksdb(events.sparkSession)
    jobs = events.select("camera_id", F.lit(True).alias("is_job"), "id", F.col("asked_ms").alias("at_ms"), F.col("from_ms").alias("lo_ms"), F.col("to_ms").alias("hi_ms"))
    known = segments.select("camera_id", F.lit(False).alias("is_job"), F.lit(0).cast("long").alias("id"), F.col("known_ms").alias("at_ms"), F.col("start_ms").alias("lo_ms"), F.col("end_ms").alias("hi_ms"))
    timed = jobs.unionByName(known).withColumn("row_time", F.timestamp_millis("at_ms")).withWatermark("row_time", late)
    return timed.groupBy("camera_id").transformWithStateInPandas(ClipProcessor(analysis.deadline_ms(segment_seconds), ahead_ms, keep_ms), analysis.CLIP, "Append", "EventTime")
