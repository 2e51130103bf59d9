"""Joins over time and space: overlaps, as-of and nearest matches, spots, and what a ledger leaves to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box

#: Ranges meet by camera and slot of this many seconds, so that a join is on equal keys and not on every pair of a camera.
SLOT = 600


def slot_of(t: Column, seconds: int = SLOT) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, t) / seconds)


def slots(start: Column, end: Column, seconds: int = SLOT) -> Column:
    """The slots that a range touches. A range of k slots is repeated k times, so slots suit ranges of about their length."""
    return F.explode(F.sequence(slot_of(start, seconds), slot_of(end, seconds)))


def overlapping(windows: DataFrame, segments: DataFrame, longest: str = "10 minutes") -> DataFrame:
    """windows (camera_id, from_at, to_at) with the camera's segments (seg_start, seg_end) that overlap them, strictly at
    both ends; segments that began longer than longest before from_at are left out. Each pair comes once: it is kept in
    the first slot that both touch."""
    w = windows.withColumn("__slot", slots(F.col("from_at"), F.col("to_at")))
    s = segments.withColumn("__slot", slots(F.col("seg_start"), F.col("seg_end"))).withColumnRenamed("camera_id", "__camera")
    meets = (F.col("camera_id") == F.col("__camera")) & (w["__slot"] == s["__slot"]) & (F.col("seg_end") > F.col("from_at")) & (F.col("seg_start") < F.col("to_at")) & (F.col("seg_start") >= F.col("from_at") - F.expr(f"interval {longest}"))
    both = w.join(s, meets)
    return both.where(w["__slot"] == slot_of(F.greatest("seg_start", "from_at"))).drop(w["__slot"]).drop(s["__slot"]).drop("__camera")


def containing(events: DataFrame, ranges: DataFrame, slack: str = "2 seconds") -> DataFrame:
    """id and, of the camera's ranges that hold the event's start with some slack, the one that began last (of equals the
    one with the largest id). Events without such a range are left out."""
    padded = ranges.select(F.col("camera_id").alias("__camera"), F.col("segment_id"), F.col("seg_start"), F.col("seg_end"), slots(F.col("seg_start") - F.expr(f"interval {slack}"), F.col("seg_end") + F.expr(f"interval {slack}")).alias("__slot"))
    e = events.select("id", "camera_id", "started_at", slots(F.col("started_at"), F.col("started_at")).alias("__own"))
    at = F.col("started_at")
    holds = (F.col("camera_id") == F.col("__camera")) & (F.col("__own") == F.col("__slot")) & (at >= F.col("seg_start") - F.expr(f"interval {slack}")) & (at <= F.col("seg_end") + F.expr(f"interval {slack}"))
    return e.join(padded, holds).groupBy("id").agg(F.max(F.struct("seg_start", "segment_id")).alias("m")).select("id", F.col("m.segment_id").alias("segment_id"))


def nearest_start(left: DataFrame, right: DataFrame, slack_seconds: int = 2) -> DataFrame:
    """left_id and the right_id whose start is nearest, within the slack; of equally near ones the smaller id.
    Both have camera_id, an id and a start."""
    slot = slot_of(F.col("start"), slack_seconds + 1)
    r = right.select(F.col("camera_id").alias("__camera"), "right_id", F.col("start").alias("__start"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("__slot"))
    l = left.select("camera_id", "left_id", "start", slot.alias("__own"))  # noqa: E741
    apart = F.abs(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("__start")))
    both = l.join(r, (F.col("camera_id") == F.col("__camera")) & (F.col("__own") == F.col("__slot")) & (apart <= slack_seconds * 1_000_000))
    return both.groupBy("left_id").agg(F.min(F.struct(apart.alias("apart"), "right_id")).alias("m")).select("left_id", F.col("m.right_id").alias("right_id"), F.col("m.apart").alias("micros_apart"))


def in_marked_spot(events: DataFrame, least: float = 0.5, newest: int | None = None) -> DataFrame:
    """Events whose box overlaps, by IoU, the box of another event of the camera that a reviewer marked as nothing.
    newest: only marks among so many of each camera's latest marked events count, whatever these were marked as. Marks with one
    box are one row. Boxes meet by camera and by cells of a grid: boxes that overlap share the cell of their intersection's
    corner."""
    marks = events.where("marked")
    if newest is not None:
        marks = marks.withColumn("__n", F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("id")))).where(F.col("__n") <= newest)
    marks = marks.where("feedback = 'nothing'").groupBy(F.col("camera_id").alias("m_camera"), *Box.of().columns("m_")).agg(F.min("id").alias("m_id"), F.count("*").alias("m_n"))
    mine, theirs = Box.of(), Box.of("m_")
    near = lambda b, of: of.withColumn("__gx", F.explode(F.sequence(F.floor(b.x1 * 16), F.floor(b.x2 * 16)))).withColumn("__gy", F.explode(F.sequence(F.floor(b.y1 * 16), F.floor(b.y2 * 16))))
    e, m = near(mine, events.select("id", "camera_id", *mine.columns())), near(theirs, marks)
    meets = (F.col("camera_id") == F.col("m_camera")) & (e["__gx"] == m["__gx"]) & (e["__gy"] == m["__gy"]) & ((F.col("m_n") > 1) | (F.col("id") != F.col("m_id"))) & (mine.iou(theirs) >= least)
    return e.join(m, meets, "left_semi").select("id", "camera_id").distinct()


def sharing_clip(events: DataFrame) -> DataFrame:
    """Events whose clip another event within an hour uses too: [-1 h, +1 h) about their start."""
    other = events.where("clip_path is not null").select(F.col("clip_path").alias("__clip"), F.col("id").alias("__id"), F.col("started_at").alias("__at"))
    close = (F.col("clip_path") == F.col("__clip")) & (F.col("id") != F.col("__id")) & (F.col("__at") >= F.col("started_at") - F.expr("interval 1 hour")) & (F.col("__at") < F.col("started_at") + F.expr("interval 1 hour"))
    return events.join(other, close, "left_semi")


def withdrawn(existing: DataFrame, marked: DataFrame) -> DataFrame:
    """Marked cases of an earlier export that are no longer marked."""
    return existing.join(marked.select("id"), "id", "left_anti")


def to_import(files: DataFrame, ledger: DataFrame, now: Column, settle: str = "10 seconds") -> DataFrame:
    """Files that no ledger row knows and that ended long enough ago, oldest first."""
    return not_imported(files, ledger, now, settle).orderBy("file_start", "file")


def not_imported(files: DataFrame, ledger: DataFrame, now: Column, settle: str = "10 seconds") -> DataFrame:
    """to_import() in any order."""
    return files.where(F.col("file_end") <= now - F.expr(f"interval {settle}")).join(ledger, ["hub", "file"], "left_anti")


def best_detection(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """For each expected box (e_x1, ...) the detection that overlaps it most, of equals the surest, then the first."""
    return expected.join(found, on).withColumn("iou", Box.of("e_").iou(Box.of())).groupBy(on).agg(F.max_by("det", F.struct("iou", "score", -F.col("det"))).alias("det"), F.max("iou").alias("iou"))


def suppressed(detections: DataFrame, most: float = 0.45) -> DataFrame:
    """Class-wise suppression in each frame: by falling score, a box goes if a kept one of its label overlaps it by more.
    An ordered fold over the frame's few boxes, inside the JVM."""
    row = F.struct((-F.col("score")).alias("order"), "det", "label", "x1", "y1", "x2", "y2")

    def iou(a: Column, b: Column) -> Column:
        side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
        both = side("x1", "x2") * side("y1", "y2")
        own = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
        union = own(a) + own(b) - both
        return F.when(union > 0, both / union).otherwise(0.0)

    kept = F.aggregate(
        F.sort_array(F.collect_list(row)),
        F.filter(F.collect_list(row), lambda r: F.lit(False)),
        lambda acc, r: F.when(F.exists(acc, lambda k: (k["label"] == r["label"]) & (iou(k, r) > most)), acc).otherwise(F.concat(acc, F.array(r))),
    )
    return detections.groupBy("frame").agg(kept.alias("kept")).select("frame", F.explode("kept.det").alias("det"))


def merged_regions(detections: DataFrame, same: float = 0.45, contained: float = 0.6, other: float = 0.7) -> DataFrame:
    """Detections of overlapping regions as objects, frame by frame: by falling score, a box that meets a kept one of its
    label (by IoU, or by the share of the smaller one inside) widens it, and one at the place of another label's goes."""
    area = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))

    def shared(a: Column, b: Column) -> Column:
        side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
        return side("x1", "x2") * side("y1", "y2")

    def meets(k: Column, d: Column) -> Column:
        both = shared(k, d)
        union = area(k) + area(d) - both
        iou = F.when(union > 0, both / union).otherwise(0.0)
        inside = both / F.greatest(F.least(area(k), area(d)), F.lit(1e-7))
        return F.when(k["label"] == d["label"], (iou > same) | (inside > contained)).otherwise(iou > other)

    def widened(k: Column, d: Column) -> Column:
        return F.struct(k["order"].alias("order"), k["det"].alias("det"), k["label"].alias("label"), F.least(k["x1"], d["x1"]).alias("x1"), F.least(k["y1"], d["y1"]).alias("y1"), F.greatest(k["x2"], d["x2"]).alias("x2"), F.greatest(k["y2"], d["y2"]).alias("y2"))

    def step(kept: Column, d: Column) -> Column:
        first = F.array_position(F.transform(kept, lambda k: meets(k, d)), True)
        return F.when(first == 0, F.concat(kept, F.array(d))).otherwise(F.transform(kept, lambda k, i: F.when((i + 1 == first) & (k["label"] == d["label"]), widened(k, d)).otherwise(k)))

    row = F.struct((-F.col("score")).alias("order"), "det", "label", "x1", "y1", "x2", "y2")
    rows = F.sort_array(F.collect_list(row))
    objects = F.aggregate(rows, F.filter(F.collect_list(row), lambda r: F.lit(False)), step)
    return detections.groupBy("frame").agg(objects.alias("o")).select("frame", F.explode("o").alias("o")).select("frame", "o.det", "o.label", "o.x1", "o.y1", "o.x2", "o.y2")
