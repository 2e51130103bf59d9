"""Ordered computations: slots, round robin, segments, medians of the last scores; see carried.py for those over whole histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import passed


def best_per_slot(rows: DataFrame, key: str, at: Column, score: str, most: int, tie: str) -> DataFrame:
    """Of each key the best row of each slot, then the best of those slots."""
    first = rows.withColumn("__slot", at).withColumn("__r", F.row_number().over(Window.partitionBy(key, "__slot").orderBy(F.desc(score), tie))).where("__r = 1")
    return first.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where(F.col("__r") <= most).drop("__slot", "__r")


def round_robin(rows: DataFrame, buckets: list[str], newest: str, want: int) -> DataFrame:
    """The newest of each bucket in turn until want rows are there; only want rows of a bucket can matter."""
    turn = F.row_number().over(Window.partitionBy(*buckets).orderBy(F.desc(newest)))
    return rows.withColumn("turn", turn).where(F.col("turn") <= want).orderBy("turn", *buckets).limit(want)


SEGMENT = "camera_id string, started_us long, ended_us long, n long, bytes long"


def recorded(packets: DataFrame, seconds: int, most_bytes: int = 64 << 20, usual: int = 9000, drift_us: int = 500_000) -> DataFrame:
    """Segments from a camera's packets (arrived_us, ts90, key_frame, size): each begins with a key frame and ends before
    the first key frame at which it is long or large enough. A packet lasts until the next (the usual time if that is no
    time or over five seconds); its wall time runs with the 90 kHz clock from an anchor, which is set anew where it drifts
    from the arrival. The last packet lasts as long as the one before. Only the open segment is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, before, anchor, seg, out = None, None, None, None, []

        def wall(arrived: int, ts: int) -> int:
            nonlocal anchor
            at = arrived if anchor is None else anchor[0] + (ts - anchor[1]) * 100 // 9
            if anchor is None or abs(at - arrived) > drift_us:
                anchor, at = (arrived, ts), arrived
            return at

        def put(lasts: int) -> None:
            """The packet before joins the open segment: start, end of its last packet, packets, bytes, last duration."""
            nonlocal seg
            at = wall(before[0], before[1])
            start, _, n, size, _ = seg or (at, at, 0, 0, 0)
            seg = (start, at + lasts * 100 // 9, n + 1, size + before[3], lasts)

        def close() -> None:
            nonlocal seg
            if seg is not None:
                out.append((camera, *seg[:4]))
            seg = None

        def flush() -> None:
            nonlocal before
            if before is not None:
                put(seg[4] if seg is not None else usual)
            before = None
            close()

        for part in batches:
            for k, arrived, ts, key, size in zip(part["camera_id"], part["arrived_us"], part["ts90"], part["key_frame"], part["size"], strict=True):
                if k != camera:
                    flush()
                    camera, anchor = k, None
                if before is None and seg is None and not key:
                    continue
                if before is not None:
                    step = ts - before[1]
                    put(step if 0 < step <= 5 * 90_000 else usual)
                    if key and (seg[1] - seg[0] >= seconds * 1_000_000 or seg[3] > most_bytes):
                        close()
                before = (arrived, ts, key, size)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")])
            out.clear()
        flush()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return packets.select("camera_id", "arrived_us", "ts90", "key_frame", "size").repartition("camera_id").sortWithinPartitions("camera_id", "ts90", "arrived_us").mapInPandas(run, SEGMENT)


def last_scores(rows: DataFrame, key: str, order: str, score: str, most: int = 100) -> DataFrame:
    """The exact median and the maximum (0 at least) of a key's last scores."""
    last = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= most)
    return last.groupBy(key).agg(F.median(score).alias("median_score"), F.greatest(F.max(score), F.lit(0.0)).alias("top_score"))


def last_times(rows: DataFrame, key: str, order: str, value: str, most: int = 200, percent: int = 95) -> DataFrame:
    """Mean and nearest-rank percentile of a key's last values that aren't null: what a pool of workers says of its jobs."""
    last = rows.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= most)
    held = last.groupBy(key).agg(F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("__v"))
    at = F.least(F.floor(F.size("__v") * percent / 100), F.size("__v") - 1).cast("int")
    return held.select(key, "mean", F.get("__v", at).alias("p"), F.size("__v").cast("long").alias("n"))


def measured(rows: DataFrame, key: str, seconds: float = 2.0) -> DataFrame:
    """Frames a second and kilobits a second of a stream's units (key, id, at in seconds, bytes). A window begins where the one
    before ended, the first with the first unit, and ends with the first unit that comes seconds after that or later."""
    # A unit belongs to the window that ends with the next cut at or after it.
    cuts = passed(rows.select(key, "id", "at", "bytes"), key, seconds)
    sums = cuts.groupBy(key, "__before").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.when(F.col("__kept"), F.col("at"))).alias("ended_at"), F.max("__from").alias("__from"))
    elapsed = F.col("ended_at") - F.col("__from")
    return sums.where("ended_at is not null and __from is not null").select(key, "ended_at", "n", (F.col("n") / elapsed).alias("fps"), (F.col("bytes") * 8 / 1000 / elapsed).alias("kbps"))


def nearest_rank(rows: DataFrame, key: str, value: str, percent: int = 95, cells: int = 1024) -> DataFrame:
    """Mean and nearest-rank percentile: the value at floor(n * percent / 100), the last at most. Null values aren't read.

    A histogram of each key's range shows the cell that holds the rank; only that cell's distinct values are put in order.
    All of it is partial aggregates, so a key with most of the rows isn't sorted in one task."""
    rows = rows.select(F.col(key).alias("__key"), F.col(value).alias("__v")).where("__v is not null")
    sums = rows.groupBy("__key").agg(F.avg("__v").alias("mean"), F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    sums = sums.withColumn("__at", F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1))
    share = F.when(F.col("__hi") > F.col("__lo"), (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    placed = rows.join(sums, rows["__key"].eqNullSafe(sums["__key"])).drop(rows["__key"]).withColumn("__cell", F.floor(share * (cells - 1)))

    def holding(counted: DataFrame, by: str) -> DataFrame:
        """Of a key's groups in order, the one with the rank __at in it, and how many come before it."""
        before = Window.partitionBy("__key").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("__before", F.col("__start") + F.coalesce(F.sum("__k").over(before), F.lit(0)))
        return counted.where((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__k")))

    of_cells = placed.groupBy("__key", "__at", "__cell").agg(F.count("*").alias("__k")).withColumn("__start", F.lit(0).cast("long"))
    cell = holding(of_cells, "__cell").select(F.col("__key").alias("__of"), F.col("__cell").alias("__in"), F.col("__before").alias("__start"))
    inside = placed.join(cell, placed["__key"].eqNullSafe(cell["__of"]) & (F.col("__cell") == F.col("__in")))
    values = inside.groupBy("__key", "__at", "__start", "mean", "n", "__v").agg(F.count("*").alias("__k"))
    return holding(values, "__v").select(F.col("__key").alias(key), "mean", F.col("__v").alias("p"), "n")


def clip_rows(frames: DataFrame, windows: DataFrame, key: str, slot: str = "day") -> DataFrame:
    """For each window (from_at, to_at) of a key: the last key frame at or before it begins, else the first one there is,
    and the last frame within it; keys without frames have no rows.

    Frames and the bounds of windows are put in one order by time. Each slot of a key is ordered for itself, and what the
    slots before it had last comes from one row a slot, so a key with most of the rows is dealt out by time."""
    slot_of = F.date_trunc(slot, "at").alias("slot")
    rows = frames.select(key, "at", slot_of, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("window_id"), F.coalesce("key_frame", F.lit(False)).alias("key_frame"))
    for kind, bound in ((1, "from_at"), (2, "to_at")):
        rows = rows.unionByName(windows.select(key, F.col(bound).alias("at"), F.lit(kind).alias("kind"), F.col("window_id").cast("long").alias("window_id"), F.lit(False).alias("key_frame")).select(key, "at", slot_of, "kind", "window_id", "key_frame"))
    at_frame, at_key = F.when(F.col("kind") == 0, F.col("at")), F.when(F.col("key_frame"), F.col("at"))
    # Frames come before bounds of the same time.
    within = Window.partitionBy(key, "slot").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy(key, "slot").agg(F.max(at_frame).alias("__f"), F.max(at_key).alias("__k"), F.min(at_key).alias("__least"), F.count_if(F.col("kind") == 0).alias("__frames"))
    carried = slots.select(F.col(key).alias("__key"), F.col("slot").alias("__slot"), F.max("__f").over(before).alias("__f"), F.max("__k").over(before).alias("__k"), F.min("__least").over(Window.partitionBy(key)).alias("__least"), F.sum("__frames").over(Window.partitionBy(key)).alias("__frames"))
    seen = rows.withColumn("frame", F.last(at_frame, ignorenulls=True).over(within)).withColumn("keyed", F.last(at_key, ignorenulls=True).over(within)).where("kind > 0")
    known = seen.join(carried, (F.col(key) == F.col("__key")) & F.col("slot").eqNullSafe(F.col("__slot"))).where("__frames > 0")
    first = F.coalesce(F.max(F.when((F.col("kind") == 1) & F.col("at").isNotNull(), F.coalesce("keyed", "__k"))), F.max("__least"))
    return known.groupBy(key, "window_id").agg(first.alias("first_at"), F.max(F.when((F.col("kind") == 2) & F.col("at").isNotNull(), F.coalesce("frame", "__f"))).alias("last_at"))


def clip_rows_of_one_kind(frames: DataFrame, segments: DataFrame, windows: DataFrame, key: str, slot: str = "day") -> DataFrame:
    """clip_rows() of frames that all have the same stream parameters. frames have segment; segments: key, segment, info.

    Segments in order with the same info are a stretch. A clip is cut from the first stretch that has a frame at or after its
    start, else from the last one; what comes before and after a change of parameters isn't mixed. windows: key, window_id,
    from_at, to_at."""
    w = Window.partitionBy(key).orderBy("segment")
    changed = (~F.col("info").eqNullSafe(F.lag("info").over(w)) | F.lag("segment").over(w).isNull()).cast("int")
    stretches = segments.withColumn("__new", changed).withColumn("stretch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = frames.join(stretches.select(key, "segment", "stretch"), [key, "segment"])
    ends = of.groupBy(key, "stretch").agg(F.max("at").alias("last"))
    chosen = windows.join(ends, key).groupBy(key, "window_id", "from_at", "to_at").agg(F.coalesce(F.min(F.when(F.col("last") >= F.col("from_at"), F.col("stretch"))), F.max("stretch")).alias("stretch"))
    both = F.struct(key, "stretch")
    out = clip_rows(of.select(both.alias("__of"), "at", "key_frame"), chosen.select(both.alias("__of"), "window_id", "from_at", "to_at"), "__of", slot)
    return out.select(F.col(f"__of.{key}").alias(key), "window_id", F.col("__of.stretch").alias("stretch"), "first_at", "last_at")


def merged_recordings(tracks: DataFrame, most_crops: int = 3) -> DataFrame:
    """The events of recordings after tidying; tracks: recording, id, label, started_at, ended_at, top_score, median_score,
    moved, crops (an array of structs with quality and crop).

    A recording with objects has no motion events; one without keeps them as they are. The tracks of one label are one
    event: the track with the best score (the first of equals) stays, with its own median, from the earliest start to the
    latest end, with the highest score and the best crops of all of them, moved if any moved. Tracks without an end give
    nothing to it, and one that stays without an end only gets the start.
    """
    is_motion, ended = F.col("label") == "motion", F.col("ended_at").isNotNull()
    objects = tracks.where(~is_motion)
    best = F.max_by("id", F.struct("top_score", -F.col("id")))
    of = ("recording", "label")
    spans = objects.groupBy(*of).agg(
        best.alias("id"),
        F.min(F.when(ended, F.col("started_at"))).alias("__start"),
        F.max("ended_at").alias("__end"),
        F.max(F.when(ended, F.col("top_score"))).alias("__top"),
        F.bool_or(F.when(ended, F.col("moved"))).alias("__moved"),
    )
    # Only the best crops of a label are brought together.
    place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("quality"), "id", "k"))
    crops = objects.where(ended).select(*of, "id", F.posexplode("crops").alias("k", "c")).select(*of, "id", "k", "c.quality", "c.crop")
    crops = crops.withColumn("__place", place).where(F.col("__place") <= max(1, most_crops))
    crops = crops.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("__place", "crop"))).alias("__crops")).select(*of, F.transform("__crops", lambda c: c["crop"]).alias("__crops"))
    kept = objects.join(spans, [*of, "id"]).join(crops, [*of], "left")
    none = F.array().cast("array<long>")
    own = F.transform("crops", lambda c: c["crop"])
    merged = kept.select(
        *of,
        "id",
        F.coalesce("__start", "started_at").alias("started_at"),
        F.when(ended, F.col("__end")).alias("ended_at"),
        F.when(ended, F.col("__top")).otherwise(F.col("top_score")).alias("top_score"),
        "median_score",
        F.when(ended, F.col("__moved")).otherwise(F.col("moved")).alias("moved"),
        F.when(ended, F.coalesce("__crops", none)).otherwise(own).alias("crops"),
    )
    alone = tracks.where(is_motion).join(objects.select("recording").distinct(), "recording", "left_anti")
    return merged.unionByName(alone.select(*of, "id", "started_at", "ended_at", "top_score", "median_score", "moved", own.alias("crops")))
