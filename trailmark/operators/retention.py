"""Changes to the store as set computations: patches, ids, upserts, and the retention pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_path


def with_ids(new: DataFrame, existing: DataFrame, *order: str, slots: int = 64) -> DataFrame:
    """new with ids that follow the largest existing one, in an order of its rows. Rows are counted by ranges of the order
    first, so that numbering needs no single task."""
    at = shared_path(new.sparkSession, "ranged")
    new.repartitionByRange(slots, *order).withColumn("__part", F.spark_partition_id()).write.parquet(at)
    # Written, so that counting and numbering see the same ranges whatever is computed again.
    ranged = new.sparkSession.read.parquet(at)
    within = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))  # slots rows at most
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    return within.join(F.broadcast(before.select("__part", "__before")), "__part").join(F.broadcast(top), F.lit(True)).withColumn("id", F.col("__top") + F.col("__before") + F.col("__n")).drop("__part", "__n", "__before", "__top")


def patched(events: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """events after their patches: for each field the last patch that sets it wins, and setting null clears it.
    patches has id, seq and for each field a struct (is_set, value)."""
    last = patches.groupBy("id").agg(*(F.max_by(f, F.when(F.col(f"{f}.is_set"), F.col("seq"))).alias(f"__{f}") for f in fields))
    both = events.join(last, "id", "left")
    new = [F.when(F.coalesce(F.col(f"__{f}.is_set"), F.lit(False)), F.col(f"__{f}.value")).otherwise(F.col(f)).alias(f) for f in fields]
    return both.select(*(c for c in events.columns if c not in fields), *new)


def latest(log: DataFrame, key: list[str], seq: str, deleted: str | None = None) -> DataFrame:
    """The last row of each key; keys whose last row is a deletion are gone."""
    rest = [c for c in log.columns if c not in key]
    rows = log.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))
    return rows if deleted is None else rows.where(~F.col(deleted)).drop(deleted)


def ledger(imports: DataFrame, seq: str) -> DataFrame:
    """What became of each hub's files (hub, file, event_id): the last row counts; -1 stands for a file of which nothing was kept."""
    return latest(imports.withColumn("event_id", F.coalesce("event_id", F.lit(-1).cast("long"))), ["hub", "file"], seq)


def closed(events: DataFrame) -> DataFrame:
    """After a crash: open events end when they began, and clips that were pending have failed."""
    return events.withColumn("ended_at", F.coalesce("ended_at", "started_at")).withColumn("clip_state", F.when(F.col("clip_state") == "pending", "failed").otherwise(F.col("clip_state")))


def note(text: Column) -> Column:
    """A reviewer's text: trimmed, 200 characters at most, null if nothing is left."""
    return F.nullif(F.left(F.trim(text), F.lit(200)), F.lit(""))


def segment_cutoff(events: DataFrame, now: Column, keep_hours: int, pre_seconds: int) -> DataFrame:
    """One row with cutoff: now less the kept hours, or earlier where a clip that began within a day before is still pending."""
    keep = now - F.expr(f"interval {keep_hours} hours")
    pending = events.where((F.col("clip_state") == "pending") & (F.col("started_at") >= keep - F.expr("interval 24 hours")))
    return pending.agg(F.least(keep, F.min("started_at") - F.expr(f"interval {pre_seconds} seconds")).alias("cutoff"))


def expired_segments(segments: DataFrame, cutoff: DataFrame) -> DataFrame:
    return segments.join(F.broadcast(cutoff), (F.col("seg_start") < F.col("cutoff")) & (F.col("seg_end") < F.col("cutoff"))).drop("cutoff")


#: The files of an event that a retention pass removes.
MEDIA = ("clip_path", "snapshot_path", "thumb_path", "sharp_path")


def expired_events(events: DataFrame, cutoff: Column) -> DataFrame:
    """Events without a mark that began before an instant and still have something to purge: a file, or a state to set."""
    has = F.coalesce(*MEDIA).isNotNull()
    return events.where((F.col("started_at") < cutoff) & F.col("feedback").isNull() & ((F.col("clip_state") != "purged") | has))


def sized_clips(events: DataFrame, files: DataFrame | None) -> DataFrame:
    """events that have a clip, with bytes: the stored size, else the length of its file (files: path, length), else 0."""
    clips = events.where("clip_path is not null")
    if files is None:
        return clips.withColumn("bytes", F.coalesce("clip_bytes", F.lit(0)))
    known = clips.join(files.select("path", "length"), F.col("clip_bytes").isNull() & (F.col("clip_path") == F.col("path")), "left")
    return known.withColumn("bytes", F.coalesce("clip_bytes", "length", F.lit(0))).drop("path", "length")


def over_cap(events: DataFrame, cap: int, files: DataFrame | None = None) -> DataFrame:
    """Clips to purge, with their bytes, until the total is within the cap: oldest local day first, motion first within a
    day. Every event with a clip counts, whatever its state; marked ones stay.

    Running sums are taken in two steps, over cells of a day, kind and minute and then within a cell, so that no task sorts
    the clips of a day."""
    clips = sized_clips(events, files)
    total = clips.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("__total"))
    free = clips.where(~F.col("marked")).withColumn("__object", (F.col("label") != "motion").cast("int")).withColumn("__minute", F.date_trunc("minute", "started_at"))
    cell = ["local_date", "__object", "__minute"]
    cells = free.groupBy(*cell).agg(F.sum("bytes").alias("__bytes"))
    # Cells are summed up by day first, so that no task orders the minutes of all days.
    days = cells.groupBy("local_date").agg(F.sum("__bytes").alias("__day"))
    days = days.withColumn("__until", F.coalesce(F.sum("__day").over(Window.orderBy("local_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__day")
    within = Window.partitionBy("local_date").orderBy("__object", "__minute").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__earlier", F.coalesce(F.sum("__bytes").over(within), F.lit(0))).drop("__bytes").join(days, "local_date")
    inside = Window.partitionBy(*cell).orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = free.join(cells, cell).withColumn("__before", F.col("__until") + F.col("__earlier") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return rows.join(F.broadcast(total), F.lit(True)).where(F.col("__total") - F.col("__before") > cap).drop("__object", "__minute", "__earlier", "__until", "__before", "__total")


def run_once(events: DataFrame, segments: DataFrame, now: Column, cap: int, clips_days: int = 30, keep_hours: int = 48, pre_seconds: int = 5, files: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """kind, id, bytes: what one retention pass does, as its report: segments to delete, events that lose their media for
    their age, and clips to purge until the rest is within the cap. A dry run changes nothing between the steps, so the last
    one still counts what the second would have purged."""
    cutoff = segment_cutoff(events, now, keep_hours, pre_seconds)
    gone = expired_segments(segments, cutoff).select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"), F.col("seg_bytes").alias("bytes"))
    old = expired_events(events, now - F.expr(f"interval {clips_days} days"))
    rest = events if dry_run else events.join(old.select("id"), "id", "left_anti")
    sizes = sized_clips(old, files).select("id", "bytes")
    purged = old.select("id").join(sizes, "id", "left").select(F.lit("expired").alias("kind"), "id", "bytes")
    return gone.unionByName(purged).unionByName(over_cap(rest, cap, files).select(F.lit("over cap").alias("kind"), "id", "bytes"))


def became_motion(events: DataFrame, wrong: DataFrame, motion_cameras: list[str]) -> DataFrame:
    """events after those named in wrong (id) turned out to be nothing but motion: on cameras that report motion they are
    motion events, on others they are gone."""
    known = events.join(wrong.select("id", F.lit(True).alias("__wrong")).distinct(), "id", "left").withColumn("__wrong", F.coalesce("__wrong", F.lit(False)))
    left = known.where(~F.col("__wrong") | F.col("camera_id").isin(motion_cameras))
    return left.withColumn("label", F.when(F.col("__wrong"), "motion").otherwise(F.col("label"))).drop("__wrong")
