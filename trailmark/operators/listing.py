"""Lists of events: filters, keyset pages, scans by time and day, and what a list shows of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

WINDOWS = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}


def window_start(window: str | None, now: str) -> Column:
    """The start of an enumerated look-back window (24h if none is named)."""
    if (window or "24h") not in WINDOWS:
        raise ValueError(f"window has to be one of {', '.join(WINDOWS)}")
    return F.expr(f"timestamp_ntz'{now}' - interval {WINDOWS[window or '24h']}")


def matching(events: DataFrame, camera: str | None = None, label: str | None = None, since: Column | None = None, marked: bool = False, species: str | None = None) -> DataFrame:
    """Events that meet every condition given. A species is a common or scientific name, whatever the case of A-Z."""
    if camera:
        events = events.where(F.col("camera_id") == camera)
    if label:
        events = events.where(F.col("label") == label)
    if since is not None:
        events = events.where(F.col("started_at") >= since)
    if marked:
        events = events.where("marked")
    if species:
        name = ascii_lower(F.lit(species))
        events = events.where((ascii_lower(F.col("common_name")) == name) | (ascii_lower(F.col("scientific_name")) == name))
    return events


def page(events: DataFrame, limit: int = 50, after: int | None = None, before: int | None = None, newest_first: bool = True) -> DataFrame:
    """One page by id, exclusive of both cursors; the limit has to be from 1 to 500. Spark keeps only the page in each task."""
    if not 1 <= limit <= 500:
        raise ValueError("limit has to be from 1 to 500")
    if after is not None:
        events = events.where(F.col("id") > after)
    if before is not None:
        events = events.where(F.col("id") < before)
    return events.orderBy(F.desc("id") if newest_first else F.asc("id")).limit(limit)


def cursors(paged: DataFrame) -> DataFrame:
    return paged.agg(F.max("id").alias("next_after_id"), F.min("id").alias("next_before_id"), F.count("*").alias("n"))


def between(events: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    events = events.where(F.col("started_at") >= start)
    return events if end is None else events.where(F.col("started_at") < end)


def shown(events: DataFrame) -> DataFrame:
    """With the paths a client may ask for and whether the event still goes on."""
    url = lambda kind: F.concat(F.lit("/api/v1/events/"), F.col("id").cast("string"), F.lit(f"/{kind}"))
    return events.select(
        "*",
        F.when(F.col("snapshot_path").isNotNull(), url("snapshot")).alias("snapshot_url"),
        F.when(F.coalesce("thumb_path", "snapshot_path").isNotNull(), url("thumb")).alias("thumb_url"),
        F.when((F.col("clip_state") == "ready") & F.col("clip_path").isNotNull(), url("clip")).alias("clip_url"),
        F.col("ended_at").isNull().alias("active"),
    )


def prunable(events: DataFrame, cameras: list[str], labels: list[str], before: str) -> DataFrame:
    """Ended events of some cameras and labels from before a local day."""
    return events.where(F.col("camera_id").isin(cameras) & F.col("label").isin(labels) & (F.col("local_date") < F.lit(before).cast("date")) & F.col("ended_at").isNotNull())


def reclassifiable(events: DataFrame, since: str, cameras: list[str] | None = None, named_too: bool = False) -> DataFrame:
    """Ended animals with a clip from a local day on; only unnamed ones unless named_too."""
    events = events.where((F.col("label") == "animal") & F.col("clip_path").isNotNull() & F.col("ended_at").isNotNull() & (F.col("local_date") >= F.lit(since).cast("date")))
    events = events if named_too else events.where(F.col("common_name").isNull())
    return events if not cameras else events.where(F.col("camera_id").isin(cameras))
