"""Looks of the detector, clips and what they wait for, visits that are due for a look."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analysis, tracking
from ..sources.adapter import read
from .registry import query
from .stateful import moving_detections

_FRAMES = "frames as materialized (select 'camera' || user_id % 8 as camera_id, event_id as id, row_number() over (partition by user_id % 8 order by event_id) as k, 250 * row_number() over (partition by user_id % 8 order by event_id) + case when event_id % 211 = 0 then 9000 else 0 end as t, event_type <> 'error' as moving, event_id % 53 = 0 as due, event_id % 37 = 0 as found from events), ordered as materialized (select *, row_number() over (partition by camera_id order by t, id) as n from frames)"


def looked_at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight cameras, four a second with pauses; most move, few are due or show anything."""
    e, i = read(spark, sf_dir, "events").withColumn("of", F.col("user_id") % 8), F.col("event_id")
    k = F.row_number().over(Window.partitionBy("of").orderBy("event_id")).cast("long")
    at = 250 * k + F.when(i % 211 == 0, 9_000).otherwise(0)
    return e.select(F.concat(F.lit("camera"), "of").alias("camera_id"), i.alias("id"), at.alias("at_ms"), (F.col("event_type") != "error").alias("moving"), (i % 53 == 0).alias("due"), (i % 37 == 0).alias("found"))


@query(
    "select camera_id, id, t as at_ms, looks, cast(fruitless as integer) as fruitless from walk where n > 0",
    "recursive " + _FRAMES,
    """walk as (
        select distinct camera_id, 0::bigint as n, null::bigint as id, null::bigint as t, 0::bigint as fruitless, null::bigint as looked, null::bigint as moved, false as looks from frames
        union all
        select camera_id, n, id, t, case when not looks then calm when found or due then 0 else calm + 1 end, case when looks then t else looked end, moved, looks
        from (select *, (moving or due) and not (not due and calm >= 15 and looked is not null and t - looked < 1000) as looks
            from (select o.camera_id, o.n, o.id, o.t, o.moving, o.due, o.found, w.looked, case when o.moving then o.t else w.moved end as moved, case when not o.moving and coalesce(o.t - w.moved > 10000, true) then 0 else w.fruitless end as calm
                from walk w join ordered o on o.camera_id = w.camera_id and o.n = w.n + 1)))""",
)
def st_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of each camera the detector looks at."""
    return analysis.looks(looked_at_frames(spark, sf_dir))


def jobs_and_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Objects ask for a clip as they end; recordings of up to two minutes are known a while after their end, some very late."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    ms = F.floor(F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1_000)
    e = e.select(F.concat(F.lit("camera"), F.col("user_id") % 4).alias("camera_id"), i.alias("id"), ms.alias("ms"), "event_type")
    jobs = e.where("event_type <> 'error'").select("id", "camera_id", (F.col("ms") - 5_000).alias("from_ms"), (F.col("ms") + 1_000 * (F.col("id") % 40)).alias("to_ms"), (F.col("ms") + 1_000 * (F.col("id") % 40)).alias("asked_ms"))
    end = F.col("ms") + 60_000 + 1_000 * (F.col("id") % 60)
    segments = e.where("event_type = 'error'").select("camera_id", (F.col("ms") - 30_000).alias("start_ms"), end.alias("end_ms"), (end + F.when(F.col("id") % 5 == 0, 200_000).otherwise(1_500)).alias("known_ms"))
    return jobs, segments


_MS = "((epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) // 1000)"


@query(
    """select camera_id, id, decided as decided_ms, coalesce(reached <= until, false) as covered, cast((select count(*) from pairs p where p.id = d.id and known <= decided) as integer) as n_segments,
        greatest(lo, coalesce((select min(s_lo) from pairs p where p.id = d.id and known <= decided), lo)) as start_ms
    from (select j.*, asked + 60000 as until, least(coalesce(r.reached, asked + 60000), asked + 60000) as decided, r.reached from jobs j left join (select id, min(greatest(known, asked)) as reached from pairs where s_hi >= hi and known <= asked + 60000 group by id) r on r.id = j.id) d""",
    f"jobs as (select event_id as id, 'camera' || user_id % 4 as camera_id, {_MS} - 5000 as lo, {_MS} + 1000 * (event_id % 40) as hi, {_MS} + 1000 * (event_id % 40) as asked from events where event_type <> 'error')",
    f"segs as (select 'camera' || user_id % 4 as camera_id, {_MS} - 30000 as s_lo, {_MS} + 60000 + 1000 * (event_id % 60) as s_hi, {_MS} + 60000 + 1000 * (event_id % 60) + case when event_id % 5 = 0 then 200000 else 1500 end as known from events where event_type = 'error')",
    "pairs as (select * from jobs join segs using (camera_id) where s_hi > lo and s_lo < hi and s_lo >= lo - 600000)",
)
def st_clip_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each clip is cut, and from how many recordings."""
    return analysis.clip_jobs(*jobs_and_segments(spark, sf_dir))


@query()
def st_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that weren't seen for 0.4 s, with the boxes where to look for them."""
    return tracking.visits(moving_detections(spark, sf_dir), tracking.Settings(due_seconds=0.4)).where("kind = 'due'")
