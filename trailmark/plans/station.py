"""A station's cameras, its logs and rates, and days whose midnight is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import ordered, station
from ..sources.adapter import CAMERAS, SIGHTINGS, read, unmarked_sightings
from .analysis import looked_at_frames
from .registry import query


def _cameras(spark: SparkSession) -> DataFrame:
    """Four cameras of the fixture: two streams of a hub, of which one is turned off, a battery camera and one without a hub."""
    rows = [
        ("driveway", "Driveway", "stream", "h1", True, True, "rtsp://10.0.0.1/h264Preview_01_sub", "rtsp://10.0.0.1/h264Preview_01_main", None),
        ("yard", "Yard", "stream", "h1", False, False, "rtsp://a:b@10.0.0.2/x", None, "rtsp://10.0.0.2/y"),
        ("gate", "Gate", "hub_clips", "h2", None, True, None, None, None),
        ("trail", "Trail", "stream", None, True, False, "rtsp://10.0.0.4/live", None, None),
    ]
    return spark.createDataFrame(rows, "id string, name string, kind string, hub string, enabled boolean, record boolean, detect_url string, record_url string, full_url string")


@query(
    """select camera_id, count(*) as n, case camera_id when 'driveway' then true when 'trail' then false when 'gate' then false end as record,
        case camera_id when 'driveway' then 'rtsp://u%201:p%40@10.0.0.1/h264Preview_01_main' when 'trail' then 'rtsp://10.0.0.4/live' end as live_url, camera_id in ('driveway', 'gate') as "full", case camera_id when 'gate' then 120 end as live_seconds
    from sightings where camera_id <> 'yard' group by camera_id""",
    SIGHTINGS,
)
def pr_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the enabled cameras, with what a page shows of each and the stream that a look at it opens."""
    assert len(CAMERAS) == 4
    hubs = spark.createDataFrame([("h1", "u 1", "p@"), ("h2", "v", "q")], "hub string, user string, password string")
    own = station.with_hub_credentials(_cameras(spark), hubs)
    urls = own.select("id", station.live_url(F.col("record"), F.col("record_url"), F.col("detect_url")).alias("live_url"))
    shown = station.listed_cameras(own, battery_live=True).join(urls, "id")
    counts = unmarked_sightings(spark, sf_dir).groupBy(F.col("camera_id").alias("id")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(shown), "id").select(F.col("id").alias("camera_id"), "n", "record", "live_url", "full", "live_seconds")


@query("select event_type, round(avg(value), 6) as mean, max(value) filter (where i = least(n * 95 // 100, n - 1)) as p, count(*) as n from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from (select *, row_number() over (partition by event_type order by event_id desc) as r from events) where r <= 200) group by event_type")
def ag_last_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and percentile of each kind's last 200 values."""
    return ordered.last_times(read(spark, sf_dir, "events"), "event_type", "event_id", "value").withColumn("mean", F.round("mean", 6))


@query(
    "select user_id, ended_at, n, round(n / (ended_at - start), 9) as fps, round(bytes * 8 / 1000.0 / (ended_at - start), 9) as kbps from (select user_id, win, max(case when cut then \"at\" end) as ended_at, max(case when cut then start end) as start, count(*) as n, sum(bytes) as bytes from walk where win > 0 group by user_id, win) where ended_at is not null",
    "recursive o as (select user_id, epoch_us(ts) / 1000000.0::double as \"at\", event_id % 5000 as bytes, row_number() over (partition by user_id order by ts, event_id) as n from events)",
    "walk as (select user_id, n, \"at\", bytes, 0::bigint as win, \"at\" as start, \"at\" as last, true as cut from o where n = 1 union all select o.user_id, o.n, o.\"at\", o.bytes, case when w.cut then w.win + 1 else w.win end, w.last, case when o.\"at\" - w.last >= 7200 then o.\"at\" else w.last end, o.\"at\" - w.last >= 7200 from walk w join o on o.user_id = w.user_id and o.n = w.n + 1)",
)
def ag_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each user's events over windows of two hours or more."""
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("double") / 1_000_000
    units = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), at.alias("at"), (F.col("event_id") % 5000).alias("bytes"))
    return ordered.measured(units, "user_id", 7_200.0).select("user_id", "ended_at", "n", F.round("fps", 9).alias("fps"), F.round("kbps", 9).alias("kbps"))


@query("select camera_id, time_bucket(interval 1 minute, timestamp '2024-01-01 00:00:00' + to_microseconds(t * 1000)) as minute, count(*) as analysed, count(*) filter (where moving) as motion, count(*) filter (where due) as looks, count(*) filter (where found) as dropped, round(avg(id % 100), 6) as mean_ms from (select 'camera' || user_id % 8 as camera_id, event_id as id, 250 * row_number() over (partition by user_id % 8 order by event_id) + case when event_id % 211 = 0 then 9000 else 0 end as t, event_type <> 'error' as moving, event_id % 53 = 0 as due, event_id % 37 = 0 as found from events) group by all")
def ag_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a station logs of its cameras every minute."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, at_ms / 1000)")
    frames = looked_at_frames(spark, sf_dir).select("camera_id", at.alias("at"), "moving", F.col("due").alias("looked_at"), F.col("found").alias("dropped"), (F.col("id") % 100).alias("ms"))
    return station.minute_counters(frames).withColumn("mean_ms", F.round("mean_ms", 6))


_HAVANA = "timezone('America/Havana', d)"


# Of a midnight that comes twice, the earlier one, an hour before the other.
@query(f"select event_id, case when timezone('America/Havana', {_HAVANA} - interval 1 hour) = d then timezone('UTC', {_HAVANA} - interval 1 hour) when timezone('America/Havana', {_HAVANA}) = d then timezone('UTC', {_HAVANA}) else d end as midnight from (select event_id, cast(date '2020-01-01' + cast(event_id % 2500 as integer) as timestamp) as d from events)")
def fn_midnights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of days where clocks are put forward at midnight once a year."""
    e = read(spark, sf_dir, "events")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("event_id") % 2500).cast("int"))
    return e.select("event_id", clock.local_midnight(day, "America/Havana").alias("midnight"))


@query(
    """select user_id, window_id, stretch, coalesce(max(ts) filter (where key_frame and ts <= from_at), min(ts) filter (where key_frame)) as first_at, max(ts) filter (where ts <= to_at) as last_at
    from (select w.user_id, window_id, from_at, to_at, coalesce(min(stretch) filter (where last >= from_at), max(stretch)) as stretch from (select user_id, event_id as window_id, ts as from_at, ts + interval 2 day as to_at from events where event_type = 'error') w join (select user_id, stretch, max(ts) as last from f group by user_id, stretch) e using (user_id) group by all) join f using (user_id, stretch) group by user_id, window_id, stretch""",
    "s as (select *, cast(sum(case when info is distinct from before or first then 1 else 0 end) over (partition by user_id order by segment rows unbounded preceding) as bigint) as stretch from (select user_id, segment, info, lag(info) over (partition by user_id order by segment) as before, lag(segment) over (partition by user_id order by segment) is null as first from (select distinct user_id, time_bucket(interval 3 day, ts) as segment, dayofyear(time_bucket(interval 3 day, ts)) // 3 % 5 < 3 as info from events)))",
    "f as (select e.user_id, ts, event_type = 'view' as key_frame, stretch from events e join s on s.user_id = e.user_id and s.segment = time_bucket(interval 3 day, ts))",
)
def wn_clip_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips from recordings of three days, whose parameters change now and then."""
    e = read(spark, sf_dir, "events")
    # Buckets of three days as counted from 2000-01-03, as SQL's do.
    days = F.floor(F.timestamp_diff("DAY", F.expr("timestamp_ntz'2000-01-03 00:00:00'"), F.col("ts")) / 3) * 3
    segment = F.expr("timestamp_ntz'2000-01-03 00:00:00'") + F.make_dt_interval(days.cast("int"))
    frames = e.select("user_id", F.col("ts").alias("at"), (F.col("event_type") == "view").alias("key_frame"), segment.alias("segment"))
    segments = frames.select("user_id", "segment").distinct().withColumn("info", F.floor(F.dayofyear("segment") / 3) % 5 < 3)
    windows = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("from_at"), F.expr("ts + interval 2 days").alias("to_at"))
    return ordered.clip_rows_of_one_kind(frames, segments, windows, "user_id")
