"""Retention, changes and ordered computations over sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carried, jobs, ordered, retention
from ..sources.adapter import NOW, SEGMENTS, SIGHTINGS, read, segments, sightings, unmarked_sightings
from ..sources.ledger import Ledger
from ..sources.scratch import shared_path, stored
from .registry import query

_SIZED = "sized as (select s.*, coalesce(clip_bytes, file_bytes, 0) as size from sightings s left join (select distinct clip_path as path, 60000 + length(clip_path) * 1000 as file_bytes from sightings where clip_path is not null) on path = clip_path where clip_path is not null)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of clip files as their folder lists them."""
    paths = unmarked_sightings(spark, sf_dir).where("clip_path is not null").select("clip_path").distinct()
    return paths.select(F.col("clip_path").alias("path"), (60_000 + F.length("clip_path") * 1_000).cast("long").alias("length"))


@query("select id, size as bytes from (select id, size, coalesce(sum(size) over (order by local_date, label <> 'motion', started_at, id rows between unbounded preceding and 1 preceding), 0) as before from sized where not marked) where (select sum(size) from sized) - before > 3000000000", SIGHTINGS, _SIZED)
def wn_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.over_cap(sightings(spark, sf_dir), 3_000_000_000, _files(spark, sf_dir)).select("id", "bytes")


@query("select segment_id from segments where seg_start < (select least(timestamp '2024-01-20 00:00:00' - interval 48 hour, min(started_at) - interval 5 second) from sightings where clip_state = 'pending' and started_at >= timestamp '2024-01-20 00:00:00' - interval 72 hour) and seg_end < (select least(timestamp '2024-01-20 00:00:00' - interval 48 hour, min(started_at) - interval 5 second) from sightings where clip_state = 'pending' and started_at >= timestamp '2024-01-20 00:00:00' - interval 72 hour)", SIGHTINGS, SEGMENTS)
def sk_expired_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = retention.segment_cutoff(sightings(spark, sf_dir), F.expr("timestamp_ntz'2024-01-20 00:00:00'"), 48, 5)
    return retention.expired_segments(segments(spark, sf_dir), cutoff).select("segment_id")


_OLD = "select * from sightings where started_at < timestamp '2024-01-20 00:00:00' - interval 10 day and feedback is null and (clip_state <> 'purged' or clip_path is not null or snapshot_path is not null or thumb_path is not null or sharp_path is not null)"


@query(f"select id, label from ({_OLD})", SIGHTINGS)
def sk_expired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.expired_events(sightings(spark, sf_dir), F.expr("timestamp_ntz'2024-01-20 00:00:00' - interval 10 days")).select("id", "label")


@query("select clip_state, count(*) as n, count(*) filter (where ended_at = started_at) as n_closed from (select case when clip_state = 'pending' then 'failed' else clip_state end as clip_state, coalesce(ended_at, started_at) as ended_at, started_at from sightings) group by clip_state", SIGHTINGS)
def sk_close_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.closed(sightings(spark, sf_dir)).groupBy("clip_state").agg(F.count("*").alias("n"), F.count_if(F.col("ended_at") == F.col("started_at")).alias("n_closed"))


@query("select id, case when id % 3 = 0 then 'purged' else clip_state end as clip_state, case when id % 6 = 0 then null when id % 3 = 0 then 'old/' || clip_path else clip_path end as clip_path from sightings", SIGHTINGS)
def sk_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patches for every third event: the first moves its clip, the second purges it, and clears the path of every sixth."""
    events = sightings(spark, sf_dir).select("id", "clip_state", "clip_path")
    entry = lambda is_set, value: F.struct(is_set.alias("is_set"), value.cast("string").alias("value"))
    third = events.where("id % 3 = 0")
    moved = third.select("id", F.lit(1).alias("seq"), entry(F.lit(False), F.lit(None)).alias("clip_state"), entry(F.lit(True), F.concat(F.lit("old/"), "clip_path")).alias("clip_path"))
    purged = third.select("id", F.lit(2).alias("seq"), entry(F.lit(True), F.lit("purged")).alias("clip_state"), entry(F.col("id") % 6 == 0, F.lit(None)).alias("clip_path"))
    return retention.patched(events, moved.union(purged), ["clip_state", "clip_path"])


@query("select event_id, 10000000 + row_number() over (order by ts, event_id) as id from events where event_type = 'click'")
def sk_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts")
    have = spark.range(10_000_000, 10_000_001)
    return retention.with_ids(new, have, "ts", "event_id").select("event_id", F.col("id").cast("long").alias("id"))


@query("select camera_id, slot, id from (select camera_id, id % 500 as slot, id, label, row_number() over (partition by camera_id, id % 500 order by id desc) as r from sightings) where r = 1 and label <> 'motion'", SIGHTINGS)
def sk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert log: the last row of a key counts, and a motion row deletes it."""
    log = sightings(spark, sf_dir).select("camera_id", (F.col("id") % 500).alias("slot"), "id", (F.col("label") == "motion").alias("gone"))
    return retention.latest(log, ["camera_id", "slot"], "id", "gone")


@query("select conv_id, turn, nullif(substr(trim(text), 1, 200), '') as note from conversations")
def sk_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", retention.note(F.col("text")).alias("note"))


@query("select id, camera_id, label from (select id, camera_id, label, row_number() over (partition by camera_id, label order by id desc) as r from sightings where not marked) order by r, camera_id, label limit 37", SIGHTINGS)
def wn_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.round_robin(sightings(spark, sf_dir).where("not marked"), ["camera_id", "label"], "id", 37).select("id", "camera_id", "label")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as k from (select *, row_number() over (partition by user_id, date_trunc('day', ts) order by value desc, event_id) as r from events) where r = 1) where k <= 3")
def wn_best_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return ordered.best_per_slot(e, "user_id", F.date_trunc("day", "ts"), "value", 3, "event_id").select("user_id", "event_id", "value")


@query("select camera_id, run, min(started_at) as run_start, max(started_at) as run_end, count(*) as n from (select camera_id, started_at, cast(sum(new) over (partition by camera_id order by started_at rows unbounded preceding) as bigint) as run from (select *, case when started_at <= lag(started_at) over (partition by camera_id order by started_at) + interval 20 minute then 0 else 1 end as new from sightings)) group by camera_id, run", SIGHTINGS)
def st_motion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried.sessions(unmarked_sightings(spark, sf_dir), "camera_id", "started_at", "20 minutes")


@query(
    "select user_id, id, \"at\" from kept",
    "recursive o as (select user_id, event_id as id, cast(epoch_us(ts) as double) / 1000000 as \"at\", row_number() over (partition by user_id order by ts, event_id) as n from events)",
    "walk as (select user_id, id, \"at\", n, \"at\" as last, true as hit from o where n = 1 union all select o.user_id, o.id, o.\"at\", o.n, case when o.\"at\" - walk.last >= 0.9 * 86400 then o.\"at\" else walk.last end, o.\"at\" - walk.last >= 0.9 * 86400 from walk join o on o.user_id = walk.user_id and o.n = walk.n + 1)",
    "kept as (select * from walk where hit)",
)
def wn_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("double") / 1_000_000
    return carried.throttled(read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), at.alias("at")), "user_id", 86_400.0)


@query("select user_id, event_id, cast(sum(step) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as unwrapped from (select user_id, event_id, coalesce(((clock - lag(clock) over (partition by user_id order by event_id) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, clock) as step from (select user_id, event_id, (event_id * 1000000007) % 4294967296 as clock from events))")
def wn_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 1_000_000_007 % 4_294_967_296).alias("clock"))
    return carried.unwrapped(e, "user_id", "event_id", "clock", F.floor(F.col("event_id") / 4096)).select("user_id", "event_id", "unwrapped")


_UNITS = "units as materialized (select 'camera' || user_id % 4 as camera_id, event_id as seq, cast(event_id * 3000 + event_id * event_id % 1777 + case when event_id % 301 = 0 then 900000 else 0 end as bigint) as ts90, event_type = 'view' as key_frame, value as ms from events)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    ts = i * 3000 + i * i % 1777 + F.when(i % 301 == 0, 900_000).otherwise(0)
    return e.select(F.concat(F.lit("camera"), F.col("user_id") % 4).alias("camera_id"), i.alias("seq"), ts.alias("ts90"), (F.col("event_type") == "view").alias("key_frame"), F.col("value").alias("ms"))


@query(
    "select camera_id, seq, duration, cast(coalesce(sum(duration) over (partition by camera_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as decode_time from (select camera_id, seq, cast(least(greatest(floor(average + 0.5), 1), 45000) as bigint) as duration from walk)",
    "recursive " + _UNITS,
    "o as materialized (select *, row_number() over (partition by camera_id order by seq) as n, ts90 - lag(ts90) over (partition by camera_id order by seq) as step from units)",
    "walk as (select camera_id, seq, n, 3000.0::double as average from o where n = 1 union all select o.camera_id, o.seq, o.n, case when step between 1 and 45000 then average + 0.05::double * (step - average) else average end from walk join o on o.camera_id = walk.camera_id and o.n = walk.n + 1)",
)
def wn_frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live stream's frames with durations from a decayed average."""
    return carried.frame_durations(_units(spark, sf_dir)).select("camera_id", "seq", "duration", "decode_time")


@query(
    "select camera_id, seq, round(mean + 1e-9, 6) as mean_ms from walk",
    "recursive " + _UNITS,
    "o as materialized (select *, row_number() over (partition by camera_id order by seq) as n from (select *, min(seq) filter (where key_frame) over (partition by camera_id) as first from units) where seq >= first)",
    "walk as (select camera_id, seq, n, ms as mean from o where n = 1 union all select o.camera_id, o.seq, o.n, mean * 0.95::double + ms * 0.05::double from walk join o on o.camera_id = walk.camera_id and o.n = walk.n + 1)",
)
def wn_decode_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding times, averaged with decay from each camera's first key frame on."""
    return carried.decode_means(_units(spark, sf_dir)).select("camera_id", "seq", F.round(F.col("mean_ms") + 1e-9, 6).alias("mean_ms"))


@query("select camera_id, median(top_score) as median_score, greatest(max(top_score), 0) as top_score from (select *, row_number() over (partition by camera_id order by id desc) as r from sightings) where r <= 100 group by camera_id", SIGHTINGS)
def ag_last_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.last_scores(unmarked_sightings(spark, sf_dir), "camera_id", "id", "top_score")


@query("select event_type, round(avg(value), 6) as mean, max(value) filter (where i = least(n * 95 // 100, n - 1)) as p, count(*) as n from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) group by event_type")
def ag_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.nearest_rank(read(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("select user_id, window_id, coalesce(max(ts) filter (where key_frame and ts <= from_at), min(ts) filter (where key_frame)) as first_at, max(ts) filter (where ts <= from_at + interval 2 day) as last_at from (select user_id, ts, event_type = 'view' as key_frame from events) join (select user_id, event_id as window_id, ts as from_at from events where event_type = 'error') using (user_id) group by user_id, window_id")
def wn_clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return _clip_rows(e, e.where("event_type = 'error'"))


@query("select user_id, window_id, coalesce((select max(ts) from events f where f.user_id = w.user_id and event_type = 'view' and ts <= from_at), (select min(ts) from events f where f.user_id = w.user_id and event_type = 'view')) as first_at, (select max(ts) from events f where f.user_id = w.user_id and ts <= from_at + interval 2 day) as last_at from (select user_id, event_id as window_id, ts as from_at from events) w")
def wn_clip_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As wn_clip_rows, with every event as a window."""
    e = read(spark, sf_dir, "events")
    return _clip_rows(e, e)


def _clip_rows(e: DataFrame, of: DataFrame) -> DataFrame:
    frames = e.select("user_id", F.col("ts").alias("at"), (F.col("event_type") == "view").alias("key_frame"))
    windows = of.select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("from_at"), F.expr("ts + interval 2 days").alias("to_at"))
    return ordered.clip_rows(frames, windows, "user_id")


_TRACKS = "tracks as (select id // 6 as recording, *, id % 5 = 0 as moved, [{'quality': (id * 7919 % 100) / 100.0, 'crop': id * 10}, {'quality': (id * 104729 % 97) / 100.0, 'crop': id * 10 + 1}] as crops from sightings)"


@query(
    """select t.recording, t.label, t.id, coalesce(s.started, t.started_at) as started_at, case when t.ended_at is not null then s.ended end as ended_at, case when t.ended_at is not null then s.top else t.top_score end as top_score, t.median_score,
        case when t.ended_at is not null then s.any_moved else t.moved end as moved, case when t.ended_at is not null then coalesce(c.crops, []) else list_transform(t.crops, lambda x: x.crop) end as crops
    from tracks t join spans s on s.id = t.id left join best c on c.recording = t.recording and c.label = t.label
    union all select recording, label, id, started_at, ended_at, top_score, median_score, moved, list_transform(crops, lambda x: x.crop) from tracks where label = 'motion' and recording not in (select recording from tracks where label <> 'motion')""",
    SIGHTINGS,
    _TRACKS,
    "spans as (select recording, label, max_by(id, (top_score, -id)) as id, min(started_at) filter (where ended_at is not null) as started, max(ended_at) as ended, max(top_score) filter (where ended_at is not null) as top, bool_or(moved) filter (where ended_at is not null) as any_moved from tracks where label <> 'motion' group by recording, label)",
    "best as (select recording, label, list(crop order by place) as crops from (select recording, label, c.crop as crop, row_number() over (partition by recording, label order by c.quality desc, id, c.crop) as place from (select recording, label, id, unnest(crops) as c from tracks where label <> 'motion' and ended_at is not null)) where place <= 3 group by recording, label)",
)
def ag_merged_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events at a time as the tracks of one recording, with two crops each."""
    s, i = unmarked_sightings(spark, sf_dir), F.col("id")
    crop = lambda quality, k: F.struct(quality.alias("quality"), (i * 10 + k).alias("crop"))
    crops = F.array(crop(i * 7919 % 100 / 100.0, 0), crop(i * 104729 % 97 / 100.0, 1))
    return ordered.merged_recordings(s.withColumn("recording", F.floor(i / 6)).withColumn("moved", i % 5 == 0).withColumn("crops", crops))


@query("select user_id, time_bucket(interval 2 hour, ts) as start, count(*) as frames, round(sum(value), 6) as amount from events group by user_id, time_bucket(interval 2 hour, ts)")
def ag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "2 hours").alias("w")).agg(F.count("*").alias("frames"), F.round(F.sum("value"), 6).alias("amount")).select("user_id", F.col("w.start").alias("start"), "frames", "amount")


@query(
    "select user_id, id, \"at\" from kept",
    "recursive o as (select user_id, event_id as id, cast(epoch_us(ts) as double) / 1000000 as \"at\", row_number() over (partition by user_id order by ts, event_id) as n from events)",
    "walk as (select user_id, id, \"at\", n, \"at\" as last, true as hit, 1 as k from o where n = 1 union all select o.user_id, o.id, o.\"at\", o.n, case when o.\"at\" - walk.last >= 14400 and k < 3 then o.\"at\" else walk.last end, o.\"at\" - walk.last >= 14400 and k < 3, case when o.\"at\" - walk.last >= 14400 and k < 3 then k + 1 else k end from walk join o on o.user_id = walk.user_id and o.n = walk.n + 1)",
    "kept as (select * from walk where hit)",
)
def wn_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pictures of a user at most, four hours apart."""
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("double") / 1_000_000
    return carried.throttled(read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), at.alias("at")), "user_id", 14_400.0, 1.0, 3)


_WALL = "case when a_at is null or abs(a_at + (b_ts - a_ts) * 100 // 9 - b_at) > 500000 then b_at else a_at + (b_ts - a_ts) * 100 // 9 end"
_ANEW = "(a_at is null or abs(a_at + (b_ts - a_ts) * 100 // 9 - b_at) > 500000)"


@query(
    """select camera_id, d_start as started_us, d_end as ended_us, d_n as n, d_bytes as bytes from walk where d_n is not null
    union all select camera_id, coalesce(s_start, t0), t0 + lasts * 100 // 9, coalesce(s_n, 0) + 1, coalesce(s_bytes, 0) + b_size from (select *, coalesce(s_last, 9000) as lasts, """ + _WALL + """ as t0 from (select *, row_number() over (partition by camera_id order by k desc) as r from walk) where r = 1 and b_at is not null)""",
    "recursive packets as materialized (select 'camera' || user_id as camera_id, (event_id // 50) * 100000 + event_id % 977 as arrived, (event_id // 50) * 9000 as ts, event_type = 'view' as key, event_id % 5000 as size, row_number() over (partition by user_id order by (event_id // 50) * 9000, (event_id // 50) * 100000 + event_id % 977) as k from events)",
    f"""walk as (
        select distinct camera_id, 0::bigint as k, null::bigint as b_at, null::bigint as b_ts, null::bigint as b_size, null::bigint as a_at, null::bigint as a_ts, null::bigint as s_start, null::bigint as s_end, null::bigint as s_n, null::bigint as s_bytes, null::bigint as s_last, null::bigint as d_start, null::bigint as d_end, null::bigint as d_n, null::bigint as d_bytes from packets
        union all
        select camera_id, k, case when starts then arrived end, case when starts then ts end, case when starts then size end, a_at, a_ts,
            case when not closes then n_start end, case when not closes then n_end end, case when not closes then n_n end, case when not closes then n_bytes end, case when not closes then n_last end,
            case when closes then n_start end, case when closes then n_end end, case when closes then n_n end, case when closes then n_bytes end
        from (select *, key and n_n is not null and b_at is not null and (n_end - n_start >= 2000000 or n_bytes > 67108864) as closes
            from (select camera_id, k, arrived, ts, key, size, starts, b_at, case when b_at is not null and {_ANEW} then b_at else a_at end as a_at, case when b_at is not null and {_ANEW} then b_ts else a_ts end as a_ts,
                    case when b_at is null then s_start else coalesce(s_start, t0) end as n_start, case when b_at is null then s_end else t0 + lasts * 100 // 9 end as n_end,
                    case when b_at is null then s_n else coalesce(s_n, 0) + 1 end as n_n, case when b_at is null then s_bytes else coalesce(s_bytes, 0) + b_size end as n_bytes, case when b_at is null then s_last else lasts end as n_last
                from (select w.* exclude (k, d_start, d_end, d_n, d_bytes), p.k, p.arrived, p.ts, p.key, p.size, w.b_at is not null or w.s_n is not null or p.key as starts, case when p.ts - w.b_ts between 1 and 450000 then p.ts - w.b_ts else 9000 end as lasts, {_WALL} as t0
                    from walk w join packets p on p.camera_id = w.camera_id and p.k = w.k + 1))))""",
)
def wn_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user as a packet 0.1 s after the one before."""
    e = read(spark, sf_dir, "events")
    n = F.floor(F.col("event_id") / 50)
    packets = e.select(F.concat(F.lit("camera"), F.col("user_id").cast("string")).alias("camera_id"), (n * 100_000 + F.col("event_id") % 977).alias("arrived_us"), (n * 9000).alias("ts90"), (F.col("event_type") == "view").alias("key_frame"), (F.col("event_id") % 5000).alias("size"))
    return ordered.recorded(packets, 2)


_BEFORE_20 = "(select least(timestamp '2024-01-20 00:00:00' - interval 48 hour, min(started_at) - interval 5 second) from sightings where clip_state = 'pending' and started_at >= timestamp '2024-01-20 00:00:00' - interval 72 hour)"
@query(
    f"""select 'segment' as kind, segment_id as id, seg_bytes as bytes from segments where seg_start < {_BEFORE_20} and seg_end < {_BEFORE_20}
    union all select 'expired', id, case when clip_path is not null then coalesce(clip_bytes, 60000 + length(clip_path) * 1000) end from old
    union all select 'over cap', id, size from (select id, size, coalesce(sum(size) over (order by local_date, label <> 'motion', started_at, id rows between unbounded preceding and 1 preceding), 0) as before from left_over where not marked) where (select sum(size) from left_over) - before > 100000000""",
    SIGHTINGS,
    SEGMENTS,
    f"old as ({_OLD})",
    _SIZED,
    "left_over as (select * from sized where id not in (select id from old))",
)
def sk_run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retention pass with all its steps."""
    return retention.run_once(sightings(spark, sf_dir), segments(spark, sf_dir), F.expr("timestamp_ntz'2024-01-20 00:00:00'"), 100_000_000, clips_days=10, files=_files(spark, sf_dir))


@query("select id, camera_id, case when clip_state = 'failed' then 'motion' else label end as label from sightings where clip_state <> 'failed' or camera_id in ('yard', 'gate')", SIGHTINGS)
def sk_became_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = unmarked_sightings(spark, sf_dir).select("id", "camera_id", "label", "clip_state")
    return retention.became_motion(s, s.where("clip_state = 'failed'"), ["yard", "gate"]).select("id", "camera_id", "label")


@query(
    """select file, case when id_of is not null then 'motion' when n > 0 then 'events' else 'nothing' end as became, n, top_score from (
        select f.file, case when f.recording % 7 = 0 and f.ended <= timestamp '2024-01-15 00:00:00' - interval 10 second then 1 end as id_of,
            case when f.recording % 7 <> 0 then case when objects > 0 then labels else total end when f.ended <= timestamp '2024-01-15 00:00:00' - interval 10 second then 1 else 0 end as n,
            case when f.recording % 7 <> 0 then case when objects > 0 then object_score else motion_score end when f.ended <= timestamp '2024-01-15 00:00:00' - interval 10 second then 0.0 end as top_score
        from (select id // 6 as recording, concat('file', cast(id // 6 as varchar)) as file, max(coalesce(ended_at, started_at)) as ended, count(*) as total, count(*) filter (where label <> 'motion') as objects, count(distinct label) filter (where label <> 'motion') as labels, max(top_score) filter (where label <> 'motion') as object_score, max(top_score) as motion_score from sightings group by id // 6) f)""",
    SIGHTINGS,
)
def sk_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings imported by two runs, of which the second keeps nothing of those in which nothing was found, and a third that has nothing left to do."""
    s, i = unmarked_sightings(spark, sf_dir).withColumn("recording", F.floor(F.col("id") / 6)), F.col("id")
    named = s.withColumn("hub", F.lit("h")).withColumn("file", F.concat(F.lit("file"), "recording"))
    ended = F.coalesce("ended_at", "started_at")
    files = named.groupBy("hub", "file").agg(F.min("camera_id").alias("camera_id"), F.min("started_at").alias("file_start"), F.max(ended).alias("file_end"), F.min("clip_path").alias("clip_path"), F.sum("clip_bytes").alias("bytes"))
    tracks = named.where("recording % 7 <> 0").withColumn("moved", i % 5 == 0).withColumn("ended_at", ended).withColumn("crops", F.array().cast("array<struct<quality:double,crop:long>>"))
    files, made = stored(files, "files"), jobs.Imports(Ledger(spark, shared_path(spark, "imports")))
    for day, keep_motion in (("2024-01-15", True), ("2024-03-15", False), ("2024-03-15", False)):
        made.run(files, tracks, F.expr(f"timestamp_ntz'{day} 00:00:00'"), keep_motion=keep_motion)
    of_file = made.events().groupBy("hub", "file").agg(F.count("*").alias("n"), F.max("top_score").alias("top_score"))
    became = F.when(F.col("event_id") > 0, "motion").when(F.col("event_id") == jobs.ANALYSED, "events").otherwise("nothing")
    return made.outcomes().join(of_file, ["hub", "file"], "left").select("file", became.alias("became"), F.coalesce("n", F.lit(0)).alias("n"), "top_score")


@query(
    "select id, case when outcome in ('still unnamed') then 'motion' when outcome = 'not an animal' then new_label else 'animal' end as label, common_name from (select id, case when old_name is not null then 'kept' else outcome end as outcome, new_label, coalesce(old_name, case when outcome = 'named' then given end) as common_name from (select s.id, s.common_name as old_name, a.* exclude (id) from sightings s join (select id, case when id % 4 = 0 then 'Elk' end as given, case when clip_path is null or ended_at is null then 'kept' when id % 4 = 0 then 'named' when id % 3 = 0 and id % 5 > 0 then 'not an animal' when id % 5 = 0 and id % 4 > 0 then 'still unnamed' else 'unknown' end as outcome, case when id % 3 = 0 then 'person' end as new_label from sightings) a on a.id = s.id where s.label = 'animal'))",
    SIGHTINGS,
)
def sk_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animals after classifying the unnamed ones again, twice: the second run finds only those without an answer."""
    stored = unmarked_sightings(spark, sf_dir).where("label = 'animal'").select("id", "label", "common_name", "camera_id", "local_date", "clip_path", "ended_at")
    i = F.col("id")
    moved, said = i % 5 > 0, F.when((i % 3 == 0) & (i % 5 > 0), "person")
    answers = stored.select("id", F.when(i % 4 == 0, "Elk").alias("name"), said.alias("said"), moved.alias("moved"), F.lit(True).alias("has_crops"))
    made = jobs.Reclassified(Ledger(spark, shared_path(spark, "reclassified")))
    for _ in range(2):
        made.run(stored, answers, "2000-01-01")
    return made.events(stored).select("id", "label", "common_name")
