"""Motion events, recordings in which nothing was found, crops, and what hubs and streams say of themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import motion, retention
from ..sources.adapter import DETECTIONS, SIGHTINGS, detections, read, unmarked_sightings
from .registry import query

_FRAMES = "frames as materialized (select *, row_number() over (partition by camera_id order by at_ms, id) as k from (select concat('camera', user_id) as camera_id, event_id as id, 400 * i + event_id % 700 + 9000 * (i // 23) as at_ms, event_type <> 'error' as moving, value / 500 as area, value > 250 as objects from (select *, row_number() over (partition by user_id order by event_id) as i from events)))"
#: One step of the walk per frame of a camera: what holds after it, and the event that it closed.
_WALK = """walk as (
 select distinct camera_id, 0::bigint as k, null::bigint as since, null::bigint as seen, null::double as area, null::bigint as best, null::bigint as started, null::bigint as last_at, null::bigint as picture, 0::bigint as n, null::bigint as until, null::bigint as done, null::bigint as done_start, null::bigint as done_end, null::bigint as done_picture from frames
 union all
 select camera_id, k, case when not closes then since end, seen, case when not closes then area end, case when not closes then best end,
  case when closes then null when splits then at_ms when starts then since else started end,
  case when splits or starts or (hit and started is not null) then at_ms else last_at end,
  case when splits then at_ms when starts then best else picture end,
  n + (splits or starts)::bigint, case when closes then at_ms + 12000 else until end,
  case when closes or splits then n end, case when closes or splits then started end, case when closes then last_at when splits then at_ms end, case when closes or splits then picture end
 from (select *, hit and started is null and at_ms - since >= 3000 and (until is null or at_ms >= until) as starts, hit and started is not null and at_ms - started >= 20000 as splits,
   started is not null and (objects or (not hit and at_ms - last_at > 5000)) as closes
  from (select camera_id, k, at_ms, objects, hit, started, last_at, picture, n, until, case when hit then at_ms else seen end as seen,
    case when objects then null when not hit then since when anew or since is null then at_ms else since end as since,
    case when objects then null when not hit then area when anew or area is null or new_area > area then new_area else area end as area,
    case when objects then null when not hit then best when anew or area is null or new_area > area then at_ms else best end as best
   from (select w.camera_id, f.k, f.at_ms, f.objects, f.area as new_area, f.moving and not f.objects as hit, coalesce(f.at_ms - w.seen > 1000, true) as anew, w.since, w.seen, w.area, w.best, w.started, w.last_at, w.picture, w.n, w.until
     from walk w join frames f on f.camera_id = w.camera_id and f.k = w.k + 1))))"""


@query(f"with recursive {_FRAMES}, {_WALK} select camera_id, done as n, done_start as started_ms, done_end as ended_ms, done_picture as picture_ms from walk where done is not null union all select camera_id, n, started, last_at, picture from (select *, row_number() over (partition by camera_id order by k desc) as r from walk) where r = 1 and started is not null")
def st_motion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion of each user's camera, which sees a frame for each event of the user and pauses after every 23rd."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    at = 400 * F.col("i") + F.col("event_id") % 700 + 9000 * F.floor(F.col("i") / 23)
    frames = e.select(F.concat(F.lit("camera"), "user_id").alias("camera_id"), F.col("event_id").alias("id"), at.alias("at_ms"), (F.col("event_type") != "error").alias("moving"), (F.col("value") / 500).alias("area"), (F.col("value") > 250).alias("objects"))
    return motion.motion_events(frames, cooldown=12_000, longest=20_000)


@query("select min(camera_id) as camera_id, 'motion' as label, 'pir' as raw_class, min(started_at) as started_at, max(ended_at) as ended_at, 0.0::double as top_score, 0.0::double as median_score, 'ready' as clip_state, clip_path, max(clip_bytes) as clip_bytes from sightings where clip_path is not null group by clip_path having count(*) filter (where label <> 'motion' and top_score > 0.5) = 0", SIGHTINGS)
def sk_silent_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in which no sure object was found, as motion events."""
    s = unmarked_sightings(spark, sf_dir).where("clip_path is not null")
    recordings = s.groupBy("clip_path").agg(F.min("camera_id").alias("camera_id"), F.min("started_at").alias("rec_start"), F.max("ended_at").alias("rec_end"), F.max("clip_bytes").alias("clip_bytes"))
    return motion.silent_recordings(recordings, s.where("label <> 'motion' and top_score > 0.5"))


@query("select frame, place, crop, quality, moved from (select frame, det as crop, score as quality, row_number() over (partition by frame order by score desc, det) as place, bool_or(x1 > 0.3) over (partition by frame) as moved from detections where label = 'animal') where place <= 3", DETECTIONS)
def su_best_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best crops of each frame's animals."""
    crops = detections(spark, sf_dir).select("frame", F.col("det").alias("crop"), "label", F.col("score").alias("quality"), (F.col("x1") > 0.3).alias("moved"))
    return motion.best_crops(crops, "frame", 3).withColumn("place", F.col("place").cast("long"))


@query("select frame, arg_max(det, score * 1000 + det) as view, max(score) as quality from detections group by frame", DETECTIONS)
def su_sharpest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.sharpest(detections(spark, sf_dir).select("frame", F.col("det").alias("view"), F.col("score").alias("quality")), "frame")


@query("select s_nationkey as hub, cast(s_suppkey as integer) as channel, case when s_suppkey % 5 = 0 then '' else s_name end as name, s_suppkey % 2 = 1 as online, s_suppkey % 3 = 1 as sleeping from supplier where s_suppkey % 7 <> 0")
def sc_hub_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as channels that a nation's hubs report, 16 a hub at most; some without a number, a name or a state."""
    n = F.col("s_suppkey")
    state = F.struct(F.when(n % 7 != 0, n).alias("channel"), F.when(n % 5 != 0, F.col("s_name")).alias("name"), (n % 2).cast("int").alias("online"), F.when(n % 3 != 2, (n % 3).cast("int")).alias("sleep"))
    hubs = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("hub"), F.floor(n / 16).alias("__of")).agg(F.to_json(F.struct(F.collect_list(state).alias("status"))).alias("said"))
    return hubs.select("hub", F.inline(motion.hub_channels(F.col("said"))))


_CONFIG = "config as (select p_partkey, case p_partkey % 2 when 0 then 'h264' else 'h265' end as codec, substr(case when p_partkey % 3 = 0 then concat(substr(md5(cast(p_partkey as varchar)), 1, 16), '0a000000', substr(md5(cast(p_partkey as varchar)), 25)) else md5(cast(p_partkey as varchar)) end, 1, 2 * (p_partkey % 5 + case when p_partkey % 4 < 3 then 12 else 0 end)) as h from part)"
_HVC = "concat('hvc1.', ['', 'A', 'B', 'C'][b1 // 64 + 1], b1 % 32, '.', format('{:X}', list_sum(list_transform(range(32), lambda i: ((flags >> i) & 1) << (31 - i)))::bigint), case when (b1 // 32) % 2 = 1 then '.H' else '.L' end, b12, array_to_string(list_transform(range(1, used + 1), lambda i: concat('.', format('{:X}', ('0x' || substr(h, 11 + 2 * i, 2))::bigint))), ''))"


@query(f"select p_partkey, case when codec = 'h264' and length(h) >= 8 then concat('avc1.', substr(h, 3, 6)) when codec = 'h265' and length(h) >= 26 then {_HVC} end as name from (select *, ('0x0' || substr(h, 3, 2))::bigint as b1, ('0x0' || substr(h, 5, 8))::bigint as flags, ('0x0' || substr(h, 25, 2))::bigint as b12, coalesce(list_max(list_filter(range(1, 7), lambda i: substr(h, 11 + 2 * i, 2) <> '00')), 0) as used from config)", _CONFIG)
def fn_codec_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of streams whose decoders' configurations are digests of part numbers, cut to various lengths."""
    n, digest = F.col("p_partkey"), F.md5(F.col("p_partkey").cast("string"))
    mixed = F.when(n % 3 == 0, F.concat(F.substring(digest, 1, 16), F.lit("0a000000"), F.substring(digest, 25, 8))).otherwise(digest)
    config = F.unhex(F.left(mixed, 2 * (n % 5 + F.when(n % 4 < 3, 12).otherwise(0)).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", motion.codec_string(F.when(n % 2 == 0, "h264").otherwise("h265"), config).alias("name"))


@query("select hub, file, coalesce(event_id, -1) as event_id from (select *, row_number() over (partition by hub, file order by id desc) as r from (select camera_id as hub, clip_path as file, case when label <> 'motion' then id end as event_id, id from sightings where clip_path is not null)) where r = 1", SIGHTINGS)
def sk_import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last import of each camera's clips; those of motion kept nothing."""
    s = unmarked_sightings(spark, sf_dir).where("clip_path is not null")
    imports = s.select(F.col("camera_id").alias("hub"), F.col("clip_path").alias("file"), F.when(F.col("label") != "motion", F.col("id")).alias("event_id"), F.col("id").alias("seq"))
    return retention.ledger(imports, "seq").select("hub", "file", "event_id")


@query("select s_nationkey as hub, cast(s_suppkey as varchar) as token, s_name as name, concat('source', s_suppkey % 3) as source, case when s_suppkey % 4 = 0 then '' else 'H264' end as encoding, cast(case when s_suppkey % 4 = 0 then 0 else 640 + s_suppkey % 5 end as integer) as width, cast(case when s_suppkey % 4 = 0 then 0 else 360 end as integer) as height, cast(case when s_suppkey % 4 <> 0 then s_suppkey % 30 end as integer) as fps, cast(null as integer) as bitrate_kbps, case when s_suppkey % 4 = 0 then '' else concat('encoder', s_suppkey) end as encoder from supplier")
def sc_camera_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as media profiles that a nation's cameras report in XML, 16 a camera at most; a quarter has no encoder."""
    n = F.col("s_suppkey")
    encoder = F.format_string('<tt:VideoEncoderConfiguration token="encoder%d"><tt:Encoding>H264</tt:Encoding><tt:Resolution><tt:Width>%d</tt:Width><tt:Height>360</tt:Height></tt:Resolution><tt:RateControl><tt:FrameRateLimit>%d</tt:FrameRateLimit><tt:BitrateLimit>auto</tt:BitrateLimit></tt:RateControl></tt:VideoEncoderConfiguration>', n, 640 + n % 5, n % 30)
    profile = F.format_string('<trt:Profiles token="%d"><tt:Name>%s</tt:Name><tt:VideoSourceConfiguration><tt:SourceToken>source%d</tt:SourceToken></tt:VideoSourceConfiguration>%s</trt:Profiles>', n, "s_name", n % 3, F.when(n % 4 != 0, encoder).otherwise(""))
    said = F.concat(F.lit('<s:Envelope xmlns:s="s" xmlns:trt="m" xmlns:tt="t"><s:Body><trt:GetProfilesResponse>'), F.array_join(F.collect_list(profile), ""), F.lit("</trt:GetProfilesResponse></s:Body></s:Envelope>"))
    cameras = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("hub"), F.floor(n / 16).alias("__of")).agg(said.alias("said"))
    return cameras.select("hub", F.inline(motion.camera_profiles(F.col("said"))))


@query("select p_partkey, codec, cast(width as integer) as width, cast(width / 2 as integer) as height from (select p_partkey, unnest(['JPEG', 'H264']) as codec, p_size * 2 as width from part) where codec = 'H264' or p_partkey % 3 <> 0")
def sc_allowed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as encoders with their sizes in XML; one size of each is no number."""
    size, n = F.col("p_size"), F.col("p_partkey")
    one = F.format_string("<tt:ResolutionsAvailable><tt:Width>%d</tt:Width><tt:Height>%d</tt:Height></tt:ResolutionsAvailable>", size * 2, size)
    odd = F.lit("<tt:ResolutionsAvailable><tt:Width>any</tt:Width><tt:Height>1</tt:Height></tt:ResolutionsAvailable>")
    said = F.concat(F.lit('<s:Envelope xmlns:s="s" xmlns:tt="t"><s:Body><GetVideoEncoderConfigurationOptionsResponse><Options>'), F.when(n % 3 != 0, F.concat(F.lit("<tt:JPEG>"), one, F.lit("</tt:JPEG>"))).otherwise(""), F.lit("<tt:H264>"), one, odd, F.lit("</tt:H264></Options></GetVideoEncoderConfigurationOptionsResponse></s:Body></s:Envelope>"))
    # The table is a small file and reading XML takes long, so rows are dealt out first.
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    return parts.select("p_partkey", F.inline(motion.allowed_sizes(said)))
