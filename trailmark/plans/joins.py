"""Joins over sightings, segments and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..sources.adapter import CAMERAS, DETECTIONS, SEGMENTS, SIGHTINGS, detections, segments, sightings, unmarked_sightings
from .registry import query

#: IoU of boxes a and b, as SQL.
IOU = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(f"select distinct a.id, a.camera_id from sightings a, sightings b where b.feedback = 'nothing' and a.camera_id = b.camera_id and a.id <> b.id and {IOU} >= 0.5", SIGHTINGS)
def jn_marked_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.in_marked_spot(sightings(spark, sf_dir))


@query(f"select distinct a.id, a.camera_id from sightings a, (select *, row_number() over (partition by camera_id order by id desc) as r from sightings where marked) b where b.r <= 500 and b.feedback = 'nothing' and a.camera_id = b.camera_id and a.id <> b.id and {IOU} >= 0.5", SIGHTINGS)
def jn_newest_marked_spot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the page of a camera's newest 500 marked events, those that were marked as nothing."""
    return joins.in_marked_spot(sightings(spark, sf_dir), newest=500)


@query("select id, segment_id from (select e.id, g.segment_id, row_number() over (partition by e.id order by seg_start desc, segment_id desc) as r from sightings e join segments g on e.camera_id = g.camera_id and e.started_at >= seg_start - interval 2 second and e.started_at <= seg_end + interval 2 second) where r = 1", SIGHTINGS, SEGMENTS)
def jn_recording_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.containing(unmarked_sightings(spark, sf_dir), segments(spark, sf_dir))


@query("select e.id, g.segment_id, g.seg_bytes from sightings e join segments g on e.camera_id = g.camera_id and seg_end > e.started_at - interval 5 second and seg_start < coalesce(e.ended_at, e.started_at) + interval 10 second and seg_start >= e.started_at - interval 5 second - interval 10 minute", SIGHTINGS, SEGMENTS)
def jn_segments_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = unmarked_sightings(spark, sf_dir).select("id", "camera_id", F.expr("started_at - interval 5 seconds").alias("from_at"), F.expr("coalesce(ended_at, started_at) + interval 10 seconds").alias("to_at"))
    return joins.overlapping(w, segments(spark, sf_dir)).select("id", "segment_id", "seg_bytes")


@query("select segment_id, camera_id, seg_start from segments where camera_id = 'yard' and seg_end > timestamp '2024-01-15 00:00:00' and seg_start < timestamp '2024-01-16 00:00:00' and seg_start >= timestamp '2024-01-15 00:00:00' - interval 10 minute", SIGHTINGS, SEGMENTS)
def sc_segments_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("camera_id = 'yard' and seg_end > timestamp_ntz'2024-01-15 00:00:00' and seg_start < timestamp_ntz'2024-01-16 00:00:00' and seg_start >= timestamp_ntz'2024-01-15 00:00:00' - interval 10 minutes").select("segment_id", "camera_id", "seg_start")


@query("select segment_id, camera_id, seg_start from segments where seg_start < timestamp '2024-01-05 00:00:00'", SIGHTINGS, SEGMENTS)
def sc_segments_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("seg_start < timestamp_ntz'2024-01-05 00:00:00'").select("segment_id", "camera_id", "seg_start").orderBy("seg_start", "segment_id")


@query("select left_id, right_id, micros_apart from (select l.id as left_id, r.id as right_id, abs(epoch_us(l.started_at) - epoch_us(r.started_at)) as micros_apart, row_number() over (partition by l.id order by abs(epoch_us(l.started_at) - epoch_us(r.started_at)), r.id) as n from sightings l join sightings r on l.camera_id = r.camera_id and abs(epoch_us(l.started_at) - epoch_us(r.started_at)) <= 90000000 where l.label = 'animal' and r.label = 'motion') where n = 1", SIGHTINGS)
def jn_nearest_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = unmarked_sightings(spark, sf_dir)
    side = lambda label, name: s.where(F.col("label") == label).select("camera_id", F.col("id").alias(name), F.col("started_at").alias("start"))
    return joins.nearest_start(side("animal", "left_id"), side("motion", "right_id"), 90)


@query("select id, clip_path from sightings a where exists (select 1 from sightings b where b.clip_path = a.clip_path and b.id <> a.id and b.started_at >= a.started_at - interval 1 hour and b.started_at < a.started_at + interval 1 hour)", SIGHTINGS)
def jn_shared_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.sharing_clip(unmarked_sightings(spark, sf_dir)).select("id", "clip_path")


@query("select id, camera_id from sightings where clip_path is not null and feedback is null", SIGHTINGS)
def jn_withdrawn_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    return joins.withdrawn(s.where("clip_path is not null").select("id", "camera_id"), s.where("feedback is not null"))


@query("select id from sightings a where clip_state = 'ready' and not marked and ended_at is not null and not exists (select 1 from sightings b where b.id = a.id and b.snapshot_path is null)", SIGHTINGS)
def jn_new_for_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    settled = s.where("clip_state = 'ready' and not marked and ended_at is not null").select("id")
    return joins.withdrawn(settled, s.where("snapshot_path is null"))


@query("select concat('hub', cast(segment_id % 2 as varchar)) as hub, concat(cast(segment_id as varchar), '.mp4') as file, seg_start as file_start from segments where seg_end <= timestamp '2024-01-20 00:00:00' - interval 10 second and seg_bytes <= 1000000", SIGHTINGS, SEGMENTS)
def jn_to_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = segments(spark, sf_dir).select("segment_id", F.concat(F.lit("hub"), F.col("segment_id") % 2).alias("hub"), F.concat("segment_id", F.lit(".mp4")).alias("file"), F.col("seg_start").alias("file_start"), F.col("seg_end").alias("file_end"), "seg_bytes")
    ledger = files.where("seg_bytes > 1000000").select("hub", "file")
    return joins.to_import(files, ledger, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("hub", "file", "file_start")


@query("select camera_id, count(*) as n, case camera_id when 'yard' then 'spruce' when 'gate' then 'larch' when 'trail' then 'larch' else 'sorrel' end as detector from sightings group by camera_id", SIGHTINGS)
def jn_detector_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's own detector, else its hub's, else the default."""
    cameras = spark.createDataFrame(list(zip(CAMERAS, ("h1", "h1", "h2", "h2"), (None, "spruce", None, None), strict=True)), "camera_id string, hub string, own string")
    hubs = spark.createDataFrame([("h1", None), ("h2", "larch")], "hub string, theirs string")
    counts = unmarked_sightings(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("n"))
    return counts.join(cameras, "camera_id", "left").join(hubs, "hub", "left").select("camera_id", "n", F.coalesce("own", "theirs", F.lit("sorrel")).alias("detector"))


@query(f"select frame, det, iou from (select b.frame, b.det, {IOU} as iou, row_number() over (partition by b.frame order by {IOU} desc, b.score desc, b.det) as r from detections a join detections b on a.frame = b.frame where a.det = 1) where r = 1", DETECTIONS)
def jn_best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    expected = d.where("det = 1").select("frame", *(F.col(c).alias(f"e_{c}") for c in ("x1", "y1", "x2", "y2")))
    return joins.best_detection(expected, d, "frame")


# The oracle takes boxes one by one in each frame's order: n is the place, kept the places kept so far as bits.
@query(
    f"select o.frame, o.det from o join (select frame, max_by(kept, n) as kept from k group by frame) f on o.frame = f.frame where (f.kept >> cast(o.n - 1 as integer)) & 1 = 1",
    "recursive " + DETECTIONS,
    "o as (select *, row_number() over (partition by frame order by score desc, det, label, x1, y1, x2, y2) as n from detections)",
    f"hit as (select b.frame, b.n, sum(cast(1 as bigint) << cast(a.n - 1 as integer)) as rivals from o a join o b on a.frame = b.frame and a.label = b.label and a.n < b.n and {IOU} > 0.45 group by b.frame, b.n)",
    "oh as (select o.frame, o.n, cast(coalesce(rivals, 0) as bigint) as rivals from o left join hit on o.frame = hit.frame and o.n = hit.n)",
    "k as (select frame, cast(1 as bigint) as n, cast(1 as bigint) as kept from o where n = 1 union all select k.frame, k.n + 1, case when k.kept & oh.rivals = 0 then k.kept | (cast(1 as bigint) << cast(k.n as integer)) else k.kept end from k join oh on oh.frame = k.frame and oh.n = k.n + 1)",
)
def jn_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.suppressed(detections(spark, sf_dir))


_AREA = "(greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0))".format
_BOTH = "(greatest(least(q.x2, d.x2) - greatest(q.x1, d.x1), 0) * greatest(least(q.y2, d.y2) - greatest(q.y1, d.y1), 0))"
#: Whether a kept box q meets the next box d: by IoU, or within one label by the share of the smaller one inside.
_MEETS = f"case when q.label = d.label then {_BOTH} / nullif({_AREA('q')} + {_AREA('d')} - {_BOTH}, 0) > 0.45 or {_BOTH} / greatest(least({_AREA('q')}, {_AREA('d')}), 1e-7) > 0.6 else coalesce({_BOTH} / nullif({_AREA('q')} + {_AREA('d')} - {_BOTH}, 0) > 0.7, false) end"


@query(
    "select frame, b.det, b.label, b.x1, b.y1, b.x2, b.y2 from (select w.frame, unnest(kept) as b from walk w join (select frame, count(*) as n from detections group by frame) c on c.frame = w.frame and c.n = w.n)",
    "recursive " + DETECTIONS,
    "o as materialized (select frame, row_number() over (partition by frame order by score desc, det, label, x1, y1, x2, y2) as n, {'det': det, 'label': label, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} as d from detections)",
    f"""walk as (
        select frame, n, [d] as kept from o where n = 1
        union all
        select frame, n, case when coalesce(hit, 0) = 0 then list_append(kept, d) when kept[hit].label <> d.label then kept
            else list_concat(kept[1:hit - 1], [{{'det': kept[hit].det, 'label': d.label, 'x1': least(kept[hit].x1, d.x1), 'y1': least(kept[hit].y1, d.y1), 'x2': greatest(kept[hit].x2, d.x2), 'y2': greatest(kept[hit].y2, d.y2)}}], kept[hit + 1:]) end
        from (select o.frame, o.n, o.d, w.kept, list_position(list_transform(w.kept, lambda q: {_MEETS.replace('d.', 'o.d.').replace('o.o.d.', 'o.d.')}), true) as hit from walk w join o on o.frame = w.frame and o.n = w.n + 1))""",
)
def jn_merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of overlapping regions as objects."""
    return joins.merged_regions(detections(spark, sf_dir))
