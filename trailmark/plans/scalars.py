"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, colour, geometry, text
from ..functions.geometry import Box
from ..sources.adapter import DETECTIONS, LABELS, NOW, SIGHTINGS, ZONE, detections, read, unmarked_sightings
from .registry import query

_W, _H = "greatest(x2 - x1, 0)", "greatest(y2 - y1, 0)"
_PX = "least(floor(least(greatest(x1, 0), 1) * 640), 639)"
_PY = "least(floor(least(greatest(y1, 0), 1) * 360), 359)"
_CLAMP = "greatest(least({}, 1), 0)".format


@query(
    f"select frame, det, round({_W} * {_H}, 9) as area, round((x1 + x2) / 2, 9) as cx, round((y1 + y2) / 2, 9) as cy, round({_CLAMP(f'x1 - {_W} * 0.1')}, 9) as ex1, round({_CLAMP(f'y2 + {_H} * 0.1')}, 9) as ey2, cast({_PX} as bigint) as px, cast({_PY} as bigint) as py, cast(least(greatest(ceil({_CLAMP('x2')} * 640), {_PX} + 1), 640) - {_PX} as bigint) as pw, cast(least(greatest(ceil({_CLAMP('y2')} * 360), {_PY} + 1), 360) - {_PY} as bigint) as ph, round(x1 + 0.1 * 2, 9) as nx1 from detections",
    DETECTIONS,
)
def fn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    grown, (px, py, pw, ph), (cx, cy) = b.expanded(0.2).clamped(), b.pixels(640, 360), b.center()
    ahead = b.moved_by(F.lit(0.1), F.lit(0.0), F.lit(5.0))
    r = lambda c: F.round(c, 9)
    return detections(spark, sf_dir).select("frame", "det", r(b.area()).alias("area"), r(cx).alias("cx"), r(cy).alias("cy"), r(grown.x1).alias("ex1"), r(grown.y2).alias("ey2"), px.cast("long").alias("px"), py.cast("long").alias("py"), pw.cast("long").alias("pw"), ph.cast("long").alias("ph"), r(ahead.x1).alias("nx1"))


_BOTH = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)".format


@query(f"select a.frame, b.det, round({_BOTH} / ({_AREA('a')} + {_AREA('b')} - {_BOTH}), 9) as iou, (a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2) as touches, round(least(a.x1, b.x1), 9) as ux1, round(greatest(a.y2, b.y2), 9) as uy2 from detections a join detections b on a.frame = b.frame where a.det = 1 and b.det > 1", DETECTIONS)
def fn_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    first = d.where("det = 1").select("frame", *Box.of().columns("a_"))
    a, b = Box.of("a_"), Box.of()
    return first.join(d.where("det > 1"), "frame").select("frame", "det", F.round(a.iou(b), 9).alias("iou"), a.touches(b).alias("touches"), F.round(F.least(a.x1, b.x1), 9).alias("ux1"), F.round(F.greatest(a.y2, b.y2), 9).alias("uy2"))


@query("select frame, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from detections group by frame", DETECTIONS)
def ag_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("frame").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


_TRIANGLE = [(0.1, 0.1), (0.7, 0.2), (0.4, 0.8)]
_CROSS = " + ".join(f"case when ({ay} > cy) <> ({by} > cy) and cx < ({bx} - {ax}) * (cy - {ay}) / ({by} - {ay}) + {ax} then 1 else 0 end" for (ax, ay), (bx, by) in zip(_TRIANGLE, _TRIANGLE[1:] + _TRIANGLE[:1], strict=True))


@query(f"select frame, det, ({_CROSS}) % 2 = 1 as masked from (select frame, det, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from detections)", DETECTIONS)
def fn_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = Box.of().center()
    return detections(spark, sf_dir).select("frame", "det", geometry.in_polygon(cx, cy, _TRIANGLE).alias("masked"))


@query(f"select frame, det, cast(case when wanted <= 360 then floor(least(greatest((x1 + x2) / 2 * 640 - side / 2, 0), 640 - side)) else 0 end as bigint) as l, cast(case when wanted <= 360 then floor(least(greatest((y1 + y2) / 2 * 360 - side / 2, 0), 360 - side)) else 0 end as bigint) as t, cast(case when wanted <= 360 then side end as bigint) as side from (select *, least(greatest(wanted, 96), 360) as side from (select *, ceil(greatest({_W} * 640, {_H} * 360) * 1.25) as wanted from detections))", DETECTIONS)
def fn_square_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top, side = geometry.square_around(Box.of(), 640, 360, 96, 0.25)
    return detections(spark, sf_dir).select("frame", "det", left.cast("long").alias("l"), top.cast("long").alias("t"), side.cast("long").alias("side"))


_IN = "{} between 0.01 and 0.99".format


def _shift_sql(a: str) -> str:
    inside = " and ".join(_IN(c) for c in (f"a.{a}1", f"b.{a}1", f"a.{a}2", f"b.{a}2"))
    d1, d2 = f"(b.{a}1 - a.{a}1)", f"(b.{a}2 - a.{a}2)"
    return f"case when {inside} and {d1} * {d2} > 0 then least(abs({d1}), abs({d2})) else 0 end"


_MOVED = f"""
pairs as (select a.frame, b.det, {_shift_sql('x')} as dx, {_shift_sql('y')} as dy, greatest(a.x2 - a.x1, 0) as aw, greatest(a.y2 - a.y1, 0) as ah, greatest(b.x2 - b.x1, 0) as bw, greatest(b.y2 - b.y1, 0) as bh, a.x1 - b.x1 as l, b.x2 - a.x2 as r, {' and '.join(_IN(c) for c in ('a.x1', 'b.x1', 'a.x2', 'b.x2'))} as seen from detections a join detections b on a.frame = b.frame and a.det = 1 and b.det > 1)"""


@query(
    "select frame, det, sqrt(dx * dx + dy * dy) > 0.15 * sqrt(aw * aw + ah * ah) or (abs((greatest(bw, 1e-7) / greatest(bh, 1e-7)) / (greatest(aw, 1e-7) / greatest(ah, 1e-7)) - 1) <= 0.25 and not (greatest(bw * bh, 1e-7) / greatest(aw * ah, 1e-7) between 0.55 and 1.8) and seen and l * r > 0 and least(abs(l), abs(r)) >= 0.3 * greatest(abs(l), abs(r))) as moved from pairs",
    DETECTIONS,
    _MOVED.strip(),
)
def fn_has_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection of a frame against the frame's first one."""
    d = detections(spark, sf_dir)
    first = d.where("det = 1").select("frame", *Box.of().columns("a_"))
    return first.join(d.where("det > 1"), "frame").select("frame", "det", geometry.has_moved(Box.of("a_"), Box.of(), 0.15).alias("moved"))


@query(f"select id, local_date, local_hour, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') as text, epoch_us(started_at) as micros, timezone('UTC', timezone('{ZONE}', cast(local_date as timestamp))) as midnight, datediff('second', timestamp '2024-01-01', coalesce(ended_at, timestamp '{NOW}')) - datediff('second', timestamp '2024-01-01', started_at) as seconds, epoch_us(started_at) + (id % 9000) * 100 // 9 as sample_end from (select * from sightings where ended_at is null or date_trunc('second', started_at) = started_at or true)", SIGHTINGS)
def fn_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, at = unmarked_sightings(spark, sf_dir), F.col("started_at")
    whole = lambda c: F.date_trunc("second", c)
    return s.select("id", "local_date", "local_hour", clock.rfc3339(at).alias("text"), clock.micros(at).alias("micros"), clock.local_midnight(F.col("local_date"), ZONE).alias("midnight"), clock.duration_seconds(whole(at), whole(F.col("ended_at")), F.expr(f"timestamp_ntz'{NOW}'")).alias("seconds"), clock.sample_end(clock.micros(at), F.col("id") % 9000).alias("sample_end"))


_LOCAL = f"timezone('{ZONE}', timezone('UTC', date_trunc('second', started_at)))"


@query(
    f"select id, year, mon, day, hour, min, sec, timezone('UTC', timezone('{ZONE}', make_timestamp(year, mon, day, hour, min, cast(sec as double)))) as back, make_timestamp(year, mon, day, hour, min, cast(sec as double)) as own from (select id, cast(date_part('year', l) as integer) as year, cast(date_part('month', l) as integer) as mon, cast(date_part('day', l) as integer) as day, cast(date_part('hour', l) as integer) as hour, cast(date_part('minute', l) as integer) as min, cast(floor(date_part('second', l)) as integer) as sec from (select id, {_LOCAL} as l from sightings))",
    SIGHTINGS,
)
def fn_time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar fields of the local time, the time that they stand for, and what a camera shows that counts as C does."""
    s, at = unmarked_sightings(spark, sf_dir), F.date_trunc("second", "started_at")
    s = s.withColumn("p", clock.fields(clock.local(at, ZONE)))
    p = F.col("p")
    own = clock.camera_time(p["year"] - 1900, p["mon"] - 1, p["day"], p["hour"], p["min"], p["sec"])
    return s.select("id", "p.*", clock.from_fields(p, ZONE).alias("back"), own.alias("own"))


@query(f"select id, i as part, case when i = 0 then started_at else timezone('UTC', timezone('{ZONE}', cast(d0 + cast(i as integer) as timestamp))) end as from_at, least(started_at + interval 30 hour, timezone('UTC', timezone('{ZONE}', cast(d0 + cast(i + 1 as integer) as timestamp))) - interval 1 second) as to_at from (select *, unnest(range(cast(d1 - d0 as bigint) + 1)) as i from (select id, started_at, cast(timezone('{ZONE}', timezone('UTC', started_at)) as date) as d0, cast(timezone('{ZONE}', timezone('UTC', started_at + interval 30 hour)) as date) as d1 from sightings)) x", SIGHTINGS)
def fn_day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = clock.day_parts(F.col("started_at"), F.expr("started_at + interval 30 hours"), ZONE)
    return unmarked_sightings(spark, sf_dir).select("id", F.posexplode(parts).alias("part", "p")).select("id", F.col("part").cast("long").alias("part"), "p.from_at", "p.to_at")


@query("select page_id, concat(regexp_extract(url, '^([^?]*)', 1), regexp_replace(regexp_extract(url, '^[^?]*(\\?.*)?$', 1), '([?&])(ref|token)=[^&]*', '\\1\\2=***', 'gi')) as hidden, regexp_replace(url, '^([^:]+://)', '\\1u%20s:p%40%2A~@') as given, url as bare, replace(replace(regexp_extract(url, '://([^/?#]*)', 1), '_sub', '_main'), 'www.', '') as host from pages")
def fn_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, url = read(spark, sf_dir, "pages"), F.col("url")
    given = text.with_credentials(url, F.lit("u s"), F.lit("p@*~"))
    return p.select("page_id", text.redacted(url, ("ref", "token")).alias("hidden"), given.alias("given"), text.without_credentials(given).alias("bare"), F.replace(F.replace(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("_sub"), F.lit("_main")), F.lit("www."), F.lit("")).alias("host"))


@query("select id, upper(substr(common_name, 1, 1)) || substr(common_name, 2) as shown, nullif(scientific_name, '') as scientific, lower(trim(common_name)) = 'deer' or contains(lower(common_name), 'deer') as deer, regexp_matches(camera_id, '^[a-z0-9_-]+$') as valid, least(pow(2, least(id % 9, 5)), 30)::bigint as backoff, md5(camera_id) as digest, lower(hex(encode(label))) as bytes, concat('clips/', strftime(local_date, '%Y-%m-%d'), '/', cast(id as varchar), '.mp4') as path from sightings", SIGHTINGS)
def fn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = unmarked_sightings(spark, sf_dir)
    path = text.clip_path("clips", F.col("local_date"), F.col("id"), ".mp4")
    return s.select("id", text.display_name(F.col("common_name")).alias("shown"), F.nullif("scientific_name", F.lit("")).alias("scientific"), text.same_name(F.col("common_name"), F.lit("deer")).alias("deer"), text.valid_id(F.col("camera_id")).alias("valid"), text.backoff_seconds(F.col("id") % 9).alias("backoff"), text.md5_hex(F.col("camera_id")).alias("digest"), text.to_hex(F.col("label")).alias("bytes"), path.alias("path"))


_STEPS = "[1.0 * m, 2.0 * m, 2.5 * m, 5.0 * m, 10.0 * m]"


@query(f"select event_id, cast(case when n <= 5 then 5 else coalesce(list_min(list_filter({_STEPS}, lambda s: s >= n and s % 5 = 0)), 10 * m) end as bigint) as axis from (select event_id, event_id % 4321 as n, pow(10, floor(log10(greatest(event_id % 4321, 1)))) as m from events)")
def fn_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", text.nice_max(F.col("event_id") % 4321).alias("axis"))


_BYTE = "greatest(least(({}) >> 8, 255), 0)".format
_RGB = f"{_BYTE('298 * (y - 16) + 409 * (v - 128) + 128')} as r, {_BYTE('298 * (y - 16) - 100 * (u - 128) - 208 * (v - 128) + 128')} as g, {_BYTE('298 * (y - 16) + 516 * (u - 128) + 128')} as b"


@query(f"select *, ((66 * r + 129 * g + 25 * b + 128) >> 8) + 16 as y2, ((112 * b - 38 * r - 74 * g + 128) >> 8) + 128 as u2, ((112 * r - 94 * g - 18 * b + 128) >> 8) + 128 as v2 from (select event_id, {_RGB}, v - u >= 40 or y >= 200 as warm from (select event_id, event_id % 256 as y, (event_id * 7) % 256 as u, (event_id * 13) % 256 as v from events))")
def fn_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels from YUV to RGB and back, and whether they are warm."""
    y, u, v = F.col("event_id") % 256, F.col("event_id") * 7 % 256, F.col("event_id") * 13 % 256
    pixels = read(spark, sf_dir, "events").select("event_id", *(c.alias(n) for c, n in zip(colour.yuv_to_rgb(y, u, v), "rgb", strict=True)), colour.is_warm(y, u, v).alias("warm"))
    again = colour.rgb_to_yuv(*map(F.col, "rgb"))
    return pixels.select("*", *(c.alias(n) for c, n in zip(again, ("y2", "u2", "v2"), strict=True)))


@query("select count(*) as n, count(distinct label) as labels from sightings", SIGHTINGS)
def fn_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the enumeration stop the query."""
    return unmarked_sightings(spark, sf_dir).select(text.label_or_error(F.col("label"), LABELS).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


_CAMERA_URL = "concat('rtsp://10.0.0.', cast(id % 250 as varchar), '/h264Preview_', lpad(cast(id % 12 as varchar), 2, '0'), case when id % 3 = 0 then '_main' else '_sub' end)"


@query(
    f"""select id, base64(unhex(sha1(concat(camera_id, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ'), label)))) as digest, label as back,
        case when kind = 'stream' then case when id % 4 = 0 then cast(id % 7 as integer) when id % 12 > 0 then cast(id % 12 - 1 as integer) end end as channel,
        case when kind = 'stream' and id % 3 <> 0 then replace(url, '_sub', '_main') end as full_url,
        case when kind = 'hub_clips' then concat('rtsp://u:p%40@hub', cast(id % 5 as varchar), ':554/h264Preview_', lpad(cast(id % 7 + 1 as varchar), 2, '0'), '_sub') end as live_url
    from (select *, case when label = 'person' then 'hub_clips' else 'stream' end as kind, {_CAMERA_URL} as url from sightings)""",
    SIGHTINGS,
)
def fn_camera_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a login, bytes through digits and back, and the URLs that a camera's settings stand for."""
    i = F.col("id")
    url = F.concat(F.lit("rtsp://10.0.0."), (i % 250).cast("string"), F.lit("/h264Preview_"), F.lpad((i % 12).cast("string"), 2, "0"), F.when(i % 3 == 0, "_main").otherwise("_sub"))
    s = unmarked_sightings(spark, sf_dir).withColumn("kind", F.when(F.col("label") == "person", "hub_clips").otherwise("stream")).withColumn("url", url)
    hub = F.concat(F.lit("https://admin:x@hub"), (i % 5).cast("string"), F.lit(":8443/web"))
    none = F.lit(None).cast("string")
    return s.select(
        "id",
        text.password_digest(F.col("camera_id"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("label")).alias("digest"),
        text.from_hex(text.to_hex(F.col("label"))).cast("string").alias("back"),
        text.snapshot_channel(F.col("kind"), F.lit("hub"), F.when(i % 4 == 0, (i % 7).cast("int")), F.col("url")).alias("channel"),
        text.full_stream_url(F.col("kind"), F.col("url"), none).alias("full_url"),
        text.hub_live_url(F.col("kind"), hub, F.lit("u"), F.lit("p@"), (i % 7).cast("int"), main=False).alias("live_url"),
    )
