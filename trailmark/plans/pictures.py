"""Regions to look at, motion against a running background, and what covers a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pictures, regions
from ..sources.adapter import DETECTIONS, detections, read
from .registry import query

WIDTH, HEIGHT, SIZE, MOST = 640, 360, 96, 3


def _grown(b: str, share: float) -> str:
    dx, dy = f"(greatest({b}.x2 - {b}.x1, 0) * {share} / 2)", f"(greatest({b}.y2 - {b}.y1, 0) * {share} / 2)"
    return f"{{'x1': {b}.x1 - {dx}, 'y1': {b}.y1 - {dy}, 'x2': {b}.x2 + {dx}, 'y2': {b}.y2 + {dy}}}"


_NEAR = f"list_filter(groups, lambda g: list_transform([{{'a': {_grown('own', regions.NEAR)}, 'b': {_grown('g', regions.NEAR)}}}], lambda p: p.a.x1 <= p.b.x2 and p.b.x1 <= p.a.x2 and p.a.y1 <= p.b.y2 and p.b.y1 <= p.a.y2)[1])"
_EDGE = lambda f, c: f"list_{f}(list_transform(list_append(near, own), lambda g: g.{c}))"
#: Boxes are taken in one by one; a box that touched something looks again before the next one comes.
_CLUSTER = f"""grouping_walk as (
    select frame, motion, 1 as n, motion[1] as own, motion[1:0] as groups from framed where len(motion) > 0
    union all
    select frame, motion, case when len(near) > 0 then n else n + 1 end,
        case when len(near) > 0 then {{'x1': {_EDGE('min', 'x1')}, 'y1': {_EDGE('min', 'y1')}, 'x2': {_EDGE('max', 'x2')}, 'y2': {_EDGE('max', 'y2')}}} else motion[n + 1] end,
        case when len(near) > 0 then list_filter(groups, lambda g: not list_contains(near, g)) else list_append(groups, own) end
    from (select *, {_NEAR} as near from grouping_walk where n <= len(motion)))"""


def _square(b: str) -> str:
    wanted = f"ceil(greatest(greatest({b}.x2 - {b}.x1, 0) * {WIDTH}, greatest({b}.y2 - {b}.y1, 0) * {HEIGHT}) * {1 + regions.PADDING})"
    side = f"least(greatest({wanted}, {SIZE}), {min(WIDTH, HEIGHT)})"
    at = lambda lo, hi, long: f"floor(least(greatest(({b}.{lo} + {b}.{hi}) / 2 * {long} - {side} / 2, 0), {long} - {side}))"
    return f"case when {wanted} <= {min(WIDTH, HEIGHT)} then {{'l': {at('x1', 'x2', WIDTH)}, 't': {at('y1', 'y2', HEIGHT)}, 'w': {side}, 'h': {side}}} else {{'l': 0.0::double, 't': 0.0::double, 'w': {WIDTH}.0::double, 'h': {HEIGHT}.0::double}} end"


_OVERLAP = f"greatest(least(own.l + own.w, b.l + b.w) - greatest(own.l, b.l), 0) * greatest(least(own.t + own.h, b.t + b.h) - greatest(own.t, b.t), 0) > {regions.OVERLAP} * least(own.w * own.h, b.w * b.h)"
_BOTH = f"{{'x1': least(own.l, b.l) / {WIDTH}, 'y1': least(own.t, b.t) / {HEIGHT}, 'x2': greatest(own.l + own.w, b.l + b.w) / {WIDTH}, 'y2': greatest(own.t + own.h, b.t + b.h) / {HEIGHT}}}"
#: The first square looks at all others; if it grew, at all that are left again; else the next one is first.
_MERGE = f"""merging_walk as (
    select frame, squares[1:0] as done, squares[1] as own, squares[2:] as rest, squares[1:0] as kept, false as grew from squared
    union all
    select frame, case when b is null and not grew then list_append(done, own) else done end,
        case when b is not null and meets then {_square('joined')} when b is null and not grew then kept[1] else own end,
        case when b is not null then rest[2:] when grew then kept else kept[2:] end,
        case when b is null then kept[1:0] when meets then kept else list_append(kept, b) end, b is not null and (grew or meets)
    from (select *, coalesce({_OVERLAP}, false) as meets, {_grown('wide', -regions.PADDING / (1 + regions.PADDING))} as joined from (select *, {_BOTH} as wide from (select *, rest[1] as b from merging_walk where own is not null))))"""


@query(
    f"select frame, place, cast(r.l as bigint) as \"left\", cast(r.t as bigint) as top, cast(r.w as bigint) as wide, cast(r.h as bigint) as high from (select frame, unnest(range(1, least(len(done), {MOST}) + 1)) as place, done[place] as r from merging_walk where own is null)",
    "recursive " + DETECTIONS,
    "small as (select frame, det, label, x1, y1, x1 + (x2 - x1) / 6 as x2, y1 + (y2 - y1) / 6 as y2 from detections)",
    "framed as (select frame, coalesce(list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} order by det, x1, y1, x2, y2) filter (where label <> 'vehicle'), []) as motion, coalesce(list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} order by det, x1, y1, x2, y2) filter (where label = 'vehicle'), []) as due from small group by frame)",
    _CLUSTER,
    "grouped as (select frame, list(g order by (g.x2 - g.x1) * (g.y2 - g.y1) desc, i) as groups from (select frame, unnest(groups) as g, unnest(range(len(groups))) as i from grouping_walk where n > len(motion)) group by frame)",
    f"squared as (select frame, list_transform(list_concat(coalesce(groups, []), due), lambda q: {_square('q')}) as squares from framed left join grouped using (frame))",
    _MERGE,
)
def fn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each frame: of its people and animals as what moves, and of its vehicles as what is due for a look."""
    d = detections(spark, sf_dir).withColumn("x2", F.expr("x1 + (x2 - x1) / 6")).withColumn("y2", F.expr("y1 + (y2 - y1) / 6"))
    row = F.struct("det", "x1", "y1", "x2", "y2")
    boxes = lambda only: F.transform(F.array_sort(F.collect_list(F.when(only, row))), lambda r: F.struct(r["x1"].alias("x1"), r["y1"].alias("y1"), r["x2"].alias("x2"), r["y2"].alias("y2")))
    frames = d.groupBy("frame").agg(boxes(F.col("label") != "vehicle").alias("motion"), boxes(F.col("label") == "vehicle").alias("due"))
    return regions.select_regions(frames, WIDTH, HEIGHT, SIZE, MOST).withColumn("place", F.col("place").cast("long"))


_MASKS = {"camera1": [[(0.0, 0.0), (0.25, 0.0), (0.25, 1.0), (0.0, 1.0)]]}
#: Brightness of a cell: noise of the vector, a bright square where the label says so, and now and then a flash.
_LUMA = "90 + floor(8 * v) + case when label >= 4 and i % 8 in (label % 7, label % 7 + 1) and i // 8 in (vec_id // 30 % 7, vec_id // 30 % 7 + 1) then 100 else 0 end + case when vec_id % 97 = 0 then 80 else 0 end"
_AT = lambda dx, dy: f"luma[1 + least(greatest(i // 8 + {dy}, 0), 7) * 8 + least(greatest(i % 8 + {dx}, 0), 7)]"
_AROUND = " or ".join(f"(i % 8 + {dx} between 0 and 7 and i // 8 + {dy} between 0 and 7 and changed[1 + (i // 8 + {dy}) * 8 + i % 8 + {dx}])" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
_BACKGROUND = f"""walk as (
    select camera_id, k, frame, list_transform(soft, lambda x: x * 16) as ground, 1 as seen, 0.0::double as share, list_transform(soft, lambda x: false) as shown from planes where k = 1
    union all
    select camera_id, k, frame, case when share > 0.5 then target else list_transform(range(64), lambda i: ground[i + 1] + cast(floor((target[i + 1] - ground[i + 1]) * case when grown[i + 1] then 1 else 5 end / 256.0) as bigint)) end,
        case when share > 0.5 then 10 else seen end, share, list_transform(grown, lambda g: g and share <= 0.5 and seen > 10)
    from (select *, list_transform(range(64), lambda i: {_AROUND}) as grown
        from (select *, len(list_filter(changed, lambda c: c)) / 64.0 as share
            from (select *, list_transform(range(64), lambda i: abs(target[i + 1] - ground[i + 1]) > 400 and not (camera_id = 'camera1' and i % 8 < 2)) as changed
                from (select p.camera_id, p.k, p.frame, w.ground, w.seen + 1 as seen, list_transform(p.soft, lambda x: x * 16) as target from walk w join planes p on p.camera_id = w.camera_id and p.k = w.k + 1)))))"""
_PLANES = (
    f"cells as (select vec_id, 'camera' || vec_id % 3 as camera_id, list(cast({_LUMA} as bigint) order by i) as luma from (select vec_id, label, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings) group by vec_id)",
    f"planes as materialized (select camera_id, vec_id as frame, row_number() over (partition by camera_id order by vec_id) as k, list_transform(range(64), lambda i: ({' + '.join(_AT(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1))} + 4) // 9) as soft from cells)",
)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as planes of 8 x 8 cells of three cameras."""
    e = read(spark, sf_dir, "embeddings")
    i = F.expr("transform(embedding, (e, n) -> named_struct('v', cast(e as double), 'i', n))")
    luma = F.expr("transform(cells, c -> " + _LUMA.replace("* v)", "* c.v)").replace("i % 8", "c.i % 8").replace("i // 8", "c.i div 8").replace("vec_id // 30", "vec_id div 30") + ")")
    return e.withColumn("cells", i).select(F.concat(F.lit("camera"), F.col("vec_id") % 3).alias("camera_id"), F.col("vec_id").alias("frame"), F.lit(8).alias("width"), F.lit(8).alias("height"), luma.cast("array<int>").alias("luma"))


@query(
    "select camera_id, frame, round(share, 9) as changed_share, cast(len(list_filter(shown, lambda s: s)) as bigint) as n_shown from walk",
    "recursive " + _PLANES[0],
    _PLANES[1],
    _BACKGROUND,
)
def st_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each frame differs from its camera's running background, and how many cells are shown as moving."""
    changed = pictures.changes(_frames(spark, sf_dir), masks=_MASKS)
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["x2"] - r["x1"] + 1)
    return changed.select("camera_id", "frame", F.round("changed_share", 9).alias("changed_share"), n.alias("n_shown"))


@query(
    """select camera_id, frame, row_number() over (partition by camera_id, frame order by n desc, root) as place, n, x1, y1, x2, y2
    from (select camera_id, frame, root, count(*) as n, min(a % 8) / 8.0::double as x1, min(a // 8) / 8.0::double as y1, (max(a % 8) + 1) / 8.0::double as x2, (max(a // 8) + 1) / 8.0::double as y2
        from (select camera_id, frame, a, min(b) as root from reached group by camera_id, frame, a) group by camera_id, frame, root)""",
    "recursive " + _PLANES[0],
    _PLANES[1],
    _BACKGROUND,
    "lit as materialized (select camera_id, frame, i from (select camera_id, frame, unnest(shown) as s, unnest(range(64)) as i from walk) where s)",
    "reached as (select camera_id, frame, i as a, i as b from lit union select r.camera_id, r.frame, r.a, l.i from reached r join lit l on l.camera_id = r.camera_id and l.frame = r.frame and abs(l.i % 8 - r.b % 8) <= 1 and abs(l.i // 8 - r.b // 8) <= 1)",
)
def st_motion_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected areas that move, with their boxes."""
    found = pictures.motion_boxes(pictures.changes(_frames(spark, sf_dir), masks=_MASKS))
    return found.select("camera_id", "frame", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "x1", "y1", "x2", "y2")
