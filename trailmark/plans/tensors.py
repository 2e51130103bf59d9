"""Detector tensors in three layouts, hub answers without secrets, keys of taxa, boxes of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import Box
from ..operators import species, tensors
from ..sources.adapter import DETECTIONS, SIGHTINGS, TAXONOMY, detections, read, taxonomy, unmarked_sightings
from .registry import query

SIZE, LEAST = 320.0, 0.2
#: A vector's 64 numbers as 8 candidates of 8: place, size, objectness and three class scores.
_VALUES = "[160 + 160 * e[8 * i + 1], 160 + 160 * e[8 * i + 2], 40 + 100 * abs(e[8 * i + 3]), 40 + 100 * abs(e[8 * i + 4]), 1.0::double, 2 * abs(e[8 * i + 6]), 2 * abs(e[8 * i + 7]), 2 * abs(e[8 * i + 8])]"
_CLAMP = "least(greatest({}, 0), 1)".format
_FOUND = (
    "rows_of as (select vec_id as frame, i, " + _VALUES + " as v from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e, unnest(range(8)) as i from embeddings))",
    f"found as (select frame, i, case when v[6] >= v[7] and v[6] >= v[8] then 0 when v[7] >= v[8] then 1 else 2 end as class, greatest(v[6], v[7], v[8]) as score, {_CLAMP('(v[1] - v[3] / 2) / 320')} as x1, {_CLAMP('(v[2] - v[4] / 2) / 320')} as y1, {_CLAMP('(v[1] + v[3] / 2) / 320')} as x2, {_CLAMP('(v[2] + v[4] / 2) / 320')} as y2 from rows_of)",
)


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates in each layout."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = F.expr("transform(sequence(0, 7), i -> array(160 + 160 * e[8 * i], 160 + 160 * e[8 * i + 1], 40 + 100 * abs(e[8 * i + 2]), 40 + 100 * abs(e[8 * i + 3]), 1D, 2 * abs(e[8 * i + 5]), 2 * abs(e[8 * i + 6]), 2 * abs(e[8 * i + 7])))")
    d = e.select("frame", rows.alias("r"))
    boxes = "array(r[0] - r[2] / 2, r[1] - r[3] / 2, r[0] + r[2] / 2, r[1] + r[3] / 2, greatest(r[5], r[6], r[7]), case when r[5] >= r[6] and r[5] >= r[7] then 0D when r[6] >= r[7] then 1D else 2D end)"
    layouts = {
        tensors.ROWS: ((1, 8, 8), "flatten(r)"),
        tensors.COLUMNS: ((1, 7, 8), "flatten(transform(array(0, 1, 2, 3, 5, 6, 7), a -> transform(r, x -> x[a])))"),
        tensors.BOXES: ((1, 8, 6), f"flatten(transform(r, r -> {boxes}))"),
    }
    each = F.array(*(F.struct(F.lit(k).alias("layout"), F.array(*map(F.lit, shape)).alias("shape"), F.expr(sql).alias("values")) for k, (shape, sql) in layouts.items()))
    return d.select("frame", F.explode(each).alias("t")).select("frame", "t.*")


@query(f"select frame, layout, i, class, score, x1, y1, x2, y2 from found, (values ('rows'), ('columns'), ('boxes')) as l(layout) where score >= {LEAST}", *_FOUND)
def fn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a detector, alike from each layout."""
    return tensors.candidates(_tensors(spark, sf_dir), SIZE, LEAST).withColumn("i", F.col("i").cast("long"))


_IOU = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(
    "select o.frame, layout, o.i, case class when 0 then 'person' else 'vehicle' end as label, case class when 0 then 'person' when 1 then 'bicycle' else 'car' end as raw_class, o.score, x1, y1, x2, y2 from o join (select frame, max_by(kept, n) as kept from k group by frame) f on o.frame = f.frame, (values ('rows'), ('columns'), ('boxes')) as l(layout) where (f.kept >> cast(o.n - 1 as integer)) & 1 = 1",
    "recursive " + _FOUND[0],
    _FOUND[1],
    f"o as materialized (select *, row_number() over (partition by frame order by score desc, i) as n from found where score >= {LEAST})",
    f"oh as materialized (select b.frame, b.n, coalesce(sum(cast(1 as bigint) << cast(a.n - 1 as integer)) filter (where a.n < b.n and a.class = b.class and {_IOU} > 0.45), 0)::bigint as rivals from o b join o a on a.frame = b.frame group by b.frame, b.n)",
    "k as (select frame, cast(1 as bigint) as n, cast(1 as bigint) as kept from o where n = 1 union all select k.frame, k.n + 1, case when k.kept & oh.rivals = 0 then k.kept | (cast(1 as bigint) << cast(k.n as integer)) else k.kept end from k join oh on oh.frame = k.frame and oh.n = k.n + 1)",
)
def fn_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detector of everyday classes reports: the best of overlapping candidates, by class."""
    return tensors.detected(_tensors(spark, sf_dir), SIZE, LEAST, tensors.COCO).withColumn("i", F.col("i").cast("long"))


_ANSWER = "'{{\"cmd\":\"Login\",\"id\":' || id || ',\"Token\":{{\"name\":\"' || {0} || '\",\"leaseTime\":3600}},\"list\":[{{\"PassWord\":' || {1} || ',\"deep\":[[{{\"password\":' || {1} || ',\"Token\":\"kept\"}}],null,true]}},\"' || label || '\"],\"token\":\"é kept\"}}'".format


@query(f"select id, {_ANSWER(chr(39) + 'REDACTED' + chr(39), chr(39) + chr(34) + 'REDACTED' + chr(34) + chr(39))} as answer from sightings", SIGHTINGS)
def fn_redacted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub answers with tokens and passwords at several depths, as they may be kept."""
    answer = F.expr(_ANSWER("camera_id", "clip_bytes"))
    s = unmarked_sightings(spark, sf_dir).withColumn("clip_bytes", F.coalesce("clip_bytes", F.lit(0)))
    return s.select("id", text.redacted_json(answer).alias("answer"))


_RANKS = "t_class, t_order, t_family, t_genus, t_species"


@query(
    "select event, class, t_class || ';' || t_order || ';' || t_family || ';' || t_genus || ';' || t_species as full_class, "
    + ", ".join(f"case when {' and '.join(f'{r} <> {chr(39) * 2}' for r in _RANKS.split(', ')[:k])} then {(' || ' + chr(39) + ';' + chr(39) + ' || ').join(_RANKS.split(', ')[:k])} end as key{k}" for k in range(1, 6))
    + " from (select vec_id as event, cast(vec_id % 64 as integer) as class from embeddings) join taxonomy using (class)",
    TAXONOMY,
)
def fn_taxon_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole key of each event's class, and the keys of the taxa above it."""
    ranks = [F.col(r) for r in (*species.RANKS, "t_species")]
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event"), (F.col("vec_id") % 64).cast("int").alias("class")).join(F.broadcast(taxonomy(spark)), "class")
    return e.select("event", "class", text.full_class(ranks).alias("full_class"), *(text.ancestor_key(ranks, k).alias(f"key{k}") for k in range(1, 6)))


@query("select frame, det, label, (160 + least(x1, y2) * 320) / 640 as x1, (20 + least(y1, x2) * 320) / 360 as y1, (160 + greatest(x1, y2) * 320) / 640 as x2, (20 + greatest(y1, x2) * 320) / 360 as y2 from detections", DETECTIONS)
def fn_region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes given by two corners in any order, found in a square of 320 pixels, in the whole picture."""
    d = detections(spark, sf_dir)
    box = Box(F.col("x1"), F.col("y1"), F.col("y2"), F.col("x2")).ordered().within_region(F.lit(160), F.lit(20), F.lit(320), 640, 360)
    return d.select("frame", "det", "label", *box.columns())
