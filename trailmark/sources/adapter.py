"""The driver's tables in the shapes of the sighting model, as DataFrames and as the same projections in ANSI SQL.

Every query is "adapter view -> operator"; the SQL here is what the oracles start from. NOW stands for the current time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"
NOW = "2024-01-31 00:00:00"
LABELS = ("person", "vehicle", "animal", "motion")
CAMERAS = ("driveway", "yard", "gate", "trail")
#: Names that animals of the fixture carry, by event_id % 9, and their scientific names.
COMMON = ("White-tailed deer", "white-tailed deer", "Red fox", "Coyote", "Wild turkey", "Domestic cat", "red fox", None, None)
SCIENTIFIC = {"white-tailed deer": "Odocoileus virginianus", "red fox": "Vulpes vulpes", "coyote": "Canis latrans", "wild turkey": "Meleagris gallopavo", "domestic cat": "Felis catus"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, values: tuple[str | None, ...]) -> str:
    return f"case {key} " + " ".join(f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(values)) + " end"


_CAMERA = _case("user_id % 4", CAMERAS)
_LABEL = "case event_type when 'view' then 'person' when 'click' then 'vehicle' when 'error' then 'motion' else 'animal' end"
_COMMON = f"case when {_LABEL} = 'animal' then {_case('event_id % 9', COMMON)} end"
_SCIENTIFIC = f"case when event_id % 18 = 0 then '' else case lower({_COMMON}) " + " ".join(f"when '{k}' then '{v}'" for k, v in SCIENTIFIC.items()) + " end end"
#: What both engines compute alike; the rest differs in dialect.
_SHARED = {
    "id": "event_id + 1",
    "camera_id": _CAMERA,
    "label": _LABEL,
    "started_at": "ts",
    "top_score": "0.45 + value / 1000",
    "median_score": "(0.45 + value / 1000) * 0.9",
    "common_name": _COMMON,
    "scientific_name": f"case when {_COMMON} is not null then {_SCIENTIFIC} end",
    "species_score": f"case when {_COMMON} is not null then 0.7 + 0.29 * value / 500 end",
    "clip_state": "case event_id % 20 when 0 then 'failed' when 1 then 'purged' when 2 then 'pending' else 'ready' end",
    "clip_bytes": "case when event_id % 13 <> 0 then 100000 + (event_id * 7919) % 900000 end",
    # A few failed, purged and pending events have a clip all the same.
    "clip_path": "case when event_id % 20 not in (0, 1, 2) or event_id % 60 in (0, 21, 42) then concat('clips/', cast(event_id - event_id % 3 as varchar(20)), '.mp4') end",
    "snapshot_path": "case when event_id % 5 <> 0 then concat('snapshots/', cast(event_id as varchar(20)), '.jpg') end",
    "thumb_path": "case when event_id % 7 <> 0 then concat('thumbs/', cast(event_id as varchar(20)), '.jpg') end",
    "sharp_path": "case when event_id % 11 = 0 then concat('sharp/', cast(event_id as varchar(20)), '.jpg') end",
    "x1": "cast(event_id % 60 as double) / 100",
    "y1": "cast((event_id * 3) % 55 as double) / 100",
    "x2": "cast(event_id % 60 + 5 + event_id % 31 as double) / 100",
    "y2": "cast((event_id * 3) % 55 + 8 + event_id % 27 as double) / 100",
    "marked": "coalesce(toxic = 1 or quality = 0, false)",
    "feedback": "case when toxic = 1 then 'nothing' when quality = 0 and event_id % 2 = 0 then 'animal' when quality = 0 then 'person' end",
    "feedback_species": "case when quality = 0 and toxic <> 1 and event_id % 4 = 0 then 'Moose' when quality = 0 and toxic <> 1 and event_id % 4 = 2 then null end",
}


#: Columns that a reviewer gave.
MARKS = ("marked", "feedback", "feedback_species")


def id_range(least: int | None = None, most: int | None = None) -> Column:
    """A filter on the table's own column, which reaches the scan, for ids from least to most."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("event_id") >= least - 1)
    return out if most is None else out & (F.col("event_id") <= most - 1)


def around_day(day: str) -> Column:
    """A filter on the table's own column for a day in any zone; which day it is locally is still to be asked."""
    start = f"timestamp_ntz'{day} 00:00:00'"
    return F.expr(f"ts >= {start} - interval 1 day and ts < {start} + interval 2 day")


def sightings(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """Events of four cameras with what a reviewer said about them; times are UTC without a zone. only: a filter on the
    events' own columns."""
    marks = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    events = _events(spark, sf_dir, only)
    return _shaped(events.join(marks, events["event_id"] == marks["doc_id"], "left"), tuple(_SHARED))


def unmarked_sightings(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """sightings() without a reviewer's columns, and without the join that gives them."""
    return _shaped(_events(spark, sf_dir, only), tuple(c for c in _SHARED if c not in MARKS))


def _events(spark: SparkSession, sf_dir: str, only: Column | None) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events if only is None else events.where(only)


def _shaped(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("ts"))
    return rows.select(
        *(F.expr(_SHARED[name]).alias(name) for name in columns),
        F.to_date(local).alias("local_date"),
        F.hour(local).alias("local_hour"),
        F.when(F.col("event_id") % 97 != 0, F.expr("ts + make_dt_interval(0, 0, 0, 5 + event_id % 90)")).alias("ended_at"),
    )


_LOCAL = f"timezone('{ZONE}', timezone('UTC', ts))"
SIGHTINGS = (
    "sightings as (select "
    + ", ".join(f"{sql} as {name}" for name, sql in _SHARED.items())
    + f", cast({_LOCAL} as date) as local_date, cast(hour({_LOCAL}) as integer) as local_hour, case when event_id % 97 <> 0 then ts + to_seconds(5 + event_id % 90) end as ended_at"
    + " from events left join labels on event_id = doc_id)"
)

_DETECTIONS = {
    "frame": "l_orderkey",
    "det": "l_linenumber",
    "label": "case l_returnflag when 'A' then 'animal' when 'N' then 'person' else 'vehicle' end",
    "score": "l_quantity / 50",
    "x1": "cast(l_partkey % 40 as double) / 100",
    "y1": "cast(l_suppkey % 40 as double) / 100",
    "x2": "cast(l_partkey % 40 + 20 + l_suppkey % 40 as double) / 100",
    "y2": "cast(l_suppkey % 40 + 20 + l_partkey % 40 as double) / 100",
}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a detector: a frame is an order, a detection one of its lines."""
    return read(spark, sf_dir, "lineitem").select(*(F.expr(sql).alias(name) for name, sql in _DETECTIONS.items()))


DETECTIONS = "detections as (select " + ", ".join(f"{sql} as {name}" for name, sql in _DETECTIONS.items()) + " from lineitem)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of 10 to 409 seconds that begin a little before every motion event."""
    return unmarked_sightings(spark, sf_dir).where("label = 'motion'").select("camera_id", F.col("id").alias("segment_id"), F.expr("started_at - interval 3 seconds").alias("seg_start"), F.expr("started_at + make_dt_interval(0, 0, 0, 7 + id % 400)").alias("seg_end"), (F.coalesce("clip_bytes", F.lit(70_000)) * 2).alias("seg_bytes"))


SEGMENTS = "segments as (select camera_id, id as segment_id, started_at - interval 3 second as seg_start, started_at + to_seconds(7 + id % 400) as seg_end, coalesce(clip_bytes, 70000) * 2 as seg_bytes from sightings where label = 'motion')"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores of crops: three crops of one event by vec_id, weighted by their label."""
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("event"), F.col("vec_id").alias("crop"), ((F.col("label") + 1) / 10.0).alias("weight"), F.transform("embedding", lambda x: x.cast("double") * 20).alias("z"))


LOGITS = "logits as (select cast(floor(vec_id / 3) as bigint) as event, vec_id as crop, cast(label + 1 as double) / 10 as weight, list_transform(embedding, lambda x: cast(x as double) * 20) as z from embeddings)"


def taxonomy(spark: SparkSession) -> DataFrame:
    """64 classes: 0 blank, 1 human, 2 vehicle, then species nested by integer division."""
    i = F.col("class")
    return spark.range(64).select(F.col("id").cast("int").alias("class")).select(
        "class",
        F.when(i < 3, "").otherwise(F.concat(F.lit("class"), F.floor(i / 32))).alias("t_class"),
        F.when(i < 3, "").otherwise(F.concat(F.lit("order"), F.floor(i / 16))).alias("t_order"),
        F.when(i < 3, "").otherwise(F.concat(F.lit("family"), F.floor(i / 8))).alias("t_family"),
        F.when(i < 3, "").otherwise(F.concat(F.lit("genus"), F.floor(i / 4))).alias("t_genus"),
        F.when((i < 3) | (i % 4 == 0), "").otherwise(F.concat(F.lit("species"), i)).alias("t_species"),
        F.when(i == 0, "blank").when(i == 1, "human").when(i == 2, "vehicle").otherwise(F.concat(F.lit("kind "), i)).alias("common"),
    )


def _nested(name: str, by: int) -> str:
    return f"case when i < 3 then '' else concat('{name}', cast(floor(i / {by}) as bigint)) end as t_{name}"


TAXONOMY = f"taxonomy as (select i as class, {_nested('class', 32)}, {_nested('order', 16)}, {_nested('family', 8)}, {_nested('genus', 4)}, case when i < 3 or i % 4 = 0 then '' else concat('species', i) end as t_species, case i when 0 then 'blank' when 1 then 'human' when 2 then 'vehicle' else concat('kind ', i) end as common from (select cast(unnest(range(64)) as integer) as i))"
