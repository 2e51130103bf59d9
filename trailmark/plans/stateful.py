"""Visits, update logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracking
from ..sources.adapter import SIGHTINGS, read, unmarked_sightings
from ..sources.scratch import shared_path
from ..streaming import feed, pipeline
from .registry import query


def moving_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two things a user's camera sees for each of the user's events, 200 ms apart: one that drifts and one that stays."""
    e = read(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 50).alias("n"), "value", (F.col("event_type") != "error").alias("stays"))
    # A frame is one row until it is dealt out: both things take the best of its events, the one that stays of those it is in.
    frames = e.groupBy("user_id", "n").agg(F.max("value").alias("value"), F.max(F.when(F.col("stays"), F.col("value"))).alias("staying"), F.max("stays").alias("stays"))
    x, box = (F.col("n") % 60) / 100.0, ("x1", "y1", "x2", "y2")
    drift = F.struct(F.lit("vehicle").alias("label"), (0.4 + F.col("value") / 1000).alias("score"), (x + 0.02).alias("x1"), F.lit(0.2).alias("y1"), (x + 0.32).alias("x2"), F.lit(0.5).alias("y2"))
    stay = F.struct(F.lit("animal").alias("label"), (0.35 + F.col("staying") / 1000).alias("score"), *(F.lit(v).alias(c) for v, c in zip((0.6, 0.6, 0.8, 0.9), box, strict=True)))
    both = F.when(F.col("stays"), F.array(drift, stay)).otherwise(F.array(drift))
    camera = F.concat(F.lit("camera"), F.col("user_id").cast("string"))
    return frames.select(camera.alias("camera_id"), (F.col("n") * 0.2).alias("at"), F.inline(both))


@query()
def st_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.visits(moving_detections(spark, sf_dir))


@query("select id, label, max(top_score) as top_score, max(ended_at) as ended_at, bool_or(label = 'motion') as demoted, count(*) as n_updates from (select id, label, top_score * k / 3 as top_score, case when k = 3 then ended_at end as ended_at from sightings, (select unnest([1, 2, 3]) as k)) group by id, label", SIGHTINGS)
def st_update_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started, updated and ended rows of each event folded into it: scores only rise, the end is the last one told."""
    s = unmarked_sightings(spark, sf_dir)
    log = s.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("id", "label", (F.col("top_score") * F.col("k") / 3).alias("top_score"), F.when(F.col("k") == 3, F.col("ended_at")).alias("ended_at"))
    return log.groupBy("id", "label").agg(F.max("top_score").alias("top_score"), F.max("ended_at").alias("ended_at"), F.bool_or(F.col("label") == "motion").alias("demoted"), F.count("*").alias("n_updates"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return pipeline.file_stream(spark, path, schema).withColumn("at", F.col("ts").cast("timestamp"))


@query("select event_id, user_id from events")
def st_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, though the stream brings each twice."""
    twice = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return pipeline.drained(pipeline.without_repeats(twice, "at", ["event_id"], "7 days").select("event_id", "user_id"), "ingest")


@query("select event_type, start, frames, round(amount, 6) as amount from (select event_type, time_bucket(interval 1 day, ts) as start, count(*) as frames, sum(value) as amount from events group by event_type, time_bucket(interval 1 day, ts)) where start + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def st_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates of the days that are over for certain."""
    out = pipeline.drained(pipeline.rates(_event_stream(spark, sf_dir), "at", "1 day", "1 hour", "event_type"), "rates")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "frames", F.round("amount", 6).alias("amount"))


@query("select user_id as id, seq, kind, value, case kind when 'ended' then 'ended' else 'started' end as replayed from (select user_id, event_id as seq, case event_type when 'view' then 'started' when 'click' then 'updated' when 'error' then 'removed' else 'ended' end as kind, value, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 and kind <> 'removed'")
def st_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change of its user, written by a stream: each user's last state, and as what it would be replayed."""
    at = shared_path(spark, "feed")
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "updated").when(F.col("event_type") == "error", "removed").otherwise("ended")
    changes = _event_stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), "value")
    made = feed.Feed(spark, at, changes.schema)
    made.write(changes, f"{at}-state", availableNow=True).awaitTermination()
    return made.table().select("id", "seq", "kind", "value", F.when(F.col("kind") == "ended", "ended").otherwise("started").alias("replayed"))
