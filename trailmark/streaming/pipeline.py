"""Structured Streaming over sightings: ingest without repeats, rates, clips that meet their segments, visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a table. The path is given as a pattern, because Spark takes any other for a folder of files."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def without_repeats(stream: DataFrame, at: str, keys: list[str], lateness: str) -> DataFrame:
    """Each key once, as long as its repeats come within the lateness; the state forgets older ones."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def rates(stream: DataFrame, at: str, width: str, lateness: str, *keys: str) -> DataFrame:
    """Count and sum of value for each window and key, told once no more can come."""
    w = stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), *keys)
    return w.agg(F.count("*").alias("frames"), F.sum("value").alias("amount")).select(*keys, F.col("w.start").alias("start"), "frames", "amount")


def clips_with_segments(events: DataFrame, segments: DataFrame, lateness: str = "1 hour", ahead: str = "10 minutes") -> DataFrame:
    """Each event with the camera's segments that end after it began and start before it ends; events without any come
    alone once the watermark has passed them."""
    e = events.withWatermark("from_at", lateness)
    s = segments.withWatermark("seg_start", lateness).withColumnRenamed("camera_id", "seg_camera")
    meets = F.expr(f"camera_id = seg_camera and seg_start >= from_at - interval {ahead} and seg_start < from_at + interval {ahead} and seg_start < to_at and seg_end > from_at")
    return e.join(s, meets, "leftOuter")


def split(stream: DataFrame, sinks: dict, checkpoint: str, **trigger: object) -> list:
    """One stream to several sinks: for each name a function of the stream's rows and the folder that its result goes to. Each is
    a query of its own with its own checkpoint, so that a slow or broken one holds up no other."""
    started = []
    for name, (rows_of, path) in sinks.items():
        writer = rows_of(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}")
        started.append((writer.trigger(**trigger) if trigger else writer).queryName(f"{name}-{abs(hash(path))}").start())
    return started


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
