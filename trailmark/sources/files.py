"""Files of the sighting model: label and geofence files, segment indexes, case corpora, folders; and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANKS = ("uuid", "t_class", "t_order", "t_family", "t_genus", "t_species", "common")
GEOFENCE = "map<string,struct<allow:map<string,array<string>>,block:map<string,array<string>>>>"
SEGMENT = "codec string, width int, height int, config string, samples array<struct<offset:long,size:long,key:boolean,wall_us:long,ticks:long>>"


def labels(lines: DataFrame) -> DataFrame:
    """Rows of a label file (column value: seven fields between semicolons); other lines are left out. class: the place."""
    parts = F.split("value", ";", -1)
    return lines.where(F.size(parts) == len(RANKS)).select(*(F.trim(F.get(parts, F.lit(i))).alias(r) for i, r in enumerate(RANKS)))


def taxonomy(labels_read: DataFrame, order: str) -> DataFrame:
    """One row for each full class; of repeated ones the last by order."""
    key = F.concat_ws(";", *RANKS[1:6])
    return labels_read.withColumn("taxon", key).withColumn("__n", F.row_number().over(Window.partitionBy("taxon").orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def geofence(text: DataFrame) -> DataFrame:
    """taxon, allow, block from JSON documents (column value); absent maps are empty."""
    rules = text.select(F.explode(F.from_json("value", GEOFENCE)).alias("taxon", "rule"))
    empty = F.create_map().cast("map<string,array<string>>")
    return rules.select("taxon", F.coalesce("rule.allow", empty).alias("allow"), F.coalesce("rule.block", empty).alias("block"))


def segment_samples(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample of segment indexes in JSON, with the file it is from."""
    read = spark.read.schema(SEGMENT).json(path, multiLine=True)
    return read.select(F.input_file_name().alias("file"), "codec", "width", "height", F.posexplode("samples").alias("place", "s")).select("file", "codec", "width", "height", "place", "s.*")


def sample_bytes(files: DataFrame, samples: DataFrame) -> DataFrame:
    """The bytes of samples (path, offset, size) cut from binary files (path, content)."""
    return samples.join(files.select("path", "content"), "path").select(samples["*"], F.expr("substring(content, cast(offset + 1 as int), cast(size as int))").alias("bytes"))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """n_files and bytes below a folder, from listings alone: contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def hub_recordings(answers: DataFrame) -> DataFrame:
    """Recordings from hub answers in JSON (column value): name, size (a number or its text) and calendar fields of start, in
    order of start. A name that comes again right after itself in that order is one recording. Answers are told apart by a
    column hub, where there is one, and ordered each for itself."""
    shape = "array<struct<name:string,size:string,start:struct<year:int,mon:int,day:int,hour:int,min:int,sec:int>>>"
    hub = [c for c in ("hub",) if c in answers.columns]
    rows = answers.select(*hub, F.monotonically_increasing_id().alias("__answer"), F.posexplode(F.from_json(F.get_json_object("value", "$.files"), shape)).alias("__place", "f"))
    rows = rows.select(*hub, "__answer", "__place", "f.name", F.expr("try_cast(f.size as bigint)").alias("size"), "f.start")
    # What comes right after itself is found among the rows of a day first; the day before tells its last name.
    day = F.struct("start.year", "start.mon", "start.day")
    rows = rows.withColumn("__day", day)
    order = ("start", "__answer", "__place")
    before = F.lag("name").over(Window.partitionBy(*hub, "__day").orderBy(*order))
    last = rows.groupBy(*hub, "__day").agg(F.max_by("name", F.struct(*order)).alias("__name"))
    last = last.withColumn("__last", F.lag("__name").over(Window.partitionBy(*hub).orderBy("__day"))).select(*(F.col(c).alias(f"__{c}") for c in hub), F.col("__day").alias("__of"), "__last")
    met = rows.withColumn("__before", before).withColumn("__first", F.row_number().over(Window.partitionBy(*hub, "__day").orderBy(*order)) == 1)
    on = F.expr(" and ".join(["__day <=> __of", *(f"{c} <=> __{c}" for c in hub)]))
    met = met.join(last, on, "left").withColumn("__before", F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__before")))
    return met.where(~F.col("name").eqNullSafe(F.col("__before")) | F.col("__before").isNull()).select(*hub, "name", "size", "start")


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments by camera and local day, sorted by their start within each file."""
    day = segments.withColumn("day", F.date_format("seg_start", "yyyyMMdd"))
    day.repartition("camera_id", "day").sortWithinPartitions("camera_id", "day", "seg_start").write.mode("append").partitionBy("camera_id", "day").parquet(path)


def write_corpus(cases: DataFrame, path: str) -> None:
    """Cases as lines of JSON."""
    cases.write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a corpus; a folder that isn't there has none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


#: What this library writes; a newer store is refused.
STORE_VERSION = 1


def open_store(spark: SparkSession, folder: str) -> int:
    """Opens a store's folder, or begins one: its version, which is kept beside its tables, is returned."""
    at = f"{folder}/meta"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        spark.range(1).select(F.lit(STORE_VERSION).alias("version")).coalesce(1).write.json(at)
        return STORE_VERSION
    version = spark.read.schema("version int").json(at).first()["version"]
    if version > STORE_VERSION:
        raise ValueError(f"the store in {folder} has version {version}; this library knows {STORE_VERSION}")
    return version
