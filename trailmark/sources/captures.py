"""Captured streams and raw ones as rows: one for each unit of video, with its bytes.

Files are listed and read by Spark, so they may lie wherever Spark reads. A file is a row with its bytes, which are cut in the
JVM; Python only says where a raw stream's units are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a line of units says, and the stream's own parameters.
UNIT = "offset long, len long, received_us long, ts_90k long, key boolean"
INFO = "codec string, width int, height int, decoder_config_hex string"
#: Kinds of NAL units: slices, of which one begins a sequence, and the two parameter sets.
SLICE, IDR, SPS, PPS = 1, 5, 7, 8
PLACES = "array<struct<offset:long,size:long,kind:int>>"


def _base(path: Column, ending: str) -> Column:
    return F.regexp_replace(path, f"{ending}$", "")


def capture_units(spark: SparkSession, folder: str, start_us: int | None = None) -> DataFrame:
    """base (the path without its ending), place (from 0), received_us, ts_90k, key, bytes, codec, width, height and config of all
    captures in a folder: `.h264` with the bytes, `.units.jsonl` with a line for each unit, `.info.json`.

    start_us: the time that each capture's first unit is set to, the others after it as they were. A unit that lies outside
    its file stops the query. Captures without units have no rows.
    """
    path = F.col("_metadata.file_path")
    listed = spark.read.schema(UNIT).option("pathGlobFilter", "*.units.jsonl").json(folder).select(_base(path, r"\.units\.jsonl").alias("base"), "*").where("offset is not null")
    info = spark.read.schema(INFO).option("pathGlobFilter", "*.info.json").option("multiLine", True).json(folder).select(_base(path, r"\.info\.json").alias("base"), "codec", "width", "height", F.unhex("decoder_config_hex").alias("config"))
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.h264").load(folder).select(_base(F.col("path"), r"\.h264").alias("base"), "content")
    # A file's units come to its bytes as one array, so that the bytes aren't copied to each of them.
    units = listed.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("offset", "len", "received_us", "ts_90k", "key"))).alias("units"))
    # Spark lists no file without bytes, so a capture may be without one.
    both = units.join(held, "base", "left").join(info, "base").withColumn("content", F.coalesce("content", F.lit(b"")))
    first = F.get("units", F.lit(0))["received_us"]
    shift = F.lit(0) if start_us is None else F.lit(start_us) - first

    def unit(u: Column) -> Column:
        inside = (u["offset"] >= 0) & (u["len"] >= 0) & (u["offset"] + u["len"] <= F.length("content"))
        data = F.when(inside, F.substring("content", (u["offset"] + 1).cast("int"), u["len"].cast("int"))).otherwise(F.raise_error(F.concat(F.lit("unit outside of "), F.col("base"))).cast("binary"))
        return F.struct((u["received_us"] + shift).alias("received_us"), u["ts_90k"].alias("ts_90k"), u["key"].alias("key"), data.alias("bytes"))

    rows = both.select("base", "codec", "width", "height", "config", F.posexplode(F.transform("units", unit)).alias("place", "u"))
    return rows.select("base", "place", "u.*", "codec", "width", "height", "config")


def _places(data: bytes | None) -> list[tuple[int, int, int]]:
    """(offset, size, kind) of the units between start codes (00 00 01, with any zeros before)."""
    x = np.frombuffer(data or b"", np.uint8)
    starts = np.flatnonzero((x[:-2] == 0) & (x[1:-1] == 0) & (x[2:] == 1)) + 3 if len(x) > 2 else np.empty(0, np.int64)
    solid = np.flatnonzero(x) + 1
    out = []
    for k, start in enumerate(starts.tolist()):
        end = len(x)
        if k + 1 < len(starts):
            before = np.searchsorted(solid, int(starts[k + 1]) - 3, "right")
            end = max(start, int(solid[before - 1]) if before else 0)
        out.append((start, end - start, int(x[start]) & 31 if start < end else -1))
    return out


def nal_places(content: Column) -> Column:
    """Where the units of a raw stream are, as an array of (offset, size, kind)."""

    def find(files: pd.Series) -> pd.Series:
        return files.map(lambda data: [dict(zip(("offset", "size", "kind"), p, strict=True)) for p in _places(data)])

    return F.pandas_udf(find, PLACES)(content)


def raw_units(files: DataFrame, fps: int = 10, start_us: int = 0) -> DataFrame:
    """path, place, received_us, ts_90k, key, bytes of the slices of raw streams (path, content), one a picture, as so many a
    second. A stream without both parameter sets stops the query."""
    d = files.select("path", "content", nal_places(F.col("content")).alias("nals"))
    has = lambda kind: F.exists("nals", lambda n: n["kind"] == kind)
    slices = F.filter("nals", lambda n: n["kind"].isin(SLICE, IDR))
    whole = F.when(has(SPS) & has(PPS), slices).otherwise(F.raise_error(F.concat(F.lit("no parameter sets in "), F.col("path"))).cast(PLACES))
    cut = F.transform(whole, lambda n: F.struct((n["kind"] == IDR).alias("key"), F.substring("content", (n["offset"] + 1).cast("int"), n["size"].cast("int")).alias("bytes")))
    rows = d.select("path", F.posexplode(cut).alias("place", "u"))
    fps = max(1, fps)
    return rows.select("path", "place", (F.lit(start_us) + F.col("place") * (1_000_000 // fps)).cast("long").alias("received_us"), F.expr(f"cast(place as bigint) * 90000 div {fps}").alias("ts_90k"), "u.key", "u.bytes")


def rate_of(url: Column) -> Column:
    """Pictures a second that a file URL asks for (fps=), 10 if it doesn't, 1 at least."""
    return F.greatest(F.coalesce(F.regexp_extract(url, "[?&]fps=([0-9]+)", 1).try_cast("int"), F.lit(10)), F.lit(1))
