"""What the corpus operators share: reading a table, intermediate tables, and words as Spark expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the body of a character class of Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where a local session names none (a test) is one made here."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="trailmark-", dir=os.environ.get("TRAILMARK_TMP"))
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Paths of the tables written by stored() and not discarded yet, and the names of those of bucketed().
written: list[str] = []
_named: dict[str, str] = {}


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once as Parquet to the shared folder and read back: later steps don't compute it again, and an executor's loss costs them nothing."""
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    written.append(at)
    return spark.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Like stored(), with the rows of one value of column in one of so many buckets: a group by that column reads them in place.
    Also the same table as plain files."""
    spark = df.sparkSession
    called = f"{name}_{uuid.uuid4().hex}"
    at = f"{scratch_dir(spark)}/{called}"
    df.write.bucketBy(buckets, column).option("path", at).option("compression", "zstd").saveAsTable(called)
    written.append(at)
    _named[at] = called
    return spark.table(called), spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of stored() that nothing will read any more."""
    for at in paths:
        if called := _named.pop(at, None):
            spark.sql(f"drop table if exists {called}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        written.remove(at)


def each_text(column: pa.Array) -> Iterator[str | None]:
    """A batch's texts as Python strings, one at a time: a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The maximal runs of other than ASCII white space; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))
