"""Documents to training tokens in five stages, each one operator of trailmark.llm applied to all its predecessor kept.

Every stage is written as Parquet to the folder that driver and executors share, and read again by the next; what a stage
wrote besides is deleted then.

Cases, in every stage: extra columns are dropped, whatever their names; rows without id or text, empty and very long texts
count as the stage's operator says; repeated rows stay until the near-duplicates, which leave one row of an id (rows without
id stay); of documents that tie, the smallest id stays (near-duplicates) and the order of hashes decides (mixing); an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import mixing, near_duplicates, pieces, quality_model, quality_rules
from trailmark.llm.common import discard, stored, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("kept").select(*COLUMNS)


def quality_model_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer doesn't take for bad ones."""
    return quality_model.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles link at a similarity of 0.8; rows without id stay."""
    resolved = stored(near_duplicates.resolve(docs, percent=80).select("doc_id", "kept"), "near-resolved")
    # The ids to leave out grow with the corpus: they are merged at every size, never broadcast.
    gone = resolved.where("not kept").select("doc_id").distinct().hint("merge")
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    if resolved.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    # Of rows with one id, the first in an order over their whole content.
    order = Window.partitionBy("doc_id").orderBy(*(F.xxhash64(c) for c in COLUMNS[1:]))
    return left.withColumn("__n", F.row_number().over(order)).where("__n = 1 or doc_id is null").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all tokens, dealt by weight over domains, languages and sources; a document may come once for each of two epochs."""
    return mixing.select(docs, fraction=0.5, epochs=2, weights=mixing.MIX, keep=COLUMNS).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with whether they decode to its text."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality rules", quality_rule_stage),
    ("quality classifier", quality_model_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("piece encoding", encoding_stage),
]

#: Learned rules, a trained scorer and merges by rank can't be written as SQL; tests/llm/test_pipeline.py holds each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), set(written)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
            # Only this table is read from here on.
            discard(spark, [at for at in written[:-1] if at not in before])
    return docs
