"""A change feed and the table it adds up to, written once per micro-batch whatever is broken off and run again.

A stream of changes (id, seq, kind, and what a row holds) is written by foreachBatch. A batch's changes go to a folder of their
own, which a second attempt replaces, and then one row with the batch's number goes to the ledger: only batches in the ledger
exist for readers, so a writer that dies between the two leaves nothing that counts. The table is the last change of each id
by batch and seq; removed ids have none. It is folded from a snapshot and the batches after it.

Readers take a position (the last batch in the ledger) before anything else. What they replay is the table at that position,
and what they follow are the batches after it, so that nothing is lost between the two and nothing comes twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.ledger import Ledger

KINDS = ("started", "updated", "ended", "removed")
#: The most rows of one replay, as of one page.
MOST = 500


@dataclass
class Feed:
    """A feed in a folder that driver and executors share. schema: that of the changes, with id, seq and kind."""

    spark: SparkSession
    folder: str
    schema: StructType

    def __post_init__(self) -> None:
        self.ledger = Ledger(self.spark, self.folder)

    # Writing

    def write(self, changes: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Starts the writer of a stream of changes; trigger as of DataStreamWriter.trigger()."""
        stream = changes.select(*self.schema.fieldNames()).writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint)
        return (stream.trigger(**trigger) if trigger else stream).start()

    def put(self, changes: DataFrame, batch: int) -> None:
        """One batch: its changes, then its row in the ledger. A batch in the ledger is left as it is."""
        self.ledger.put(batch, {"changes": changes})

    def compact(self) -> int:
        """Writes the table as a snapshot, from which it is folded from now on; returns its position. Changes stay for readers."""
        upto = self.position()
        if upto >= 0 and not self.ledger.has(f"snapshots/upto={upto}"):
            self._folded(upto).write.mode("overwrite").parquet(f"{self.folder}/snapshots/upto={upto}")
        return upto

    # Reading

    def position(self) -> int:
        """The last batch in the ledger, -1 for none."""
        return self.ledger.position()

    def changes(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Changes of the batches in the ledger after one and up to another, with batch: what a reader at a position follows."""
        return self.ledger.table("changes", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields), after, upto)

    def _folded(self, upto: int) -> DataFrame:
        """The last change of each id, removed ones too, so that a snapshot knows them."""
        snapshot = max((s for s in self.ledger.numbers("snapshots", "upto") if s <= upto), default=-1)
        rows = self.changes(snapshot, upto)
        if snapshot >= 0:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(f"{self.folder}/snapshots/upto={snapshot}"))
        columns = [c for c in rows.columns if c != "id"]
        # A partial aggregate: an id with most of the changes is one row a task.
        last = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("batch", "seq")).alias("r"))
        return last.select("id", *(F.col(f"r.{c}").alias(c) for c in columns))

    def table(self, upto: int | None = None) -> DataFrame:
        """The rows as they are, or as they were at a position."""
        return self._folded(self.position() if upto is None else upto).where("kind <> 'removed'")

    def replay(self, after_id: int, most: int = MOST) -> tuple[int, DataFrame]:
        """A position, and what a reader has missed who has seen ids up to after_id: rows with later ids, the earliest first.
        Their kind is "ended" if their last change was that, else "started". changes(position) goes on from there."""
        at = self.position()
        rows = self.table(at).where(F.col("id") > after_id).orderBy("id").limit(min(most, MOST))
        return at, rows.withColumn("kind", F.when(F.col("kind") == "ended", "ended").otherwise("started")).orderBy("id")


def versions(changes: DataFrame) -> DataFrame:
    """changes with version: 1 for the first change of an id, and so on by batch and seq."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy("id").orderBy("batch", "seq")))
