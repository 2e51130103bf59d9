"""Numbered parts of tables in a shared folder, of which only those in a ledger count.

What is written goes to a folder of its number, which another attempt replaces; the last thing written is the number's row in
the ledger. So whatever breaks off half way leaves nothing that a reader sees, and is done again under the same number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Ledger:
    """A folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _place(self, name: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def has(self, name: str) -> bool:
        """Whether a part was written to its end."""
        fs, place = self._place(f"{name}/_SUCCESS")
        return fs.exists(place)

    def numbers(self, name: str = "ledger", column: str = "batch") -> list[int]:
        """Numbers of the whole parts of a folder, from a listing."""
        fs, place = self._place(name)
        if not fs.exists(place):
            return []
        parts = [p.getPath().getName() for p in fs.listStatus(place)]
        return sorted(int(p.split("=")[1]) for p in parts if p.startswith(f"{column}=") and self.has(f"{name}/{p}"))

    def position(self) -> int:
        """The last number in the ledger, -1 for none."""
        return max(self.numbers(), default=-1)

    def commit(self, batch: int) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def put(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Parts of several tables, which come to be all at once. A number in the ledger is left as it is."""
        if self.has(f"ledger/batch={batch}"):
            return
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        self.commit(batch)

    def table(self, name: str, schema: str, after: int = -1, upto: int | None = None) -> DataFrame:
        """All parts of a table that are in the ledger, with batch."""
        whole = f"{schema}, batch long"
        paths = [f"{self.folder}/{name}/batch={b}" for b in self.numbers() if b > after and (upto is None or b <= upto)]
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/{name}").parquet(*paths)
