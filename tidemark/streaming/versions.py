"""State that a stream of batches carries in files: each batch adds its changes only, old versions are removed.

A batch may be repeated after a failure. So a batch writes under its own number, reads smaller numbers only, and a folder is removed
only when no repeated batch can still need it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A whole table is written every so many batches, so that a read meets few files and old changes can go.
WHOLE_EVERY = 32


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class KeyedState:
    """One row per key as of the batches before; a batch writes the keys it touches."""

    def __init__(self, folder: str, keys: Sequence[str], schema: T.StructType, whole_every: int = WHOLE_EVERY):
        self.folder, self.keys, self.schema, self.whole_every = folder, list(keys), schema, whole_every

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The state before ``batch_id``."""
        whole = (batch_id - 1) // self.whole_every * self.whole_every if batch_id > 0 else 0
        parts = [(self._path("whole", whole), whole)] if whole else []
        parts += [(self._path("changes", b), b) for b in range(whole + 1 if whole else 0, batch_id)]
        if not parts:
            return spark.createDataFrame([], self.schema)
        rows = None
        for path, batch in parts:
            one = spark.read.schema(self.schema).parquet(path).withColumn("_batch", F.lit(batch))
            rows = one if rows is None else rows.unionByName(one)
        values = [c for c in self.schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col("_batch")).alias("_v"))
        return newest.select(*self.keys, "_v.*").select(*self.schema.names)

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Add the state of the keys that the batch has touched."""
        spark = changed.sparkSession
        changed.select(*self.schema.names).write.mode("overwrite").parquet(self._path("changes", batch_id))
        if batch_id and batch_id % self.whole_every == 0:
            before = self.read(spark, batch_id).join(changed.select(*self.keys), self.keys, "left_anti")
            now = spark.read.schema(self.schema).parquet(self._path("changes", batch_id))
            before.unionByName(now).write.mode("overwrite").parquet(self._path("whole", batch_id))
            # this batch may be repeated and then reads from the whole table before; older ones are not read again
            oldest = batch_id - self.whole_every
            if oldest > 0:
                remove_folder(spark, self._path("whole", oldest - self.whole_every))
            for batch in range(oldest - self.whole_every, oldest):
                remove_folder(spark, self._path("changes", batch))


class Panes:
    """Partial totals per pane of time; a batch adds its own, readers sum them up, panes behind the window are removed."""

    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def add(self, partials: DataFrame, pane: str, batch_id: int) -> None:
        """``pane`` names the column whose value is the folder; only the batch's own files are written."""
        spread = partials.withColumn("batch", F.lit(batch_id))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(pane, "batch").parquet(self.folder)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.folder)

    def remove_before(self, spark: SparkSession, pane: str, first: int) -> list[int]:
        """Remove the folders of panes before ``first``; returns them."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in files.listStatus(root)]
        numbers = [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{pane}=") and n.split("=", 1)[1].lstrip("-").isdigit()]
        old = sorted(n for n in numbers if n < first)
        for number in old:
            remove_folder(spark, f"{self.folder}/{pane}={number}")
        return old
