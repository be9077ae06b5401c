"""A capture index laid out in key order: sorted files and a manifest of their first and last keys.

Rows are range-partitioned by (key, tie) and sorted, so each file covers one stretch of keys. The manifest has a row per file; a
lookup reads the manifest, and then only the files whose stretch meets the wanted one. An append adds files and manifest rows of its
own; merging lays all rows out anew as one version. Readers follow the newest version listed in the manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# after every text that begins with a prefix: a prefix ends at its last character's successor
_LAST = "\U0010ffff"
MANIFEST = "version bigint, file string, first_key string, last_key string, n bigint"


def _lay_out(rows: DataFrame, key: str, tie: str, folder: str, version: int, blocks: int | None) -> DataFrame:
    part = f"{folder}/blocks/part={uuid.uuid4().hex}"
    keyed = rows.where(F.col(key).isNotNull())
    placed = keyed.repartitionByRange(blocks, key, tie) if blocks else keyed.repartitionByRange(key, tie)
    placed.sortWithinPartitions(key, tie).write.parquet(part)
    written = rows.sparkSession.read.parquet(part).withColumn("file", F.col("_metadata.file_path"))
    return written.groupBy("file").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n")).select(
        F.lit(version).cast("bigint").alias("version"), "file", "first_key", "last_key", "n"
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the newest version."""
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return listed.where(F.col("version") == listed.select(F.max("version")).scalar())


def write_index(rows: DataFrame, key: str, tie: str, folder: str, blocks: int | None = None) -> None:
    """Begin an index; rows without a key are left out."""
    _lay_out(rows, key, tie, folder, 0, blocks).write.mode("errorifexists").parquet(f"{folder}/manifest")


def append_index(rows: DataFrame, key: str, tie: str, folder: str, blocks: int | None = None) -> None:
    """Add rows as sorted files of their own; they are seen as soon as the manifest lists them."""
    version = manifest(rows.sparkSession, folder).select(F.max("version")).first()[0]
    _lay_out(rows, key, tie, folder, version or 0, blocks).write.mode("append").parquet(f"{folder}/manifest")


def merge_index(spark: SparkSession, key: str, tie: str, folder: str, blocks: int | None = None) -> None:
    """Lay all rows of the newest version out anew, as the next version; readers change over with the manifest."""
    now = manifest(spark, folder)
    files = [r["file"] for r in now.select("file").collect()]
    version = now.select(F.max("version")).first()[0]
    whole = spark.read.parquet(*files)
    _lay_out(whole, key, tie, folder, version + 1, blocks).write.mode("append").parquet(f"{folder}/manifest")


def stretch(value: str, match_type: str = "prefix") -> list[tuple[str, str]]:
    """Key ranges (from, to, both included) that hold every match: ``exact``, ``prefix``, ``host`` (``uk,co,x``) or ``domain``."""
    ends = {"exact": [value], "prefix": [value], "host": [value + ")"], "domain": [value + ")", value + ","]}[match_type]
    return [(low, low if match_type == "exact" else low + _LAST) for low in ends]


def files_of(spark: SparkSession, folder: str, value: str, match_type: str = "prefix") -> list[str]:
    """The files that a lookup reads: as many as the wanted stretch of keys has."""
    meets = F.lit(False)
    for low, high in stretch(value, match_type):
        meets = meets | ((F.col("first_key") <= high) & (F.col("last_key") >= low))
    return [r["file"] for r in manifest(spark, folder).where(meets).select("file").collect()]


def lookup(spark: SparkSession, folder: str, key: str, value: str, match_type: str = "prefix") -> DataFrame:
    """The rows of a match, read from the files of its stretch; inside a file the range is pushed down to its row groups."""
    files = files_of(spark, folder, value, match_type)
    if not files:
        anyone = manifest(spark, folder).select("file").first()
        return spark.read.parquet(anyone["file"]).limit(0)
    inside = F.lit(False)
    for low, high in stretch(value, match_type):
        inside = inside | F.col(key).between(low, high)
    return spark.read.parquet(*files).where(inside)
