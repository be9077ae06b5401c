"""Writers: JSON lines, prefix lists, access lists, daily parquet, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import upsert_days
from tidemark.operators.ordered import rank_by_range
from tidemark.sources.topics import TIME_FORMATS


def write_jsonl(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").options(**TIME_FORMATS).json(folder)


def prefix_lines(df: DataFrame, column: str) -> DataFrame:
    """Distinct prefixes as a one-column frame ready for :func:`write_lines`."""
    return df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()


def write_lines(df: DataFrame, folder: str) -> None:
    """Text lines in ascending order over all files (files are ranges, sorted by name)."""
    df.select("value").orderBy("value").write.mode("overwrite").text(folder)


def access_lines(rules: DataFrame, prefix: str, access: str) -> DataFrame:
    """Access-list lines ``<prefix> - {"access": ...}``; readers expect them in descending order."""
    entry = F.to_json(F.struct(F.col(access).alias("access"), F.col(prefix).alias("url")))
    return rules.select(F.concat_ws(" - ", F.col(prefix), entry).alias("value")).distinct()


def write_access_list(rules: DataFrame, prefix: str, access: str, folder: str) -> None:
    access_lines(rules, prefix, access).orderBy(F.col("value").desc()).write.mode("overwrite").text(folder)


def read_lines(spark: SparkSession, folder: str, line_no: str = "line_no") -> DataFrame:
    """(line_no, value): the lines of a folder of text files in their order over all files, numbered from 1."""
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.text(folder).select("value", *place, F.monotonically_increasing_id().alias("_at")).withColumn("_all", F.lit(0))
    return rank_by_range(lines, ["_all"], ["_file", "_start", "_at"], line_no).select(line_no, "value")


def write_days(df: DataFrame, ts: str, folder: str) -> None:
    """Parquet by day. Rebalancing splits a busy day over as many tasks as its size asks for and joins small days."""
    days = df.withColumn("day", F.to_date(ts))
    days.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(folder)


def upsert_into_days(df: DataFrame, day: str, keys: Sequence[str], version: Sequence[str], columns: Sequence[str], folder: str) -> None:
    """Merge updates into a day-partitioned table; only the touched days are rewritten."""
    spark = df.sparkSession
    existing = spark.read.parquet(folder)
    merged = upsert_days(existing, df, day, keys, version, columns)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)
