"""Readers for tables laid out by day, URL lists, curated dumps and relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_days(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Days ``first``..``last`` of a folder partitioned by ``day``; other days are not opened."""
    return spark.read.parquet(folder).where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blanks are dropped."""
    return clean_url_lines(spark.read.text(path), "value")


def clean_url_lines(lines: DataFrame, column: str) -> DataFrame:
    return lines.select(F.trim(column).alias("url")).where(F.col("url") != "")


def read_curated_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dump with a header line; fields may hold line breaks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def jdbc_options(
    url: str, table: str, user: str, column: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options for a read-only, range-split relational read (``spark.read.format("jdbc").options(**...)``)."""
    if partitions < 1 or lower >= upper:
        raise ValueError("a split read needs at least one partition and lower < upper")
    return {
        "url": url,
        "dbtable": table,
        "user": user,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        "sessionInitStatement": "SET default_transaction_read_only = on",
    }


def latest_domain_list(spark: SparkSession, glob: str) -> DataFrame:
    """Registered names from the newest monthly file (``...YYYY-MM...`` in its name)."""
    lines = spark.read.schema("domain string").csv(glob).withColumn(
        "month", F.regexp_extract(F.input_file_name(), r"([0-9]{4}-[0-9]{2})[^/]*$", 1)
    )
    return newest_month(lines.where(F.col("domain").isNotNull()), "month")


def newest_month(lines: DataFrame, month: str) -> DataFrame:
    return lines.where(F.col(month) == lines.select(F.max(month)).scalar())
