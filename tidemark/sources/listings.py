"""File and object listings, and capture index lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.crawl_fields import dash_to_null
from tidemark.sources.topics import TIME_FORMATS

# Fixed value: a file's line in a recursive listing (permissions, copies, owner, group, size, date, time, path).
FILE_LINE = r"^[-l][rwxsStT-]{9}[+]?\s+\S+\s+\S+\s+\S+\s+[0-9]+\s+[0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2}\s.+$"
FOLDER_LINE = r"^d[rwxsStT-]{9}[+]?\s"
LISTING_FIELDS = 8

# The 11 fields of a capture index line.
INDEX_FIELDS = ("urlkey", "ts14", "url", "mime", "status", "digest", "redirect", "meta", "length", "offset", "filename")
INDEX_LINE = r"^[^ ]+(?: [^ ]+){10} *$"
INDEX_HEADER = r"^ ?CDX "

OBJECT_SCHEMA = "key string, size bigint, last_modified timestamp_ntz, storage_class string"


def read_listing(spark: SparkSession, glob: str) -> DataFrame:
    return parse_listing(spark.read.text(glob))


def parse_listing(lines: DataFrame) -> DataFrame:
    """One row per file; folders are left out. Lines of another form (errors of a partial listing) come back in ``_corrupt``.

    A file that is missing from a listing may still exist, as a listing may be cut short: never take
    absence for deletion.
    """
    # one pattern decides, one split cuts; the path is the last field and may hold spaces
    good = F.col("value").rlike(FILE_LINE)
    cut = lines.where((F.trim("value") != "") & ~F.col("value").rlike(FOLDER_LINE)).select(
        F.when(good, F.split("value", r"\s+", LISTING_FIELDS)).alias("_p"), F.when(~good, F.col("value")).alias("_corrupt")
    )
    part = [F.get("_p", F.lit(i)) for i in range(LISTING_FIELDS)]
    return cut.select(
        part[0].alias("permissions"),
        part[1].try_cast("int").alias("replication"),
        part[2].alias("owner"),
        part[3].alias("group"),
        part[4].cast("bigint").alias("size"),
        F.concat_ws(" ", part[5], part[6]).try_cast("timestamp_ntz").alias("modified_at"),
        part[7].alias("file_path"),
        "_corrupt",
    )


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Cloud object listing (JSON lines)."""
    return spark.read.schema(OBJECT_SCHEMA).options(**TIME_FORMATS).json(path)


def read_capture_index(spark: SparkSession, glob: str) -> DataFrame:
    return parse_index_lines(spark.read.text(glob))


def parse_index_lines(lines: DataFrame) -> DataFrame:
    """Capture index rows; ``-`` is null. Header lines are left out; malformed lines (not 11 fields) come back in ``_corrupt``."""
    good = F.col("value").rlike(INDEX_LINE)
    cut = lines.where((F.trim("value") != "") & ~F.col("value").rlike(INDEX_HEADER)).select(
        F.when(good, F.split(F.trim("value"), " ")).alias("_p"), F.when(~good, F.col("value")).alias("_corrupt")
    )
    numbers = {"length", "offset", "status"}
    columns = []
    for i, name in enumerate(INDEX_FIELDS):
        value = dash_to_null(F.get("_p", F.lit(i)))
        columns.append((value.try_cast("bigint") if name in numbers else value).alias(name))
    return cut.select(*columns, "_corrupt")


def index_lines(df: DataFrame) -> DataFrame:
    """Capture index rows as text lines."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in INDEX_FIELDS]
    return df.select(F.concat_ws(" ", *fields).alias("value"))


def tracked_schema() -> T.StructType:
    """A tracked file as exported by the file tracker."""
    text, texts = T.StringType(), T.ArrayType(T.StringType())
    return T.StructType(
        [
            T.StructField("id", text),
            T.StructField("file_path_s", text),
            T.StructField("hdfs_service_id_s", text),
            T.StructField("kind_s", text),
            T.StructField("stream_s", text),
            T.StructField("modified_at_dt", T.TimestampNTZType()),
            T.StructField("timestamp_dt", T.TimestampNTZType()),
            T.StructField("cdx_index_ss", texts),
            T.StructField("log_analysis_ss", texts),
            T.StructField("access_url_s", text),
            T.StructField("size", T.LongType()),
        ]
    )


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    """Export of the file tracker (JSON lines) under plain column names."""
    raw = spark.read.schema(tracked_schema()).options(**TIME_FORMATS).json(path)
    return raw.select(
        "id",
        F.col("file_path_s").alias("file_path"),
        F.col("hdfs_service_id_s").alias("service"),
        F.col("kind_s").alias("kind"),
        F.col("stream_s").alias("stream"),
        F.col("modified_at_dt").alias("modified_at"),
        F.col("timestamp_dt").alias("tracked_at"),
        F.col("cdx_index_ss").alias("cdx_index"),
        F.col("log_analysis_ss").alias("log_analysis"),
        F.col("access_url_s").alias("access_url"),
        "size",
    )
