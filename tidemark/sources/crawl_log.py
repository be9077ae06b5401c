"""Crawl log text: one line per fetch, fields separated by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import crawl_fields as cf
from tidemark.functions.urls import url_host

# The fields of a crawl event and their types.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(n, T.StringType()) for n in ("url", "via", "seed", "crawl_name", "hop_path", "thread", "host", "http_method")],
        *[T.StructField(n, T.LongType()) for n in ("status_code", "size", "wire_bytes")],
        T.StructField("mimetype", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("content_digest", T.StringType()),
        T.StructField("start_time_plus_duration", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("duration", T.LongType()),
        T.StructField("warc_filename", T.StringType()),
        T.StructField("warc_offset", T.LongType()),
        T.StructField("warc_length", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("warc_content_type", "warc_type", "warc_id")],
        T.StructField("annotations", T.ArrayType(T.StringType())),
        T.StructField("extra_info", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Order of the fields on a line; the last one is a JSON object and may hold spaces.
LINE_FIELDS = (
    "timestamp", "status_code", "size", "url", "hop_path", "via", "mimetype", "thread",
    "start_time_plus_duration", "content_digest", "seed", "annotations", "extra_info",
)


def read_crawl_log(spark: SparkSession, glob: str, crawl_name: str) -> DataFrame:
    return parse_lines(spark.read.text(glob), crawl_name)


def parse_lines(lines: DataFrame, crawl_name: str) -> DataFrame:
    """The 27 event fields and ``_corrupt``, which holds a line that is no log line (its fields are null)."""
    parts = F.split(F.trim("value"), r"\s+", len(LINE_FIELDS))
    # split and parsed once: columns with several uses stay in a projection of their own
    cut = lines.where(F.trim("value") != "").select("value", parts.alias("_p"))
    cut = cut.withColumn("_info", cf.extra_info(F.get("_p", F.lit(len(LINE_FIELDS) - 1))))
    field = {name: cf.dash_to_null(F.get("_p", F.lit(i))) for i, name in enumerate(LINE_FIELDS)}
    when = F.try_to_timestamp(field["timestamp"]).cast("timestamp_ntz")
    status = field["status_code"].try_cast("bigint")
    good = (F.size("_p") >= len(LINE_FIELDS) - 1) & when.isNotNull() & status.isNotNull() & field["url"].isNotNull()
    info = F.col("_info")
    # a dash in the hop path stands for none
    values = {
        "timestamp": when,
        "url": field["url"],
        "via": field["via"],
        "seed": field["seed"],
        "crawl_name": F.lit(crawl_name),
        "hop_path": F.coalesce(field["hop_path"], F.lit("")),
        "thread": field["thread"],
        "host": url_host(field["url"]),
        "http_method": F.coalesce(info["method"], F.lit("GET")),
        "status_code": status,
        "size": field["size"].try_cast("bigint"),
        "wire_bytes": info["wireBytes"].try_cast("bigint"),
        "mimetype": cf.mime_type(field["mimetype"]),
        "content_type": field["mimetype"],
        "content_length": info["contentSize"].try_cast("bigint"),
        "content_digest": field["content_digest"],
        "start_time_plus_duration": field["start_time_plus_duration"],
        "start_time": cf.start_time(field["start_time_plus_duration"]),
        "duration": cf.duration_ms(field["start_time_plus_duration"]),
        "warc_filename": info["warcFilename"],
        "warc_offset": info["warcFileOffset"].try_cast("bigint"),
        "warc_length": info["warcFileRecordLength"].try_cast("bigint"),
        "warc_content_type": info["warcContentType"],
        "warc_type": info["warcType"],
        "warc_id": info["warcId"],
        "annotations": cf.annotation_list(field["annotations"]),
        "extra_info": info,
    }
    return cut.withColumn("_good", F.coalesce(good, F.lit(False))).select(
        *[
            F.when(F.col("_good"), values[f.name]).cast(f.dataType).alias(f.name)
            for f in EVENT_SCHEMA.fields
        ],
        F.when(~F.col("_good"), F.col("value")).alias("_corrupt"),
    )


def event_id(ts: str = "timestamp", url: str = "url"):
    """Identity of an event: ``<timestamp>:<url>``."""
    return F.concat_ws(":", F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col(url))
