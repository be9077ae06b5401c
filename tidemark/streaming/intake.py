"""Streams of crawl events: daily tables, duplicate-safe intake, windowed counts, retention.

Every sink takes a checkpoint folder, which replaces the consumer position. Functions that start a
query return it; with ``available_now`` the query ends when the input is used up.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter


def file_stream(spark: SparkSession, glob: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(glob)


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool, every: str = "1 minute") -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; stored times are zone-free and read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tail_to_days(events: DataFrame, ts: str, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append events to a table partitioned by day."""
    writer = events.withColumn("day", F.to_date(ts)).writeStream.format("parquet").option("path", folder)
    return start(writer.partitionBy("day").outputMode("append"), checkpoint, available_now)


def append_to(df: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", folder).outputMode("append")
    return start(writer, checkpoint, available_now)


def windowed_counts(
    events: DataFrame, ts: str, terms: list[str], length: str, delay: str, slide: str | None = None
) -> DataFrame:
    """Counts per window and terms; in append mode a window appears once it is behind the watermark."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        event_time(events, ts)
        .withWatermark(ts, delay)
        .groupBy(window.alias("w"), *terms)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            *terms,
            "n",
        )
    )


def drop_repeats(events: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Each identity once, as long as its repeats arrive within ``delay``; state older than that is dropped."""
    return event_time(events, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """Each URL key once over the stream's whole life: exact, so its state is one key per URL seen."""
    return events.dropDuplicates([key])


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, mode: str = "append"
) -> StreamingQuery:
    """Run ``work(batch, batch_id)`` per micro-batch. A batch may be repeated after a failure, so outputs are
    written by batch id (:func:`write_batch`) or replaced as a whole."""
    return start(stream.writeStream.foreachBatch(work).outputMode(mode), checkpoint, available_now)


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """This batch's part of an output; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def keep_recent(df: DataFrame, day: str, today: date | Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days, today included."""
    end = today if isinstance(today, Column) else F.lit(today)
    return df.where(F.col(day) > F.date_sub(end, days))


def drop_old_days(spark: SparkSession, table: str, today: date, days: int) -> list[str]:
    """Drop day partitions of a catalog table that are older than ``days``; returns the dropped days."""
    listed = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").toLocalIterator()]
    old = sorted(d for d in listed if (today - date.fromisoformat(d)).days >= days)
    for d in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = '{d}')")
    return old
