"""Streams with several outputs: scope split, document spotter, rolling summary, activity alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.times import bucket_start, epoch_seconds, from_epoch_seconds
from tidemark.operators.counters import held_alerts
from tidemark.operators.documents import NEW
from tidemark.operators.ordered import trailing_sum
from tidemark.streaming.intake import each_batch, write_batch
from tidemark.streaming.versions import Panes, remove_folder

PANE_SECONDS = 3600
# What a pane keeps: totals per minute and value; the pane and the batch that wrote them are folders.
PARTIAL = T.StructType(
    [
        T.StructField("minute", T.TimestampNTZType()), T.StructField("dimension", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("pane", T.LongType()), T.StructField("batch", T.LongType()),
    ]
)


def split_by_scope(
    stream: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    accepted: str,
    discarded: str,
    checkpoint: str,
    crawl_name: str,
    available_now: bool = False,
) -> StreamingQuery:
    """In-scope URLs (with the crawl's name) to one folder, discarded ones to another; every URL is in exactly one.

    ``decide`` adds ``decision`` and ``rule`` to a batch.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        judged = decide(batch).persist()
        write_batch(
            judged.where("decision = 'ACCEPT'").withColumn("crawl_name", F.lit(crawl_name)), accepted, batch_id
        )
        write_batch(judged.where("decision <> 'ACCEPT'"), discarded, batch_id)
        judged.unpersist()

    return each_batch(stream, work, checkpoint, available_now)


def spot_documents(
    stream: DataFrame,
    find: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Found documents per batch. One URL may be found again in a later batch; read with :func:`read_documents`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        write_batch(find(batch), folder, batch_id)

    return each_batch(stream, work, checkpoint, available_now)


def read_documents(folder: str, spark) -> DataFrame:
    """One row per document: its earliest finding, in state NEW."""
    found = spark.read.parquet(folder).drop("batch")
    others = [c for c in found.columns if c != "document_url"]
    return (
        found.where(F.col("status") == NEW)
        .groupBy("document_url")
        .agg(F.min_by(F.struct(*others), F.struct("wayback_timestamp", "size")).alias("_d"))
        .select("document_url", "_d.*")
    )


def rolling_summary(
    stream: DataFrame,
    ts: str,
    dimensions: list[str],
    size: str,
    window_seconds: int,
    partials: str,
    summary: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep a small table of totals per dimension value over the last window.

    Raw events are read once: a batch adds its rows per minute and value to the panes (hours) they fall in and writes nothing
    else of them; panes behind the window are removed. The summary of the window is written per batch as one version, and versions
    before the last one are removed. The window ends at the newest event seen.
    """
    panes = Panes(partials, PARTIAL)

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(ts).isNotNull()).select(
            bucket_start(ts, 60).alias("minute"), size, *[F.col(d).cast("string").alias(d) for d in dimensions]
        )
        total = F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value"))
        kinds = F.array(total, *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])
        long = rows.select("minute", F.col(size).cast("bigint").alias("_size"), F.explode(kinds).alias("_d")).select("minute", "_size", "_d.*")
        part = long.groupBy("minute", "dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))
        panes.add(part.withColumn("pane", F.floor(epoch_seconds("minute") / PANE_SECONDS)), "pane", batch_id)
        known = panes.read(spark).where(F.col("batch") <= batch_id)
        newest = known.select(F.max(epoch_seconds("minute"))).first()[0]
        if newest is None:
            return
        first_pane = (newest - window_seconds) // PANE_SECONDS
        inside = known.where((F.col("pane") >= first_pane) & (epoch_seconds("minute") > newest - window_seconds))
        totals = inside.groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        totals.write.mode("overwrite").parquet(f"{summary}/version={batch_id}")
        panes.remove_before(spark, "pane", first_pane)
        for old in range(max(0, batch_id - 8), batch_id - 1):
            remove_folder(spark, f"{summary}/version={old}")

    return each_batch(stream, work, checkpoint, available_now)


def read_summary(folder: str, spark) -> DataFrame:
    """The newest version of a rolling summary."""
    versions = spark.read.parquet(folder)
    return versions.where(F.col("version") == versions.select(F.max("version")).scalar()).drop("version")


def activity_alerts(
    hourly: DataFrame, ts: str, n: str, first, last, window_seconds: int = 14_400, below: int = 10, hold_seconds: int = 3600
) -> DataFrame:
    """Spans in which the trailing count stayed under ``below``. ``hourly`` holds closed hours; hours without any row count as 0."""
    spine = hourly.sparkSession.range(1).select(
        F.explode(F.sequence(epoch_seconds(first), epoch_seconds(last), F.lit(3600).cast("bigint"))).alias("_s")
    ).select(from_epoch_seconds(F.col("_s")).alias(ts))
    # one row per hour of the watched span
    filled = spine.join(hourly, ts, "left").select(ts, F.coalesce(n, F.lit(0)).alias(n), F.lit("all").alias("_series"))
    grown = trailing_sum(filled, ["_series"], ts, n, window_seconds, "increase")
    return held_alerts(grown, ["_series"], ts, F.col("increase") < below, hold_seconds).drop("_series")
