"""Monitoring counters: increase, rate, alerts that must hold for a time, metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_seconds
from tidemark.operators.ordered import nearest_value, trailing_sum


def counter_steps(df: DataFrame, labels: Sequence[str], ts: str, value: str, out: str = "step") -> DataFrame:
    """Growth since the previous sample; after a reset (a smaller value) the whole value counts."""
    before = nearest_value(df, labels, [ts], F.struct(F.col(value).alias("v")), "_before", bucket_seconds=86_400)
    previous = F.col("_before")["v"]
    step = (
        F.when(F.col("_before").isNull(), F.lit(0))
        .when(F.col(value) < previous, F.col(value))
        .otherwise(F.col(value) - previous)
    )
    return before.withColumn(out, step.cast(df.schema[value].dataType)).drop("_before")


def counter_increase(
    df: DataFrame, labels: Sequence[str], ts: str, value: str, seconds: int, out: str = "increase"
) -> DataFrame:
    """Reset-aware growth over the trailing ``seconds``; no extrapolation to the window's edges (our choice)."""
    return trailing_sum(counter_steps(df, labels, ts, value, "_step"), labels, ts, "_step", seconds, out).drop("_step")


def counter_rate(
    df: DataFrame, labels: Sequence[str], ts: str, value: str, seconds: int, out: str = "rate"
) -> DataFrame:
    """Growth per second over the trailing ``seconds``."""
    return counter_increase(df, labels, ts, value, seconds, "_inc").withColumn(out, F.col("_inc") / seconds).drop("_inc")


def held_alerts(
    df: DataFrame, labels: Sequence[str], ts: str, condition: Column, hold_seconds: int
) -> DataFrame:
    """Unbroken runs of samples for which ``condition`` held at least ``hold_seconds``: since, until, samples."""
    marked = df.withColumn("_bad", F.coalesce(condition, F.lit(False)))
    runs = nearest_value(
        marked, labels, [ts], F.when(~F.col("_bad"), F.col(ts)), "_last_ok", bucket_seconds=86_400
    ).where("_bad")
    return (
        runs.groupBy(*labels, "_last_ok")
        .agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count(F.lit(1)).alias("samples"))
        .where(epoch_seconds("until") - epoch_seconds("since") >= hold_seconds)
        .drop("_last_ok")
    )


def record_count_metrics(outputs: dict[str, DataFrame], metric: str = "record_count") -> DataFrame:
    """(metric, kind, value) for each named output; one combined job, one row per output."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), "value"
        )
        for kind, df in outputs.items()
    ]
    total = rows[0]
    for row in rows[1:]:
        total = total.unionByName(row)
    return total


def job_metrics(df: DataFrame, job: str, status: str, ts: str, records: str) -> DataFrame:
    """Per job and status in long form: batch count, records sent, time of the last run."""
    totals = df.groupBy(job, status).agg(
        F.count(F.lit(1)).alias("task_batch_size"),
        F.sum(records).cast("bigint").alias("task_total_sent_record_count"),
        epoch_seconds(F.max(ts)).alias("task_event_timestamp"),
    )
    return totals.unpivot(
        [job, status],
        ["task_batch_size", "task_total_sent_record_count", "task_event_timestamp"],
        "metric",
        "value",
    )
