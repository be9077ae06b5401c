"""Ordered computations per key that do not need a whole key in one task.

A plain window puts every row of a key into one task. One server or URL may hold a large share
of all events, so the work is split by (key, time bucket): the window runs inside a bucket, one
small summary row per bucket is carried along the key, and both are put together by an equi join.
A task then holds at most one bucket of a key; choose ``bucket_seconds`` so that a busy key's bucket is
small, and not so short that most buckets of a quiet key hold a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_seconds
from tidemark.session import use_checkpoints

HOUR = 3600
# bucket of rows without a time: before all others
NO_TIME = -(2**62)


def by_bucket(df: DataFrame, keys: Sequence[str], time: str, bucket_seconds: int) -> DataFrame:
    """Add ``_key`` (all keys in one struct) and ``_bucket``; neither is ever null.

    Grouping, windows and the join back all use these two columns, so rows are shuffled once. A struct with null
    fields equals itself, which a null key column would not.
    """
    bucket = F.floor(epoch_seconds(time) / bucket_seconds)
    return df.withColumn("_key", F.struct(*keys)).withColumn("_bucket", F.coalesce(bucket, F.lit(NO_TIME)))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    include_row: bool = False,
    bucket_seconds: int = HOUR,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's earlier rows (and the row itself if asked).

    ``order`` starts with the time column and must be a total order within a key.
    """
    rows = by_bucket(df, keys, order[0], bucket_seconds).withColumn("_value", F.coalesce(value, F.lit(0)))
    along_key = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("_key", "_bucket")
        .agg(F.sum("_value").alias("_bucket_sum"))
        .select("_key", "_bucket", F.coalesce(F.sum("_bucket_sum").over(along_key), F.lit(0)).alias("_carried"))
    )
    in_bucket = Window.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if include_row else -1
    )
    return (
        rows.join(carried, ["_key", "_bucket"], "left")
        .withColumn(out, F.col("_carried") + F.coalesce(F.sum("_value").over(in_bucket), F.lit(0)))
        .select(*df.columns, out)
    )


def nearest_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    before: str | None = None,
    after: str | None = None,
    bucket_seconds: int = HOUR,
) -> DataFrame:
    """Add ``before`` and/or ``after``: the closest non-null ``value`` on an earlier and on a later row of the key.

    Wrap a value that may itself be null in a struct. ``order`` starts with the time column and must
    be a total order within a key. Both directions share one shuffle of the rows.
    """
    order = list(order)
    rows = by_bucket(df, keys, order[0], bucket_seconds).withColumn("_value", value)
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    along_key, in_bucket, last_of_bucket = {}, {}, {}
    for name, later in ((before, False), (after, True)):
        if name is None:
            continue
        sides = [F.col(c).desc() if later else F.col(c) for c in ("_bucket", *order)]
        along_key[name] = Window.partitionBy("_key").orderBy(sides[0]).rowsBetween(Window.unboundedPreceding, -1)
        in_bucket[name] = Window.partitionBy("_key", "_bucket").orderBy(*sides[1:]).rowsBetween(Window.unboundedPreceding, -1)
        last_of_bucket[name] = (F.min_by if later else F.max_by)("_value", position).alias(f"_edge_{name}")
    carried = (
        rows.groupBy("_key", "_bucket")
        .agg(*last_of_bucket.values())
        .select(
            "_key",
            "_bucket",
            *[F.last(f"_edge_{n}", ignorenulls=True).over(w).alias(f"_carried_{n}") for n, w in along_key.items()],
        )
    )
    out = rows.join(carried, ["_key", "_bucket"], "left")
    for name, window in in_bucket.items():
        out = out.withColumn(
            name, F.coalesce(F.last("_value", ignorenulls=True).over(window), F.col(f"_carried_{name}"))
        )
    return out.select(*df.columns, *in_bucket)


def trailing_sum(
    df: DataFrame, keys: Sequence[str], time: str, value: str, seconds: int, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows of the key in ``(t - seconds, t]``.

    Each row is sent to its own bucket of that width and to the next one, so that a bucket sees all
    rows its windows reach; only rows in their own bucket are kept.
    """
    keys = list(keys)
    at = F.floor(epoch_seconds(time) / seconds)
    spread = df.withColumn("_home", at).withColumn("_bucket", F.explode(F.array(at, at + 1)))
    reach = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(epoch_seconds(time))
        .rangeBetween(-(seconds - 1), Window.currentRow)
    )
    return (
        spread.withColumn(out, F.sum(value).over(reach))
        .where(F.col("_home") == F.col("_bucket"))
        .drop("_home", "_bucket")
    )


def rank_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 1, 2, ... within a key by any total order, also where one key has very many rows.

    Rows are laid out in sorted ranges, written once to the checkpoint folder so that ranges cannot shift, numbered
    inside each range, and lifted by the key's row count in the ranges before.
    """
    use_checkpoints(df.sparkSession)
    keys, order = list(keys), list(order)
    laid_out = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        laid_out.join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_offset") + F.row_number().over(in_range))
        .select(*df.columns, out)
    )
