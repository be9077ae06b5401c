"""Counts over time, top terms, facets and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import bucket_start, epoch_seconds, from_epoch_seconds
from tidemark.operators.ordered import nearest_value
from tidemark.session import use_checkpoints

# Longest gap, in buckets, that is filled with zeros where no bound is asked for; buckets that one row of a filled gap holds.
MAX_GAP, STRETCH = 1_000_000, 10_000


def _filled_buckets(counts: DataFrame, seconds: int, start: datetime | None, end: datetime | None) -> DataFrame:
    """(bucket): every bucket of the range, spread over tasks.

    Where a bound is not asked for, gaps of more than ``MAX_GAP`` buckets between neighbouring times stay empty: one stray
    time far away adds its own bucket, not millions of zeros.
    """
    spark = counts.sparkSession
    lower, upper = (F.lit(bound).cast("timestamp_ntz") for bound in (start, end))
    low, high = counts.select(
        epoch_seconds(bucket_start(lower, seconds) if start else F.min("bucket")),
        epoch_seconds(bucket_start(upper, seconds) if end else F.max("bucket")),
    ).first()
    if low is None or high is None or low > high:
        return spark.range(0).select(from_epoch_seconds(F.col("id")).alias("bucket"))
    if (start and end) or (high - low) // seconds <= MAX_GAP:
        return spark.range(low, high + 1, seconds).select(from_epoch_seconds(F.col("id")).alias("bucket"))
    asked = spark.createDataFrame([(low,), (high,)], "at bigint").select(from_epoch_seconds(F.col("at")).alias("bucket"))
    between = F.col("bucket").between(from_epoch_seconds(F.lit(low)), from_epoch_seconds(F.lit(high)))
    marks = counts.select("bucket").where(between).union(asked).distinct().withColumn("_all", F.lit(0))
    after = nearest_value(marks, ["_all"], ["bucket"], F.col("bucket"), after="_next", bucket_seconds=seconds * STRETCH)
    steps = F.floor((epoch_seconds("_next") - epoch_seconds("bucket")) / seconds).cast("bigint")
    held = after.select(epoch_seconds("bucket").alias("at"), F.when(steps <= MAX_GAP, steps).otherwise(F.lit(1)).alias("n"))
    held = held.select("at", F.coalesce("n", F.lit(1)).alias("n"))
    # a long gap is cut into stretches, so that no row holds it as a list
    cut = held.select("n", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(STRETCH).cast("bigint"))).alias("first"))
    inside = F.sequence(F.col("first"), F.least(F.col("first") + STRETCH, F.col("n")) - 1)
    return cut.select("at", F.explode(inside).alias("i")).select(from_epoch_seconds(F.col("at") + F.col("i") * seconds).alias("bucket"))


def counts_over_time(
    df: DataFrame,
    ts: str,
    seconds: int,
    terms: Sequence[str] = (),
    start: datetime | None = None,
    end: datetime | None = None,
    counted: str | None = None,
    out: str = "n",
) -> DataFrame:
    """Rows per time bucket (and term), with a zero row for every empty bucket of every term.

    Rows outside ``start`` to ``end`` and rows without a time are left out. Without a bound the data's own first or last bucket
    holds, and gaps of more than ``MAX_GAP`` buckets are not filled. ``counted`` counts only rows where that column is not null.
    """
    use_checkpoints(df.sparkSession)
    terms = list(terms)
    # the rows are read once; bounds, terms and zeros come from the counts
    counts = (
        df.groupBy(*terms, bucket_start(ts, seconds).alias("bucket"))
        .agg(F.count(F.col(counted) if counted else F.lit(1)).alias(out))
        .checkpoint()
    )
    spine = _filled_buckets(counts, seconds, start, end)
    if terms:
        spine = counts.select(*terms).distinct().crossJoin(spine)  # the result has a row for each of these
    on = F.lit(True)
    right = counts.where(F.col("bucket").isNotNull()).select(*[F.col(c).alias(f"_c_{c}") for c in [*terms, "bucket"]], out)
    for c in [*terms, "bucket"]:
        on = on & spine[c].eqNullSafe(right[f"_c_{c}"])
    return spine.join(right, on, "left").select(*terms, "bucket", F.coalesce(F.col(out), F.lit(0)).alias(out))


def top_terms(df: DataFrame, term: str, n: int, out: str = "n") -> DataFrame:
    """The ``n`` most frequent terms, ties by term."""
    return df.groupBy(term).agg(F.count(F.lit(1)).alias(out)).orderBy(F.col(out).desc(), F.col(term)).limit(n)


def top_terms_over_time(df: DataFrame, term: str, n: int, ts: str, seconds: int, **bounds: datetime) -> DataFrame:
    """Counts over time for the ``n`` most frequent terms only."""
    top = top_terms(df.where(F.col(term).isNotNull()), term, n).select(term)
    return counts_over_time(df.join(top, term, "left_semi"), ts, seconds, [term], **bounds)


def status_totals(df: DataFrame, status: str, names: DataFrame, code: str, name: str, counted: str) -> DataFrame:
    """Rows per named status; rows with a status that has no name drop out."""
    return (
        df.join(names, F.col(status) == F.col(code))
        .groupBy(name)
        .agg(F.count(counted).alias("n"))
    )


def facet_counts(df: DataFrame, facets: Sequence[str], n: int) -> DataFrame:
    """(facet, value, n): the ``n`` most frequent values of each facet, in one pass over the rows."""
    facets = list(facets)
    plain = df.select(*[F.col(f).cast("string").alias(f) for f in facets])
    sets = [[F.col(f)] for f in facets]
    # grouping id bits are 0 for the column that is grouped on, leftmost column highest
    full = (1 << len(facets)) - 1
    which = F.grouping_id()
    name = F.lit(None).cast("string")
    for i, facet in enumerate(facets):
        name = F.when(F.col("_g") == full - (1 << (len(facets) - 1 - i)), F.lit(facet)).otherwise(name)
    counted = (
        plain.groupingSets(sets, *facets)
        .agg(F.count(F.lit(1)).alias("n"), which.alias("_g"))
        .select(name.alias("facet"), F.coalesce(*facets).alias("value"), "n")
    )
    order = Window.partitionBy("facet").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def activity_summary(
    df: DataFrame, ts: str, window_seconds: int, now: datetime | Column, dimensions: Sequence[str], size: str
) -> DataFrame:
    """(dimension, value, n, bytes) over the last window: one total row and one per value of each dimension."""
    dimensions = list(dimensions)
    end = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    recent = df.where(
        (F.col(ts) > end - F.expr(f"interval {int(window_seconds)} seconds")) & (F.col(ts) <= end)
    ).select(size, *[F.col(d).cast("string").alias(d) for d in dimensions])
    full = (1 << len(dimensions)) - 1
    name = F.lit("total")
    for i, dimension in enumerate(dimensions):
        name = F.when(F.col("_g") == full - (1 << (len(dimensions) - 1 - i)), F.lit(dimension)).otherwise(name)
    return (
        recent.groupingSets([[], *[[F.col(d)] for d in dimensions]], *dimensions)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
            F.grouping_id().alias("_g"),
        )
        .select(name.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n", "bytes")
    )


def holdings(df: DataFrame, levels: Sequence[str], size: str) -> DataFrame:
    """Files and bytes for every level of a roll-up; ``level`` counts the levels that are summed away."""
    levels = list(levels)
    return (
        df.rollup(*levels)
        .agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.grouping_id().alias("_g"))
        .withColumn("level", F.bit_count("_g").cast("int"))
        .drop("_g")
    )
