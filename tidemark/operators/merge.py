"""Merging partial updates into one record per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_non_null(df: DataFrame, keys: Sequence[str], version: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: for each column its newest non-null value. Order of arrival does not matter.

    An aggregate rather than a window, so that rows combine before the shuffle and a key with very
    many updates does not meet in one task. Values of one version must be equal or ``version`` must
    be total.
    """
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*version, c))).alias(c) for c in columns]
    )


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``existing`` with ``updates`` merged in; applying the same updates again changes nothing."""
    names = [*dict.fromkeys([*keys, *version, *columns])]
    both = existing.select(*names).unionByName(updates.select(*names))
    extra = [c for c in version if c not in keys and c not in columns]
    merged = latest_non_null(both, keys, version, [*extra, *columns])
    return merged.select(*names)


def upsert_days(existing: DataFrame, updates: DataFrame, day: str, keys: Sequence[str], version: Sequence[str],
                columns: Sequence[str]) -> DataFrame:
    """New content of only those days that ``updates`` touches, for a dynamic partition overwrite."""
    touched = updates.select(day).distinct()
    return upsert(existing.join(touched, day, "left_semi"), updates, [day, *keys], version, columns)
