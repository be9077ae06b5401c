"""Stored files: comparison between stores, holdings, batches, missing logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage_paths import CHECKPOINT_START, checkpoint_number, path_parts
from tidemark.operators.ordered import nearest_value, rank_by_range
from tidemark.session import use_checkpoints


def parse_paths(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Add job, launch, folder, kind, stream, legal basis and file name from the storage path."""
    return df.withColumn("_parts", path_parts(path)).select(*df.columns, "_parts.*")


def compare_stores(source: DataFrame, target: DataFrame, path: str, checksum: str, one_way: bool = True) -> DataFrame:
    """(path, result): ``match``, ``differ``, ``unknown``, ``missing`` (in target), ``extra`` (only in target).

    A match clears a file for removal, so it needs one checksum on each side, present and equal. A path with a
    missing checksum on either side is ``unknown``; copies of a path that disagree are ``differ``. ``one_way`` leaves out extras.
    """

    def sums(side: DataFrame, name: str) -> DataFrame:
        least, greatest = F.min(checksum), F.max(checksum)
        return side.groupBy(path).agg(
            F.when(least == greatest, least).alias(f"_{name}"), F.bool_or(F.col(checksum).isNull()).alias(f"_{name}_open")
        )

    left, right = sums(source, "source"), sums(target, "target")
    both = left.join(right, path, "left" if one_way else "full_outer")
    result = (
        F.when(F.col("_target_open").isNull(), "missing")
        .when(F.col("_source_open").isNull(), "extra")
        .when(F.col("_source_open") | F.col("_target_open"), "unknown")
        .when(F.col("_source") == F.col("_target"), "match")
        .otherwise("differ")
    )
    return both.select(path, result.alias("result"))


IDENTITY = ("file_path", "size", "modified_at")


def with_known_sums(listing: DataFrame, known: DataFrame, checksum: str = "checksum") -> DataFrame:
    """``listing`` with the checksum that an earlier run made of the same path, size and time; null where there is none."""
    sums = known.where(F.col(checksum).isNotNull()).groupBy(*IDENTITY).agg(F.max(checksum).alias(checksum))
    return listing.drop(checksum).join(sums, list(IDENTITY), "left")


def refreshed_sums(listing: DataFrame, known: DataFrame, hashed: Callable[[DataFrame], DataFrame], checksum: str = "checksum") -> DataFrame:
    """(path, size, time, checksum, fresh) for every listed file; only files that are new or changed go through ``hashed``.

    ``hashed`` gets (path, size, time) rows and returns them with a checksum, null where a file could not be read: such a file is tried
    again in the next run. The result, stored, is the next run's ``known``. Files no longer listed drop out of it.
    """
    use_checkpoints(listing.sparkSession)
    met = with_known_sums(listing.select(*IDENTITY).distinct(), known, checksum).checkpoint()
    old = met.where(F.col(checksum).isNotNull()).withColumn("fresh", F.lit(False))
    new = hashed(met.where(F.col(checksum).isNull()).select(*IDENTITY)).withColumn("fresh", F.lit(True))
    return old.unionByName(new.select(*IDENTITY, checksum, "fresh"))


def reconcile(stores: dict[str, DataFrame], name: str) -> DataFrame:
    """(name, one copy count per store, copies, stores holding it) over the union of all listings."""
    listed = None
    for store, df in stores.items():
        rows = df.select(name, F.lit(store).alias("_store"))
        listed = rows if listed is None else listed.unionByName(rows)
    counts = [F.count(F.when(F.col("_store") == s, 1)).alias(f"{s}_copies") for s in stores]
    held = sum((F.col(f"{s}_copies") > 0).cast("int") for s in stores)
    return (
        listed.groupBy(name)
        .agg(*counts, F.count(F.lit(1)).alias("copies"))
        .withColumn("stores", held)
    )


def store_name(path: Column) -> Column:
    """The name that listings of different stores share: no scheme, authority or bucket, no leading slash, single slashes."""
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(F.regexp_replace(bare, "/+", "/"), "^/", "")


def holders(stores: dict[str, DataFrame], path: str, size: str) -> DataFrame:
    """(name, size, size_differs, held_by) over all listings, one row per normalised name.

    ``held_by`` lists the stores in order of their names, joined by ``+``; ``size`` is the largest one listed, null if none lists any,
    and ``size_differs`` tells that listings disagree. Names that are null or empty have no row; a name listed twice is one.
    """
    listed = [
        df.select(store_name(F.col(path)).alias("name"), F.col(size).cast("long").alias("size"), F.lit(s).alias("store"))
        for s, df in stores.items()
    ]
    least, most = F.min("size"), F.max("size")
    return (
        reduce(DataFrame.unionByName, listed)
        .where("name <> ''")
        .groupBy("name")
        .agg(
            most.alias("size"),
            F.coalesce(least < most, F.lit(False)).alias("size_differs"),
            F.array_join(F.sort_array(F.collect_set("store")), "+").alias("held_by"),
        )
    )


def unprocessed(files: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """Files without a processed mark."""
    return files.join(marks.select(path).distinct(), path, "left_anti")


def newest_batches(df: DataFrame, groups: Sequence[str], modified: str, tie_break: str, batch_size: int) -> DataFrame:
    """Add ``batch``: newest-first batch number within a group. Rows are ranked over sorted ranges, so a day or a group of any size is spread."""
    flipped = df.withColumn("_age", F.expr(f"timestamp_ntz'9999-01-01 00:00:00' - {modified}"))
    numbered = rank_by_range(flipped, groups, ["_age", tie_break], "_no")
    return numbered.withColumn("batch", F.floor((F.col("_no") - 1) / batch_size).cast("bigint")).drop("_age", "_no")


def next_batch(df: DataFrame, modified: str, tie_break: str, batch_size: int) -> DataFrame:
    """The newest ``batch_size`` rows."""
    return df.orderBy(F.col(modified).desc(), F.col(tie_break)).limit(batch_size)


def checkpoint_gaps(files: DataFrame, path: str, block: int = 10_000) -> DataFrame:
    """Runs of missing checkpoint logs per job and launch: the first and last missing number.

    Each distinct checkpoint number takes the next one of its launch, found in blocks of numbers.
    """
    logs = (
        files.where(F.col(path).contains(CHECKPOINT_START))
        .select(path_parts(path).alias("_parts"), checkpoint_number(path).alias("cp"))
        .where("cp is not null")
        .select("_parts.job", "_parts.launch_id", "cp")
        .distinct()
        .withColumn("_at", F.timestamp_seconds("cp").cast("timestamp_ntz"))
    )
    following = nearest_value(logs, ["job", "launch_id"], ["_at"], F.col("cp"), after="_next", bucket_seconds=block)
    return following.where(F.col("_next") > F.col("cp") + 1).select(
        "job",
        "launch_id",
        (F.col("cp") + 1).alias("first_missing"),
        (F.col("_next") - 1).alias("last_missing"),
        (F.col("_next") - F.col("cp") - 1).alias("missing"),
    )


def log_growth(files: DataFrame, expected: DataFrame, path: str, size: str, modified: str) -> DataFrame:
    """Size and last touch per expected job; jobs without any log have nulls and ``present`` false."""
    # a cheap test that every log passes spares the other files the parsing
    parsed = files.where(F.col(path).contains("/logs/")).select(path_parts(path).alias("_parts"), size, modified)
    logs = parsed.where(F.col("_parts.folder") == "logs").groupBy(F.col("_parts.job").alias("job")).agg(
        F.max(size).alias("log_size_bytes"), F.max(modified).alias("log_touched"), F.count(F.lit(1)).alias("logs")
    )
    return expected.join(logs, "job", "left").withColumn("present", F.col("logs").isNotNull())


def locate_files(names: DataFrame, locations: DataFrame, name: str, path: str, access_url: str, default_prefix: str) -> DataFrame:
    """Where to fetch each named file: the store's own URL, else the default prefix and path (one per file, the least)."""
    known = locations.groupBy(name).agg(
        F.min(F.coalesce(F.col(access_url), F.concat(F.lit(default_prefix), F.col(path)))).alias("location")
    )
    return names.join(known, name, "left")
