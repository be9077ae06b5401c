"""Capture index operators: closest capture, recrawl gate, revisits, history, deletions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import EARLIEST_TS14, LATEST_TS14, epoch_micros, epoch_seconds, from_ts14
from tidemark.operators.ordered import nearest_value, rank_by_range
from tidemark.operators.prefixes import prefix_hits
from tidemark.session import use_checkpoints

YEAR_SECONDS = 31_536_000


def target_time(ts14: Column | str) -> Column:
    """Requested time; the two sentinels become times before and after every capture."""
    value = F.col(ts14) if isinstance(ts14, str) else ts14
    return (
        F.when(value == EARLIEST_TS14, F.lit("1000-01-01 00:00:00").cast("timestamp_ntz"))
        .when(value == LATEST_TS14, F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
        .otherwise(from_ts14(value))
    )


def closest_capture(
    requests: DataFrame,
    captures: DataFrame,
    key: str,
    target: str,
    ts: str,
    capture_id: str,
    columns: Sequence[str],
    skip_revisits: str | None = None,
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Each request with its nearest capture of the same key on either side; at equal distance the earlier one.

    ``requests`` has ``key``, ``target`` and any columns of its own; ``captures`` has ``key``, ``ts``,
    ``capture_id`` and ``columns``. Both are laid on one time line per key and each request takes the
    last capture at or before it and the first one after it, so no request meets all captures of its
    key. ``skip_revisits`` names a boolean column of captures to leave out. Requests without any
    capture keep nulls.
    """
    if skip_revisits:
        captures = captures.where(~F.col(skip_revisits))
    payload = F.struct(F.col(ts).alias("ts"), F.col(capture_id).alias("id"), *[F.col(c) for c in columns])
    own = [c for c in requests.columns if c not in (key, target)]
    line = captures.select(
        key, F.col(ts).alias("_at"), F.lit(0).alias("_kind"), F.col(capture_id).cast("string").alias("_tie"),
        payload.alias("_capture"), *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in own],
    ).unionByName(
        requests.select(
            key, F.col(target).alias("_at"), F.lit(1).alias("_kind"),
            F.xxhash64(*(own or [target])).cast("string").alias("_tie"),
            F.lit(None).cast(captures.select(payload.alias("p")).schema["p"].dataType).alias("_capture"), *own,
        )
    )
    order = ["_at", "_kind", "_tie"]
    both = nearest_value(line, [key], order, F.col("_capture"), "_before", "_after", bucket_seconds)
    asked = both.where(F.col("_kind") == 1)
    gap_before = epoch_micros("_at") - epoch_micros(F.col("_before.ts"))
    gap_after = epoch_micros(F.col("_after.ts")) - epoch_micros("_at")
    take_before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (gap_before <= gap_after))
    best = F.when(take_before, F.col("_before")).otherwise(F.col("_after"))
    return asked.select(
        key, F.col("_at").alias(target), *own, best["ts"].alias("capture_ts"), best["id"].alias("capture_id"),
        *[best[c].alias(c) for c in columns],
    )


def capture_for_time(captures: DataFrame, key: str, ts: str, capture_id: str, ts14: str, columns: Sequence[str]) -> DataFrame:
    """One requested time for every key: its closest capture, as a map-side combinable aggregate."""
    target = target_time(F.lit(ts14))
    distance = F.abs(epoch_micros(ts) - epoch_micros(target))
    best = F.min_by(
        F.struct(F.col(ts).alias("capture_ts"), F.col(capture_id).alias("capture_id"), *columns),
        F.struct(distance, F.col(ts), F.col(capture_id)),
    )
    return captures.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def recently_seen(
    candidates: DataFrame,
    captures: DataFrame,
    key: str,
    now: str,
    captured_at: str,
    interval_seconds: int = YEAR_SECONDS,
    launch: str | None = None,
    out: str = "seen_recently",
) -> DataFrame:
    """Flag candidates whose key was captured less than ``interval_seconds`` before ``now``.

    With ``launch`` (a column of candidates, may be null) a capture from before the launch does not
    count: a new launch asks for a fresh copy. Only the latest capture of a key matters, so the
    capture side is reduced to one row per key first.
    """
    last = captures.groupBy(key).agg(F.max(captured_at).alias("_last"))
    fresh = (epoch_seconds(now) - epoch_seconds("_last")) < interval_seconds
    if launch:
        fresh = fresh & (F.col(launch).isNull() | (F.col("_last") >= F.col(launch)))
    return (
        candidates.join(last, key, "left")
        .withColumn(out, F.coalesce(fresh, F.lit(False)))
        .withColumnRenamed("_last", "last_capture")
    )


def mark_revisits(
    captures: DataFrame, keys: Sequence[str], ts: str, capture_id: str, indexed: DataFrame | None = None
) -> DataFrame:
    """The first capture of each (URL, digest) stays a response; later ones become revisits of it.

    ``indexed`` (keys, ts, capture_id) holds captures of earlier batches, which may be the first. Batches may run newest first, so
    an indexed capture that proves later than one of this batch keeps the type it has. A capture with a missing key part
    cannot be compared and stays a response.
    """
    keys = list(keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    known = captures.select(*keys, ts, capture_id)
    if indexed is not None:
        known = known.unionByName(indexed.select(*keys, ts, capture_id))
    first = known.where(whole).groupBy(*keys).agg(F.min_by(capture_id, F.struct(ts, capture_id)).alias("_first"))
    revisit = F.col("_first").isNotNull() & (F.col(capture_id) != F.col("_first"))
    return (
        captures.join(first, keys, "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_first")
    )


def fetch_history(captures: DataFrame, key: str, ts: str, capture_id: str, length: int = 2) -> DataFrame:
    """The last ``length`` captures per URL, newest first (each task keeps at most that many per URL)."""
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(capture_id).desc())
    return captures.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= length)


def content_changes(
    captures: DataFrame, key: str, ts: str, capture_id: str, digest: str, bucket_seconds: int = 86_400
) -> DataFrame:
    """Each capture with the digest of the one before it and whether the content changed (null for the first)."""
    out = nearest_value(captures, [key], [ts, capture_id], F.struct(F.col(digest).alias("d")), "_before", bucket_seconds=bucket_seconds)
    return (
        out.withColumn("previous_digest", F.col("_before")["d"])
        .withColumn(
            "changed", F.when(F.col("_before").isNotNull(), ~F.col(digest).eqNullSafe(F.col("previous_digest")))
        )
        .drop("_before")
    )


def drop_listed(captures: DataFrame, deletions: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Captures without the listed records; a record is named by all identity columns."""
    return captures.join(deletions.select(*identity).distinct(), list(identity), "left_anti")


def resolved_aliases(aliases: DataFrame, old: str, new: str) -> DataFrame:
    """(old, final, steps): where each aliased key lives after all its aliases, and how many there were.

    A key with several aliases takes the least. Rounds of pointer doubling: each joins a key's target with that target's own target, so a
    chain of n aliases takes log2(n) rounds. A loop has no end: its keys, and those that lead into it, go to the least key of the loop, and
    their ``steps`` is null. Aliases of a key to itself and nulls are left out.
    """
    use_checkpoints(aliases.sparkSession)
    # nulls go after the checkpoint: a null test of a computed key would repeat its whole expression
    one = aliases.groupBy(F.col(old).alias("key")).agg(F.min(F.when(F.col(new) != F.col(old), F.col(new))).alias("to")).checkpoint()
    one = one.where("key is not null and to is not null")
    # "least" is the least key among the targets passed, so that it covers a loop once all its keys have been passed
    state = one.select("key", "to", F.lit(1).cast("long").alias("steps"), F.col("to").alias("least"), F.lit(False).alias("ended"))
    edges, reach = state.count(), 1
    while reach < 2 * edges:
        onward = state.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("least").alias("further"))
        met = state.join(onward, "to", "left")
        state = met.select(
            "key",
            F.coalesce("next", "to").alias("to"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.least("least", F.coalesce("further", "least")).alias("least"),
            F.col("next").isNull().alias("ended"),
        ).checkpoint()
        reach *= 2
        if state.where(~F.col("ended")).isEmpty():
            break
    # a target that has a target still lies in a loop; from there all keys passed are the loop's
    looped = state.select(F.col("key").alias("to"), F.col("least").alias("of_loop"))
    return state.join(looped, "to", "left").select(
        F.col("key").alias(old),
        F.coalesce("of_loop", "to").alias("final"),
        F.when(F.col("of_loop").isNull(), F.col("steps")).alias("steps"),
    )


def apply_aliases(df: DataFrame, key: str, aliases: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """Add the key a URL lives under now, through chains of aliases (:func:`resolved_aliases`); keys without an alias stay."""
    final = resolved_aliases(aliases, old, new).select(F.col(old).alias(key), F.col("final").alias("_new"))
    return df.join(final, key, "left").withColumn(out, F.coalesce("_new", key)).drop("_new")


def scan_from(
    captures: DataFrame,
    key: str,
    ts14: str,
    prefixes: DataFrame,
    prefix: str,
    from_ts14: str,
    limit: int,
    capture_id: str,
) -> DataFrame:
    """Captures under any listed prefix from a time on, at most ``limit`` per prefix (the scan's own cap), in key order.

    14-digit times compare as text. The cap may be millions and one prefix may cover most captures, so rows are
    ranked by sorted ranges rather than in one window per prefix.
    """
    recent = captures.where(F.col(ts14) >= from_ts14)
    hits = recent.join(prefix_hits(recent, key, prefixes.select(prefix), prefix), key)
    return rank_by_range(hits, [prefix], [key, ts14, capture_id], "scan_no").where(F.col("scan_no") <= limit)


def deletion_profile(captures: DataFrame, by: Sequence[str], ts: str, key: str) -> DataFrame:
    """How often one payload (digest, type, status) occurs, on how many URLs and over which time."""
    per_key = captures.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    return per_key.groupBy(*by).agg(
        F.sum("_n").alias("captures"),
        F.count(F.lit(1)).alias("urls"),
        F.min("_first").alias("first_ts"),
        F.max("_last").alias("last_ts"),
    )


def first_seen_urls(df: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """One row per URL, its earliest: the exact form of the crawler's already-seen filter."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(ts, row_id)).alias("_first")).select(key, "_first.*")
