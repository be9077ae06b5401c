"""Scheduled jobs, put together from the operators.

A job takes its inputs as DataFrames and the run's date or time as a parameter, never the clock, so
any run can be repeated or back-filled. What a job writes is replaced by a repeat, not doubled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import content, storage_paths
from tidemark.functions.crawl_fields import mime_type
from tidemark.functions.times import to_ts14
from tidemark.functions.urls import prefix_line_key, reversed_host, surt_key
from tidemark.operators import captures as capture_ops
from tidemark.operators import counters, curation, documents, filters, histograms, merge, prefixes, suffixes, textindex, tracking
from tidemark.operators.ordered import nearest_value
from tidemark.session import use_checkpoints
from tidemark.sinks import committed, exports, publish
from tidemark.sources.listings import parse_listing


# --- file tracking ---------------------------------------------------------------------------


def track_files(listing_lines: DataFrame, tracked: DataFrame, service: str, seen_at: Column, under: str | None = None) -> DataFrame:
    """The tracker's table with a new listing merged in; ``under`` limits the run to a path subset.

    Files missing from the listing stay as they are, as a listing may be cut short.
    """
    files = parse_listing(listing_lines).where("file_path IS NOT NULL")
    if under:
        files = files.where(F.col("file_path").startswith(under))
    rows = tracking.parse_paths(files).select(
        "file_path", F.lit(service).alias("service"), "kind", "stream", "size", "modified_at", seen_at.alias("seen_at")
    )
    return merge.upsert(tracked, rows, ["file_path", "service"], ["seen_at"], ["kind", "stream", "size", "modified_at"])


# --- capture index ---------------------------------------------------------------------------


@dataclass(frozen=True)
class IndexRun:
    rows: DataFrame
    marks: DataFrame


def capture_index(
    files: DataFrame,
    marks: DataFrame,
    records: DataFrame,
    stream: str,
    now: datetime,
    batch_size: int,
    years: int = 10,
    indexed: DataFrame | None = None,
) -> IndexRun:
    """Index rows for the newest batch of files of a stream that are not indexed yet, and the marks for them.

    ``records`` carries ``file_path`` beside the capture's own columns. A file of any size is read by
    many tasks; the batch is a list of at most ``batch_size`` file names. ``indexed`` holds the rows of earlier batches
    (urlkey, content_digest, ts, event_id), whose captures this batch's may repeat.
    """
    waiting = tracking.unprocessed(
        filters.years_back(files.where(F.col("stream") == stream), "modified_at", now, years), marks, "file_path"
    )
    batch = tracking.next_batch(waiting, "modified_at", "file_path", batch_size).select("file_path")
    # at most batch_size names
    chosen = records.join(batch, "file_path", "left_semi")
    keyed = filters.http_responses(chosen).withColumns({"urlkey": surt_key("url"), "ts14": to_ts14("ts")})
    rows = capture_ops.mark_revisits(keyed, ["urlkey", "content_digest"], "ts", "event_id", indexed)
    return IndexRun(
        rows.select(
            "urlkey", "ts14", "url", mime_type("mimetype").alias("mime"), "status_code", "content_digest",
            "record_type", "refers_to", "size", "event_id", "file_path", "ts",
        ),
        batch.withColumn("marked_for", F.lit(stream)),
    )


# --- full-text index -------------------------------------------------------------------------


def fulltext_index(
    records: DataFrame, scopes: DataFrame, allowed: DataFrame, collection: str, suffix_rules: DataFrame | None = None, rule: str = "rule"
) -> DataFrame:
    """One index row per response page: text, digest, elements, links, labels of its collections, access terms.

    Pages are filtered before their text is touched, and text is extracted before any join, so only short
    columns and the extracted text are moved. With ``suffix_rules`` a row also has ``link_domains``, the registered domains of the
    linked hosts, and ``text_print``, the banded fingerprint of its text (null for a page without words).
    """
    used = filters.index_records(records)
    rows = used.select(
        "page_id",
        "url",
        "urlkey",
        "host",
        content.html_text("html").alias("text"),
        content.payload_sha1("html").alias("digest"),
        F.array_join(content.elements_used("html"), ",").alias("elements"),
        F.array_join(content.outlink_hosts("html", "url"), ",").alias("link_hosts"),
        F.array_join(content.postcodes(content.html_text("html")), ",").alias("postcodes"),
    )
    labelled = prefixes.annotate(rows, "urlkey", scopes, "surt_prefix", ["collection", "subject"])
    flagged = prefixes.flag_covered(labelled, "urlkey", allowed, "surt_prefix", "open_access")
    out = flagged.withColumn("access_terms", F.when(F.col("open_access"), "open").otherwise("reading room")).withColumn(
        "index_collection", F.lit(collection)
    ).drop("open_access")
    return out if suffix_rules is None else _with_links_and_print(out, suffix_rules, rule)


def _with_links_and_print(rows: DataFrame, suffix_rules: DataFrame, rule: str) -> DataFrame:
    hosts = rows.select("page_id", F.explode(F.split("link_hosts", ",")).alias("_host")).where("_host <> ''")
    domains = suffixes.with_domains(hosts, "_host", suffix_rules, rule).groupBy("page_id").agg(
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("link_domains")
    )
    bands = textindex.fingerprints(rows, "page_id", "text").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda b: b["value"]), " ").alias("text_print")
    )
    linked = rows.join(domains, "page_id", "left").withColumn("link_domains", F.coalesce("link_domains", F.lit("")))
    return linked.join(bands, "page_id", "left")


# --- documents -------------------------------------------------------------------------------


def analyse_logs(events: DataFrame, feed: DataFrame, day: date, job: str, earlier: DataFrame | None = None) -> DataFrame:
    """Documents found in one day of crawl logs that ``earlier`` findings (``document_url``) do not hold yet."""
    start = F.lit(datetime(day.year, day.month, day.day)).cast("timestamp_ntz")
    today = events.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")))
    found = documents.find_documents(today, feed, "surt_prefix", "target_id", job)
    return found if earlier is None else found.join(earlier.select("document_url").distinct(), "document_url", "left_anti")


DOCUMENT_ROW = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("document_url", "filename", "landing_page_url", "source", "wayback_timestamp", "job_name")],
        T.StructField("size", T.LongType()), T.StructField("status", T.StringType()), T.StructField("target_id", T.LongType()),
    ]
)
LOG_MARK = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("marked_for", T.StringType())])
METRIC_ROW = T.StructType([T.StructField("metric", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.LongType())])


def analyse_waiting_logs(files: DataFrame, events: DataFrame, feed: DataFrame, job: str, root: str, batch_size: int) -> str:
    """Find documents in the newest log files without a mark; findings, marks and metrics become visible together or not at all.

    ``files`` has (file_path, modified_at), ``events`` a ``file_path`` beside the log's own columns. Documents that an earlier run found are not
    found again; rows that break the table's constraints are kept apart as ``invalid``. A run that fails leaves its logs waiting.
    """
    spark = files.sparkSession
    marks = committed.read_committed(spark, root, "marks", LOG_MARK)
    earlier = committed.read_committed(spark, root, "findings", DOCUMENT_ROW)
    use_checkpoints(spark)
    batch = tracking.next_batch(tracking.unprocessed(files, marks, "file_path"), "modified_at", "file_path", batch_size).checkpoint()
    rows = events.join(batch.select("file_path"), "file_path", "left_semi")
    found = documents.find_documents(rows, feed, "surt_prefix", "target_id", job)
    new = found.join(earlier.select("document_url").distinct(), "document_url", "left_anti")
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENT_ROW]).checkpoint()
    broken = documents.invalid_documents(new)
    whole = documents.valid_documents(new)
    metrics = counters.record_count_metrics({"findings": whole, "invalid": broken, "logs": batch})
    outputs = {
        "findings": whole,
        "invalid": broken,
        "marks": batch.select("file_path", F.lit(job).alias("marked_for")),
        "metrics": metrics.select(*[F.col(f.name).cast(f.dataType) for f in METRIC_ROW]),
    }
    return committed.commit_run(outputs, root)


def process_documents(
    found: DataFrame, index: DataFrame, batch_size: int, base_url: str, accept: Column
) -> DataFrame:
    """The newest NEW documents with target, access URL and their next state; ``index`` tells what can be played back."""
    waiting = found.where(F.col("status") == documents.NEW)
    batch = filters.latest_rows(waiting, batch_size, "wayback_timestamp", "document_url")
    judged = documents.next_states(batch, index, ["document_url", "wayback_timestamp"], accept)
    return documents.with_access_url(judged, base_url)


def locate_documents(found: DataFrame, headers: DataFrame, feed: DataFrame) -> DataFrame:
    """Found documents with their landing page and target: the page that the response's ``rel=up`` link names, else the page found before.

    ``headers`` has (document_url, wayback_timestamp, link), one or more rows per capture. The target is that of the longest prefix over the landing page.
    """
    link = F.min(F.when(documents.landing_page("link", F.lit("")) != "", F.col("link"))).alias("_link")
    named = headers.groupBy("document_url", "wayback_timestamp").agg(link)
    rows = found.drop("target_id").join(named, ["document_url", "wayback_timestamp"], "left")
    rows = rows.withColumn("landing_page_url", documents.landing_page("_link", "landing_page_url")).drop("_link")
    keyed = rows.withColumn("_landing_key", surt_key("landing_page_url"))
    return documents.assign_targets(keyed, "_landing_key", feed, "surt_prefix", "target_id").drop("_landing_key", "matched_prefix")


# --- curated export --------------------------------------------------------------------------


def curated_outputs(targets: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """The seven exported outputs of the curated data, of every target; bad URLs are reported by the quality checks alone."""
    keyed = targets.withColumn("surt_prefix", surt_key("url"))
    entry = F.struct(F.col("target_id").alias("id"), "title", F.array("url").alias("seeds"), "frequency", "scope", "depth", "basis")

    def lines(feed: DataFrame) -> DataFrame:
        return feed.select(F.to_json(entry).alias("value"))

    never = curation.select_feed(keyed, now, frequency=curation.NEVER_CRAWL, include_hidden=True, include_expired=True)
    labels = keyed.select("surt_prefix", "collection_id").distinct()
    return {
        "feed_npld": lines(curation.select_feed(keyed, now, basis="npld", include_hidden=True)),
        "feed_bypm": lines(curation.select_feed(keyed, now, basis="bypm", include_hidden=True)),
        "never_crawl": exports.prefix_lines(never, "surt_prefix"),
        "allows": exports.access_lines(
            keyed.where("open_access").withColumn("access", F.lit("allow")), "surt_prefix", "access"
        ),
        "blocks": exports.access_lines(never.withColumn("access", F.lit("block")), "surt_prefix", "access"),
        "annotations": labels.select(F.to_json(F.struct("surt_prefix", "collection_id")).alias("value")),
        "collections": curation.collection_pages(
            keyed, "collection_id", "target_id", ["target_id", "title", "hidden"]
        ).select(F.to_json(F.struct("collection_id", "page", "members")).alias("value")),
    }


def export_curated(targets: DataFrame, now: datetime, root: str) -> DataFrame:
    """Write all outputs and publish them together; returns the manifest rows, whose counts are the job's metrics."""
    return publish.publish_all(curated_outputs(targets, now), root)


# --- transfers and reports -------------------------------------------------------------------


def verified_transfer(source: DataFrame, target: DataFrame, day: datetime, checksum: str = "checksum") -> DataFrame:
    """Files of the day's window with the result of comparing checksums; those that match may be removed from the source."""
    ready = filters.ready_to_move(source, "file_path", "modified_at", day)
    return tracking.compare_stores(ready, target, "file_path", checksum)


def storage_report(stores: dict[str, DataFrame]) -> DataFrame:
    """Files by how many copies and stores hold them."""
    held = tracking.reconcile(stores, "file_path")
    counts = [f"{s}_copies" for s in stores]
    return held.groupBy("copies", "stores", *[(F.col(c) > 0).alias(c.replace("_copies", "")) for c in counts]).agg(
        F.count(F.lit(1)).alias("files")
    )


def storage_holdings(stores: dict[str, DataFrame]) -> DataFrame:
    """Files and bytes by the stores that hold them and by upper folder (two levels), with totals; names are compared normalised.

    ``level`` 0 has one row per (held_by, folder), 1 per held_by, 2 all. A file whose listings disagree on its size
    counts once, with its largest size, and in ``size_differs`` too.
    """
    held = tracking.holders(stores, "file_path", "size").withColumn("folder", F.substring_index("name", "/", 2))
    return held.rollup("held_by", "folder").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if("size_differs").alias("size_differs"),
        (F.grouping("held_by") + F.grouping("folder")).cast("int").alias("level"),
    )


# --- take-down and complaints ----------------------------------------------------------------


@dataclass(frozen=True)
class TakeDown:
    deletions: DataFrame
    remaining: DataFrame
    profile: DataFrame


def take_down(captures: DataFrame, prefix_list: DataFrame, from_ts14: str) -> TakeDown:
    """Captures under the listed prefixes from a time on: the deletion list, what stays, and what the list looks like."""
    recent = captures.where(F.col("ts14") >= from_ts14)
    doomed = prefixes.covered(recent, "urlkey", prefix_list, "surt_prefix")
    return TakeDown(
        doomed,
        capture_ops.drop_listed(captures, doomed, ["urlkey", "ts14", "event_id"]),
        capture_ops.deletion_profile(doomed, ["content_digest", "mimetype", "status_code"], "ts", "urlkey"),
    )


def complaint_follow_up(events: DataFrame, path_pattern: str, start: datetime, end: datetime, since: datetime) -> DataFrame:
    """Hosts fetched in the stated time under the path, the exclusion line for each, and fetches after ``since``."""
    hosts = (
        filters.between_times(events, "ts", start, end).where(F.col("url").rlike(path_pattern)).groupBy("host").agg(
            F.count(F.lit(1)).alias("hits")
        )
    )
    later = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).groupBy("host").agg(
        F.count(F.lit(1)).alias("fetches_since")
    )
    return hosts.join(later, "host", "left").select(
        "host",
        "hits",
        F.concat(F.lit("+"), reversed_host("host"), F.lit(")")).alias("exclusion"),
        F.coalesce("fetches_since", F.lit(0)).alias("fetches_since"),
    )


def apply_exclusions(events: DataFrame, lines: DataFrame, line: str, since: datetime) -> DataFrame:
    """(host, fetches, still_in_scope) from a time on: what of each host's fetches the exclusion lines leave in scope."""
    shut = lines.select(prefix_line_key(F.col(line)).alias("surt_prefix"))
    later = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).withColumn("_key", surt_key("url"))
    judged = prefixes.flag_covered(later, "_key", shut, "surt_prefix", "_shut")
    return judged.groupBy("host").agg(F.count(F.lit(1)).alias("fetches"), F.count_if(~F.col("_shut")).alias("still_in_scope"))


# --- crawler tidy-up -------------------------------------------------------------------------


def archive_moves(files: DataFrame, launches: DataFrame, path: str, job: str, output_root: str) -> DataFrame:
    """Target path of each loose archive file: the folder of the launch that was running when it was written.

    A file without a target (no time in its name, or older than every launch) has a null path and the reason.

    ``launches`` has ``launch_id`` (14 digits). The file's time comes from its name. Launches are few and files many, so
    only the days of the files are laid on one time line with the launches: a day has the last launch before it and its own
    launches, and each file takes the last one up to its time. Files are neither sorted nor shuffled; the days, which the calendar bounds, are broadcast.
    """
    name = storage_paths.file_name(path)
    named = files.select(F.col(path), storage_paths.archive_ts17(name).alias("_ts17"))
    started = F.try_to_timestamp(F.left("_ts17", F.lit(14)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    timed = named.select(F.col(path), started.alias("_at")).withColumn("_day", F.to_date("_at"))
    launched = launches.where("launch_id is not null").select(
        "launch_id", F.try_to_timestamp("launch_id", F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("_at")
    ).distinct()
    # no test for a null day here: it would be pushed below the files' own shuffles, which could then not be shared by both readers
    days = timed.select("_day").distinct()
    line = days.select(
        F.lit(job).alias("_job"), F.col("_day").cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("launch_id")
    ).unionByName(launched.select(F.lit(job).alias("_job"), "_at", F.lit(1).alias("_kind"), "launch_id"))
    before = nearest_value(line, ["_job"], ["_at", "_kind", "launch_id"], F.col("launch_id"), "_before", bucket_seconds=86_400)
    of_day = launched.groupBy(F.to_date("_at").alias("_day")).agg(F.collect_list(F.struct("_at", "launch_id")).alias("_launches"))
    known = before.where("_kind = 0").select(F.to_date("_at").alias("_day"), "_before").join(of_day, "_day", "left")
    placed = timed.join(F.broadcast(known), "_day", "left")
    reached = F.array_max(F.filter("_launches", lambda launch: launch["_at"] <= F.col("_at")))["launch_id"]
    placed = placed.select(path, "_at", F.coalesce(reached, F.col("_before")).alias("_launch"))
    target = F.concat(F.lit(f"{output_root}/{job}/"), "_launch", F.lit("/warcs/"), storage_paths.file_name(path))
    return placed.select(
        path,
        F.when(F.col("_at").isNotNull(), target).alias("target_path"),
        F.when(F.col("_at").isNull(), "no time in the name").when(F.col("_launch").isNull(), "before the first launch").alias("reason"),
    )


def tidy_report(files: DataFrame, expected_jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log growth per expected job, missing checkpoint logs)."""
    return (
        tracking.log_growth(files, expected_jobs, "file_path", "size", "modified_at"),
        tracking.checkpoint_gaps(files, "file_path"),
    )


# --- activity --------------------------------------------------------------------------------


def activity_report(events: DataFrame, now: datetime | Column) -> DataFrame:
    return histograms.activity_summary(events, "ts", 2 * 3600, now, ["host", "status_code", "mimetype"], "size")


def job_result_metrics(runs: DataFrame) -> DataFrame:
    return counters.job_metrics(runs, "job", "status", "ts", "records")


# --- back-fill -------------------------------------------------------------------------------


def back_fill(spark: SparkSession, run: Callable[[date], DataFrame], first: date, last: date, folder: str) -> Sequence[date]:
    """Run a daily job for every day from ``first`` to ``last``; a day's rows replace what an earlier run left for it."""
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    for day in days:
        run(day).write.mode("overwrite").parquet(f"{folder}/day={day.isoformat()}")
    return days
