"""Finding documents in the crawl log and following them to acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import to_ts14
from tidemark.functions.urls import access_url, document_filename, surt_key
from tidemark.operators.prefixes import covered, longest_prefix

# The content type looked for, review states, the link header form.
DOCUMENT_TYPE = r"^application/pdf.*"
NEW, ACCEPTED, REJECTED = "NEW", "ACCEPTED", "REJECTED"
REL_UP = r"<([^>]+)>;\s*rel=\"?up\"?"

NOT_NULL_COLUMNS = (
    "document_url", "filename", "landing_page_url", "source", "wayback_timestamp", "job_name", "size", "status",
)


def watched_documents(events: DataFrame, key: str, content_type: str, watched: DataFrame, prefix: str) -> DataFrame:
    """Events that are documents of a watched target: right content type and under a watched prefix."""
    # the cheap test first, so that only documents are matched against prefixes
    return covered(events.where(F.col(content_type).rlike(DOCUMENT_TYPE)), key, watched, prefix)


def landing_page(link_header: Column | str, via: Column | str) -> Column:
    """Target of a ``rel=up`` link header, else the referring page."""
    header = F.col(link_header) if isinstance(link_header, str) else link_header
    up = F.regexp_extract(F.coalesce(header, F.lit("")), REL_UP, 1)
    return F.when(up != "", up).otherwise(F.col(via) if isinstance(via, str) else via)


def assign_targets(documents: DataFrame, landing_key: str, feed: DataFrame, prefix: str, target_id: str) -> DataFrame:
    """Each document with the target of the longest prefix over its landing page; the lowest id on a tie."""
    return longest_prefix(
        documents, landing_key, feed.select(prefix, target_id), prefix, tie_break=[-F.col(target_id)]
    ).withColumnRenamed(prefix, "matched_prefix")


def find_documents(
    events: DataFrame, feed: DataFrame, prefix: str, target_id: str, job: str,
    url: str = "url", ts: str = "ts", row_id: str = "event_id", content_type: str = "mimetype", size: str = "size",
    landing: str = "landing_page_url", source: str = "source",
) -> DataFrame:
    """Documents-found rows (status NEW), one per URL: its earliest capture."""
    keyed = events.withColumn("_key", surt_key(url))
    found = watched_documents(keyed, "_key", content_type, feed, prefix)
    one = found.groupBy(F.col(url).alias("document_url")).agg(
        F.min_by(F.struct(ts, row_id, size, landing, source), F.struct(ts, row_id)).alias("_d")
    )
    rows = one.select(
        "document_url",
        document_filename("document_url").alias("filename"),
        F.col("_d")[landing].alias("landing_page_url"),
        F.col("_d")[source].alias("source"),
        to_ts14(F.col("_d")[ts]).alias("wayback_timestamp"),
        F.lit(job).alias("job_name"),
        F.col("_d")[size].alias("size"),
        F.lit(NEW).alias("status"),
    ).withColumn("_landing_key", surt_key("landing_page_url"))
    return assign_targets(rows, "_landing_key", feed, prefix, target_id).drop("_landing_key", "matched_prefix")


def _breaks_constraints(documents: DataFrame) -> Column:
    broken = F.lit(False)
    for column in NOT_NULL_COLUMNS:
        if column in documents.columns:
            broken = broken | F.col(column).isNull()
    return broken


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Rows that break the table's constraints: a required column is null."""
    return documents.where(_breaks_constraints(documents))


def valid_documents(documents: DataFrame) -> DataFrame:
    return documents.where(~_breaks_constraints(documents))


def present_in_index(documents: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Documents whose capture is in the index."""
    return documents.join(index.select(*keys).distinct(), keys, "left_semi")


def next_states(documents: DataFrame, index: DataFrame, keys: list[str], accept: Column) -> DataFrame:
    """NEW documents that can be played back become ACCEPTED or REJECTED; the rest keep their state for a later run."""
    seen = index.select(*keys).distinct().withColumn("_indexed", F.lit(True))
    state = (
        F.when(F.col("status") != NEW, F.col("status"))
        .when(F.col("_indexed").isNull(), F.lit(NEW))
        .when(accept, F.lit(ACCEPTED))
        .otherwise(F.lit(REJECTED))
    )
    return documents.join(seen, keys, "left").withColumn("status", state).drop("_indexed")


def with_access_url(documents: DataFrame, base: str) -> DataFrame:
    return documents.withColumn("access_url", access_url(base, "wayback_timestamp", "document_url"))


def presence_audit(wanted: DataFrame, stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """For each wanted URL key, in which stages it occurs, and the first stage that lacks it (``none`` when all have it)."""
    out = wanted
    for name, df in stages:
        mark = df.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(mark, key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    gap = F.coalesce(*[F.when(~F.col(f"in_{name}"), F.lit(name)) for name, _ in stages], F.lit("none"))
    return out.withColumn("first_gap", gap)
