"""Curated crawl targets: feed selection, options, taxonomy, quality checks, launches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schedules import is_due
from tidemark.functions.urls import surt_key, url_host
from tidemark.operators.ordered import running_total
from tidemark.operators.prefixes import covered, not_covered
from tidemark.operators.suffixes import suffixes_of
from tidemark.session import use_checkpoints

# Document review states by code.
DOCUMENT_STATUS = ((0, "New"), (1, "Saved"), (2, "Submitted"), (3, "Ignored"), (4, "Deleted"))
NEVER_CRAWL = "NEVERCRAWL"


def status_names(spark, names: Sequence[tuple[int, str]] = DOCUMENT_STATUS) -> DataFrame:
    return spark.createDataFrame(list(names), "code int, status_name string")


def select_feed(
    targets: DataFrame,
    now: datetime,
    basis: str | None = None,
    frequency: str | None = None,
    include_hidden: bool = False,
    include_expired: bool = False,
) -> DataFrame:
    """Targets of one crawl feed. ``frequency`` None means every crawled target (never-crawl ones left out)."""
    out = targets
    if basis is not None:
        out = out.where(F.col("basis") == basis)
    out = out.where(F.col("frequency") == frequency) if frequency else out.where(F.col("frequency") != NEVER_CRAWL)
    if not include_hidden:
        out = out.where(~F.col("hidden"))
    if not include_expired:
        out = out.where(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(now).cast("timestamp_ntz")))
    return out


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """Feeds under one roof, each row tagged with its legal basis."""
    out = None
    for basis, df in feeds.items():
        tagged = df.withColumn("basis", F.lit(basis))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def union_collections(collections: dict[str, DataFrame]) -> DataFrame:
    """One logical collection over several physical ones; missing columns are null."""
    out = None
    for name, df in collections.items():
        tagged = df.withColumn("collection", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def option_sheets(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the option sheets whose condition holds, in the stated order."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda s: s.isNotNull())


def launches(
    feed: DataFrame, hour: datetime, never_crawl: DataFrame, prefix: str, sheets: Sequence[tuple[str, Column]] = ()
) -> DataFrame:
    """Launch messages of one hour: due targets outside the never-crawl list, keyed by URL and launch time.

    Running an hour again gives the same messages.
    """
    at = F.lit(hour).cast("timestamp_ntz")
    due = feed.where(is_due("frequency", "start_date", "end_date", at)).withColumn("urlkey", surt_key("url"))
    return not_covered(due, "urlkey", never_crawl, prefix).select(
        "url",
        "urlkey",
        "target_id",
        at.alias("launch_ts"),
        F.array_join(option_sheets(sheets), ",").alias("sheets") if sheets else F.lit("").alias("sheets"),
        F.concat(F.date_format(at.cast("timestamp"), "yyyyMMddHHmmss"), F.lit(":"), F.col("url")).alias("message_key"),
    )


def feed_violations(feed: DataFrame, never_crawl: DataFrame, key: str, prefix: str) -> DataFrame:
    """Feed rows that the never-crawl list covers; there should be none."""
    return covered(feed, key, never_crawl, prefix)


def assemble_seeds(sources: Sequence[tuple[str, DataFrame]], url: str) -> DataFrame:
    """Distinct seeds over ranked sources: per key the first source wins, then the least URL."""
    union = None
    for rank, (name, df) in enumerate(sources):
        rows = df.select(F.col(url).alias("url"), F.lit(name).alias("source"), F.lit(rank).alias("_rank"))
        union = rows if union is None else union.unionByName(rows)
    keyed = union.withColumn("urlkey", surt_key("url"))
    return (
        keyed.groupBy("urlkey")
        .agg(F.min_by(F.struct("url", "source"), F.struct("_rank", "url")).alias("_s"))
        .select("urlkey", "_s.url", "_s.source")
    )


def scope_list(seeds: DataFrame, key: str) -> DataFrame:
    """Host-level scope prefixes of a seed list."""
    return seeds.select(F.concat(F.substring_index(key, ")", 1), F.lit(")")).alias("surt_prefix")).distinct()


def taxonomy_ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) for every node; depth 0 is the node itself, the least depth counts.

    One equality join per level, checkpointed, until a level brings no new (node, ancestor) pair; so a hierarchy of any depth is
    followed, and a loop in it ends by itself.
    """
    use_checkpoints(edges.sparkSession)
    links = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("parent IS NOT NULL").distinct().checkpoint()
    # every edge's child is a node, also one without a parent
    nodes = edges.select(F.col(child).alias("node")).union(links.select("parent")).distinct()
    level = nodes.select("node", F.col("node").alias("ancestor")).checkpoint()
    found, depth = level.withColumn("depth", F.lit(0)), 0
    while True:
        depth += 1
        higher = level.join(links, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()
        level = higher.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").checkpoint()
        if level.isEmpty():
            return found
        found = found.unionByName(level.withColumn("depth", F.lit(depth))).checkpoint()


# Our rules; the tool that holds the original ones is not public.
URL_SYNTAX = r"^https?://[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+(:[0-9]+)?([/?#].*)?$"


def quality_problems(targets: DataFrame, url: str, record_id: str, suffix_rules: DataFrame, rule: str) -> DataFrame:
    """(record_id, rule): ``bad_url``, ``unknown_suffix``, ``duplicate_url``, ``no_start_date``.

    A suffix is known if a public-suffix rule matches the host. Suffixes and duplicates are looked up by join; a URL that
    many records share is counted first.
    """
    keyed = targets.withColumns({"_key": surt_key(url), "_host": F.coalesce(url_host(url), F.lit(""))})
    repeated = keyed.groupBy("_key").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    known = suffixes_of(keyed, "_host", suffix_rules, rule).where("listed").select("_host", F.lit(True).alias("_known"))
    checked = keyed.join(repeated, "_key", "left").join(known, "_host", "left")
    valid = F.coalesce(F.col(url).rlike(URL_SYNTAX), F.lit(False))
    rules = F.array(
        F.when(~valid, F.lit("bad_url")),
        F.when(valid & F.col("_known").isNull(), F.lit("unknown_suffix")),
        F.when(F.col("_repeated"), F.lit("duplicate_url")),
        F.when(F.col("start_date").isNull(), F.lit("no_start_date")),
    )
    return checked.select(record_id, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def quality_summary(problems: DataFrame) -> DataFrame:
    return problems.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def collection_pages(members: DataFrame, collection: str, order: str, columns: Sequence[str], page_size: int = 1000) -> DataFrame:
    """Members of each collection as JSON arrays of at most ``page_size`` entries, in ``order`` (an integer id).

    Pages are cut by id range blocks first, so a collection of any size never meets in one task: page
    number = rank of the member by id, computed as a running total over id blocks.
    """
    at = members.withColumn("_t", F.timestamp_seconds(F.col(order)).cast("timestamp_ntz"))
    ranked = running_total(at, [collection], ["_t"], F.lit(1), "_no", bucket_seconds=100_000).drop("_t")
    return (
        ranked.withColumn("page", F.floor(F.col("_no") / page_size).cast("bigint"))
        .groupBy(collection, "page")
        .agg(
            F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))),
                                  lambda m: F.struct(*[m[c].alias(c) for c in columns]))).alias("members"),
            F.count(F.lit(1)).alias("n"),
        )
    )
