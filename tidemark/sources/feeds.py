"""Crawl feeds (JSON lines) and prefix lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.urls import prefix_line_key, surt_key

FEED_SCHEMA = (
    "id bigint, title string, seeds array<string>,"
    " schedules array<struct<frequency: string, start: timestamp_ntz, end: timestamp_ntz>>,"
    " scope string, depth string, ignore_robots boolean, watched boolean, basis string, hidden boolean"
)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed records; lines that do not parse are kept in ``_corrupt``."""
    return parse_feed(spark.read.text(path))


def parse_feed(lines: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.where(F.trim("value") != "").select(F.from_json("value", f"{FEED_SCHEMA}, _corrupt string", options).alias("_r")).select("_r.*")


def feed_seeds(feed: DataFrame) -> DataFrame:
    """One row per seed and schedule."""
    seeds = feed.where("_corrupt IS NULL").select("*", F.explode("seeds").alias("url")).drop("seeds")
    return (
        seeds.select("*", F.explode_outer("schedules").alias("_s"))
        .select(
            F.col("id").alias("target_id"), "title", "url", surt_key("url").alias("urlkey"),
            F.col("_s.frequency").alias("frequency"), F.col("_s.start").alias("start_date"), F.col("_s.end").alias("end_date"),
            "scope", "depth", "ignore_robots", "watched", "basis", "hidden",
        )
    )


def read_prefix_list(spark: SparkSession, path: str, decision: str) -> DataFrame:
    return parse_prefix_lines(spark.read.text(path), decision)


def parse_prefix_lines(lines: DataFrame, decision: str) -> DataFrame:
    """(surt_prefix, decision); blank lines and ``#`` comments are left out."""
    used = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return used.select(prefix_line_key("value").alias("surt_prefix"), F.lit(decision).alias("decision")).distinct()
