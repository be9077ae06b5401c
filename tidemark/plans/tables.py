"""The given tables and the derived inputs the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.times import bucket_start, to_ts14
from tidemark.functions.urls import host_key, surt_key, url_host
from tidemark.operators.filters import http_responses
from tidemark.plans.views import SHARED_TEXT, SUFFIX_RULES
from tidemark.session import use_utc

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy access by name: ``t.events`` reads parquet, ``t.crawl_log`` derives the crawl log from it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = use_utc(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in SHARED_TEXT:
            text = SHARED_TEXT[name]
            used = {table: getattr(self, table) for table in TABLE_NAMES if "{" + table + "}" in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)

    @property
    def captures(self) -> DataFrame:
        return http_responses(self.crawl_log).withColumns({"urlkey": surt_key("url"), "ts14": to_ts14("ts")})

    @property
    def page_record(self) -> DataFrame:
        return self.pages.withColumns(
            {
                "urlkey": surt_key("url"),
                "host": url_host("url"),
                "status_code": F.expr("CASE page_id % 10 WHEN 0 THEN 301 WHEN 1 THEN 404 ELSE 200 END"),
                "record_type": F.expr("CASE WHEN page_id % 7 = 0 THEN 'metadata' ELSE 'response' END"),
            }
        )

    @property
    def surt_prefixes(self) -> DataFrame:
        closed = host_key(url_host("url"))
        accept = self.pages.where("page_id % 3 = 0").select(closed.alias("surt_prefix"), F.lit("accept").alias("decision"))
        reject = self.pages.where("page_id % 5 = 0").select(
            F.concat(closed, F.lit("/en")).alias("surt_prefix"), F.lit("reject").alias("decision")
        )
        return accept.unionByName(reject).distinct()

    @property
    def suffix_rules(self) -> DataFrame:
        return self.spark.createDataFrame([(rule,) for rule in SUFFIX_RULES], "rule string")

    @property
    def scope_accept(self) -> DataFrame:
        return self.events.where("user_id % 20 < 15").selectExpr(
            "concat('uk,co,example,h', user_id % 20, ')') AS surt_prefix"
        ).distinct()

    @property
    def scope_exclude(self) -> DataFrame:
        return self.events.where("user_id % 2 = 0").selectExpr(
            "concat('uk,co,example,h', user_id % 20, ')/blog/') AS surt_prefix"
        ).distinct()

    @property
    def curated(self) -> DataFrame:
        return self.curated_base.withColumns(
            {
                "start_date": F.expr(
                    "CASE WHEN target_id % 17 = 0 THEN NULL ELSE TIMESTAMP_NTZ'2023-01-01 09:30:00'"
                    " + make_dt_interval(CAST(target_id % 300 AS INT), CAST(target_id % 5 AS INT)) END"
                ),
                "end_date": F.expr(
                    "CASE WHEN target_id % 9 = 0 THEN TIMESTAMP_NTZ'2023-12-31 00:00:00'"
                    " + make_dt_interval(CAST(target_id % 40 AS INT)) END"
                ),
            }
        )

    @property
    def counter_samples(self) -> DataFrame:
        hourly = self.events.groupBy(F.col("event_type").alias("kind"), bucket_start("ts", 3600).alias("ts")).count()
        in_day = Window.partitionBy("kind", F.to_date("ts")).orderBy("ts")
        return hourly.select("kind", "ts", F.sum("count").over(in_day).alias("value"))

    @property
    def offset_samples(self) -> DataFrame:
        hourly = self.events.groupBy((F.col("event_id") % 4).alias("part"), bucket_start("ts", 3600).alias("ts")).count()
        return hourly.select("part", "ts", F.sum("count").over(Window.partitionBy("part").orderBy("ts")).alias("value"))

    @property
    def ip_lists(self) -> DataFrame:
        return self.spark.createDataFrame(
            [
                (0, "Main", "192.0.2.0/28, 192.0.2.16/29, 198.51.100.7"),
                (1, "North", "192.0.2.64/26,192.0.2.32/31,192.0.2.34/32"),
                (2, "South", "192.0.2.128/25"),
                (3, "Annex", "192.0.2.200/30, 203.0.113.0/24"),
            ],
            "location_id int, location string, ips string",
        )
