"""Text inputs: lines are made from the tables, parsed by the readers and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import to_ts14
from tidemark.operators import tracking
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.views import ts14
from tidemark.session import shared_dir
from tidemark.sinks.exports import write_jsonl
from tidemark.sources import crawl_log, feeds, listings, tables, topics


def _log_lines(t: Tables):
    return t.crawl_log.select(
        F.concat_ws(
            " ",
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            F.lpad(F.col("status_code").cast("string"), 6, " "),
            F.lpad(F.col("size").cast("string"), 10, " "),
            "url",
            F.when(F.col("hop_path") == "", "-").otherwise(F.col("hop_path")),
            F.lit("-"),
            "mimetype",
            F.coalesce("thread", F.lit("-")),
            F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmssSSS"), F.lit("+"), (F.col("event_id") % 900).cast("string")),
            F.concat(F.lit("sha1:"), "content_digest"),
            F.concat(F.lit("http://"), "host", F.lit("/")),
            F.when(F.col("annotations") == "Q:serverMaxSuccessKb", "Q:serverMaxSuccessKb,ip:192.0.2.1").otherwise("-"),
            F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"contentSize": '), "size", F.lit(', "scopeDecision": "ACCEPT by rule 2"}'))).otherwise("-"),
        ).alias("value")
    ).unionByName(t.crawl_log.where("event_id % 100 = 0").select(F.concat(F.lit("not a log line "), "event_id").alias("value")))


@query(
    "crawl_log_lines",
    "S1 F5 F6 F7",
    """
    SELECT date_trunc('milliseconds', ts) AS "timestamp", url, host, CAST(status_code AS BIGINT) AS status_code, size, hop_path, thread, mimetype,
      'sha1:' || content_digest AS content_digest, date_trunc('milliseconds', ts) AS start_time, CAST(event_id % 900 AS BIGINT) AS duration,
      CASE WHEN annotations = 'Q:serverMaxSuccessKb' THEN 'Q:serverMaxSuccessKb|ip:192.0.2.1' ELSE '' END AS annotations,
      CASE WHEN event_id % 2 = 0 THEN size END AS content_length, CASE WHEN event_id % 2 = 0 THEN 'ACCEPT by rule 2' END AS scope_decision, CAST(NULL AS VARCHAR) AS corrupt
    FROM crawl_log
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not a log line ' || event_id FROM crawl_log WHERE event_id % 100 = 0
    """,
)
def crawl_log_lines(t: Tables):
    parsed = crawl_log.parse_lines(_log_lines(t), "frequent")
    return parsed.select(
        "timestamp", "url", "host", "status_code", "size", "hop_path", "thread", "mimetype", "content_digest",
        "start_time", "duration", F.when(F.col("_corrupt").isNull(), F.array_join("annotations", "|")).alias("annotations"),
        "content_length", F.col("extra_info")["scopeDecision"].alias("scope_decision"), F.col("_corrupt").alias("corrupt"),
    )


@query(
    "topic_messages",
    "S2 S3 K4",
    """
    SELECT 'uk,co,example,h' || (user_id % 20) AS key, event_id, ts, CAST(CASE WHEN event_type = 'click' THEN 301 END AS BIGINT) AS status_code FROM events
    """,
)
def topic_messages(t: Tables):
    """Publish as keyed JSON messages and parse them back."""
    log = t.crawl_log.withColumn("status_code", F.expr("CASE WHEN status_code = 301 THEN 301L END"))
    sent = topics.authority_messages(log, "url", ["event_id", "ts", "status_code"])
    schema = T.StructType.fromDDL("event_id bigint, ts timestamp_ntz, status_code bigint")
    return topics.parse_messages(sent, schema).where("_corrupt IS NULL").drop("_corrupt")


@query(
    "file_listing",
    "S5 F22 F9",
    """
    SELECT file_path, size, modified_at, 'access' AS owner, split_part(file_path, '/', 4) AS job, CAST(3 AS INTEGER) AS replication, NULL AS _corrupt FROM tracked_file
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'lsr: error in ' || r_name FROM region
    """,
)
def file_listing(t: Tables):
    stamp = F.date_format(F.col("modified_at").cast("timestamp"), "yyyy-MM-dd HH:mm")
    files = t.tracked_file.select(
        F.concat(F.lit("-rw-r--r--   3 access supergroup "), F.lpad(F.col("size").cast("string"), 12, " "), F.lit(" "), stamp, F.lit(" "), "file_path").alias("value")
    )
    folders = t.tracked_file.select(
        F.concat(F.lit("drwxr-xr-x   - access supergroup            0 "), stamp, F.lit(" "), F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)).alias("value")
    ).distinct()
    broken = t.region.select(F.concat(F.lit("lsr: error in "), "r_name").alias("value"))
    listed = listings.parse_listing(files.unionByName(folders).unionByName(broken))
    return tracking.parse_paths(listed).select("file_path", "size", "modified_at", "owner", "job", "replication", "_corrupt")


@query(
    "capture_index_lines",
    "S6 F13",
    f"""
    SELECT urlkey, ts14, url, CASE WHEN event_id % 5 <> 0 THEN mimetype END AS mime, CAST(status_code AS BIGINT) AS status, content_digest AS digest, size AS length,
      event_id AS "offset", CAST(NULL AS VARCHAR) AS redirect, NULL AS _corrupt FROM captures
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'cut off ' || r_name FROM region
    """,
)
def capture_index_lines(t: Tables):
    rows = t.captures.select(
        "urlkey", "ts14", "url", F.expr("CASE WHEN event_id % 5 <> 0 THEN mimetype END AS mime"), F.col("status_code").alias("status"),
        F.col("content_digest").alias("digest"), F.lit(None).cast("string").alias("redirect"), F.lit(None).cast("string").alias("meta"),
        F.col("size").alias("length"), F.col("event_id").alias("offset"), F.lit("/output/a.warc.gz").alias("filename"),
    )
    header = t.crawl_log.limit(1).select(F.lit(" CDX N b a m s k r M S V g").alias("value"))
    broken = t.region.select(F.concat(F.lit("cut off "), "r_name").alias("value"))
    back = listings.parse_index_lines(listings.index_lines(rows).unionByName(header).unionByName(broken))
    return back.select("urlkey", "ts14", "url", "mime", "status", "digest", "length", "offset", "redirect", "_corrupt")


@query(
    "feed_records",
    "S4",
    """
    SELECT target_id, url, frequency, start_date, basis, hidden FROM curated
    """,
)
def feed_records(t: Tables):
    entry = F.struct(
        F.col("target_id").alias("id"), "title", F.array("url").alias("seeds"),
        F.array(F.struct("frequency", F.col("start_date").alias("start"), F.col("end_date").alias("end"))).alias("schedules"),
        "scope", "depth", "ignore_robots", "watched", "basis", "hidden",
    )
    lines = t.curated.select(F.to_json(entry).alias("value")).unionByName(
        t.curated.where("target_id % 50 = 0").select(F.concat(F.lit('{"id": broken '), "target_id").alias("value"))
    )
    return feeds.feed_seeds(feeds.parse_feed(lines)).select("target_id", "url", "frequency", "start_date", "basis", "hidden")


@query(
    "prefix_list_lines",
    "S12 P22",
    """
    SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'uk,co,example,site' || c_custkey || ')/x/' WHEN 1 THEN 'uk,co,example,site' || c_custkey
      ELSE 'uk,co,example,site' || c_custkey || ')/docs/a?b=1' END AS surt_prefix, 'reject' AS decision FROM customer
    """,
)
def prefix_list_lines(t: Tables):
    lines = t.customer.selectExpr(
        """CASE c_custkey % 3 WHEN 0 THEN concat('+http://(uk,co,example,site', c_custkey, ')/x/')
           WHEN 1 THEN concat(' www.Site', c_custkey, '.example.co.uk') ELSE concat('https://site', c_custkey, '.example.co.uk/docs/a?b=1') END AS value"""
    ).unionByName(t.customer.selectExpr("concat('# ', c_name) AS value"))
    return feeds.parse_prefix_lines(lines, "reject")


@query(
    "curated_dump",
    "S7",
    "SELECT target_id, title || chr(10) || 'second \"line\"' AS title, url, basis FROM curated_base",
)
def curated_dump(t: Tables):
    folder = shared_dir(t.spark, "curated-csv")
    rows = t.curated_base.select("target_id", F.concat("title", F.lit('\nsecond "line"')).alias("title"), "url", "basis")
    rows.write.csv(folder, header=True, escape='"')
    return tables.read_curated_csv(t.spark, folder, "target_id bigint, title string, url string, basis string")


@query(
    "object_listing",
    "S10",
    "SELECT substr(file_path, 2) AS key, size, modified_at AS last_modified, 'GLACIER' AS storage_class FROM tracked_file WHERE size % 10 <> 0",
)
def object_listing(t: Tables):
    folder = shared_dir(t.spark, "objects")
    rows = t.tracked_file.where("size % 10 <> 0").select(
        F.expr("substring(file_path, 2) AS key"), "size", F.col("modified_at").alias("last_modified"), F.lit("GLACIER").alias("storage_class")
    )
    write_jsonl(rows, folder)
    return listings.read_objects(t.spark, folder)


@query(
    "newest_domain_list",
    "S12",
    "SELECT 'site' || c_custkey || '.example.co.uk' AS domain, '2024-02' AS month FROM customer WHERE c_custkey % 2 = 0",
)
def newest_domain_list(t: Tables):
    folder = shared_dir(t.spark, "domains")
    names = t.customer.selectExpr("c_custkey", "concat('site', c_custkey, '.example.co.uk') AS value")
    names.where("c_custkey % 2 = 1").select("value").write.text(f"{folder}/2024-01")
    names.where("c_custkey % 2 = 0").select("value").write.text(f"{folder}/2024-02")
    lines = t.spark.read.schema("domain string").csv([f"{folder}/2024-01", f"{folder}/2024-02"]).withColumn(
        "month", F.regexp_extract(F.input_file_name(), r"domains-[^/]*/([0-9]{4}-[0-9]{2})/", 1)
    )
    return tables.newest_month(lines, "month")


@query(
    "event_identity",
    "K5 S14",
    f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z:' || url AS id, {ts14('ts')} AS ts14 FROM crawl_log",
)
def event_identity(t: Tables):
    return t.crawl_log.select("event_id", crawl_log.event_id("ts", "url").alias("id"), to_ts14("ts").alias("ts14"))
